"""Sessions over a stream that stops and goes on, against the batch form and a plain walk."""

import random

from tallgrass.streaming import sessions

SHAPE = "conversation long, turn long, role string, content string"


def walked(rows, most, stop):
    out = {}
    for c in {r[0] for r in rows if r[0] is not None}:
        turns = {t: (role, text) for k, t, role, text in rows if k == c}
        at = questions = 0
        while at in turns:
            role, text = turns[at]
            questions += role == "user"
            if questions > most:
                break
            ends = stop in (text or "") or (questions >= most and role == "assistant")
            out[c, at] = (role, text, questions, ends)
            if ends:
                break
            at += 1
    return out


def told(df):
    rows = df.collect()
    out = {(r["conversation"], r["turn"]): (r["role"], r["content"], r["questions"], r["ends"]) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(25):
        size = rnd.randint(1, 12)
        gap = rnd.randrange(size) if rnd.random() < 0.2 else -1
        for t in range(size):
            text = rnd.choice(["hello", "more", None, "please TERMINATE now"] if rnd.random() < 0.2 else ["hello", "more"])
            if t != gap:
                rows.append((c, t, rnd.choice(["user", "assistant", "assistant", None]), text))
    return rows


def test_batch_equals_the_walk(spark):
    rows = conversations(1) + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, SHAPE)
    assert told(sessions.batch_sessions(df, 3)) == walked(rows, 3, sessions.STOP)
    assert sessions.batch_sessions(df.where("turn > 99")).count() == 0


def test_a_stream_that_stops_and_goes_on_equals_the_batch(spark, tmp_path):
    """Turns come in four parts, shuffled and some of them twice; the query ends after each part and starts anew."""
    rows = conversations(2)
    rnd = random.Random(7)
    late = rows[:]
    rnd.shuffle(late)
    parts = [late[i::4] for i in range(4)]
    parts[2] += rnd.sample(parts[0], 10)  # sent again
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.createDataFrame([], SHAPE).coalesce(1).write.parquet(source)
    for part in parts:
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SHAPE).parquet(source)
        query = sessions.serve_sessions(stream, out, checkpoint, 3)
        query.awaitTermination()
    want = walked(rows, 3, sessions.STOP)
    assert told(spark.read.parquet(out)) == want
    assert told(sessions.batch_sessions(spark.createDataFrame(rows, SHAPE), 3)) == want
