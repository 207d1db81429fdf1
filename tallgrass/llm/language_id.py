"""Operator 6: language identification by the nearest of several centroids per language.

A text becomes a vector of its letter n-grams of one to three characters (lower case; any
run of other characters is one word break), hashed into DIMENSIONS places and weighted by
(1 + log count) * idf, at length 1.  The vectors of each language's training documents are
clustered by spherical k-means; a text gets the language of the centroid of the highest
cosine.  It is rejected where it lies beyond that centroid's reach.  Short texts lie further
off than long ones, so each centroid has a reach for each BAND of lengths: MARGIN of the
quantile OUTLIERS of the cosines that training texts, and excerpts of their middle with such
a length, have with it.  A centroid with fewer than ENOUGH of these takes its language's.

The model is fitted on at most about TRAIN_ROWS labelled documents, in equal shares per
language, chosen by a hash of doc_id and text; this bound is a parameter.  Prediction reads the
whole of each text and nothing else.

Cases: null texts, empty texts and texts without a letter get `und`, score 0, and are
rejected; very long texts are read whole; of equal cosines the language first in
alphabetical order wins; repeated rows each get a prediction; rows of null doc_id are not
held out; without any labelled row all texts get `und`; rows of null lang are never trained
on; further columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

DIMENSIONS = 1 << 13
CLUSTERS = 4
ROUNDS = 12
TRAIN_ROWS = 2_400
#: Reach: lengths are told apart by the power of two of their n-grams, up to the last band.
BANDS = 13
OUTLIERS = 0.01
MARGIN = 0.7
ENOUGH = 30
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool)


def grams(text: str) -> np.ndarray | None:
    """Counts by place, or None if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of a run of other characters the first stays, as a word break
    codes = np.concatenate([[0], np.where(letter, codes, 0)[kept], [0]]).astype(np.uint64)
    one = codes * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[1:] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (two[:-1] ^ (one[2:] >> np.uint64(11))) * np.uint64(0x165667B19E3779F9)
    places = np.concatenate([one[codes > 0], two, three]) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)
    return np.bincount(places.astype(np.int64), minlength=DIMENSIONS)


def band_of(counts: np.ndarray) -> int:
    return min(BANDS - 1, int(counts.sum()).bit_length() - 1)


def _excerpts(text: str) -> list[np.ndarray]:
    """Counts of the text and of excerpts of its middle, one for each shorter band."""
    found, whole, size = [grams(text)], len(text), 1
    while 2 * size < whole and len(found) < BANDS:
        part = grams(text[(whole - size) // 2 : (whole + size) // 2])
        if part is not None:
            found.append(part)
        size *= 2
    return found


def _weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    found = np.zeros(DIMENSIONS, np.float32)
    (at,) = np.nonzero(counts)
    found[at] = (1 + np.log(counts[at])) * idf[at]
    return found / max(float(np.linalg.norm(found)), 1e-12)


@dataclass
class Model:
    """Centroids at length 1, their languages, the idf, and the least cosine accepted by centroid and band."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text is rejected."""
        counts = grams(text) if text else None
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ _weights(counts, self.idf)
        best = int(np.argmax(cosines))
        score = min(1.0, max(0.0, float(cosines[best])))
        return self.languages[best], score, score < self.least[best, band_of(counts)]


def _clusters(vectors: np.ndarray) -> np.ndarray:
    """Spherical k-means; the first centroids are those furthest from the ones before."""
    centroids = vectors.mean(axis=0, keepdims=True)
    for _ in range(min(CLUSTERS, len(vectors)) - 1):
        near = (vectors @ centroids.T).max(axis=1)
        order = np.argsort(near, kind="stable")
        centroids = np.vstack([centroids, vectors[order[len(order) // 10]]])  # not an outlier itself
    for _ in range(ROUNDS):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        after = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
        if np.allclose(after, centroids, atol=1e-5):
            break
        centroids = after
    return centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on a sample of `docs` (doc_id, text, lang) of about `train_rows` rows at most."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(DIMENSIONS, np.float32), np.zeros((0, BANDS)))
    each = max(20, train_rows // len(counts))
    slots = 1 << 30
    chance = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(slots, slots * each // n))])
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)) < F.element_at(chance, F.col("lang"))

    kind = pa.struct([("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def sparse(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts:
            dense = grams(text.as_py())
            (at,) = np.nonzero(dense if dense is not None else np.zeros(1))
            found.append({"at": at.astype(np.int32), "n": (dense[at] if len(at) else at).astype(np.int32)})
        return pa.array(found, kind)

    sparse = F.arrow_udf("struct<at:array<int>,n:array<int>>")(sparse)
    # rows that repeat are chosen together, and are one here: so the hash bounds their number
    sample = cut(labelled.where(chosen).select("doc_id", "lang", "text").distinct())
    # as arrays, as Python's lists of so many numbers would stay with the driver
    found = sample.select("doc_id", "lang", sparse("text").alias("x")).select("doc_id", "lang", "x.at", "x.n").toArrow().combine_chunks()
    rows = [
        (lang, doc_id or 0, at.values.to_numpy(), n.values.to_numpy())
        for lang, doc_id, at, n in zip(found["lang"].to_pylist(), found["doc_id"].to_pylist(), found["at"], found["n"])
        if len(at.values)
    ]
    rows.sort(key=lambda r: (*r[:2], r[2].astype(">i4").tobytes()))
    seen = np.zeros(DIMENSIONS)
    for _, _, at, _ in rows:
        seen[at] += 1
    idf = (np.log((len(rows) + 1) / (seen + 1)) + 1).astype(np.float32)
    languages, centroids = [], []
    for lang in sorted({r[0] for r in rows}):
        vectors = np.zeros((0, DIMENSIONS), np.float32)
        own = [r[2:] for r in rows if r[0] == lang]
        vectors = np.zeros((len(own), DIMENSIONS), np.float32)
        for v, (at, n) in zip(vectors, own):
            v[at] = (1 + np.log(n)) * idf[at]
            v /= np.linalg.norm(v)
        found = _clusters(vectors)
        languages += [lang] * len(found)
        centroids.append(found)
    centroids = np.vstack(centroids)
    return Model(languages, centroids, idf, _reach(sample, languages, centroids, idf))


def _reach(sample: DataFrame, languages: list[str], centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The least cosine accepted, by centroid and band, from a sample (lang, text)."""
    own = {lang: [k for k, other in enumerate(languages) if other == lang] for lang in languages}

    @F.arrow_udf("array<struct<k:int,band:int,cosine:double>>")
    def measured(langs: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for lang, text in zip(langs.to_pylist(), texts.to_pylist()):
            near = []
            for counts in _excerpts(text) if lang in own else []:
                if counts is not None:
                    cosines = centroids[own[lang]] @ _weights(counts, idf)
                    near.append({"k": own[lang][int(np.argmax(cosines))], "band": band_of(counts), "cosine": float(cosines.max())})
            out.append(near)
        return pa.array(out, pa.list_(pa.struct([("k", pa.int32()), ("band", pa.int32()), ("cosine", pa.float64())])))

    found = sample.select(F.inline(measured("lang", "text"))).toArrow()  # at most BANDS for each row of the sample
    k, band, cosine = (found[c].to_numpy() for c in ("k", "band", "cosine"))
    least = np.zeros((len(languages), BANDS))
    for i, lang in enumerate(languages):
        low = 0.0
        for b in range(BANDS):
            alike = cosine[(k == i) & (band == b)]
            if len(alike) < ENOUGH:
                alike = cosine[np.isin(k, own[lang]) & (band == b)]
            if len(alike) >= ENOUGH:  # else as one band below
                low = MARGIN * float(np.quantile(alike, OUTLIERS))
            least[i, b] = low
    return least


def predict(text: Column, model: Model, spark) -> Column:
    """struct(lang_pred, score, rejected) of each whole text."""
    sent = spark.sparkContext.broadcast(model)  # CLUSTERS * DIMENSIONS floats a language

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def told(texts: pa.Array) -> pa.Array:
        own = sent.value
        langs, scores, rejected = [], [], []
        for text in texts:
            lang, score, no = own.predict(text.as_py())
            langs.append(lang)
            scores.append(score)
            rejected.append(no)
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            ["lang_pred", "score", "rejected"],
        )

    return told(text)


def held_out() -> Column:
    """The documents that are never trained on: crc32 of doc_id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row for each row of `docs`."""
    model = fit(docs.where(~held_out()), train_rows)
    told = predict(F.col("text"), model, docs.sparkSession).alias("told")
    return docs.select("doc_id", held_out().alias("held_out"), told).select("doc_id", "held_out", "told.*")
