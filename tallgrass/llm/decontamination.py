"""Operator 8: benchmark decontamination by templates.

Both texts and benchmark items are turned into typed tokens: numbers, also spelled English
ones, become <num>, unit words after a number <unit>, names (capitalised words that don't open a sentence, joined
when adjacent) <name>; all else is a word in lower case.  Windows of five tokens are hashed
and joined with those of the benchmark by hash.  Windows of placeholders only say nothing
and are left out.

Matched windows of a document and an item are read along diagonals (position in the
document minus position in the item).  On each diagonal the slots must be filled
consistently: each value that fills slots in the item has one value in the document; windows
with a value that has several there don't count.  So a question with other numbers or names
is caught, while text that only looks alike is not.
A document holds an item if consistent diagonals cover 0.8 or more of the item's windows.

A text need not be cut into windows if it has none of a few words without which no item can
be covered; that test is exact.  Documents and items are read in three forms, with names as slots,
with names as words, and with the capitalised words that open sentences as names too, and held
against each other form by form: a name is not always written as one, as in capitals, and one may
open a sentence.  Other names that are written in lower case are not told from words.  Within a sentence the first word of an item
may be part of a name, or a unit after a number; so items are also indexed as they read there,
and the document must have that word in its place.  Items of fewer than five tokens are one window of all of them;
documents are cut into windows of each length that an item has.

Cases: null or empty texts and items match nothing; very long texts are read whole; an item
that occurs several times is judged by all its diagonals; of repeated rows each doc_id is
told once per item; rows of equal item_id are one item only if their texts are equal; an
empty table on either side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW = 5
COVER = 0.8
#: Window hashes of a benchmark that scans may hold as a sorted array; 8 bytes each.
HELD_HASHES = 1_000_000

#: Unit words that count as a unit right after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi g kg mg lb oz t l ml s sec min h hr ms day days week weeks month months year years hour hours minute minutes"
    " second seconds meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters"
    " litre litres mile miles foot feet inch inches pound pounds ounce ounces dollar dollars euro euros cent cents percent % $ € £".split()
)
#: Spelled numbers.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
    " twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
#: English words that open sentences and are no names.
FUNCTION_WORDS = frozenset(
    "a about after all although an and any are as at be because before but by can consider could did do does during each either every"
    " few find for from give given had has have he her here his how however if in into is it its let many may might more most much must"
    " my near no not now of on once one or other our over she should since so some such suppose than that the their them then there"
    " these they this those though through thus to under until up upon was we were what when where whether which while who whom whose"
    " why will with within without would yes yet you your".split()
)
#: Forms in which a text is read.
AS_WORDS, AS_NAMES, OPENERS_TOO = range(3)
_SYMBOLS = "%$€£"
_TOKENS = re.compile(rf"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n{_SYMBOLS}]").findall
#: The same for texts of the first Unicode blocks only, whose letters and digits are named one by one.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_LATIN_TOKENS = re.compile(rf"[{_LETTERS}\xb2\xb3\xb9\xbc-\xbe]+|[0-9]+(?:[.,][0-9]+)*|[.!?\n{_SYMBOLS}]").findall
_BEYOND_LATIN = re.compile(f"[^\0-\u024f{_SYMBOLS}]").search
#: Classes of raw tokens, held in the low bits of their hashes.
_END, _NUMBER, _SYMBOL, _WORD, _UNIT, _CAPITAL, _CAPITAL_UNIT, _SPELLED = range(8)
_LOW = np.uint64(7)
_SLOTS = {"<num>": 8, "<unit>": 16, "<name>": 24}
#: Raw tokens whose hashes a worker keeps.
MEMO_TOKENS = 300_000


class _Hashes(dict):
    """By raw token: a hash of its lower case, alike on all machines, with its class in the low bits."""

    def __missing__(self, raw: str) -> int:
        low = raw.lower()
        capital = len(raw) > 1 and raw[0].isupper() and raw[1:].islower()
        if raw in ".!?\n":
            kind = _END
        elif raw[0].isdigit():
            kind = _NUMBER
        elif low in NUMBER_WORDS:
            kind = _SPELLED
        elif raw in _SYMBOLS:
            kind = _SYMBOL
        elif low in UNITS:
            kind = _CAPITAL_UNIT if capital else _UNIT
        else:
            kind = _CAPITAL if capital else _WORD
        self[raw] = found = xxhash.xxh3_64_intdigest(low) & ~7 | kind
        return found


_hashes = _Hashes()


@dataclass
class Template:
    """Typed tokens: their hashes, the class of each, and which raw tokens each stands for."""

    raw: list[str]
    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    plain: np.ndarray  # the hashes, but those of spelled numbers as words

    def within(self, size: int) -> "Template":
        """As read in windows of `size` tokens: in those of fewer than WINDOW, spelled numbers are words."""
        return self if size >= WINDOW else Template(self.raw, self.plain, self.first, self.last, self.plain)

    def value(self, i: int) -> str:
        """What fills slot i; empty for a word."""
        if int(self.hashes[i]) not in _SLOTS.values():
            return ""
        return " ".join(self.raw[k].lower() for k in range(self.first[i], self.last[i] + 1))

    def tokens(self) -> list[tuple[str, str]]:
        names = {v: k for k, v in _SLOTS.items()}
        words = (names.get(int(h), self.raw[k].lower()) for h, k in zip(self.hashes, self.first))
        return [(word, self.value(i)) for i, word in enumerate(words)]


def raw_tokens(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The raw tokens of a text, and the hashes with classes, places and classes of those that count, alike in all forms."""
    if len(_hashes) > MEMO_TOKENS:
        _hashes.clear()
    raw = (_TOKENS if _BEYOND_LATIN(text) else _LATIN_TOKENS)(text)
    coded = np.fromiter(map(_hashes.__getitem__, raw), np.uint64, len(raw))
    at = np.arange(len(raw))
    kind = (coded & _LOW).astype(np.int8)
    stray = (kind == _SYMBOL) & (np.concatenate([[_END], kind])[:-1] != _NUMBER)
    if stray.any():
        coded, at, kind = coded[~stray], at[~stray], kind[~stray]
    return raw, coded, at, kind


def template(text: str, names: int = AS_NAMES) -> Template:
    """The typed tokens of a text in one of the forms."""
    return typed(*raw_tokens(text), names)


def typed(raw: list[str], coded: np.ndarray, at: np.ndarray, kind: np.ndarray, names: int) -> Template:
    """The typed tokens of what `raw_tokens` gives, in one of the forms."""
    before = np.concatenate([np.array([_END], np.int8), kind])[:-1]
    unit = ((before == _NUMBER) | (before == _SPELLED)) & ((kind == _UNIT) | (kind == _CAPITAL_UNIT) | (kind == _SYMBOL))
    name = ((kind == _CAPITAL) | (kind == _CAPITAL_UNIT)) & ~unit & (names != AS_WORDS)
    opens = before == _END
    if names != OPENERS_TOO:
        name &= ~opens
    else:
        (openers,) = np.nonzero(name & opens)
        name[openers] = [raw[k].lower() not in FUNCTION_WORDS for k in at[openers]]
    hashes = coded & ~_LOW
    hashes[kind == _NUMBER] = _SLOTS["<num>"]
    hashes[unit] = _SLOTS["<unit>"]
    hashes[name] = _SLOTS["<name>"]
    plain = hashes.copy()
    hashes[kind == _SPELLED] = _SLOTS["<num>"]
    last = at.copy()
    joined = name & np.concatenate([[False], name & ~opens])[:-1]  # a name that goes on; an opener stands alone
    kept = (kind != _END) & ~joined
    (starts,) = np.nonzero(kept)
    if joined.any():
        runs = np.maximum.accumulate(np.where(~joined, np.arange(len(at)), 0))
        np.maximum.at(last, runs[joined], at[joined])
    return Template(raw, hashes[starts], at[starts], last[starts], plain[starts])


def _in_word(text: str, i: int) -> bool:
    """Whether there is a letter, as the token pattern has it, at place i."""
    return 0 <= i < len(text) and text[i].isalnum() and not text[i].isdecimal()


class Known:
    """Hashes of the benchmark's windows, and words of which a text that holds an item must have one.

    Most other hashes fail a bit table before they are looked up; most texts have no such word.
    """

    def __init__(self, hashes: np.ndarray, words: list[str]):
        self.hashes, self.words, self._found = hashes, words, None
        size = 1 << max(16, (16 * len(hashes)).bit_length())
        self.mask = np.uint64(size - 1)
        self.table = np.zeros(size, bool)
        self.table[self._cell(hashes.view(np.uint64))] = True

    def _cell(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) & self.mask).astype(np.int64)

    def may_hold(self, text: str) -> bool:
        """False only for texts that hold no item."""
        if self._found is None:
            import ahocorasick

            self._found = ahocorasick.Automaton()
            for word in self.words:
                self._found.add_word(word, len(word))
            self._found.make_automaton()
        if not self.words:
            return False
        low = text.lower()
        return any(not _in_word(low, end + 1) and not _in_word(low, end - size) for end, size in self._found.iter(low))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Places of unsigned hashes that are known."""
        (at,) = np.nonzero(self.table[self._cell(hashes)])
        own = hashes[at].view(np.int64)
        near = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return at[self.hashes[near] == own]


def windows(tokens: Template, known: Known | None = None, size: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes as signed 64-bit, their places, and the tokens in a window; with `known` those that are.

    Without a size, windows are as an item has them: of five tokens, or of all if they are fewer.
    """
    size = size or min(WINDOW, len(tokens.hashes))
    if not size or size > len(tokens.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), size
    hashes = tokens.within(size).hashes
    n = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        total = hashes[:n] + np.uint64(size)
        for k in range(1, size):
            total *= np.uint64(0xBF58476D1CE4E5B9)
            total += hashes[k : k + n]
    at = np.arange(n) if known is None else known.places(total)
    word = hashes > np.uint64(max(_SLOTS.values()))
    at = at[word[at[:, None] + np.arange(size)].any(axis=1)]
    return total[at].view(np.int64), at, size


_FOUND = "array<struct<hash:bigint,at:int,slots:array<string>>>"
_FOUND_ARROW = pa.list_(
    pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("slots", pa.list_(pa.string()))])
)
_READ = "array<struct<names:int,hash:bigint,at:int,slots:array<string>>>"
_READ_ARROW = pa.list_(
    pa.struct([("names", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("slots", pa.list_(pa.string()))])
)
#: Before a slot that an item's first word opens; the word and what follows it in the slot come behind.
_LEAD = "\x01"


def _told(tokens: Template, known: Known | None = None, size: int | None = None, lead: bool = False) -> list[dict]:
    hashes, at, size = windows(tokens, known, size)
    tokens = tokens.within(size)

    def value(i: int) -> str:
        return f"{_LEAD}{tokens.value(i)}" if lead and i == 0 else tokens.value(i)

    return [
        {"hash": h, "at": k, "slots": [value(i) for i in range(k, k + size) if tokens.value(i)]}
        for h, k in zip(hashes.tolist(), at.tolist())
    ]


def item_forms(text: str) -> list[tuple[int, bool, Template]]:
    """How names are read, whether the first word stands in one, and the tokens: an item's different forms."""
    found: list[tuple[int, bool, Template]] = []
    for names in (AS_NAMES, AS_WORDS, OPENERS_TOO):
        alone = template(text, names)
        found.append((names, False, alone))
        if names == OPENERS_TOO:
            continue
        seen = [alone.hashes.tolist()]
        for before in ("x ", "1 "):  # within a sentence; after a number
            within = template(before + text, names)
            within = Template(within.raw, within.hashes[1:], within.first[1:], within.last[1:], within.plain[1:])
            if within.hashes.tolist() not in seen:
                seen.append(within.hashes.tolist())
                found.append((names, True, within))
    return found


def needed_words(tokens: Template, cover: float) -> list[str]:
    """Words of an item such that a text without any of them covers less than `cover` of its windows.

    Each word is in the windows around it, so leaving out a few spaced words leaves out enough
    windows.  The longest are taken, as they tend to be rare.
    """
    _, at, size = windows(tokens)
    tokens = tokens.within(size)
    words: dict[str, set[int]] = {}
    for i, (word, value) in enumerate(tokens.tokens()):
        if not value:
            words.setdefault(word, set()).update(range(i - size + 1, i + 1))
    left, chosen = set(at.tolist()), []
    # lower case of a sigma depends on its neighbours
    for word in sorted(words, key=lambda w: ("σ" in w or "ς" in w, -len(w), w)):
        if len(left) < cover * len(at) or not len(at):
            break
        chosen.append(word)
        left -= words[word]
    return chosen


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, form, names, size, n, hash, at, slots: the windows of each item in each form, of `size` tokens; n of them in all."""

    @F.arrow_udf(f"array<struct<form:int,names:int,size:int,found:{_FOUND}>>")
    def forms(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            rows.append([
                {"form": i, "names": names, "size": min(WINDOW, len(t.hashes)), "found": _told(t, lead=lead)}
                for i, (names, lead, t) in enumerate(item_forms(text.as_py() or ""))
            ])
        return pa.array(rows, pa.list_(pa.struct([("form", pa.int32()), ("names", pa.int32()), ("size", pa.int32()), ("found", _FOUND_ARROW)])))

    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL").distinct()
    return (
        items.select("item_id", F.inline(forms("text")))
        .where(F.size("found") > 0)
        .select("item_id", "form", "names", "size", F.size("found").alias("n"), F.inline("found"))
    )


def in_forms(text: str, sizes: list[int], known: Known | None) -> list[dict]:
    """The windows of a text, in tokens of each size, in each form: of raw tokens that are told apart once."""
    raw, read = raw_tokens(text), []
    for names in (AS_NAMES, AS_WORDS, OPENERS_TOO):
        tokens = typed(*raw, names)
        read += [{"names": names} | w for size in sizes for w in _told(tokens, known, size)]
    return read


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, coverage: each item that a document holds."""
    items = cut(item_windows(benchmark))
    hashes = items.select("hash").distinct()
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # WINDOW at most
    few = hashes.limit(HELD_HASHES + 1).count() <= HELD_HASHES
    known = None
    if few:

        @F.arrow_udf("array<string>")
        def words(texts: pa.Array) -> pa.Array:
            found = [[w for *_, form in item_forms(t.as_py() or "") for w in needed_words(form, cover)] for t in texts]
            return pa.array(found, pa.list_(pa.string()))

        needed = benchmark.select(F.explode(words("text")).alias("word")).distinct()
        known = Known(np.array(sorted(r["hash"] for r in hashes.collect()), np.int64), sorted(r["word"] for r in needed.collect()))
    sent = docs.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf(_READ)
    def matched(texts: pa.Array) -> pa.Array:
        held = sent.value
        if held is not None and not len(held.hashes):
            return pa.array([[] for _ in texts], _READ_ARROW)
        rows = (t.as_py() or "" for t in texts)
        return pa.array([in_forms(t, sizes, held) if held is None or held.may_hold(t) else [] for t in rows], _READ_ARROW)

    # read twice below; texts should not be
    found = cut(docs.select("doc_id", F.inline(matched("text"))).withColumnRenamed("slots", "filled"))
    pairs = found.withColumnRenamed("at", "place").join(items, ["names", "hash"])
    by_item = ["doc_id", "item_id", "form", "n"]
    diagonal = (*by_item, (F.col("place") - F.col("at")).alias("diagonal"))
    # one row for each diagonal and window; slots that are filled by one value each
    lines = pairs.select(*diagonal, "at", F.arrays_zip("slots", "filled").alias("fills")).distinct()
    fills = lines.select(*by_item, "diagonal", "at", F.inline("fills"))
    # where the item's first word opens the slot, the document's value must have it, and what follows fills the rest
    lead = F.col("slots").startswith(_LEAD)
    word = F.regexp_extract("slots", f"^{_LEAD}([^ ]*)", 1)
    after = F.regexp_extract("slots", f"^{_LEAD}[^ ]* (.*)$", 1)
    value, word = F.concat(F.lit(" "), "filled"), F.concat(F.lit(" "), word)
    inner = F.concat(word, F.lit(" "))
    has = F.when(after == "", value.endswith(word)).otherwise(value.contains(inner))
    rest = F.when(after == "", "").otherwise(F.call_function("substring_index", value, inner, F.lit(-1)))
    fills = fills.select(
        *by_item, "diagonal", "at", F.when(lead, after).otherwise(F.col("slots")).alias("slot"),
        F.when(lead, rest).otherwise(F.col("filled")).alias("value"), (~lead | has).alias("has"),
    )
    filled = [*by_item, "diagonal", "slot"]
    unlike = fills.groupBy(*filled).agg(F.min("value").alias("x"), F.max("value").alias("y"), F.bool_and("has").alias("has"))
    unlike = unlike.where("x <> y OR NOT has").select(*filled)
    window = [*by_item, "diagonal", "at"]
    unsound = fills.join(unlike, filled, "left_semi").select(*window).distinct()
    sound = lines.join(unsound, window, "left_anti")
    covered = sound.groupBy(*by_item).agg((F.countDistinct("at") / F.col("n")).alias("coverage"))
    return (
        covered.where(F.col("coverage") >= cover)
        .groupBy("doc_id", "item_id")
        .agg(F.max("coverage").alias("coverage"))
    )
