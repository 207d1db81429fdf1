"""Operator 1: byte-level BPE encoding and decoding.

Every byte is mapped to the Latin-1 character of the same number, so that a
pyahocorasick automaton over the vocabulary finds all tokens in a piece of text.  The
encoder walks a piece from left to right with the longest token that starts there.  A
token may follow its predecessor only if merging the bytes of both gives back exactly
these two tokens; that answer is memoised per pair.  Where no token fits, it backtracks:
the predecessor is exchanged for its next shorter prefix.  Positions from which no
continuation was found are marked, so every position is settled once and time is linear.
The result is what applying the merges by rank would give.

Cases: null text counts as empty and gives no ids; an empty text gives no ids; a very
long text or piece is encoded whole; repeated rows are encoded each; special tokens are
never recognised; ids unknown to the vocabulary raise an error on decoding; null ids
decode to null.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the first Unicode blocks in the classes \p{L}, \p{N}, \s.
LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
LATIN_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_SPACES = "\t-\r \x85\xa0"
#: Characters beyond this one are left to the slower general pattern.
LATIN_END = "ɏ"
#: Pieces whose ids are kept in a worker at once.
MEMO_PIECES = 120_000
#: The same for pieces of which the number of ids is kept only.
MEMO_COUNTS = 240_000
MEMO_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: base64 of a token's bytes, and its rank, on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Bpe:
    """Encoder and decoder for one vocabulary of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.split_any = regex.compile(pattern).findall
        simple = (
            pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]")
            .replace(r"\p{L}", f"[{LATIN_LETTERS}]")
            .replace(r"\p{N}", f"[{LATIN_NUMBERS}]")
            .replace(r"\S", f"[^{LATIN_SPACES}]")
            .replace(r"\s", f"[{LATIN_SPACES}]")
        )
        self.split_latin = re.compile(simple).findall
        self.beyond_latin = re.compile(f"[^\0-{LATIN_END}]").search
        self.ranks = ranks
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        #: The pair whose merge made a token; single bytes have none.
        self.made_from = {rank: self._halves(token) for token, rank in ranks.items() if len(token) > 1}
        self.merged = {pair: rank for rank, pair in self.made_from.items() if pair}
        self.size_of = {rank: len(token) for token, rank in ranks.items()}
        #: The longest token that is a proper prefix, or -1.
        self.shorter = {
            rank: next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
            for token, rank in ranks.items()
        }
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(lambda piece: tuple(self.encode_piece(piece)), MEMO_PIECES)
        self.counts = _Pieces(lambda piece: len(self.encode_piece(piece)), MEMO_COUNTS)

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """Merge by rank, with the token itself forbidden: the last two parts made it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        ranks, last = self.ranks, self.ranks[token]
        while len(parts) > 2:
            at, best = -1, last
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1], last)
                if rank < best:
                    at, best = i, rank
            if at < 0:
                return None  # the token can't be reached by merges
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens by rank ends with just these two."""
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left << 32 | right] = self._stays_apart(left, right)
        return fits

    def _stays_apart(self, left: int, right: int) -> bool:
        """Undo merges from the latest on; no pair at the seam may merge before it is gone.

        `until`: the seam's present parts are merged further at that rank.
        """
        until = 1 << 62
        left_side: list[int] = [left]
        right_side: list[int] = [right]
        while True:
            a, b = left_side[-1], right_side[-1]
            rank = self.merged.get((a, b))
            if rank is not None and rank < until:
                return False
            split_a, split_b = self.made_from.get(a), self.made_from.get(b)
            # a merge of equal rank on the left comes first, as merges go from left to right
            if split_a and (not split_b or a > b):
                left_side.append(split_a[1])
                until = a
            elif split_b:
                right_side.append(split_b[0])
                until = b + 1
            else:
                return True

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one match of the pattern."""
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        size, size_of, shorter, pairs = len(raw), self.size_of, self.shorter, self.pairs
        longest = [-1] * size  # by start; matches come by rising end, so the longest is written last
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            longest[end - size_of[token] + 1] = token
        ids: list[int] = []
        dead = bytearray(size + 1)
        at, token, before = 0, longest[0], -1
        while True:
            if token < 0:
                if before < 0:
                    raise ValueError("the vocabulary doesn't cover this text")
                dead[at] = 1
                ids.pop()
                at -= size_of[before]
                token = shorter[before]
                before = ids[-1] if ids else -1
                continue
            end = at + size_of[token]
            if not dead[end]:
                fits = before < 0 or pairs.get(before << 32 | token)
                if fits is None:
                    fits = self.compatible(before, token)
                if fits:
                    ids.append(token)
                    if end == size:
                        return ids
                    at, before, token = end, token, longest[end]
                    continue
            token = shorter[token]

    def split(self, text: str) -> list[str]:
        return (self.split_any if self.beyond_latin(text) else self.split_latin)(text)

    def encode(self, text: str) -> list[int]:
        self.pieces.make_room()
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def count(self, text: str) -> int:
        """How many ids `encode` gives."""
        self.counts.make_room()
        return sum(map(self.counts.__getitem__, self.split(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Pieces(dict):
    """What `made` gives for a piece, computed at first sight; the `room` pieces of the last while are kept."""

    def __init__(self, made: Callable, room: int):
        self.made, self.room = made, room
        self.older: dict = {}

    def __missing__(self, piece: str):
        found = self.older.get(piece) or self.made(piece)
        if len(piece) <= 64:
            self[piece] = found
        return found

    def make_room(self) -> None:
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()


@functools.lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


def encode(text: Column, vocabulary: str, pattern: str) -> Column:
    """array<int> of token ids; `vocabulary` is a rank file that every executor can open."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        bpe = _loaded(vocabulary, pattern)
        found, ends = [], [0]
        for text in texts:
            ids = np.fromiter(bpe.encode(text.as_py() or ""), dtype=np.int32)
            found.append(ids)
            ends.append(ends[-1] + len(ids))
        values = np.concatenate(found) if found else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    return ids_of(text)


def count(text: Column, vocabulary: str, pattern: str) -> Column:
    """Number of token ids as a long; null and empty texts have 0."""

    @F.arrow_udf("long")
    def lengths(texts: pa.Array) -> pa.Array:
        bpe = _loaded(vocabulary, pattern)
        return pa.array([bpe.count(text.as_py() or "") for text in texts], pa.int64())

    return lengths(text)


def count_variants(text: Column, variant: Column, vocabulary: str, pattern: str) -> Column:
    """struct<own: long, variant: long>: the counts of both texts, the second null if they are equal (null is empty).

    A variant has most of its text's pieces.  It is counted right after it, while their counts are kept.
    """
    kind = pa.struct([("own", pa.int64()), ("variant", pa.int64())])

    @F.arrow_udf("struct<own:long,variant:long>")
    def lengths(texts: pa.Array, variants: pa.Array) -> pa.Array:
        bpe, found = _loaded(vocabulary, pattern), []
        for text, other in zip(texts, variants):
            text, other = text.as_py() or "", other.as_py() or ""
            found.append({"own": bpe.count(text), "variant": bpe.count(other) if other != text else None})
        return pa.array(found, kind)

    return lengths(text, variant)


def decode(ids: Column, vocabulary: str, pattern: str) -> Column:
    """binary: the bytes of the ids, null for null."""

    @F.arrow_udf("binary")
    def bytes_of(lists: pa.Array) -> pa.Array:
        bpe = _loaded(vocabulary, pattern)
        values, offsets, valid = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_valid()
        return pa.array(
            [bpe.decode(values[a:b].tolist()) if ok.as_py() else None for a, b, ok in zip(offsets, offsets[1:], valid)],
            pa.binary(),
        )

    return bytes_of(ids)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids: one row for each row of `docs` (columns doc_id, text; others are ignored)."""
    return docs.select("doc_id", encode(F.col("text"), vocabulary, pattern).alias("ids"))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded: the ids of each text and the bytes that they decode to."""
    encoded = encode_documents(docs, vocabulary, pattern)
    return encoded.withColumn("decoded", decode(F.col("ids"), vocabulary, pattern))


def digests(trips: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the rows of `round_trip`."""
    return trips.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
