"""Byte-level BPE by a rank queue that is a hierarchical bitmap (operator 8).

A pre-token is a linked list of its parts. Each pair of neighbours whose joined bytes
have a rank waits in the bucket of that rank; a bitmap of two levels
says which buckets hold something, so the next rank is two find-first-set steps away
however long the pre-token is. A merge leaves the entries of the pairs it destroyed
where they are; they are recognised as stale and skipped when they come up.

Null texts are empty, an empty text has no ids, repeated rows are encoded each.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastlane.llm.arrays import give_back, slices

# Short pre-tokens that each of two generations remembers: some 200 bytes for each of them.
REMEMBERED = 220_000
# The bitmap has two levels: words of 256 bits, and one word that says which of them are not empty.
WORD_BITS = 8
WORD_MASK = (1 << WORD_BITS) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token in a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Encoder:
    """Encodes texts by ranks. One per task: what it remembers would else stay with the Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.words = (max(ranks.values(), default=0) >> WORD_BITS) + 1
        self.of_two = np.full(1 << 16, -1, dtype=np.int64)  # ranks of tokens of two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.of_two[token[0] << 8 | token[1]] = rank
        # Two generations of remembered pre-tokens: a full young one becomes the old one.
        # Their ids are packed, four bytes each.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token: merge the pair of least rank, the leftmost of equals, until none is left.

        The pre-tokens lie end to end and share one queue; no pair reaches over a border.
        """
        rank_of = self.ranks.get
        data = b"".join(pieces)
        size = len(data)
        if not size:
            return [[] for _ in pieces]
        borders = np.cumsum([0, *map(len, pieces)])
        border = np.zeros(size + 1, dtype=np.uint8)
        border[borders] = 1
        after = list(range(1, size + 1))  # where the part that begins here ends
        before = list(range(-1, size - 1))  # where the part to the left begins
        raw = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        two = np.full(size, -1, dtype=np.int64)
        two[:-1] = self.of_two[raw[:-1] << 8 | raw[1:]]
        two[np.flatnonzero(border[1:])] = -1
        waits = two.tolist()  # rank of the pair whose left part begins here
        border = border.tobytes()

        # Positions by rank; words of bits of ranks in use; one word of bits of words in use.
        at = np.flatnonzero(two >= 0)
        at = at[np.argsort(two[at], kind="stable")]
        used, begin = np.unique(two[at], return_index=True)
        buckets = dict(zip(used.tolist(), (x.tolist() for x in np.split(at, begin[1:])), strict=False))
        low, top = [0] * self.words, 0
        for rank in buckets:
            low[rank >> WORD_BITS] |= 1 << (rank & WORD_MASK)
            top |= 1 << (rank >> WORD_BITS)

        while top:
            word = (top & -top).bit_length() - 1  # find first set, twice
            bits = low[word]
            first = bits & -bits
            rank = (word << WORD_BITS) + first.bit_length() - 1
            bits ^= first
            low[word] = bits
            if not bits:
                top ^= 1 << word
            bucket = buckets.pop(rank)
            if len(bucket) > 1:
                bucket.sort()
            least = rank
            for taken, i in enumerate(bucket):
                if waits[i] != rank:
                    continue  # stale: one of the pair has been merged since
                right = after[i]
                end = after[right]
                after[i] = end
                waits[right] = -1
                if border[end]:
                    waits[i] = -1
                else:
                    before[end] = i
                    new = waits[i] = rank_of(data[i:after[end]], -1)
                    if new >= 0:
                        if new < least:
                            least = new
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            word = new >> WORD_BITS
                            low[word] |= 1 << (new & WORD_MASK)
                            top |= 1 << word
                if not border[i]:
                    left = before[i]
                    new = waits[left] = rank_of(data[left:end], -1)
                    if new >= 0:
                        if new < least:
                            least = new
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            buckets[new] = [left]
                            word = new >> WORD_BITS
                            low[word] |= 1 << (new & WORD_MASK)
                            top |= 1 << word
                if least < rank and taken + 1 < len(bucket):
                    # A smaller rank has come up: the rest of this bucket waits its turn.
                    buckets[rank] = bucket[taken + 1:]
                    word = rank >> WORD_BITS
                    low[word] |= 1 << (rank & WORD_MASK)
                    top |= 1 << word
                    break
        found, i = [], 0
        for end in borders[1:].tolist():
            ids = []
            while i < end:
                ids.append(rank_of(data[i:after[i]]))
                i = after[i]
            found.append(ids)
        return found

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a pre-token that several texts have is encoded once."""
        split = [self.split(text) if text else [] for text in texts]
        here, missing = {}, []
        for match in set().union(*split):
            got = self.young.get(match)
            if got is None:
                got = self.old.get(match)
                if got is None:
                    missing.append(match)
                    continue
                self.young[match] = got
            here[match] = got
        made = self.ranks.get
        rare = []
        for match in missing:
            whole = made(match.encode())
            if whole is None:
                rare.append(match)
            else:
                here[match] = self.young[match] = array("i", [whole]).tobytes()
        for match, ids in zip(rare, self.pieces([x.encode() for x in rare]), strict=True):
            here[match] = packed = array("i", ids).tobytes()
            if len(match) < 64:
                self.young[match] = packed
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        return [np.frombuffer(b"".join(map(here.__getitem__, matches)), np.int32) for matches in split]


def _ids(column: pa.Array, encoder: Encoder) -> Iterator[list[np.ndarray]]:
    for start, stop in slices(column):
        yield encoder.texts(column.slice(start, stop - start).to_pylist())


def _as_lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts or [[]]), pa.int32()))


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _round_trips(batches: Iterator[pa.Array], ranks: dict[bytes, int], pattern: str) -> Iterator[pa.StructArray]:
    """Ids and decoded bytes, a slice at a time: those of a whole batch are several times as large as its texts."""
    encoder = Encoder(ranks, pattern)
    token = _tokens(ranks).__getitem__
    for column in batches:
        for part in _ids(column, encoder):
            back = [b"".join(map(token, x.tolist())) for x in part]
            yield pa.StructArray.from_arrays([_as_lists(part), pa.array(back, pa.binary())], ["ids", "decoded"])


def bpe_encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text",
               into: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text's tokens, as array<int> in ``into``.

    ``ranks`` is a whole vocabulary, whose size does not depend on the data; it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value, pattern)
        for column in batches:
            yield from map(_as_lists, _ids(column, encoder))  # a slice at a time

    return docs.withColumn(into, encode(F.col(text)))


def bpe_decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for, as binary in ``into``; null ids stay null."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = _tokens(shared.value).__getitem__
        for column in batches:
            yield pa.array([None if x is None else b"".join(map(token, x)) for x in (y.as_py() for y in column)],
                           pa.binary())

    return encoded.withColumn(into, decode(F.col(ids)))


def bpe_round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text",
                   ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``bpe_decode`` of ``bpe_encode`` in one Python worker, so that the ids need not go there twice."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _round_trips(batches, shared.value, pattern)
        give_back()  # what the worker remembered is free before it gets another task

    made = docs.withColumn(ids, both(F.col(text)))
    return made.withColumn(decoded, F.col(ids)["decoded"]).withColumn(ids, F.col(ids)["ids"])
