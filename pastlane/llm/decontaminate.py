"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment (operator 6).

The test items are a stated query set. They are taken in blocks of bounded size; each block
is broadcast and held against all rows, in a pass of its own, so that no two blocks are in memory together. Seeds are the word trigrams of the items. One pass
counts in how many rows of the corpus each seed stands. The rare ones join the items' passages:
those in few rows, and in any case the rarest half of an item's, so that an item whose
every seed is frequent (many copies make them so) still has seeds. Where
seeds meet, the item is aligned with the window of the text around them (words; a match
counts 2, a substitution or gap costs 1), and an edited or paraphrased copy is one whose
best local alignment reaches ``THRESHOLD`` of what the item reaches with itself.

Words are runs of letters and digits in lower case. Null or empty texts and items
without words are never matched; items below three words are matched whole. Repeated rows
and repeated items are matched each. Whole texts are searched, slice by slice, one text at least. An empty table of documents gives no rows, one of
items no matches. Of alignments that are as good the first counts. Input columns keep their names and values: the matches go to a column of a free name,
``into`` or that with lines after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastlane.llm.arrays import Lookup, Words, byte_table, slices
from pastlane.llm.components import free_name, written

# Words of the items of a block: the bound of what is broadcast at once.
BLOCK_WORDS = 1 << 19
GRAM = 3
# A seed is rare in this many rows, or in one row of so many.
RARE_ROWS, RARE_ONE_IN = 64, 10_000
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5

_WORD = byte_table([x for x in range(128) if not (48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122)])

HIT = "array<struct<item_id: bigint, score: double, first_word: bigint, last_word: bigint>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()),
                           ("first_word", pa.int64()), ("last_word", pa.int64())]))


class Items:
    """Test items of one block: their words, and which items have each seed and where."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        words = Words(pc.utf8_lower(pa.array(texts, pa.string())), _WORD)
        hashes = words.hashes()
        self.ids, self.words = ids, np.split(hashes, words.first[1:]) if len(ids) else []
        grams, item, place = [], [], []
        for n in range(1, GRAM + 1):
            gram, at = words.grams(hashes, n)
            # Shorter seeds only for items that have no longer ones.
            keep = (words.n[words.doc[at]] == n) if n < GRAM else np.ones(len(at), bool)
            grams.append(gram[keep])
            item.append(words.doc[at[keep]])
            place.append(at[keep] - words.first[words.doc[at[keep]]])
        self.gram, self.item, self.place = map(np.concatenate, (grams, item, place))
        self.sizes = [n for n in range(1, GRAM + 1) if n == GRAM or np.any(words.n == n)]
        self.index()

    def index(self) -> None:
        order = np.lexsort((self.place, self.item, self.gram))
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]
        self.lookup = Lookup(self.gram)
        self.begin = np.searchsorted(self.gram, self.lookup.values)
        self.end = np.append(self.begin[1:], len(self.gram))

    def keep_rare(self, counts: dict[int, int], total: int) -> None:
        """Keeps the seeds that few of ``total`` rows have, and those no more frequent than their item's median."""
        few = max(RARE_ROWS, total // RARE_ONE_IN)
        rows = np.array([counts.get(int(x), 0) for x in self.gram.view(np.int64)])
        keep = np.zeros(len(rows), bool)
        order = np.argsort(self.item, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.item[order])) + 1):
            if len(part):
                keep[part] = rows[part] <= max(few, np.sort(rows[part])[(len(part) - 1) // 2])
        self.gram, self.item, self.place = self.gram[keep], self.item[keep], self.place[keep]
        self.index()

    def seeds(self, column: pa.Array) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, hashes, word, seed) of the slices: where the seeds stand in the texts."""
        for start, stop in slices(column):
            words = Words(pc.utf8_lower(column.slice(start, stop - start)), _WORD)
            hashes = words.hashes()
            at, seed = [], []
            for n in self.sizes:
                grams, place = words.grams(hashes, n)
                here, which = self.lookup.find(grams)
                at.append(place[here])
                seed.append(which)
            yield words, hashes, np.concatenate(at), np.concatenate(seed)

    def matches(self, column: pa.Array) -> Iterator[list[dict]]:
        """Per row the items that it has a copy of."""
        for words, hashes, at, seed in self.seeds(column):
            found: list[dict[int, tuple]] = [{} for _ in range(words.rows)]
            reps = self.end[seed] - self.begin[seed]
            use = np.repeat(self.begin[seed], reps) + _ramp(reps)
            word = np.repeat(at, reps)
            item, doc = self.item[use], words.doc[word]
            begin = word - words.first[doc] - self.place[use]  # where the item would begin in its row
            for k in np.lexsort((begin, item, doc)):
                self._verify(found[doc[k]], int(item[k]), int(begin[k]), hashes, int(words.first[doc[k]]), int(words.n[doc[k]]))
            for row in found:
                yield [{"item_id": self.ids[i], "score": x[0], "first_word": x[1], "last_word": x[2]}
                       for i, x in sorted(row.items()) if x[0] >= THRESHOLD]

    def _verify(self, found: dict, item: int, begin: int, hashes: np.ndarray, first: int, n: int) -> None:
        best = found.get(item, (0.0, 0, 0, -1))
        own = self.words[item]
        slack = len(own) // 2 + 2
        if best[0] >= 1.0 or begin <= best[3]:
            return  # a whole copy is known, or this place lay in the window looked at last
        start, stop = max(0, begin - slack), min(n, begin + len(own) + slack)
        window = hashes[first + start:first + stop]
        score, a, b = 0.0, 0, 0
        if np.isin(own, window).sum() >= THRESHOLD * len(own):  # else no alignment can reach it
            score, a, b = align(own, window)
        if score > best[0]:
            best = (score, start + a, start + b, 0)
        found[item] = (*best[:3], begin + slack // 2)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group of the given sizes."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """(score, first, last) of the best local alignment; the score is a share of the item's with itself."""
    width = len(window)
    steps = np.arange(width + 1)
    row, origin = np.zeros(width + 1), steps.copy()
    best = (0.0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(window == word, MATCH, MISMATCH)
        above = row[1:] + GAP
        up = np.maximum(np.maximum(diagonal, above), 0)
        begins = np.where(diagonal >= above, origin[:-1], origin[1:])
        begins = np.where(up > 0, begins, steps[1:])
        # A gap in the item carries a value to the right, one GAP a step: a running maximum.
        tilted = np.concatenate([[0.0], up]) - GAP * steps
        run = np.maximum.accumulate(tilted)
        source = np.maximum.accumulate(np.where(tilted == run, steps, 0))
        row = run + GAP * steps
        origin = np.concatenate([[0], begins])[source]
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (float(row[k]), int(origin[k]), k - 1)
    return best[0] / (MATCH * len(item)), best[1], best[2]


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list]]:
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(total // (4 * BLOCK_WORDS)) + 1
    block = F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    for k in range(parts):  # one block is a bounded part of the query set
        rows = items.where(block == k).orderBy("id", "text").collect()
        yield [r.id for r in rows], [r.text for r in rows]


def _rows_with_seed(docs: DataFrame, text: str, items: Items) -> tuple[dict[int, int], int]:
    """The rows of the corpus that have each seed, and all rows: at most one count for each seed of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total = np.zeros(len(block.lookup.values), np.int64)
        seen = 0
        for batch in batches:
            seen += batch.num_rows
            for words, _, at, seed in block.seeds(batch.column(0)):
                once = np.unique(np.stack([words.doc[at], seed]), axis=1)[1]
                total += np.bincount(once, minlength=len(total))
        have = np.flatnonzero(total)
        seeds = pa.array([None, *block.lookup.values[have].view(np.int64).tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([seeds, pa.array([seen, *total[have].tolist()], pa.int64())], ["seed", "rows"])

    sums = docs.select(text).mapInArrow(count, "seed long, rows long").groupBy("seed").agg(F.sum("rows").alias("rows"))
    counts = {row.seed: row.rows for row in sums.collect()}
    shared.destroy()
    return counts, counts.pop(None, 0)


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", into: str = "matches") -> DataFrame:
    """``docs`` with an array of the items that each text has a copy of, their scores and word spans."""
    into, blocks = free_name(docs, into), _blocks(items, item_id, item_text)
    block, second = _rare(docs, text, *next(blocks)), next(blocks, None)
    if second is None:
        return docs.withColumn(into, _matches(docs, block)[0](F.col(text)))
    # Several passes: rows get numbers, and each pass leaves the few that have matches.
    row, names = free_name(docs, "row"), docs.columns
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found, texts = None, numbered.select(row, text)
    while block is not None:
        match, shared = _matches(docs, block)
        own = written(texts.select(row, match(F.col(text)).alias("match")).where(F.size("match") > 0), "matches")
        shared.destroy()
        found = own if found is None else found.unionByName(own)
        block, second = None if second is None else _rare(docs, text, *second), next(blocks, None)
    of_row = found.groupBy(F.col(row).alias("_of")).agg(F.array_sort(F.flatten(F.collect_list("match"))).alias(into))
    joined = numbered.join(of_row, numbered[row] == of_row["_of"], "left")
    return joined.select(*[numbered[f"`{name}`"] for name in names], F.coalesce(of_row[into], F.array().cast(HIT)).alias(into))


def _rare(docs: DataFrame, text: str, ids: list, texts: list) -> Items:
    """A block of items with the seeds that are rare in the corpus."""
    block = Items(ids, texts)
    block.keep_rare(*_rows_with_seed(docs, text, block))
    return block


def _matches(docs: DataFrame, block: Items):
    shared = docs.sparkSession.sparkContext.broadcast(block)

    @F.arrow_udf(HIT)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(list(shared.value.matches(column)), _HIT)

    return match, shared
