"""Spelling variants of words, found by blocked Gram matrices (operator 11).

Words are points: how often they have each letter. One inserted or deleted letter moves a point by a squared distance of 1,
one replaced letter by 2. Letters are dealt to groups; words whose counts by group agree up to one letter meet in a
block (a *hub*: the counts of a word, or those with one letter less), so every near pair meets in exactly one hub. In a hub one matrix product
gives all squared distances; pairs of at most two whose lengths are equal or adjacent are compared letter by letter. A word leaves a
hub with the number of its near words there and the best of them, never with pairs, so rows stay linear in words.

The number of groups follows the logarithm of the number of words and doubles until no hub is large, at most one letter a group. One task
holds one hub: some hundred bytes a word, products in tiles of 1,024 words.

* Nulls: a null text has no words, a null id is written as an empty one before the colon. Empty tables give no rows.
* Very long texts are gone through run by run; only distinct words are kept, and given to Spark every ``HELD`` words.
* Repeated rows and copies count as often as they are there. Ties of two forms go to the smaller word by code points.
* Only the id and the text are read; other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastlane.llm.components import written

# The letters of a word, and A-Z alone lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

HELD = 200_000  # distinct words that a task holds before it gives them to Spark
HUB_WORDS = 4096  # groups are made finer while a hub has more words
BLOCK_WORDS = 128  # small hubs share a block of about so many words
TILE = 1024
VERIFIED_BYTES = 1 << 22

WORDS = "word string, n long"
FOUND = "word string, near long, best_n long, best string"


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 5, slip: int = 0) -> DataFrame:
    """(word, n): how often each run of at least ``least_letters`` letters stands in the texts, A-Z lower-cased.

    With ``slip``, a run of a document loses one letter if the crc32 of ``<id>:<run>`` is divisible by it: the same letter each time.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_letters},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for row in range(batch.num_rows):
                value = batch.column(1)[row].as_py()
                if not value:
                    continue
                lowered = value.encode("utf-8", "replace").translate(LOWER).decode()
                start = zlib.crc32(f"{batch.column(0)[row].as_py() or ''}:".encode())
                for run, n in Counter(m.group() for m in runs.finditer(lowered)).items():
                    if slip and not (h := zlib.crc32(run.encode(), start)) % slip:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < least_letters:
                            continue
                    found[run] += n
                if len(found) > HELD:
                    yield _counts(found)
                    found.clear()
        yield _counts(found)

    texts = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return texts.mapInArrow(count, WORDS).groupBy("word").agg(F.sum("n").alias("n"))


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


def _letter_groups(letters: list[tuple[str, int]], groups: int) -> list[str]:
    """Letters, most frequent first, each dealt to the group with the fewest occurrences so far."""
    dealt, load = [""] * groups, [0] * groups
    for letter, n in letters:
        least = load.index(min(load))
        dealt[least] += letter
        load[least] += n
    return [group for group in dealt if group]


def _hubs(groups: list[str]) -> Column:
    """The hubs of a word: its counts by group (kind 0), and those with one letter less of group g (kind g + 1)."""
    counts = [F.length("word") - F.length(F.translate("word", group, "")) for group in groups]
    own = F.array(*counts)
    hubs = [F.struct(F.array_join(own, ",").alias("hub"), F.lit(0).alias("kind"))]
    for g, n in enumerate(counts):
        less = F.array_join(F.array(*[c - 1 if i == g else c for i, c in enumerate(counts)]), ",")
        hubs.append(F.when(n > 0, F.struct(less.alias("hub"), F.lit(g + 1).alias("kind"))))
    return F.array_compact(F.array(*hubs))


def _verified(text: np.ndarray, at: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs differ by exactly one letter; letters are bytes of ``text``, which begin at ``at``."""
    ok = np.zeros(len(a), bool)
    short, long = np.where(length[a] <= length[b], a, b), np.where(length[a] <= length[b], b, a)
    more = length[long] - length[short]
    for size, extra in set(zip(length[short].tolist(), more.tolist())):
        if extra > 1:
            continue
        chosen = np.flatnonzero((length[short] == size) & (more == extra))
        step = max(1, VERIFIED_BYTES // (size + 1))
        for i in range(0, len(chosen), step):
            part, places = chosen[i:i + step], np.arange(size)
            left, right = at[short[part]][:, None] + places, at[long[part]][:, None] + places
            same = text[left] == text[right]
            if extra:  # what is equal from the start and what is equal to the end cover the short word
                head = np.where(same.all(1), size, same.argmin(1))
                tail = (text[left] == text[right + 1])[:, ::-1]
                ok[part] = head + np.where(tail.all(1), size, tail.argmin(1)) >= size
            else:
                ok[part] = (~same).sum(1) == 1
    return ok


def _near_pairs(words: list[str], hub: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near words of a block of whole hubs as pairs of places, each pair once."""
    text = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    length = np.array([len(word) for word in words])
    at = np.cumsum(length) - length
    used, letter = np.unique(text, return_inverse=True)
    row = np.repeat(np.arange(len(words)), length)
    points = np.bincount(row * len(used) + letter, minlength=len(words) * len(used)).reshape(len(words), len(used))
    # Products of whole numbers are exact while they stay below the type's mantissa.
    exact = np.float32 if int(length.max()) < 2000 else np.float64
    points = points.astype(exact)
    half, ones = (points * points).sum(1, keepdims=True) / 2, np.ones((len(words), 1), exact)
    # With two more columns the product is minus half the squared distance.
    left, right = np.hstack([points, half, ones]), np.hstack([points, -ones, -half])
    firsts, seconds = [], []
    for i in range(0, len(words), TILE):
        for j in range(i, len(words), TILE):
            gram = left[i:i + TILE] @ right[j:j + TILE].T
            a, b = np.divmod(np.flatnonzero(gram > -1.25), gram.shape[1])
            a, b = a + i, b + j
            # A pair with one place in all groups meets in the hub of its own counts.
            keep = (a < b) & (hub[a] == hub[b]) & ((kind[a] != kind[b]) | (kind[a] == 0)) & (abs(length[a] - length[b]) < 2)
            a, b = a[keep], b[keep]
            ok = _verified(text, at, length, a, b)
            firsts.append(a[ok])
            seconds.append(b[ok])
    return np.concatenate(firsts), np.concatenate(seconds)


def _told(words: list[str], n: np.ndarray, hub: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """For each word of a block with near words there: their number, and the most frequent of them."""
    a, b = _near_pairs(words, hub, kind)
    target, other = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], target))
    target, other = target[order], other[order]
    own, first, near = np.unique(target, return_index=True, return_counts=True)
    best = other[first]
    return pa.RecordBatch.from_arrays([
        pa.array([words[i] for i in own], pa.string()), pa.array(near.astype(np.int64)),
        pa.array(n[best].astype(np.int64)), pa.array([words[i] for i in best], pa.string())], ["word", "near", "best_n", "best"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through rows (hub, kind, word, n) in the order of hubs, block after block."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pandas().tolist() for column in batch.columns), strict=True)

    block: list[tuple] = []
    for number, (_, members) in enumerate(groupby(rows(), key=itemgetter(0))):
        hub = [(number, kind, word, n) for _, kind, word, n in members]
        if len(hub) > 1:
            block.extend(hub)
        if len(block) >= BLOCK_WORDS:
            yield _block(block)
            block = []
    if block:
        yield _block(block)


def _block(block: list[tuple]) -> pa.RecordBatch:
    hub, kind, words, n = zip(*block, strict=True)
    return _told(list(words), np.array(n, np.int64), np.array(hub), np.array(kind))


def near_words(words: DataFrame, hub_words: int = HUB_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n) that have near ones: how many, and the most frequent of them."""
    spark = words.sparkSession
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().orderBy(F.desc("count"), "letter")
    letters = [(row.letter, row["count"]) for row in letters.collect() if row.letter]  # the alphabet
    groups = max(4, int(words.count()).bit_length() // 2 - 2)
    spark.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")  # Spark has dealt the cores to tasks
    while True:
        dealt = _letter_groups(letters, min(groups, max(1, len(letters))))
        met = words.select(F.explode(_hubs(dealt)).alias("at"), "word", "n").select("at.hub", "at.kind", "word", "n")
        largest = met.groupBy("hub").count().agg(F.max("count")).first()[0]
        if (largest or 0) <= hub_words or groups >= len(letters):
            break
        groups *= 2
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = met.repartition(parts, "hub").sortWithinPartitions("hub").mapInArrow(_search, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))).alias("best")
    return told.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def spelling_forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word (word, n).

    The form is the most frequent near word if it is at least ``ratio`` times as frequent; the root is where forms lead to.
    """
    near = written(near_words(words), "near-words")
    formed = near.select("word", "n_near", F.col("form").alias("_form"), F.col("form_n").alias("_form_n"))
    ok = F.col("_form_n") >= ratio * F.col("n")
    rows = written(words.join(formed, "word", "left").select(
        "word", F.when(ok, F.col("_form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(ok, F.col("_form_n")).alias("form_n")), "forms")
    # Counts grow along forms, so they lead to an end; each round doubles the way that is gone.
    ways = written(rows.where("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("end"))
        longer = written(ways.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "ways")
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return rows.join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 5,
                      least_count: int = 3, ratio: int = 2, slip: int = 0) -> DataFrame:
    """The frequent words of the texts with their spelling variants; see ``word_counts`` and ``spelling_forms``."""
    counts = word_counts(docs, key, text, least_letters, slip).where(F.col("n") >= least_count)
    return spelling_forms(written(counts, "words"), ratio)
