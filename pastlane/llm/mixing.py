"""Mixing sources to target weights by subset sums (operator 13).

Sources in the order of their code points (null last) weigh 5, 2, 1 and so on again. They share a budget of ``share`` times all words by weight;
no target is above ``most`` times its source, and what is above is shared again by weight among the others.

A source's documents are taken whole as often as the target holds all of them; the rest of the budget is fitted to a subset. Documents are counted by
exact length. What exceeds a window of ``WINDOW`` words is taken from all lengths alike; the part that rounding leaves goes to one more document a
length, longest first; what then remains is a bounded knapsack: dynamic programming over sums tells which can be reached with the
documents that are left of each length, and the sum nearest to the budget is taken (below it, if two are as near). Of the documents of a length those
with the smallest seeded tickets are taken, cut in Spark by pieces of the tickets, so that a length that most documents have is never in one task.

* Nulls: a null text has no words; null sources are one source, the last one; rows without id count, and draw their tickets by text.
* Empty texts have size 0, are in no knapsack and take no words. Empty tables give no rows. Very long texts are documents like others, never cut.
* Ties: rows of equal id and text are the same to the mix; which of them is taken does not show. A rerun gives the same rows.
* Only the named columns are read; others cannot clash.
* One task holds one source's counts by length (its number of different lengths) and the window, never its documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastlane.llm.components import written
from pastlane.operators.hot import with_position

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
WINDOW = 1 << 16  # words of a budget that the dynamic programme fits
PIECES = 4096  # pieces of the tickets of a length


def weighed(totals: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Sources (source, source_size) with their number, nulls last, and their weight."""
    named = with_position(totals.where("source is not null"), [], ts="source", tie=[])
    count = totals.where("source is not null").count()
    unnamed = totals.where("source is null").withColumn("position", F.lit(count).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights)).cast("int") + 1)
    return named.unionByName(unnamed).withColumn("weight", weight.cast("long"))


def with_targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """Adds ``target``: the weight's part of the budget, filled up level by level to ``most`` times the source."""
    cap, level = F.col("source_size") * most, 0.0
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    while True:  # a source that is full stays full, so the level rises until no more are
        full = cap <= F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(full, cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        higher = (budget - (row.full or 0)) / row.weight if row.weight else level
        if higher <= level:
            return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))
        level = higher


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each size (at most ``counts``) come nearest to ``budget`` words together."""
    taken = np.zeros(len(sizes), np.int64)
    usable = [i for i in np.argsort(-sizes) if 0 < sizes[i] <= 2 * budget and counts[i]]
    if not usable or budget <= 0:
        return taken
    top = int(2 * budget)  # a sum above it is further away than nothing
    last = np.where(np.arange(top + 1) == 0, -1, -2)  # the size by which a sum is reached first; -2: not reached
    for i in usable:
        size = int(sizes[i])
        rows = -(-(top + 1) // size)
        known = np.zeros(rows * size, bool)
        known[:top + 1] = last != -2
        ladder = known.reshape(rows, size)  # one step down adds one document
        place = np.where(ladder, np.arange(rows)[:, None], -1 - int(counts[i]) - rows)
        steps = np.arange(rows)[:, None] - np.maximum.accumulate(place, axis=0)
        new = ((steps > 0) & (steps <= counts[i])).reshape(-1)[:top + 1] & (last == -2)
        last[new] = i
        if last[math.ceil(budget - 0.5)] != -2:  # no whole number is nearer
            break
    reached = np.flatnonzero(last != -2)
    at = int(reached[np.argmin(np.abs(reached - budget))])
    while at:
        taken[last[at]] += 1
        at -= int(sizes[last[at]])
    return taken


def fitted(sizes: np.ndarray, counts: np.ndarray, budget: float, window: int = WINDOW) -> np.ndarray:
    """How many documents of each size to take, so that their words come near ``budget``."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    part = max(0, int(budget) - window)
    taken = np.array([int(n) * part // total for n in counts.tolist()], np.int64) if total else np.zeros(len(sizes), np.int64)
    left = budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes):
        if left <= window:
            break
        if sizes[i] <= left and taken[i] < counts[i]:
            size = max(1, int(sizes[i]))
            more = int(min(counts[i] - taken[i], 1 + (left - window - 1) // size, left // size))
            taken[i] += more
            left -= more * int(sizes[i])
    last = knapsack(sizes, counts - taken, min(left, window))
    rest = left - int((sizes * last).sum())
    over = [i for i in np.flatnonzero(taken < counts) if abs(int(sizes[i]) - left) < abs(rest)]
    if over:  # one long document is nearer than all that fits below
        last = np.zeros(len(sizes), np.int64)
        last[min(over, key=lambda i: abs(int(sizes[i]) - left))] = 1
    return taken + last


def _fit(lengths: DataFrame, window: int) -> DataFrame:
    """(position, size, part, chosen) of each source's lengths; counts of a source reach Python as one row."""
    def fit(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                sizes = np.array([x["size"] for x in row.lengths], np.int64)
                counts = np.array([x["n"] for x in row.lengths], np.int64)
                out.append(pd.DataFrame({"position": row.position, "size": sizes, "chosen": fitted(sizes, counts, row.budget, window)}))
            yield pd.concat(out) if out else pd.DataFrame({"position": [], "size": [], "chosen": []}).astype("int64")

    return lengths.mapInPandas(fit, "position long, size long, chosen long")


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS,
                share: float = 1.5, most: int = 2, seed: int = 13, window: int = WINDOW, pieces: int = PIECES) -> DataFrame:
    """(id, size, source, source_size, target, copies): how often the mix takes each document."""
    ticket = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    sized = written(docs.select(
        F.col(key).alias("id"), F.col(source).cast("string").alias("source"), ticket.alias("ticket"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sized")
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    sources = written(with_targets(written(weighed(totals, weights), "weighed"), share, most), "targets")

    piece = F.pmod(F.col("ticket"), F.lit(pieces))
    counts = written(sized.groupBy("source", "size", piece.alias("piece")).agg(F.count(F.lit(1)).alias("n")), "counts")
    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    by_source = lengths.where("size > 0").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n"))).alias("lengths"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.round(F.col("target") - epochs * F.col("source_size"), 6)  # halves count: they make ties
    known = by_source.withColumnRenamed("source", "of").join(sources, F.col("of").eqNullSafe(F.col("source"))).select(
        "position", budget.alias("budget"), "lengths")
    chosen = written(_fit(known, window), "chosen")

    # Pieces of a length are taken whole up to the one in which the number is reached; only there tickets are ranked.
    plan = sources.withColumn("epochs", epochs).select(
        F.col("source").alias("of"), "position", "source_size", "target", "epochs")
    before = Window.partitionBy("position", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(plan.select("of", "position"), F.col("source").eqNullSafe(F.col("of"))).select("position", "size", "piece", "n")
    placed = placed.join(chosen, ["position", "size"]).withColumn("left", F.col("chosen") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = placed.where("left > 0").select("position", "size", "piece", "left", (F.col("left") < F.col("n")).alias("partly"))

    rows = sized.withColumn("piece", piece).join(plan, F.col("source").eqNullSafe(F.col("of")))
    rows = rows.join(cut, ["position", "size", "piece"], "left")
    partly = F.coalesce("partly", F.lit(False))
    whole = rows.where(~partly).withColumn("more", F.col("left").isNotNull().cast("long"))
    rank = F.row_number().over(Window.partitionBy("position", "size", "piece").orderBy("ticket", "id"))
    ranked = rows.where(partly).withColumn("more", (rank <= F.col("left")).cast("long"))
    return whole.unionByName(ranked).select(
        "id", "size", "source", "source_size", "target", (F.col("epochs") + F.col("more")).alias("copies"))
