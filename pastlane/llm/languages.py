"""Language of a text by sparse multinomial logistic regression (operator 10).

Features are character n-grams (1 to 3) of the lower-cased text, hashed, weighted by
sublinear term frequency and inverse document frequency and scaled to length one. The
document frequencies are of all training rows. The weights come from follow-the-
regularised-leader with an elastic net on a bounded sample (``PER_LANGUAGE`` rows of each
language, chosen by hash), learnt in shards that are averaged; one shard is kept apart and
fixes the temperature that makes the scores probabilities.

A text that is null or has no letter is ``und`` with score 1. Repeated rows are predicted
each; ties of the scores go to the first language in alphabetical order. Without any training
row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastlane.llm.arrays import give_back

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
# Rows of each language that the weights are fitted on: the bound of the sample.
PER_LANGUAGE = 2500
SHARDS = 8
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02

_MULTIPLY = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)]


def buckets(text: str) -> np.ndarray:
    """The hash bucket of every character n-gram."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found, state = [], np.zeros(len(points), dtype=np.uint32)
    for n in range(3):
        if len(points) <= n:
            break
        state = (state[:len(points) - n] + points[n:] + np.uint32(1)) * _MULTIPLY[n]
        state ^= state >> np.uint32(15)
        found.append((state * _MULTIPLY[0]) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features."""
    counts = np.bincount(buckets(text), minlength=BUCKETS)
    index = np.flatnonzero(counts)
    values = (1 + np.log(counts[index])) * idf[index]
    return index, values / max(np.sqrt(values @ values), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket x language
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 1.0
        index, values = vector(text, self.idf)
        logits = values @ self.weights[index] / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _document_frequencies(rows: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Rows that have each bucket, and all rows: one small row from each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, rows_seen = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                seen = np.zeros(BUCKETS, bool)
                seen[buckets(value.as_py() or "")] = True
                have += seen
                rows_seen += 1
            give_back()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS + 1), pa.int32()), pa.array(np.append(have, rows_seen), pa.int64())],
            ["bucket", "rows"])

    sums = rows.select(text).mapInArrow(count, "bucket int, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows"))
    found = np.zeros(BUCKETS + 1, np.int64)
    for row in sums.collect():  # BUCKETS + 1 rows whatever the data
        found[row.bucket] = row.rows
    return found[:-1], int(found[-1])


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights after EPOCHS passes of follow-the-regularised-leader over the rows."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(z, n):
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            index, values, label = rows[k]
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            logits = values @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = values[:, None] * p
            grown = ni + g * g
            z[index] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[index] = grown
    return weights(z, n)


def fit_languages(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
                  per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model of the rows' languages; rows without language are passed over."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"),
        F.xxhash64(F.col(key).cast("string"), F.col(lang)).alias("draw"))
    counts = {row.lang: row.n for row in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    frequency, total = _document_frequencies(rows, "text")
    idf = np.log((1 + total) / (1 + frequency)) + 1

    share = F.create_map(*[F.lit(x) for x in sum(([k, min(1.0, per_language / n)] for k, n in counts.items()), [])])
    unit = F.pmod(F.col("draw"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(unit < share[F.col("lang")]).limit(2 * per_language * len(languages)).select(
        "text", "lang", F.pmod(F.shiftright("draw", 32), F.lit(SHARDS)).cast("int").alias("shard"))
    classes = {k: i for i, k in enumerate(languages)}

    def learn(batch: pa.Table) -> pa.Table:
        train = [(*vector(x, idf), classes[y]) for x, y in
                 zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True)]
        shard = batch["shard"][0].as_py()
        # The last shard is kept apart for the temperature.
        value = [b"" if shard == SHARDS - 1 else _ftrl(train, len(classes)).astype(np.float32).tobytes()]
        return pa.table({"shard": pa.array([shard], pa.int32()), "rows": pa.array([len(train)], pa.int64()),
                         "weights": pa.array(value, pa.binary())})

    # As many partitions as shards, which adaptive execution does not merge.
    learnt = [r for r in sample.repartition(SHARDS, "shard").groupBy("shard").applyInArrow(
        learn, "shard int, rows long, weights binary").collect() if r.weights]  # SHARDS rows of fixed size
    weights = np.zeros((BUCKETS, len(languages)))
    for row in learnt:
        weights += np.frombuffer(row.weights, np.float32).reshape(BUCKETS, -1) * (row.rows / sum(x.rows for x in learnt))

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(lambda i, v: (v @ weights[i]).tolist())(*vector(x, idf)) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(made, pa.list_(pa.float64())), pa.array([classes[x] for x in batch["lang"].to_pylist()], pa.int32())],
                ["logits", "label"])

    apart = sample.where(F.col("shard") == SHARDS - 1).select("text", "lang").mapInArrow(
        logits, "logits array<double>, label int").collect()
    return LanguageModel(languages, idf, weights.astype(np.float32), _temperature(apart))


def _temperature(rows) -> float:
    """The temperature of least log loss, from a grid; rows of the part kept apart."""
    if not rows:
        return 1.0
    logits, labels = np.array([r.logits for r in rows]), np.array([r.label for r in rows])

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), labels]))

    return float(min(np.geomspace(0.02, 5, 80), key=loss))


def predict_language(text: Column, model: LanguageModel) -> Column:
    """A struct of the predicted language and its calibrated probability; the model's size is fixed."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            made = [shared.value.predict(x.as_py()) for x in column]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in made], pa.string()),
                                              pa.array([y for _, y in made], pa.float64())], ["lang", "score"])
            give_back()

    return predict(text)
