"""Toxicity from weak votes: a generative label model and a linear classifier (operator 1).

Thirteen voters look at every text: lexicons of insults, words and word stems mined from
labelled rows, and patterns (several hits, a hit next to a second person, shouting). The label
model knows the votes only as counts of vote patterns, 8192 at most whatever the data. It is
a tree of voters under a hidden label: P(label) times P(voter | parent, label), where each
voter's parent is the one it is most correlated with given the label. Expectation-
maximisation over all pattern counts estimates the label's rate, the voters' accuracies
and these correlations; rows with a label count with it. A logistic regression is then
trained on the posterior labels, from words, stems and the votes.

A null or empty text has no words and no votes and gets the score of such a row. Repeated
rows are scored each. Without labelled rows the mined lexicons are empty; without any row
every score is low. Of features that are as strong those of smaller hashes are kept. Long texts are gone through in
slices, one text at least. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pastlane.llm.arrays import Lookup, Words, byte_table, slices, utf8
from pastlane.session import fresh_dir

# Insults by language and kind, lower case.
LEXICONS = {
    "stupidity": "idiot idiots idiotic moron morons imbecile stupid stupidity dumb dumbass fool retard cretin dimwit brainless",
    "contempt": "scum trash garbage filth filthy vermin parasite rat pig swine dirt disgusting disgrace vile",
    "worth": "loser losers clown clowns pathetic worthless useless failure coward ugly freak creep",
    "profanity": "fuck fucking fucker shit bullshit bitch bastard asshole cunt whore slut damn crap piss",
    "german": "arschloch dummkopf schwachkopf vollidiot trottel depp versager abschaum dreck drecksau hurensohn schlampe wichser",
    "french": "imbécile connard connasse salaud salope débile crétin abruti ordure merde pourriture minable raclure",
    "spanish": "idiota imbécil estúpido estúpida tonto basura escoria payaso perdedor inútil mierda cabrón puta asqueroso patético",
}
SECOND_PERSON = "you your youre ur du dich dein tu te toi vous tú eres usted"
VOTERS = [*LEXICONS, "mined-word", "stem", "two-stems", "three-stems", "aimed", "shouting"]

# Bounds of the samples: labelled rows that words and stems are mined from, and rows that
# the classifier is fitted on besides.
LABELLED_SAMPLE = 8_000
POSTERIOR_SAMPLE = 8_000
# Bounds of what is mined: words and stems that vote, features of the classifier.
MINED = 256
FEATURES = 4096
STEMS = (5, 6, 7, 8)  # first bytes of longer words
EM_ROUNDS = 60

_LETTERS = byte_table([x for x in range(128) if not (65 <= x <= 90 or 97 <= x <= 122)])


def _hash_words(words: str | list[str]) -> np.ndarray:
    values = words.split() if isinstance(words, str) else words
    if not values:
        return np.empty(0, np.uint64)
    return np.sort(Words(pa.array([" ".join(values)]), _LETTERS).hashes())


def _families(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words and of their stems, and the word each belongs to."""
    yield words.hashes(), np.arange(len(words.start))
    for size in STEMS:
        yield words.stems(size)


def _features(words: Words, wanted: Lookup | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count): hashes of words and stems, or numbers of those that are wanted."""
    docs, values = [], []
    for hashes, at in _families(words):
        if wanted is not None:
            here, hashes = wanted.find(hashes)
            at = at[here]
        docs.append(words.doc[at])
        values.append(hashes)
    doc, value = np.concatenate(docs), np.concatenate(values)
    order, first = _first_of_row(doc, value)
    keep = order[first]
    return doc[keep], value[keep], np.diff(np.append(first, len(doc)))


def _first_of_row(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by row and value, and where in it another pair begins."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return order, np.flatnonzero(new)


class Voters:
    """The votes on a slice of texts as bits of a number, in the order of VOTERS."""

    def __init__(self, words: list[int] | None = None, stems: list[int] | None = None):
        self.lexicons = [Lookup(_hash_words(x)) for x in LEXICONS.values()]
        self.mined = Lookup(np.array(words or [], np.uint64))
        self.stems = Lookup(np.array(stems or [], np.uint64))
        self.any = Lookup(np.concatenate([*(x.values for x in self.lexicons), self.mined.values]))
        self.aimed = Lookup(_hash_words(SECOND_PERSON))

    def votes(self, words: Words, raw: np.ndarray) -> np.ndarray:
        mask = np.zeros(words.rows, np.int64)
        hashes = words.hashes()
        at = self.any.find(hashes)[0]  # few: most of the rest looks at these only
        for bit, lexicon in enumerate([*self.lexicons, self.mined]):
            mask[words.doc[at[lexicon.find(hashes[at])[0]]]] |= 1 << bit
        bit = len(self.lexicons) + 1
        stemmed = [at]
        for size in STEMS:
            stem, word = words.stems(size)
            stemmed.append(word[self.stems.find(stem)[0]])
        hits = np.unique(np.concatenate(stemmed))
        count = np.bincount(words.doc[hits], minlength=words.rows)
        for n in (1, 2, 3):
            mask[count >= n] |= 1 << (bit + n - 1)
        for step in (-3, -2, -1, 1, 2, 3):  # a second person within three words
            near = hits + step
            ok = (near >= 0) & (near < len(hashes))
            near, own = near[ok], words.doc[hits[ok]]
            aimed = self.aimed.find(hashes[near])[0]
            mask[own[aimed][words.doc[near[aimed]] == own[aimed]]] |= 1 << (bit + 3)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in
                ((raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122), raw == 33)]
        upper, lower, marks = (x[words.at[1:]] - x[words.at[:-1]] for x in sums)
        loud = (upper > lower) & (upper >= 20) | (marks >= 5) & (marks * 100 > upper + lower)
        mask[loud] |= 1 << (bit + 4)
        return mask


def _parts(column: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    for start, stop in slices(column):
        part = column.slice(start, stop - start)
        words = Words(part, _LETTERS)
        yield words, utf8(part)[0]


def vote(text: Column, voters: Voters) -> Column:
    """The votes on a text, as the bits of a number."""

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            made = [voters.votes(*part) for part in _parts(column)]
            yield pa.array(np.concatenate(made) if made else np.empty(0), pa.int32())

    return count(text)


def _counted(rows: DataFrame, weight: str) -> DataFrame:
    """For every word and stem: the rows that have it, and the sum of their weights."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, before = batch.column(1).to_numpy(zero_copy_only=False), 0
            for words, _ in _parts(batch.column(0)):
                for stem, (hashes, at) in enumerate(_families(words)):
                    order, first = _first_of_row(words.doc[at], hashes)
                    keep = order[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[keep].view(np.int64)), pa.array(np.full(len(keep), stem > 0)),
                         pa.array(values[before + words.doc[at[keep]]])], ["feature", "stem", "bad"])
                before += words.rows

    return rows.select("text", F.col(weight).cast("double")).mapInArrow(
        seen, "feature long, stem boolean, bad double").groupBy("feature", "stem").agg(
        F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("all"))


def _signed(rows: DataFrame, weight: str) -> DataFrame:
    """The counted features with ``z``: how far above chance they go with toxic rows, in deviations."""
    totals = rows.agg(F.sum(weight).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    share = (totals.bad or 0) / max(totals.n, 1)
    chance = F.col("all") * F.lit(float(share))
    return _counted(rows, weight).withColumn(
        "z", (F.col("bad") - chance) / F.sqrt(chance * F.lit(1 - share) + F.lit(0.5)))


def mine_voters(labelled: DataFrame) -> Voters:
    """Voters with the words and stems that set toxic rows of a bounded labelled sample apart."""
    found = _signed(labelled, "toxic").where("z > 5 and bad >= 3").persist()
    # A word that votes is nearly always toxic; a stem only more often than chance, so its hits are counted.
    words = found.where("not stem and bad >= 0.9 * all").orderBy(F.desc("z"), "feature").limit(MINED).collect()
    stems = found.where("stem and bad >= 0.4 * all").orderBy(F.desc("z"), "feature").limit(MINED).collect()
    found.unpersist()
    return Voters([_unsigned(x.feature) for x in words], [_unsigned(x.feature) for x in stems])


def _unsigned(value: int) -> int:
    return value % (1 << 64)


@dataclass
class LabelModel:
    """P(label) and P(voter | parent, label); ``parent`` -1 is none."""

    rate: float
    parent: list[int]
    table: np.ndarray  # voter x label x parent's vote -> P(vote)

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        bits = (np.asarray(masks)[:, None] >> np.arange(len(self.parent))) & 1
        logs = np.stack([self._log(bits, y) for y in (0, 1)], axis=1)
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return p[:, 1] / p.sum(axis=1)

    def _log(self, bits: np.ndarray, y: int) -> np.ndarray:
        total = np.full(len(bits), math.log(self.rate if y else 1 - self.rate))
        for i, parent in enumerate(self.parent):
            p = self.table[i, y, bits[:, parent] if parent >= 0 else 0]
            total += np.log(np.where(bits[:, i] == 1, p, 1 - p))
        return total


def fit_label_model(masks: np.ndarray, counts: np.ndarray, bad: np.ndarray, good: np.ndarray, voters: int) -> LabelModel:
    """Expectation-maximisation over vote patterns.

    ``counts`` has the rows of each pattern without label, ``bad`` and ``good`` those with one.
    """
    bits = ((masks[:, None] >> np.arange(voters)) & 1).astype(float)
    # To begin with, a row is toxic in proportion to the share of votes it has, labels apart.
    soft = np.clip(bits.sum(axis=1) / 2.0, 0.001, 0.98)
    model = LabelModel(0.1, [-1] * voters, np.full((voters, 2, 2), 0.5))
    for round_ in range(EM_ROUNDS):
        weight = [counts * (1 - soft) + good + 1e-9, counts * soft + bad + 1e-9]
        rate = float(np.clip((weight[1].sum() + 1) / (weight[0].sum() + weight[1].sum() + 2), 1e-4, 1 - 1e-4))
        if round_ % 10 == 0:
            parent = _tree(bits, weight)
        table = np.zeros((voters, 2, 2))
        for y in (0, 1):
            own = (weight[y] @ bits + 0.5) / (weight[y].sum() + 1.0)
            for i in range(voters):
                if parent[i] < 0:
                    table[i, y] = own[i]
                    continue
                for v in (0, 1):
                    there = weight[y] * (bits[:, parent[i]] == v)
                    # Shrunk to the voter's own rate, so that a rare parent's vote does not decide alone.
                    table[i, y, v] = (there @ bits[:, i] + 10 * own[i]) / (there.sum() + 10)
        model = LabelModel(rate, parent, np.clip(table, 1e-5, 1 - 1e-5))
        soft = model.posterior(masks)
    return model


def _tree(bits: np.ndarray, weight: list[np.ndarray]) -> list[int]:
    """The voters' tree of greatest correlation given the label (maximum spanning tree)."""
    n = bits.shape[1]
    info = np.zeros((n, n))
    total = weight[0].sum() + weight[1].sum()
    for w in weight:
        both = (bits * w[:, None]).T @ bits
        one, all_ = w @ bits, w.sum()
        for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)):
            pa_, pb = (one if a else all_ - one)[:, None], (one if b else all_ - one)[None, :]
            joint = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both,
                     (0, 0): all_ - one[:, None] - one[None, :] + both}[a, b]
            ok = joint > 1e-6
            info += np.where(ok, joint * np.log(np.where(ok, joint * all_, 1) / np.where(ok, pa_ * pb, 1)), 0) / total
    parent, inside = [-1] * n, [0]
    while len(inside) < n:
        score, i, j = max((info[i, j], i, j) for i in inside for j in range(n) if j not in inside)
        parent[j] = i if score > 1e-6 else -1
        inside.append(j)
    return parent


@dataclass
class ToxicityModel:
    voters: Voters
    labels: LabelModel
    features: Lookup
    weights: np.ndarray  # of the features, then of the votes
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for words, raw in _parts(column):
            doc, feature, count = _features(words, self.features)
            logit = np.bincount(doc, self.weights[feature] * np.log1p(count), minlength=words.rows) + self.bias
            votes = self.voters.votes(words, raw)
            logit += ((votes[:, None] >> np.arange(len(VOTERS))) & 1) @ self.weights[len(self.features.values):]
            out.append(1 / (1 + np.exp(-np.clip(logit, -40, 40))))
        return np.concatenate(out) if out else np.empty(0)


def _by_draw(rows: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """About ``most`` rows, and never more than twice as many, chosen by a hash of the key."""
    if total <= most:
        return rows
    unit = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("toxicity")), F.lit(1 << 30))
    return rows.where(unit < int((1 << 30) * most / total)).limit(2 * most)


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """A bounded sample, read again from the shared folder."""
    folder = fresh_dir(rows.sparkSession, f"toxicity-{name}")
    rows.write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                 toxic: str = "toxic") -> ToxicityModel:
    """A model of which rows of ``docs`` are toxic; learns from all that it is given."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    labels = labels.where(F.col(toxic).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(F.col(toxic).cast("int")).alias("toxic"))
    # The ids of a bounded sample are broadcast; the texts are not shuffled.
    sides = {row.toxic: row.n for row in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for side, n in sorted(sides.items()):
        part = _by_draw(labels.where(F.col("toxic") == side), "key", LABELLED_SAMPLE // 2, n)
        chosen = part if chosen is None else chosen.unionByName(part)
    gold = docs.withColumn("toxic", F.lit(None).cast("int")).limit(0)
    if chosen is not None:
        gold = docs.join(F.broadcast(chosen), "key")
    voters = mine_voters(gold)

    patterns: dict[int, list[float]] = {}
    for row in docs.select(vote(F.col("text"), voters).alias("votes")).groupBy("votes").agg(
            F.count(F.lit(1)).alias("n")).collect():  # 2 ** 13 rows at most
        patterns[row.votes] = [float(row.n), 0.0, 0.0]
    gold = _kept(gold.select("text", vote(F.col("text"), voters).alias("votes"), "toxic"), "labelled")
    for row in gold.groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")).collect():
        known = patterns.setdefault(row.votes, [0.0, 0.0, 0.0])
        known[0] = max(0.0, known[0] - row.n)
        known[1 + (row.toxic == 0)] += row.n
    masks = np.array(sorted(patterns), dtype=np.int64)
    if not len(masks):
        return ToxicityModel(voters, LabelModel(0.02, [-1] * len(VOTERS), np.full((len(VOTERS), 2, 2), 0.5)),
                             Lookup(np.empty(0)), np.zeros(len(VOTERS)), -4.0)
    table = np.array([patterns[int(x)] for x in masks]).reshape(-1, 3)
    model = fit_label_model(masks, table[:, 0], table[:, 1], table[:, 2], len(VOTERS))
    features, weights, bias = _fit_classifier(docs, gold, voters, model, masks, table.sum(axis=1))
    return ToxicityModel(voters, model, features, weights, bias)


def _fit_classifier(docs: DataFrame, gold: DataFrame, voters: Voters, model: LabelModel, masks: np.ndarray,
                    rows: np.ndarray) -> tuple[Lookup, np.ndarray, float]:
    """Logistic regression on posterior labels of a bounded sample, half of it likely toxic.

    The posterior of a row that has a label is that label.
    """
    width = len(VOTERS)
    posterior = model.posterior(masks)
    spark = docs.sparkSession
    clean_rows, toxic_rows = rows[posterior < 0.5].sum(), rows[posterior >= 0.5].sum()
    # P(label) by vote pattern: a table of 2 ** 13 rows at most.
    # As Arrow: of Python rows Spark would start workers of another kind, which stay beside the others.
    table = F.broadcast(spark.createDataFrame(pa.table({"votes": pa.array(masks, pa.int32()), "p": pa.array(posterior, pa.float64())})))
    unit = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("posterior")), F.lit(1 << 30)) / float(1 << 30)
    clean, toxic = (min(1.0, POSTERIOR_SAMPLE / 2 / max(n, 1.0)) for n in (clean_rows, toxic_rows))
    # The draw comes first, so that only rows that may be chosen are looked at again.
    drawn = docs.where(unit < max(clean, toxic)).withColumn("votes", vote(F.col("text"), voters)).join(
        table, "votes").where(unit < F.when(F.col("p") >= 0.5, toxic).otherwise(clean)).limit(2 * POSTERIOR_SAMPLE)
    sample = _kept(drawn.select("text", "votes", "p").unionByName(
        gold.select("text", "votes", F.col("toxic").cast("double").alias("p"))), "sample")

    strong = _signed(sample, "p").where("all >= 3 and abs(z) > 2.5").orderBy(
        F.desc(F.abs("z")), "feature").limit(FEATURES).collect()
    features = Lookup(np.array([_unsigned(x.feature) for x in strong], np.uint64))
    known, size = len(features.values), len(features.values) + width

    @F.arrow_udf("struct<index: array<int>, value: array<double>>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            index, value, ends = [], [], [0]
            for words, _ in _parts(column):
                doc, feature, count = _features(words, features)
                index.append(feature)
                value.append(np.log1p(count))
                ends.extend(ends[-1] + np.searchsorted(doc, np.arange(1, words.rows + 1)))
            ends = pa.array(ends, pa.int32())
            yield pa.StructArray.from_arrays([
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(index), pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(value), pa.float64()))], ["index", "value"])

    # A vector as Spark stores one: written as plain columns, it is read as a vector, and no row goes through Python for it.
    voted = F.filter(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(
        F.call_function("shiftright", F.col("votes"), i) % 2 == 1, i + known)), lambda i: i.isNotNull())
    rows_of = sample.select(counted("text").alias("words"), voted.alias("voted"), "p").select(F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.concat("words.index", "voted").alias("indices"),
        F.concat("words.value", F.transform("voted", lambda i: F.lit(1.0))).alias("values")).alias("features"), "p")
    rows_of.write.parquet(folder := fresh_dir(spark, "toxicity-vectors"))
    rows_of = spark.read.schema(StructType([StructField("features", VectorUDT()), StructField("p", DoubleType())])).parquet(folder)
    # Both labels of a row, each with its probability as weight.
    both = rows_of.select("features", F.lit(1.0).alias("label"), F.col("p").alias("weight")).unionByName(
        rows_of.select("features", F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))).where("weight > 1e-6")
    if both.select("label").distinct().count() < 2:
        return features, np.zeros(size), 4.0 if posterior @ rows > rows.sum() / 2 else -4.0
    fitted = LogisticRegression(weightCol="weight", regParam=0.001, elasticNetParam=0.5, maxIter=40,
                                standardization=False, family="binomial").fit(both)
    return features, np.array(fitted.coefficients.toArray()), float(fitted.intercept)


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """The probability that a text is toxic; the model's size is fixed."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(shared.value.score(column), pa.float64())

    return score(text)
