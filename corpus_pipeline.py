"""Cleans ``documents`` for training in stages; each keeps or changes what the one before it kept.

Between stages the rows are written as Parquet to the shared folder and read again, so no
stage repeats another's work and a lost executor costs one stage at most. All stages but the last
return the columns they got. Null and empty texts have no language and go in the first stage; rows
without id are never near duplicates; rows that share an id but not a text are documents of their own, rows that share both are one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastlane.llm.catalog import bpe_digests
from pastlane.llm.components import free_name, small_batches, written
from pastlane.llm.decontaminate import contamination
from pastlane.llm.jaccard import jaccard_components
from pastlane.llm.languages import fit_languages, predict_language
from pastlane.llm.toxicity import fit_toxicity, toxicity_score
from pastlane.session import fresh_dir

# A prediction less sure than this names no language.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are in no language the corpus names."""
    with small_batches(spark):
        model = fit_languages(docs.select("doc_id", "text", "lang"))
    guess = predict_language(F.col("text"), model)
    name = free_name(docs, "guess")
    sure = (F.col(name)["lang"] != "und") & (F.col(name)["score"] >= SURE)
    return docs.withColumn(name, guess).where(sure).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    with small_batches(spark):
        model = fit_toxicity(docs.select("doc_id", "text"), labels)
    name = free_name(docs, "score")
    return docs.withColumn(name, toxicity_score(F.col("text"), model)).where(F.col(name) < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the least id, of several the one with the least hash of its text.

    A row is known by its id and its text, so of rows that share an id only those go that are near duplicates. Only ids
    and hashes are joined to the documents; Spark broadcasts those that go if they are few.
    """
    rows = written(jaccard_components(docs.select("doc_id", "text")).where(F.col("id").isNotNull()), "groups")
    least = rows.where("id = component")
    several = least.groupBy(F.col("class").alias("of")).agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first <> last")
    copies = rows.where("id <> component").select("id", "mark").unionByName(
        least.join(several, (F.col("class") == F.col("of")) & (F.col("mark") != F.col("first"))).select("id", "mark"))
    mark = free_name(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    gone = written(copies.distinct(), "copies")
    kept = marked.join(gone, (marked["doc_id"] == gone["id"]) & (marked[mark] == gone["mark"]), "left_anti")
    twice = written(rows.groupBy("id", "mark").count().where("count > 1").select(F.col("id").alias("twice_id"), F.col("mark").alias("twice_mark")), "repeated")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    same = (kept["doc_id"] == twice["twice_id"]) & (kept[mark] == twice["twice_mark"])
    repeated = kept.join(twice, same, "left_semi")
    first = repeated.groupBy("doc_id", mark).agg(F.max_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return kept.join(twice, same, "left_anti").select(*docs.columns).unionByName(first.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have a copy of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = free_name(docs, "matches")
    return contamination(docs, items, into=name).where(F.size(name) == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's tokens and of what they decode to; written at once, so that whoever runs the stage, texts come in small batches."""
    with small_batches(spark):
        return written(bpe_digests(docs.select("doc_id", "text")), "digests")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", language_id),
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

# Models and graph components are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = fresh_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        with small_batches(spark):  # workers of several stages live side by side
            stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
