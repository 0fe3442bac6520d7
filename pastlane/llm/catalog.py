"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastlane.llm.bpe import bpe_round_trip, load_ranks
from pastlane.llm.decontaminate import contamination
from pastlane.llm.fixity import audit_records
from pastlane.llm.html import extract_main_text
from pastlane.llm.jaccard import jaccard_components
from pastlane.llm.languages import fit_languages, predict_language
from pastlane.llm.licenses import licence_scan
from pastlane.llm.maxent import maxent_scores
from pastlane.llm.mixing import mix_sources
from pastlane.llm.neighbours import nearest
from pastlane.llm.oracle import PREFIX_TRIE, SPELLING_VARIANTS
from pastlane.llm.prefixes import packed_turns, prefix_trie, rebuilt_turns
from pastlane.llm.spellings import spelling_variants
from pastlane.llm.toxicity import fit_toxicity, toxicity_score

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(folds: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo ``folds``; a row without id is in none."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit_toxicity(docs.where(_part(5) != 0), labels.where(_part(5) != 0))
    scored = docs.select("doc_id", F.coalesce(_part(5) == 0, F.lit(False)).alias("held_out"),
                         toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = maxent_scores(docs, _part(10) != 0).withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id", F.coalesce(_part(10) == 0, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of all pages in which some have been changed, lost or stored twice."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = F.pmod(F.col("page_id"), F.lit(97))
    replica = pages.where(F.coalesce(kind != 5, F.lit(True))).withColumn(
        "html", F.when(kind == 3, F.concat(F.coalesce("html", F.lit("")), F.lit(" "))).otherwise(F.col("html")))
    replica = replica.unionByName(pages.where(kind == 7))
    found = audit_records(pages, replica, "page_id", ["page_id", "url", "html"])
    return found.select(F.col("node").alias("page_id"), "state", "n_primary", "n_replica")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages, into="text").select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", licence_scan(F.col("text")).alias("scan"))
    base, spans = F.col("scan.base_labels"), F.col("scan.spans")
    nearest = F.array_max(F.transform(spans, lambda x: 1 - x["edits"] / F.length(x["notice"])))
    return found.select(
        "doc_id", "scan.n_words", "scan.n_base", "scan.first_word", "scan.last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform(spans, lambda x: x["label"]))), ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(nearest, F.lit(0.0))).alias("score"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    items = _table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = contamination(docs, items).select("doc_id", F.explode("matches").alias("match"))
    return found.select("doc_id", "match.item_id", "match.score", "match.first_word", "match.last_word")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.where(_part(4) != 2))
    scored = docs.select("doc_id", F.coalesce(_part(4) == 2, F.lit(False)).alias("held_out"),
                         predict_language(F.col("text"), model).alias("guess"))
    return scored.select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda key: key % 20 == 0)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Length and digests of the ids of each text and of the bytes they decode to."""
    ranks = load_ranks(public_tokenizers.path(RANKS))
    return bpe_round_trip(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"), slip=97)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt_turns(packed_turns(turns)))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_score": op2_lm_score,
    "op3_fixity": op3_fixity,
    "op4_main_text": op4_main_text,
    "op6_decontamination": op6_decontamination,
    "op5_licence_scan": op5_licence_scan,
    "op10_language_id": op10_language_id,
    "op7_jaccard_join": op7_jaccard_join,
    "op9_neighbours": op9_neighbours,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_mix": op13_source_mix,
}

ORACLE: dict[str, str] = {
    "op3_fixity": """
        SELECT page_id,
               CASE ((page_id % 97) + 97) % 97 WHEN 5 THEN 'missing' ELSE 'changed' END AS state,
               count(*) AS n_primary,
               CASE ((page_id % 97) + 97) % 97 WHEN 5 THEN 0 WHEN 7 THEN 2 * count(*) ELSE count(*) END AS n_replica
        FROM pages WHERE ((page_id % 97) + 97) % 97 IN (3, 5, 7) GROUP BY page_id
    """,
    "op11_spelling_variants": SPELLING_VARIANTS,
    "op12_prefix_trie": PREFIX_TRIE,
}
