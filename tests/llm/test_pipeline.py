import hashlib
import random

import pyarrow as pa
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from pastlane.llm.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with one of everything that a stage has to find."""
    draw = random.Random(6)
    sounds = {"aa": "ka lo mi tu re".split(), "bb": "schru zwei pfl ach ung".split()}
    item = " ".join("".join(draw.choice("bdfgh") + draw.choice("aeiou") for _ in range(3)) for _ in range(30))

    def text(lang, n):
        return " ".join("".join(draw.choice(sounds[lang]) for _ in range(3)) for _ in range(n))

    docs = {i: (text("aa" if i % 2 else "bb", 60), "aa" if i % 2 else "bb") for i in range(300)}
    toxic = {i for i in docs if i % 10 == 0}
    for i in toxic:
        docs[i] = (docs[i][0] + " you idiot and scum", docs[i][1])
    for i in (3, 5):
        docs[300 + i] = docs[i]  # copies, exact and near
        docs[310 + i] = (docs[i][0] + " tail", docs[i][1])
    docs[7] = (f"{docs[7][0]} {item}", "aa")
    rows = [(i, t, g, "s", len(t), "x", 1.0, 5) for i, (t, g) in docs.items()]
    rows += [(900, None, "aa", "s", None, "x", 1.0, 5), (901, "", None, "s", 0, "x", 1.0, 5), (902, "1 2 3", "aa", "s", 5, "x", 1.0, 5),
             (11, docs[11][0], "aa", "s", 1, "x", 1.0, 5), (13, text("aa", 50), "aa", "s", 1, "x", 1.0, 5),
             (15, docs[15][0] + " more", "aa", "s", 1, "x", 1.0, 5), (None, text("aa", 40), "aa", "s", 1, "x", 1.0, 5)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, guess string, score double, matches int"
                          ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in docs], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, toxic


def test_stages_take_what_they_are_for(spark, corpus, tmp_path):
    folder, docs, toxic = corpus
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    gone = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, frame, folder)
        if number < 4:
            assert made.columns == frame.columns
        made.write.parquet(str(tmp_path / str(number)))
        before = sorted((r.doc_id for r in frame.select("doc_id").collect()), key=str)
        frame = spark.read.parquet(str(tmp_path / str(number)))
        after = sorted((r.doc_id for r in frame.select("doc_id").collect()), key=str)
        gone.append(sorted(set(before) - set(after)))
        if name == "near duplicates":
            # and the second of two equal rows, and one of two near copies with one id, but not another text of an id
            assert len(before) - len(after) == 6
            assert sorted(r.doc_id for r in frame.where("doc_id in (11, 13, 15)").collect()) == [11, 13, 13, 15]
    assert gone == [[900, 901, 902], sorted(toxic), [303, 305, 313, 315], [7], []]
    one = frame.where("doc_id = 1").first()
    assert one.decoded_sha256 == hashlib.sha256(docs[1][0].encode()).hexdigest() and one.n_tokens > 60
    assert frame.where("doc_id is null").count() == 1


def test_run_and_registration(spark, corpus):
    assert [x for x, _ in corpus_pipeline.STAGES] == ["language id", "toxicity", "near duplicates", "decontamination", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert set(contract.queries()) >= {*QUERIES, "pipeline"} and set(contract.oracle_sql()) >= set(ORACLE)
    assert {int(x[2:].split("_")[0]) for x in QUERIES} == set(range(1, 14))


def test_no_documents(spark, corpus):
    folder = corpus[0]
    frame = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, frame, folder)
        assert made.count() == 0
        frame = made if "text" in made.columns else frame


def test_stages_get_small_batches(spark, tmp_path, monkeypatch):
    """Every stage, also where it runs only as its rows are written, hands Python few rows at a time."""
    spark.range(3000).selectExpr("id doc_id", "'text' text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": [batch.num_rows], "text": ["text"]})

    stage = lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", stage)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [row.doc_id for row in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [1000] * 3
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_tokens_come_in_small_batches_whoever_runs_the_stage(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": [batch.num_rows], "text": ["text"]})

    monkeypatch.setattr(corpus_pipeline, "bpe_digests", lambda docs: docs.mapInArrow(sizes, "doc_id long, text string"))
    docs = spark.range(3000).selectExpr("id doc_id", "'text' text").coalesce(1)
    assert [row.doc_id for row in corpus_pipeline.tokens(spark, docs, "").collect()] == [1000] * 3


def test_toxicity_starts_no_workers_for_rows(spark, corpus, monkeypatch):
    """Rows of Python objects would start workers of another kind in every executor, which stay there."""
    def refuse(*_, **__):
        raise AssertionError("rows of Python objects")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    folder, docs, toxic = corpus
    kept = corpus_pipeline.toxicity(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert not toxic & {row.doc_id for row in kept.collect()}
