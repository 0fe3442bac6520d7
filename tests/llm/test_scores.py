"""Toxicity, language-model scores and language identification."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pastlane.llm import maxent
from pastlane.llm.languages import fit_languages, predict_language
from pastlane.llm.maxent import maxent_scores
from pastlane.llm.toxicity import VOTERS, fit_label_model, fit_toxicity, toxicity_score


def held_out(i, folds, fold=0):
    return zlib.crc32(str(i).encode()) % folds == fold


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts in two made languages; toxic ones have an insult, or two words of a stem."""
    draw = random.Random(3)
    stems = {"aa": [f"ko{x}{y}" for x in "aeiou" for y in "lmnrst"], "bb": [f"tra{x}{y}z" for x in "aeiou" for y in "bcdfg"]}
    docs, labels = [], []
    for i in range(500):
        lang = "aa" if i % 3 else "bb"
        words = [draw.choice(stems[lang]) for _ in range(draw.randrange(5, 60))]
        toxic = i % 7 == 0
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(["you idiot", "scum", "moron"]) if i % 2 else
                         f"schmutz{draw.choice('xyzwv')} schmutz{draw.choice('abcd')}er")
        elif i % 5 == 0:
            words.append("schmutzig")  # one word of the stem is not toxic
        docs.append((i, " ".join(words), lang))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_of_rows_it_did_not_learn_from(corpus):
    docs, labels = corpus
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit_toxicity(docs.where(fold != 0), labels.where(fold != 0))
    rows = docs.select("doc_id", toxicity_score(F.col("text"), model).alias("score")).collect()
    right = [(r.score >= 0.5) == (r.doc_id % 7 == 0) for r in rows if held_out(r.doc_id, 5)]
    assert np.mean(right) > 0.93
    clean = model.score(pa.array(["kola kolb", None, "", "KOLA!!"]))
    assert clean.max() < 0.5
    assert model.score(pa.array(["kola you idiot kolb"]))[0] > 0.5


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, corpus):
    labels = corpus[1]
    for docs, marks in ((odd_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels)):
        rows = odd_docs.select(toxicity_score(F.col("text"), fit_toxicity(docs, marks)).alias("s")).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.s <= 1 for r in rows)


def test_label_model_finds_accuracies_and_a_copied_voter():
    draw = np.random.default_rng(1)
    label = draw.random(40_000) < 0.2
    votes = np.zeros((40_000, 5), int)
    for k, (hit, false) in enumerate([(0.8, 0.02), (0.6, 0.05), (0.7, 0.1), (0.5, 0.01)]):
        votes[:, k] = draw.random(40_000) < np.where(label, hit, false)
    votes[:, 4] = np.where(draw.random(40_000) < 0.95, votes[:, 2], 0)  # says what voter 2 says
    masks, counts = np.unique(votes @ (1 << np.arange(5)), return_counts=True)
    model = fit_label_model(masks, counts.astype(float), np.zeros(len(masks)), np.zeros(len(masks)), 5)
    assert abs(model.rate - 0.2) < 0.05
    assert model.parent[4] == 2 or model.parent[2] == 4
    assert np.all(model.table[0, 1] > 0.6) and np.all(model.table[0, 0] < 0.05)


def test_votes_fit_their_column():
    assert len(VOTERS) <= 13


def tokens(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w] + ["\0end"]


@pytest.mark.parametrize("remembered", [1 << 17, 10])
def test_base_score_by_hand(corpus, odd_docs, monkeypatch, remembered):
    monkeypatch.setattr(maxent, "REMEMBERED", remembered)
    docs = corpus[0].unionByName(odd_docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang"))
    train = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    rows = maxent_scores(docs, train).collect()
    texts = docs.collect()
    count = Counter(w for r in texts if r.doc_id is not None and not held_out(r.doc_id, 10) for w in tokens(r.text))
    n, v = sum(count.values()), len(count)
    base = sorted(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(r.text)) for r in texts)
    assert len(rows) == len(texts) and {r.train_tokens for r in rows} == {n}
    assert np.allclose(sorted(r.base_score for r in rows), base, rtol=1e-9)
    assert sum(r.n_tokens for r in rows) == sum(len(tokens(r.text)) for r in texts)
    assert sum(r.n_known for r in rows) == sum(count[w] > 0 for r in texts for w in tokens(r.text))
    assert all(r.score < 0 for r in rows)
    if remembered > 10:  # contexts tell the languages apart
        apart = [r for r in rows if not r.trained and r.id is not None and r.id < 500]
        assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def packed_of(texts):
    rows = texts.select(F.lit(1).alias("id"), F.lit(True).alias("trained"), "text")
    return maxent.packed_tokens(rows).select("hashes", "letters")


def test_packed_tokens_are_the_tokens(odd_docs):
    texts = odd_docs.select(F.monotonically_increasing_id().alias("id"), F.lit(True).alias("trained"), "text").toArrow()
    made = maxent.Tokens.of_texts(texts["text"].combine_chunks())
    back = maxent.Tokens.unpacked(*made.packed())
    for name in ("hash", "letters", "n", "doc", "place"):
        assert np.array_equal(getattr(made, name), getattr(back, name))


def test_model_is_a_distribution(corpus):
    """After any history the probabilities of all known words and of unknown ones add up to one."""
    texts = corpus[0].select("text")
    packed = packed_of(texts)
    counts = maxent.written(maxent._token_counts(packed), "counts")
    model = maxent._start_model(packed, counts)
    maxent._round(packed, model, 0)
    assert np.abs(model.class_weights).max() > 0
    words = [w for w in {w for r in texts.collect() for w in tokens(r.text)} if w != "\0end"]
    for history in ("", "kola kolb kolc", "trabbz idiot"):
        total = 0.0
        for word in words:
            part = maxent.Tokens.of_texts(pa.array([f"{history} {word}"]))
            number = model.known(part)
            logs = model.score(part, number)
            tail = model.classes(part, number)[-2] >= maxent.HEAD_CLASSES
            total += math.exp(logs[-2] + (math.log(model.counts[number[-2]] + 0.1) if tail else 0))
        part = maxent.Tokens.of_texts(pa.array([history]))
        number = model.known(part)
        total += math.exp(model.score(part, number)[-1])  # the end
        for letters in range(maxent.TAIL_CLASSES):  # the unknown words of each tail class
            logits = model.class_logits(maxent._weight_rows(part.features(np.array([len(part.hash) - 1]))))
            p = np.exp(logits - logits.max())
            total += (p / p.sum())[0, maxent.HEAD_CLASSES + letters] * 0.1 / model.tail_mass[letters]
        assert abs(total - 1) < 1e-4


def test_every_position_gives_a_gradient(spark):
    texts = spark.createDataFrame([(" ".join(f"w{i}x{k}" for k in range(i % 5)),) for i in range(120)], "text string").coalesce(2)
    packed = packed_of(texts)
    model = maxent._start_model(packed, maxent.written(maxent._token_counts(packed), "counts"))
    for round_ in range(maxent.ROUNDS):
        maxent._round(packed, model, round_)
    part = maxent.Tokens.of_texts(pa.array([r.text for r in texts.collect()]))
    rows = maxent._weight_rows(part.features(np.arange(len(part.hash))))
    assert (np.abs(model.class_weights[rows]).max(axis=2) > 0).all()


def test_sums_of_spans():
    draw = np.random.default_rng(5)
    values, times = draw.random((300, 4)), np.sort(draw.integers(1, 40, 50))[::-1]
    owner, begin = draw.integers(0, 300, times.sum()), np.cumsum(times) - times
    assert np.allclose(maxent._sums(values, owner, begin, times), np.add.reduceat(values[owner], begin, axis=0))


def test_exponentials_shift_rows_only_where_they_must():
    """Ordinary logits need no largest of each row; one that overflows, or an own one that would vanish, gives the same softmax."""
    for logits, shifted in (([[1, 2, 3], [20, -1e4, 19]], False), ([[100, 99, 0], [1, 2, 3]], True), ([[-200, -201, -202], [0, 1, 2]], True)):
        logits, at = np.array(logits, np.float32), np.array([0, 1 if shifted else 0])
        whole = logits.astype(float) - logits.max(axis=1, keepdims=True)
        expected = (whole - np.log(np.exp(whole).sum(axis=1, keepdims=True)))[np.arange(2), at]
        made = logits.copy()
        sums, top = maxent._exponentials(made, made[np.arange(2), at])
        assert (np.ndim(top) > 0) == shifted
        assert np.allclose(np.log(made[np.arange(2), at] / sums), expected, atol=1e-5)
        assert np.allclose(maxent._log_softmax(logits.copy(), at), expected, atol=1e-5)
    assert not len(maxent._log_softmax(np.empty((0, 3), np.float32), np.empty(0, np.int64)))


@pytest.mark.parametrize("near", [3, 1024])
def test_steps_by_blocks_are_those_of_the_whole(monkeypatch, near):
    """An Adagrad step of all touched rows, computed plainly, whatever the size of the blocks."""
    monkeypatch.setattr(maxent, "NEAR", near)
    draw = np.random.default_rng(3)
    weights = draw.normal(size=(maxent.ROWS, 8)).astype(np.float32)
    learner = maxent.Learner.__new__(maxent.Learner)
    learner.rate, learner.weights = 0.12, [weights.copy()]
    learner.squares, learner.met = [np.full_like(weights, 1e-3)], [np.zeros(maxent.ROWS, np.int64)]
    rows, chosen = draw.integers(0, 40, (100, 5)), draw.integers(0, 8, 100)
    logits = maxent.Model._sum(weights, rows)
    assert np.allclose(logits, weights[rows].sum(axis=1), atol=1e-5)
    p = np.exp(logits.astype(float))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(100), chosen] -= 1
    gradient = np.zeros((maxent.ROWS, 8))
    np.add.at(gradient, rows.ravel(), np.repeat(p, 5, axis=0))
    learner._update(0, rows, logits, chosen)
    assert np.allclose(learner.weights[0], weights - 0.12 * gradient / np.sqrt(1e-3 + gradient ** 2), atol=1e-4)
    assert learner.met[0].tolist() == np.bincount(rows.ravel(), minlength=maxent.ROWS).tolist()


def test_scores_without_training_rows(no_docs, odd_docs):
    rows = maxent_scores(odd_docs, F.lit(False)).collect()
    assert len(rows) == odd_docs.count() and {r.train_tokens for r in rows} == {0}
    assert maxent_scores(no_docs, F.lit(True)).count() == 0


def test_languages(corpus, odd_docs, no_docs):
    docs = corpus[0]
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit_languages(docs.where(fold != 2))
    assert model.languages == ["aa", "bb"] and model.temperature > 0
    rows = docs.select("doc_id", "lang", predict_language(F.col("text"), model).alias("x")).collect()
    assert np.mean([r.x.lang == r.lang for r in rows if held_out(r.doc_id, 4, 2)]) > 0.98
    assert (np.abs(model.weights).sum(axis=1) == 0).mean() > 0.5  # sparse

    odd = {r.text: r.x for r in odd_docs.select("text", predict_language(F.col("text"), fit_languages(odd_docs)).alias("x")).collect()}
    assert all(odd[x].lang == "und" for x in (None, "", " \t\n", "..."))
    assert odd["one two three"].lang in ("en", "de", "fr") and 0 <= odd["one two three"].score <= 1
    assert {r.x.lang for r in odd_docs.select(predict_language(F.col("text"), fit_languages(no_docs)).alias("x")).collect()} == {"und"}
