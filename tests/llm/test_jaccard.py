import random
import re

import numpy as np
import pytest

from pastlane.llm import jaccard
from pastlane.llm.components import components
from pastlane.llm.jaccard import jaccard_components


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4)))


def brute(rows):
    """(doc_id, n, component) by every pair."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def found(frame):
    return sorted(((r.id, r.n, r.component) for r in jaccard_components(frame).collect()), key=str)


def made_rows():
    """Near copies with one to many edits, a passage that many share, and texts of a few words."""
    draw = random.Random(5)
    word = lambda: draw.choice("abcdefgh") + str(draw.randrange(400))
    rows, passage = [], [word() for _ in range(30)]
    for _ in range(8):
        base = [word() for _ in range(draw.choice([6, 12, 40, 90]))]
        for _ in range(draw.choice([1, 3, 14])):
            text = list(base)
            for _ in range(draw.randrange(4)):
                text[draw.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rows += [" ".join(passage + [word() for _ in range(draw.randrange(1, 25))]) for _ in range(40)]
    rows += ["a b c", "A b  c", "a b c d", "", "x"]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("part, leaf, bits", [(1 << 19, 16, 1 << 25), (60, 2, 0)])
def test_as_every_pair(spark, monkeypatch, part, leaf, bits):
    for name, value in (("SLICE", part), ("LEAF", leaf), ("BITS", bits), ("FREQUENT", 2), ("SAMPLED", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rows = made_rows()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_a_large_group_that_hardly_links(spark, monkeypatch):
    """Copies of one text with so many edits that most of them do not link; no table is larger than their places in units."""
    sizes = {}
    written = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda frame, name: sizes.__setitem__(name, (made := written(frame, name)).count()) or made)
    draw = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(500):
        text = list(base)
        for _ in range(draw.choice([0, 1, 3, 3, 3, 4])):
            text[draw.randrange(len(text))] = f"x{draw.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    rows += [(1000 + k, rows[k][1]) for k in range(0, 500, 2)]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert 1 < len({c for _, _, c in want}) < 400
    assert sizes["found"] <= sizes["searched-units"] <= 500 * 30 and sizes["pairs"] <= 500


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs) == brute(rows)
    assert found(no_docs) == []


def test_bounds_are_never_too_small():
    draw = random.Random(2)
    for _ in range(200):
        a = np.array(sorted(draw.sample(range(3000), draw.randrange(1, 900))), np.uint64)
        b = np.array(sorted(set(draw.sample(list(a), len(a) * 9 // 10)) | set(draw.sample(range(3000), 20))), np.uint64)
        links = 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
        may = jaccard.may_link(jaccard.count_vector(a), len(a), jaccard.count_vector(b), len(b))
        assert may or not links


def test_components_of_a_chain(spark):
    chain = [(k, k + 1) for k in range(20)] + [(100, 101), (101, 102), (7, 7)]
    rows = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert rows == {**{k: 0 for k in range(1, 21)}, 101: 100, 102: 100}
