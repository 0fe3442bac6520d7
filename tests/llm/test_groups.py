"""Operators 11 to 13 against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastlane.llm.mixing import fitted, knapsack, mix_sources
from pastlane.llm.prefixes import TURN, packed_turns, prefix_trie, rebuilt_turns
from pastlane.llm.spellings import near_words, spelling_forms, spelling_variants, word_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 11


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_forms(counts):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best
    rows = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return rows


def brute_words(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def as_rows(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_of_random_words_equal_brute_force(spark):
    rng = random.Random(5)
    counts = {}
    for _ in range(900):  # few letters, so that many are near, and anagrams many
        word = "".join(rng.choice("abcéÉx") for _ in range(rng.choice([5, 6, 6, 7, 8])))
        counts[word] = rng.choice([3, 4, 5, 8, 20, 70])
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_rows(spelling_forms(frame)) == brute_forms(counts)


def test_hubs_that_are_too_large_are_cut_by_more_groups(spark):
    words = ["".join(p) + tail for p in itertools.product("abcd", repeat=4) for tail in ("ee", "f")]
    counts = {w: 3 + i % 11 for i, w in enumerate(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    few = {tuple(r) for r in near_words(frame, hub_words=10).collect()}
    assert few == {tuple(r) for r in near_words(frame).collect()}
    assert sum(r[1] for r in few) == sum(one_edit(a, b) for a in words for b in words)


def test_words_of_documents_and_slips(spark):
    rng = random.Random(2)
    vocabulary = ["Straße", "Ärgern", "ärgern", "house", "houses", "HOUSE", "spelling", "speling", "a", "élève", "eleve", "x×y÷zéé"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(60)) + ". 'HOUSES'_house1houses") for i in range(40)]
    docs += [(None, "house houses house"), (7, None), (8, ""), (9, "9 ... 9"), (11, "w" * 30_000)] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(None))
    counts = brute_words(docs)
    assert any(w not in map(str.lower, vocabulary) for w in counts) and "w" * 30_000 in counts
    assert as_rows(spelling_variants(frame, slip=97)) == brute_forms(counts)


def test_ties_and_chains_of_forms(spark):
    counts = {"abcde": 3, "abcdf": 10, "abcdg": 10, "abcdff": 40, "abcdfff": 100, "zzzzz": 3, "zzzzy": 5}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r[0]: r for r in as_rows(spelling_forms(frame))}
    assert found["abcde"] == ("abcde", "abcdf", "abcdfff", 3, 2, 10)
    assert found["zzzzz"] == ("zzzzz", None, "zzzzz", 3, 1, None)
    assert set(found.values()) == brute_forms(counts)


def test_no_words(spark, no_docs, odd_docs):
    assert spelling_variants(no_docs).count() == 0
    assert word_counts(no_docs).count() == 0
    rows = spelling_variants(odd_docs, slip=97).collect()
    assert {r.word for r in rows} == set(brute_words([(r.doc_id, r.text) for r in odd_docs.collect()]))


# --- 12


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(family, [])[:h] + own[c][h:])
    nodes, ends, children = defaultdict(list), defaultdict(list), Counter()
    for c, path in sorted(built.items()):
        ends[path].append(c)
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for path, members in nodes.items():
        words = len(WORD.findall(path[-1][1])) * (len(members) - 1) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += words
    return sorted((min(m), len(p), -1 if not p else min(nodes[p[:-1]]), len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p, m in nodes.items())


def trie_of(spark, rows, **settings):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumn("path", F.lit("x")).withColumn("turns", F.lit(1)).withColumn("key", F.lit(None))
    found = prefix_trie(rebuilt_turns(packed_turns(frame)), **settings).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                   r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found)


def some_talks():
    rng = random.Random(9)
    rows = []
    for c in range(-45, 260):
        if c % 60 == 0:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 5])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["yes", "yes yes", "no  no\tno", "", "what then"])))
    rows += [(300 + c, t, "user", "a copy of a talk") for c in range(90) for t in range(4)]
    rows += [(400, t, "user", f"turn {t}") for t in range(300)]
    rows += [(401, t, "user", f"turn {t}" if t < 250 else "other") for t in range(300)]
    return rows


@pytest.mark.parametrize("run_turns", [1, 40, 1 << 16])
def test_trie_equals_brute_force(spark, run_turns):
    rows = some_talks()
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shards
    try:
        assert trie_of(spark, rows, run_turns=run_turns) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, None, ""),
            (None, 0, "user", "lost"), (20, 0, "", None), (21, 5, "user", "long word " * 50_000), (39, 1, "x", "y"), (-3, 0, "user", "é")]
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, []) == []


def test_turns_are_packed_as_digests_and_word_counts(spark):
    frame = spark.createDataFrame([(1, 0, "user", "one two")], "conv_id long, turn long, role string, text string")
    turns = packed_turns(frame).first().turns
    assert len(turns) == 1 and len(bytes.fromhex(turns[0])) == TURN and int(turns[0][32:], 16) == 2


# --- 13


def brute_targets(sizes, share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, excess, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while excess > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += excess * weight[s] / total
        excess = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def mixed(frame, **settings):
    return [r.asDict() for r in mix_sources(frame, **settings).collect()]


def test_knapsack_finds_the_nearest_sum():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = np.unique(rng.integers(0, 14, rng.integers(1, 6))).astype(np.int64)
        counts = rng.integers(0, 4, len(sizes)).astype(np.int64)
        budget = int(rng.integers(0, 70))
        taken = knapsack(sizes, counts, budget)
        sums = {sum(s * k for s, k in zip(sizes, picks)) for picks in itertools.product(*(range(n + 1) for n in counts))}
        assert (taken <= counts).all() and abs(int((taken * sizes).sum()) - budget) == min(abs(s - budget) for s in sums)


@pytest.mark.parametrize("budget", [0, 1, 999, 700_000, 3_333_333, 4_999_999, 10**9])
def test_budget_beyond_the_window_is_met(budget):
    sizes, counts = np.arange(0, 1000, dtype=np.int64), np.full(1000, 10, np.int64)
    taken = fitted(sizes, counts, budget, window=1 << 10)
    assert (taken <= counts).all() and (taken * sizes).sum() == min(budget, (sizes * counts).sum())


def test_one_long_document_can_be_nearest():
    assert fitted(np.array([310_000]), np.array([1]), 300_000, window=1 << 10).tolist() == [1]
    assert fitted(np.array([310_000]), np.array([1]), 100_000, window=1 << 10).tolist() == [0]


@pytest.mark.parametrize("window", [1 << 10, 1 << 18])
def test_half_a_word_makes_a_tie(window):
    assert fitted(np.array([100_001]), np.array([1]), 50_000.5, window=window).tolist() == [0]
    assert fitted(np.array([100_001]), np.array([1]), 50_001.5, window=window).tolist() == [1]
    assert fitted(np.array([2, 3]), np.array([1, 1]), 2.5, window=window).tolist() == [1, 0]


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):  # one source and one length have a third each
        source = rng.choice(["hot"] * 4 + ["a", "Z", "é", "b", "", None])
        rows.append((i, source, "w " * (7 if i % 3 == 0 else rng.choice([0, 1, 2, 5, 30, 31, 200]))))
    rows += [(None, "a", None), (5, "a", "w w"), (5, "a", "w w")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    clash = frame.withColumn("size", F.lit("x")).withColumn("position", F.lit(0)).withColumn("piece", F.lit(0)).withColumn("id", F.lit(1))
    found = mixed(clash)
    assert len(found) == len(rows)
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len((text or "").split())
    targets, taken = brute_targets(sizes), Counter()
    for row in found:
        assert row["source_size"] == sizes[row["source"]] and 0 <= row["copies"] <= 2
        assert row["target"] == pytest.approx(targets[row["source"]])
        taken[row["source"]] += row["copies"] * row["size"]
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1, (source, taken[source], target)
    def order(found):
        return sorted((str(r["id"]), str(r["source"]), r["size"], r["copies"]) for r in found)

    assert order(mixed(clash.repartition(7))) == order(found)
    assert order(mixed(clash, seed=1)) != order(found)
    few = Counter()
    for row in mixed(clash, pieces=2):
        few[row["source"]] += row["copies"] * row["size"]
    assert few == taken


def test_mix_of_little(spark, no_docs):
    assert mixed(no_docs) == []
    empty = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [(r["size"], r["source_size"], r["target"], r["copies"]) for r in mixed(empty)] == [(0, 0, 0.0, 0)] * 2
    one = spark.createDataFrame([(1, "a", "word " * 100_001)], "doc_id long, source string, text string")
    assert [r["copies"] for r in mixed(one)] == [1]
