"""Licence notices, benchmark copies, main text, neighbours and fixity."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastlane.llm import decontaminate, fixity, neighbours
from pastlane.llm.decontaminate import align, contamination
from pastlane.llm.fixity import audit_records
from pastlane.llm.html import best_paths, blocks, extract_main_text, host_paths, main_text
from pastlane.llm.licenses import BASE, NOTICES, Notices, licence_scan, scan
from pastlane.llm.neighbours import nearest


def test_base_phrases_by_hand(odd_docs, spark):
    draw = random.Random(4)
    pieces = ["CC-BY", "cc by cc BY", "General Public\n License", "all rights reserved", "all. rights", "word", "é", "cc", "by", "4.0"]
    rows = [(i, " ".join(draw.choice(pieces) for _ in range(draw.randrange(30)))) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    for row in frame.select("text", licence_scan(F.col("text")).alias("x")).collect():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), row.text or ""))
        starts, labels = [], set()
        for phrase, label in BASE.items():
            own = phrase.split()
            at = [k for k in range(len(words)) if words[k:k + len(own)] == own]
            starts += at
            labels |= {label} if at else set()
        assert row.x.n_words == len(words) and row.x.n_base == len(starts)
        assert (row.x.first_word, row.x.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert row.x.base_labels == sorted(labels)


@pytest.mark.parametrize("notice, label", NOTICES)
def test_misspelled_notices(notice, label):
    made = Notices(NOTICES)
    wrong = notice[:5] + notice[6:-3] + "x" + notice[-2:]  # a letter left out, one exchanged
    if len(notice) >= 16:
        found = scan(f"foo {wrong}, bar", made)["spans"]
        assert any(x["label"] == label and 0 < x["edits"] <= 2 and x["first_word"] == 1 for x in found)
    assert any(x["label"] == label and x["edits"] == 0 for x in scan(f"Foo. {notice.upper()}!", made)["spans"])
    assert scan("licence terms are unknown here and all lights observed", made)["spans"] == []


@pytest.mark.parametrize("name", ["mit", "bsd", "isc", "gpl"])
def test_names_are_not_read_as_others(name):
    made = Notices(NOTICES)
    for verb in ("licensed", "released"):
        spans = scan(f"this is {verb} under the {name} license", made)["spans"]
        assert [(x["label"], x["edits"], x["first_word"], x["last_word"]) for x in spans] == [(name, 0, 2, 6)]
        assert [x["label"] for x in scan(f"{verb} undr the {name} licence", made)["spans"]] == [name]
        assert scan(f"{verb} under the xyz license", made)["spans"] == []
    assert [x["label"] for x in scan("licensed under the apach license", made)["spans"]] == ["apache"]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_spans_of_random_edits_by_brute_force():
    """Every span is as far from its notice as it says, and words and places are those of the text."""
    draw, made = random.Random(12), Notices(NOTICES)
    for _ in range(60):
        text = []
        for _ in range(draw.randrange(1, 5)):
            notice = list(draw.choice(NOTICES)[0])
            for _ in range(draw.randrange(3)):
                notice[draw.randrange(len(notice))] = draw.choice("aeixyz")
            text += [draw.choice(["foo bar", "zz", "é 4"]), "".join(notice)]
        found = scan(". ".join(text), made)
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ". ".join(text))
        for span in found["spans"]:
            own = " ".join(words[span["first_word"]:span["last_word"] + 1])
            assert own == span["found"] and _distance(own, span["notice"]) - 1 <= span["edits"] <= len(span["notice"]) // 8
        ends = [(x["first_word"], x["last_word"]) for x in found["spans"]]
        assert all(a[1] < b[0] or a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_many_notices_take_time_in_proportion(no_docs):
    made = Notices(NOTICES)
    text = "all rights reservd and " * 100_000
    start = time.perf_counter()
    assert len(scan(text, made)["spans"]) == 100_000
    assert time.perf_counter() - start < 20
    assert no_docs.select(licence_scan(F.col("text"))).count() == 0


def test_two_places_and_the_nearer_of_two_notices():
    spans = scan("released under the mit license. all rights reservd and all right reserved", Notices(NOTICES))["spans"]
    assert [(x["label"], x["edits"]) for x in spans] == [("mit", 0), ("reserved", 1), ("reserved", 1)]


def _smith_waterman(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = max(0, table[i, j] + (2 if a[i] == b[j] else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
    return table.max() / (2 * len(a))


def test_alignment_as_the_table():
    draw = random.Random(1)
    for _ in range(200):
        a, b = (np.array([draw.randrange(7) for _ in range(draw.randrange(1, 16))]) for _ in range(2))
        score, first, last = align(a, b)
        assert abs(score - _smith_waterman(a, b)) < 1e-9
        if score:
            assert abs(_smith_waterman(a, b[first:last + 1]) - score) < 1e-9


def test_blocks_are_broadcast_one_after_the_other(spark, monkeypatch):
    """Twenty blocks of items; a block's broadcast is gone before the next is made."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    alive, most, made = set(), [], []
    broadcast = type(spark.sparkContext).broadcast

    def counted(self, value):
        shared = broadcast(self, value)
        if isinstance(value, decontaminate.Items):
            alive.add(id(shared))
            made.append(value)
            most.append(len(alive))
            destroy = shared.destroy
            shared.destroy = lambda *args: (alive.discard(id(shared)), destroy(*args))
        return shared

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    draw = random.Random(3)
    items = [(k, " ".join(f"w{draw.randrange(10**6)}" for _ in range(20))) for k in range(60)]
    docs = [(k, f"before {items[k % 60][1]} and {items[(k + 7) % 60][1]} after", 1, k) for k in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, matches int, row int")
    rows = contamination(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, m.item_id) for r in rows for m in r.matches_} == {(k, j % 60) for k in range(100) for j in (k, k + 7)}
    assert all(r.matches == 1 and r.row == r.doc_id for r in rows) and max(most) == 1 and len(made) >= 2 * 20


@pytest.mark.parametrize("block_words", [1 << 19, 20])
def test_copies_of_items(spark, odd_docs, no_docs, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(draw.randrange(15, 40))] for _ in range(12)]
    docs, planted = [], set()
    for i in range(120):
        text = [word() for _ in range(60)]
        if i % 3 == 0:
            k = i % 12
            copy = [x if draw.random() > 0.12 * (i % 2) else word() for x in items[k] if draw.random() > 0.05 * (i % 2)]
            text[20:20] = copy
            planted.add((i, k))
        docs.append((i, " ".join(text).upper() if i % 5 == 0 else ", ".join(text)))
    rows = [(k, " ".join(x)) for k, x in enumerate(items)]
    rows += [(100, None), (101, ""), (102, "..."), (103, "qq"), (104, "zz yy"), (0, rows[0][1])]
    table = spark.createDataFrame(rows, "item_id long, text string")
    frame = spark.createDataFrame([*docs, (500, "the QQ is here"), (501, "zz. yy")], "doc_id long, text string")
    found = {(r.doc_id, m.item_id) for r in contamination(frame, table).collect() for m in r.matches}
    assert found == planted | {(500, 103), (501, 104)}
    assert all(r.matches == [] for r in contamination(odd_docs, table).collect())
    assert contamination(no_docs, table).count() == 0
    assert all(r.matches == [] for r in contamination(odd_docs, table.limit(0)).collect())


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body class="c7"><header><h1>Site</h1></header><nav><a>menu</a></nav>
<div class="wrap"><div class="{css}"><h2>Title &amp; {k}</h2><p>{text} <a href=x>link</a>.<p>Second&nbsp;one<br>here</div>
<div class="comments"><p>reader comment of some length, longer than the text of the page itself, so it counts</p></div></div>
<aside>side</aside><form><p>form</p></form><script>var t="</p>";</script><footer>foot</footer></body></html>"""


def test_hosts_agree_on_a_path(spark):
    pages = [(k, f"http://WWW.a.org/{k}", PAGE.format(css=f"post-{k}", k=k, text="words of the article " * 12)) for k in range(5)]
    pages += [(5, "http://www.a.org/short", PAGE.format(css="post-9", k=5, text="x")), (6, "http://b.org", "<p>only text"),
              (7, None, None), (8, "no url", ""), (0, "http://WWW.a.org/0", pages[0][2])]
    frame = spark.createDataFrame([(*x, "h", "p") for x in pages], "page_id long, url string, html string, host string, path string")
    paths = {r.host: r.path for r in host_paths(frame).collect()}
    assert paths["www.a.org"].endswith("div.wrap>div.post-N")
    rows = extract_main_text(frame).collect()
    assert len(rows) == len(pages)
    text = {r.page_id: r.main_text for r in rows}
    assert text[1] == "Title & 1\n\n" + " ".join(["words of the article"] * 12) + " link.\n\nSecond one here"
    assert text[5] == "Title & 5\n\nx link.\n\nSecond one here"
    assert (text[6], text[7], text[8]) == ("only text", "", "")
    assert extract_main_text(frame.limit(0)).count() == 0


def test_broken_and_deep_pages():
    assert main_text("<p>a < b and 3 <4</p><div hidden>no</div>plain &eacute; &#x41;", None) == "a < b and 3 <4\n\nplain é A"
    assert main_text("<article><p>text <script>if (a < b) {", None) == "text"
    assert main_text("<div>" * 20_000 + "deep", None) == "deep"
    assert best_paths(blocks("<article><p>" + "long text " * 20)) [0][0] == ">article"


@pytest.mark.parametrize("open_, close", [
    ("<div class='site-inner has-sidebar'><div class='content'>", "</div></div>"), ("<div class='content-sidebar-wrap'><article>", "</article></div>"),
    ("<main class='no-sidebar'>", "</main>"), ("<article class='post comments-open'>", "</article>"), ("<div class='widget'><main>", "</main></div>"),
    ("<div id='no-sidebar'><main class='has-header'><article class='post comments-open'>", "</article></main></div>")])
def test_wrappers_named_after_what_they_lack(open_, close):
    story = "The words of the story. " * 12
    page = (f"<html><body><div class='menu'>home</div>{open_}<p>{story}</p><div class='ad'>buy</div>{close}"
            "<div class='comments'><article class='comment'>first!</article></div><div class='sidebar'>other</div></body></html>")
    assert main_text(page, None) == story.strip()
    assert main_text(page, best_paths(blocks(page))[0][0]) == story.strip()


@pytest.mark.parametrize("name", ["related-work", "share-price-table", "form-of-government", "search-algorithms-compared"])
def test_parts_of_an_article_stay(name):
    page = f"<html><body><article><p>one</p><section class='{name}'><p>two</p></section><p>three</p></article></body></html>"
    assert main_text(page, None) == "one\n\ntwo\n\nthree"


@pytest.mark.parametrize("name", ["related-posts", "share-buttons", "social", "comments-area", "ad-slot", "newsletter-signup box", "comment_list"])
def test_what_is_not_the_article_goes_from_it(name):
    page = f"<html><body><article><p>one</p><div class='{name}'><p>two</p></div><p>three</p></article></body></html>"
    assert main_text(page, None) == "one\n\nthree"


def test_input_columns_stay(spark):
    row = (1, "http://a.org", "<p>text</p>", "h", "p", "m")
    frame = spark.createDataFrame([row], "page_id long, url string, html string, __host string, __path string, main_text string")
    made = extract_main_text(frame)
    assert made.columns == [*frame.columns, "main_text_"] and tuple(made.first()) == (*row, "text")


def test_nothing_but_marked_elements():
    assert main_text("<div class='widget'><p>All there is to read.</p></div>", None) == "All there is to read."
    assert main_text("<div class='widget'><p>Not this one, though it is longer.</p></div><p>This.</p>", None) == "This."


@pytest.mark.parametrize("tag", ["svg", "math", "select", "object", "canvas"])
def test_elements_without_text_end(tag):
    assert main_text(f"<article><p>one <{tag} width='1'/>two</p><p>three</p></article>", None) == "one two\n\nthree"
    assert main_text(f"<article><p>one <{tag}><b>not</b></{tag}>two</p></article>", None) == "one two"
    assert main_text(f"<article><p>one <{tag}>not</p><p>three</p></article>", None) == "one\n\nthree"


def test_end_tag_after_many_open_ones():
    assert main_text("<nav>" + "<b>x" * 500 + "</nav><article><p>the article</p></article>", None) == "the article"
    assert main_text("<a><div>" + "<b>" * 50_000 + "</a>" * 50_000 + "text</div>", None) == "text"


def _brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 4:
            good[i] = min(good.get(i, v), v)
    ids = np.array(sorted(good))
    vectors = np.array([good[i] for i in ids])
    found = []
    for q in ids[ids % 20 == 0]:
        score = vectors @ good[q]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        found += [(q, r + 1, ids[j], round(float(score[j]), 9)) for r, j in enumerate(order)]
    return sorted(found)


@pytest.mark.parametrize("piece", [8192, 16])
def test_neighbours(spark, monkeypatch, piece):
    monkeypatch.setattr(neighbours, "PIECE_ROWS", piece)
    monkeypatch.setattr(neighbours, "CONFIDENCE", 0.9999)
    draw = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in draw.standard_normal(4)]) for i in range(200)]
    rows += [(i, [1.0, 2.0, 0.5, 0.25]) for i in range(200, 260)]  # ties
    rows += [(300, None), (320, []), (340, [0.0] * 4), (360, [1.0, None, 0.0, 0.0]), (380, [float("nan"), 1.0, 1.0, 1.0]),
             (400, [float("inf"), 1.0, 1.0, 1.0]), (420, [1.0] * 3), (None, [1.0] * 4), (20, rows[20][1])]
    frame = spark.createDataFrame([(*x, "a", 1) for x in rows], "vec_id long, embedding array<float>, id string, rank int")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in nearest(frame, lambda key: key % 20 == 0, k=5).collect())
    assert got == _brute(rows, 5)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], schema)
    assert [(r.vec_id, r.rank) for r in nearest(three, lambda key: key == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert nearest(three.limit(0), lambda key: key == 0).count() == 0


def test_recall_of_the_stop(spark, monkeypatch):
    """In many cells and partitions: the keys of both sides must be of one type to meet."""
    monkeypatch.setattr(neighbours, "PIECE_ROWS", 200)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    draw = np.random.default_rng(8)
    vectors = draw.standard_normal((3000, 24)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows = nearest(frame, lambda key: key % 100 == 0).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    exact = vectors.astype(float) @ vectors[::100].astype(float).T
    hits = 0
    for k, q in enumerate(range(0, 3000, 100)):
        score = exact[:, k].copy()
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & {r.vec_id for r in rows if r.query_id == q})
    assert hits / (20 * 30) >= 0.9


def test_the_stop_rules_out_half():
    """A query verifies less than half of as many points as there are, and finds nine of ten of the nearest."""
    draw = np.random.default_rng(5)
    vectors = draw.standard_normal((8000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    project = neighbours.Projection(64, 1.0)
    piece = neighbours.Piece(np.arange(8000), vectors, project.points(vectors))
    limit, hits = neighbours.chi_square_limit(neighbours.CONFIDENCE, neighbours.DIMENSIONS), 0
    for q in range(50):
        ids, scores = piece.search(q, vectors[q], project.queries(vectors[q:q + 1])[0], np.inf, 20, 1.0, limit)
        exact = vectors @ vectors[q]
        exact[q] = -np.inf
        hits += len(set(np.argsort(-exact)[:20]) & set(ids.tolist()))
        assert np.allclose(scores, exact[ids])
    assert hits / 1000 >= 0.9 and piece.verified < 50 * 8000 / 2


def test_fixity(spark):
    rows = [(i, f"u{i}", "x" * (i % 7)) for i in range(600)] + [(None, "a", "b"), (3, "twice", None), (40, None, ""), (-5, "n", "n")]
    schema = "page_id long, url string, html string"
    changed = [(i, u, h) for i, u, h in rows if i != 17]
    changed = [(i, u, "y" if i == 250 else None if i == 40 and h == "" else h) for i, u, h in changed] + [(9000, "new", "p")]
    first, second = (spark.createDataFrame(x, schema) for x in (rows, changed[::-1]))
    columns = ["page_id", "url", "html"]
    found = {(r.file, r.node): (r.state, r.n_primary, r.n_replica) for r in audit_records(first, second, "page_id", columns).collect()}
    assert found == {("records", 17): ("missing", 1, 0), ("records", 250): ("changed", 1, 1), ("records", 40): ("changed", 2, 2),
                     ("records", 9000): ("extra", 0, 1)}
    assert audit_records(first, first.repartition(3), "page_id", columns).count() == 0
    assert audit_records(first, first.limit(0), "page_id", columns).where("state = 'missing'").count() == 602
    assert audit_records(first.limit(0), first.limit(0), "page_id", columns).count() == 0
    assert fixity.FAN_BITS == 4
