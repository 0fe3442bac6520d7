"""DuckDB forms of the longer queries."""

from __future__ import annotations

# Bit by bit, the table of the CRC-32 of each byte, and the CRC-32 of a text as a whole.
CRC32 = """
    CREATE_TABLE AS (
        SELECT list(entry ORDER BY byte) AS entries FROM (
            SELECT byte, list_reduce(list_prepend(byte, range(8)), lambda c, k:
                CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry
            FROM range(256) AS bytes(byte)))
"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text of code points below 2,048; needs the table ``crc_table`` (entries)."""
    code = f"list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT)"
    utf8 = (f"flatten(list_transform({code}, lambda x: CASE WHEN x < 128 THEN [x] "
            "ELSE [192 + (x >> 6), 128 + (x & 63)] END))")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {utf8}), lambda c, b: "
            "xor(entries[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)")


CRC_TABLE = CRC32.replace("CREATE_TABLE", "crc_table").strip()

WORD = r"[^\x20\x09-\x0D]+"

SPELLING_VARIANTS = f"""
    WITH RECURSIVE {CRC_TABLE},
    raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    runs AS (
        SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
        FROM raw WHERE length(run) >= 5 GROUP BY ALL),
    hashed AS (SELECT run, c, {crc32("concat(doc_id, ':', run)")} AS h FROM runs, crc_table),
    words AS (
        SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
               sum(c)::BIGINT AS n
        FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3),
    masked AS (
        SELECT word, left(word, i - 1) || chr(1) || substr(word, i + 1) AS mask, left(word, i - 1) || substr(word, i + 1) AS less
        FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
    less AS (SELECT DISTINCT m.word, w.word AS near FROM masked m JOIN words w ON m.less = w.word),
    pairs AS (
        SELECT a.word, b.word AS near FROM masked a JOIN masked b ON a.mask = b.mask AND a.word <> b.word
        UNION ALL SELECT word, near FROM less UNION ALL SELECT near, word FROM less),
    best AS (
        SELECT p.word, count(*) AS n_near, min({{'less': -w.n, 'near': p.near}}) AS best
        FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
    forms AS (
        SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
               CASE WHEN -best.less >= 2 * w.n THEN best.near END AS form, CASE WHEN -best.less >= 2 * w.n THEN -best.less END AS form_n
        FROM words w LEFT JOIN best b ON b.word = w.word),
    ways(word, stop) AS (
        SELECT word, word FROM forms
        UNION ALL SELECT ways.word, f.form FROM ways JOIN forms f ON f.word = ways.stop WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, ways.stop AS root, f.n, f.n_near, f.form_n
    FROM forms f JOIN ways ON ways.word = f.word JOIN forms top ON top.word = ways.stop AND top.form IS NULL
"""

PREFIX_TRIE = f"""
    WITH {CRC_TABLE},
    turns AS (
        SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
               left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS tie
        FROM conversations WHERE conv_id IS NOT NULL),
    packed AS (SELECT conv_id, list(said ORDER BY turn NULLS FIRST, tie) AS said FROM turns GROUP BY conv_id),
    heads AS (SELECT *, {crc32("conv_id::VARCHAR")} % 4 AS h FROM packed, crc_table),
    rebuilt AS (
        SELECT c.conv_id, list_concat(coalesce(f.said[1:c.h], []), c.said[c.h + 1:]) AS said
        FROM heads c LEFT JOIN packed f ON f.conv_id = c.conv_id - c.conv_id % 20),
    nodes AS (
        SELECT said[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs
        FROM rebuilt, unnest(range(0, len(said) + 1)) AS t(d) GROUP BY ALL),
    children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    weighed AS (
        SELECT nodes.*, coalesce(children.n, 0) AS n_children,
               CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(nodes.path[depth].text, '{WORD}')) END AS saved
        FROM nodes LEFT JOIN children ON children.path = nodes.path),
    subtrees AS (
        SELECT path[1:d] AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
        FROM weighed, unnest(range(0, depth + 1)) AS t(d) GROUP BY 1),
    ends AS (SELECT said AS path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM rebuilt GROUP BY 1)
    SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens,
           coalesce(e.ends, sha256('')) AS ends_sha256
    FROM weighed w JOIN subtrees s ON s.path = w.path LEFT JOIN ends e ON e.path = w.path
    LEFT JOIN nodes p ON w.depth > 0 AND p.path = w.path[1:w.depth - 1]
"""
