"""DuckDB SQL for queries whose rows it can express; nothing here is taken from the operators.

Trees, windows and components are spelled out by all pairs, all windows or one join a level, for
tables of test size.
"""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of a decimal id, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""


def merkle(levels: int = 7, upper: int = 4) -> str:
    """op12: up to 8^levels rows a language and 8^upper languages."""
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field('n_chars')} || {field(text)})"
    parts = [
        f"""d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('+' || lang, '') AS g, {leaf('text')} AS leaf,
  CASE WHEN {CRC.format('doc_id')} % 3 = 0 THEN {leaf(LOWER.format('text'))} END AS altered FROM documents)""",
        """p0 AS (SELECT r, doc_id, g, leaf, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS j,
  coalesce(altered, leaf) AS f, '' AS s FROM d)""",
        "n0 AS (SELECT g, j AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p0)",
    ]

    def climb(p: str, n: str, k: int) -> list[str]:
        return [
            f"""{n}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (n + 7) // 8 AS n
  FROM {n}{k} GROUP BY g, {n}{k}.i // 8, n)""",
            f"""{p}{k + 1} AS (SELECT p.r, p.doc_id, p.g, p.leaf, p.j // 8 AS j,
  CASE WHEN n = 1 THEN p.f ELSE sha256(string_agg(CASE WHEN t.i = p.j THEN p.f ELSE t.h END, '' ORDER BY t.i)) END AS f,
  p.s || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> p.j), '') AS s
  FROM {p}{k} p JOIN {n}{k} t ON t.g = p.g AND t.i // 8 = p.j // 8 GROUP BY p.r, p.doc_id, p.g, p.leaf, p.j, p.f, p.s, n)""",
        ]

    for k in range(levels):
        parts += climb("p", "n", k)
    parts += [
        f"roots AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM n{levels})",
        f"q0 AS (SELECT p.r, p.doc_id, '' AS g, p.leaf, u.place AS j, p.f, p.s FROM p{levels} p JOIN roots u ON u.lang = p.g)",
        "m0 AS (SELECT '' AS g, place AS i, subroot AS h, count(*) OVER () AS n FROM roots)",
    ]
    for k in range(upper):
        parts += climb("q", "m", k)
    return f"""WITH {', '.join(parts)}
SELECT q.doc_id, q.leaf, u.subroot, m.h AS root, sha256(q.s) AS proof_sha256, q.f AS folded_root, q.f = m.h AS verified
FROM q{upper} q CROSS JOIN m{upper} m JOIN d ON d.r = q.r JOIN roots u ON u.lang = d.g"""


DIVERGENCE = f"""WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
grp AS (SELECT DISTINCT lang, source FROM docs),
uses AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(u.c, 0) AS c FROM grp g JOIN kept k USING (lang) LEFT JOIN uses u USING (lang, source, term)),
shares AS (SELECT *, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w) AS p FROM cells WINDOW w AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(c) AS c FROM cells GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w) AS q FROM whole WINDOW w AS (PARTITION BY lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
over_used AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM over_used)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 50"""

#: Smallest id reachable over ``link(a, b)``, both directions listed.
REACH = """reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS s FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
{REACH}
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = s.doc_id), s.doc_id)) AS component_id FROM sets s"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
{REACH},
r AS (SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id FROM v)
SELECT *, vec_id = component_id AS kept FROM r"""

SUFFIXES = """WITH t AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 399)) AS pos FROM t WHERE length(h) >= 800),
w AS (SELECT doc_id, pos, md5_number(substr(h, 2 * pos + 1, 800)) AS m FROM starts JOIN t USING (doc_id)),
again AS (SELECT doc_id, pos FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
edges AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 400 THEN 0 ELSE 1 END AS begins FROM again),
runs AS (SELECT doc_id, min(pos) AS b, max(pos) + 400 AS e FROM (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM edges) GROUP BY doc_id, run),
pieces AS (SELECT doc_id, b, coalesce(lag(e) OVER o, 0) AS last, e FROM runs WINDOW o AS (PARTITION BY doc_id ORDER BY b)),
cuts AS (SELECT doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS tail,
  string_agg(substr(h, 2 * last + 1, 2 * (b - last)), '' ORDER BY b) AS kept FROM pieces JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * tail + 1), h))) AS kept_sha256
FROM t LEFT JOIN cuts USING (doc_id)"""

ORACLE_SQL = {
    "op4_embeddings": EMBEDDINGS,
    "op5_suffix_dedup": SUFFIXES,
    "op9_jaccard": JACCARD,
    "op12_merkle": merkle(),
    "op13_divergence": DIVERGENCE,
}
