"""DuckDB SQL for those queries that SQL can express, stated apart from the operators."""

from __future__ import annotations

from .secret_scan import BASE, RULES

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT item, least(10, len(w)) AS n, unnest(list_transform(range(0, len(w) - least(10, len(w)) + 1), lambda a: list_slice(w, a + 1, a + least(10, len(w))))) AS span FROM item WHERE len(w) > 0),
doc AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '{_WORD}'), []) AS w FROM documents),
place AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS p, w FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT DISTINCT doc_id, p, win.n, item FROM place JOIN win ON place.n = win.n AND list_slice(w, p + 1, p + place.n) = span),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _secret_spans(rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return (
        f"SELECT doc_id, {rank} AS r, '{rule.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'n': length(m[i]), 'g': length(g[i])}}), lambda x: x.g >= {rule.least})) AS x"
        f" FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g, string_split_regex(text, '{pattern}') AS p FROM documents WHERE text IS NOT NULL)"
    )


SECRETS = f"""
WITH found AS ({" UNION ALL ".join(_secret_spans(r, k) for k, r in enumerate(RULES))}),
line AS (SELECT doc_id, r, kind, x.s AS s, kind || ':' || x.s || ':' || (x.s + x.n) AS t FROM found),
per AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)}, string_agg(t, ',' ORDER BY s, r) FILTER (r < {len(BASE)}) AS base, string_agg(t, ',' ORDER BY s, r) AS spans FROM line GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)
"""

_GAP = r"[^\x20\x09-\x0D]+"

JACCARD = f"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '{_GAP}'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(0, len(w) - 3), lambda i: array_to_string(list_slice(w, i + 1, i + 4), ' ')) END) AS s FROM doc),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT pair.a, pair.b FROM pair JOIN size x ON x.doc_id = pair.a JOIN size y ON y.doc_id = pair.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, least(doc.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = doc.doc_id), doc.doc_id)) AS component_id
FROM doc LEFT JOIN size USING (doc_id)
"""

ORACLE_SQL = {"op2_decontamination": DECONTAMINATION, "op5_jaccard_join": JACCARD, "op7_secret_scan": SECRETS}
