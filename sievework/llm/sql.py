"""SQL for DuckDB of the pN_ queries that SQL can say over whole tables in reasonable time."""

from __future__ import annotations

#: Full-width forms and what compatibility folding makes of them.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _tokens(table: str, where: str = "text IS NOT NULL") -> str:
    """CTEs that end in n(text, n_tokens): greedy longest pieces, unit by unit.

    No piece has anything but Latin letters after its first character, so a text falls apart before every other
    character; the parts are cut step by step, the longest piece that fits first.
    """
    return f"""x AS (SELECT DISTINCT text FROM {table} WHERE {where}), u AS (SELECT text, unnest(regexp_extract_all(text, '(?s).\\p{{Latin}}*')) AS unit FROM x),
    voc AS (SELECT DISTINCT piece, piece[1] AS first, length(piece) AS size FROM tokenizer_vocab WHERE piece <> ''),
    cut(unit, pos, n) AS (
      SELECT unit, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT unit FROM u)
      UNION ALL
      SELECT c.unit, c.pos + coalesce(max(v.size), 1), any_value(c.n) + CASE WHEN max(v.size) IS NULL THEN octet_length(encode(substr(c.unit, c.pos, 1))) ELSE 1 END
      FROM cut c LEFT JOIN voc v ON v.first = substr(c.unit, c.pos, 1) AND substr(c.unit, c.pos, v.size) = v.piece WHERE c.pos <= length(c.unit) GROUP BY c.unit, c.pos),
    whole AS (SELECT unit, max(n) AS n FROM cut GROUP BY unit), n AS (SELECT text, CAST(sum(n) AS BIGINT) AS n_tokens FROM u JOIN whole USING (unit) GROUP BY text)"""


_CLEAN = "lower(regexp_replace(domain, '^[\\s 　]+|[\\s 　]+$', '', 'g'))"
_RECORDS = f"""WITH RECURSIVE {_tokens('l2_dataset')}, r AS (SELECT {_CLEAN} AS domain, doc_id, chunk_idx, max(coalesce(n_tokens, 0)) AS n_tokens FROM l2_dataset LEFT JOIN n USING (text) GROUP BY ALL)"""
_SUPPLY = (
    _RECORDS
    + f""", have AS (SELECT domain AS key, CAST(sum(n_tokens) AS BIGINT) AS supply, count(*) AS n_records FROM r WHERE domain IS NOT NULL GROUP BY domain),
    e AS (SELECT unnest(map_entries(domains)) AS e FROM mix_15b_stage1), p AS (SELECT e.key AS domain, max(coalesce(e.value.epochs, 1)) AS epochs, max(coalesce(e.value.tokens, 0)) AS asked FROM e GROUP BY e.key),
    s AS (SELECT domain, coalesce(n_records, 0) AS n_records, coalesce(supply, 0) AS supply, epochs, asked, coalesce(supply, 0) * epochs < asked AS short FROM p LEFT JOIN have ON key = {_CLEAN})"""
)
_CUBE = (
    _RECORDS
    + f""", so AS (SELECT parent_doc_id AS doc_id, chunk_idx, min(source) AS source FROM chunk_pool WHERE parent_doc_id IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
    lg AS (SELECT doc_id, regexp_extract({_CLEAN.replace('domain', 'lang')}, '^([a-z]+)', 1) AS lang FROM score_ledger WHERE doc_id IS NOT NULL), lc AS (SELECT doc_id, lang, count(*) AS k FROM lg WHERE lang <> '' GROUP BY ALL),
    la AS (SELECT doc_id, arg_min(lang, (-k, lang)) AS lang FROM lc GROUP BY doc_id),
    c AS (SELECT coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(domain, 'unknown') AS domain, n_tokens FROM r LEFT JOIN so USING (doc_id, chunk_idx) LEFT JOIN la USING (doc_id))
    SELECT source, lang, domain, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, count(*) AS n_records FROM c GROUP BY CUBE (source, lang, domain)"""
)
_SPLIT = f"WITH RECURSIVE {_tokens('l2_dataset')} SELECT DISTINCT doc_id, chunk_idx FROM l2_dataset JOIN n USING (text) WHERE n_tokens > 1024"
_SHORT = f"""WITH RECURSIVE {_tokens('documents')}, h AS (SELECT source, sum(coalesce(n_tokens, 0)) AS have FROM documents LEFT JOIN n USING (text) WHERE source IS NOT NULL GROUP BY source)
    SELECT m.source FROM mix_sources m LEFT JOIN h USING (source) WHERE coalesce(have, 0) * max_repeats < weight * total_tokens"""

_FOLD = lambda c: f"regexp_replace(lower(translate({c}, '{_WIDE}', '{_NARROW}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_LEAKS = f"""WITH d AS (SELECT doc_id, {_FOLD('text')} AS t FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, CASE WHEN lower(trim(lang)) LIKE 'zh%' THEN 25 ELSE 50 END AS need, {_FOLD('prompt')} AS t FROM eval_items WHERE prompt IS NOT NULL),
    w AS (SELECT item_id, need, substr(t, pos, need) AS g FROM (SELECT *, unnest(range(1, length(t) - need + 2)) AS pos FROM i)),
    y AS (SELECT doc_id, substr(t, pos, need) AS g FROM (SELECT *, unnest(range(1, length(t) - need + 2)) AS pos FROM d, (VALUES (25), (50)) v(need))),
    f AS (SELECT DISTINCT doc_id, item_id FROM w JOIN y USING (g))"""

#: Runs of three words, a Chinese character being a word of its own.
_RUNS = """w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '([一-鿿])', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+') AS w FROM (SELECT DISTINCT doc_id, text FROM l2_dataset WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
    g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
    k AS (SELECT list_sort(g) AS g, row_number() OVER () AS rid, list(DISTINCT doc_id) AS docs FROM g GROUP BY list_sort(g)), s AS (SELECT rid, len(g) AS n, unnest(g) AS run FROM k),
    q AS (SELECT a.rid AS a, b.rid AS b, count(*) AS m, min(a.n) AS na, min(b.n) AS nb FROM s a JOIN s b ON a.run = b.run AND a.rid <= b.rid GROUP BY ALL),
    l AS (SELECT a.docs AS x, b.docs AS y FROM q JOIN k a ON q.a = a.rid JOIN k b ON q.b = b.rid WHERE m / (na + nb - m) >= 0.6), o AS (SELECT x, unnest(y) AS y FROM (SELECT unnest(x) AS x, y FROM l)),
    pairs AS (SELECT DISTINCT least(x, y) AS doc_id_a, greatest(x, y) AS doc_id_b FROM o WHERE x <> y)"""
_GROUPS = f"""WITH RECURSIVE {_RUNS}, b2 AS (SELECT doc_id_a AS u, doc_id_b AS v FROM pairs UNION SELECT doc_id_b, doc_id_a FROM pairs), r(n, c) AS (SELECT u, u FROM b2 UNION SELECT v, c FROM r JOIN b2 ON u = n),
    z AS (SELECT n, min(c) AS c FROM r GROUP BY n) SELECT n AS doc_id, c AS group_id, count(*) AS n_links FROM z JOIN b2 ON u = n GROUP BY ALL"""

_DECIDING = """
WITH deciding AS (
  SELECT q.domain, q.scorer_name, q.scorer_version, q.quota, l.doc_id,
         arg_max(l.score, (CAST(CASE WHEN regexp_matches(l.ts, '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN l.ts ELSE l.ts || 'Z' END AS TIMESTAMPTZ), l.score)) AS score
  FROM score_ledger l JOIN quota_targets q
    ON lower(trim(l.domain)) = q.domain AND l.scorer_name = q.scorer_name AND l.scorer_version = q.scorer_version
  WHERE l.score IS NOT NULL AND isfinite(l.score)
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY domain, scorer_name, scorer_version ORDER BY score DESC, doc_id) AS r,
         count(*) OVER (PARTITION BY domain, scorer_name, scorer_version) AS n
  FROM deciding)
"""

SQL = {
    "p1_found": f"WITH {_RUNS} SELECT * FROM pairs",
    "p1_groups": _GROUPS,
    "p3_found": _SUPPLY + " SELECT domain FROM s WHERE short",
    "p3_supply": _SUPPLY + " SELECT * FROM s",
    "p3_cube": _CUBE,
    "p4_found": _DECIDING + "SELECT DISTINCT domain, doc_id FROM ranked WHERE r <= ceil(quota * n - 1e-9)",
    "p4_cutoffs": _DECIDING
    + """SELECT domain, scorer_name, scorer_version, max(n) AS n, count(*) FILTER (r <= ceil(quota * n - 1e-9)) AS kept,
         min(score) FILTER (r <= ceil(quota * n - 1e-9)) AS cutoff FROM ranked GROUP BY domain, scorer_name, scorer_version""",
    "p5_found": _SPLIT,
    "p6_found": _LEAKS + " SELECT * FROM f",
    "p6_items": _LEAKS + " SELECT item_id, count(*) AS n_documents FROM f GROUP BY item_id",
    "p7_found": _SHORT,
}
