"""Queries of exact deduplication, set operations and decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decontam as H
from ..operators import dedup as X
from ..session import load
from .filter_queries import _SQUASH, _collapse, _rep, _strip
from .registry import lit, query

_KEY = f"substr(sha1({_SQUASH}), 1, 24)"


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup_keep(spark, d):
    """X1-X3."""
    t = load(spark, d, "documents").select("doc_id", "source", T.exact_key("text").alias("key"))
    return X.first_rows(t, "key", ["doc_id"]).select("doc_id", "source")


@query(
    f"""WITH k AS (SELECT doc_id, source, {_KEY} AS key, {_SQUASH} AS s FROM documents),
        w AS (SELECT *, first_value(source) OVER (PARTITION BY key ORDER BY doc_id) AS dup_of, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS r FROM k WHERE s <> '')
        SELECT key, doc_id AS ord, source, dup_of FROM w WHERE r > 1"""
)
def dup_records(spark, d):
    """X4."""
    return X.duplicate_records(load(spark, d, "documents"), "text", "source", "doc_id")


@query(f"SELECT doc_id FROM documents WHERE source <> 'web_torlo' AND {_KEY} NOT IN (SELECT {_KEY} FROM documents WHERE source = 'web_torlo')")
def exclude_seed(spark, d):
    """Documents new beside one source."""
    t = load(spark, d, "documents").select("doc_id", "source", T.exact_key("text").alias("key"))
    return X.without_keys(t.where("source <> 'web_torlo'"), F.col("key"), t.where("source = 'web_torlo'"), F.col("key")).select("doc_id")


@query(
    """WITH s AS (SELECT DISTINCT sha1(text) AS k, lower(trim(domain)) AS g FROM l2_dataset WHERE text <> '' AND domain IS NOT NULL),
        n AS (SELECT g, count(*) AS n FROM s GROUP BY g), p AS (SELECT a.g AS a, b.g AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.g < b.g GROUP BY ALL)
        SELECT p.a, p.b, shared, round(shared / x.n, 6) AS share_a, round(shared / y.n, 6) AS share_b FROM p JOIN n x ON x.g = p.a JOIN n y ON y.g = p.b"""
)
def cross_domain_overlap(spark, d):
    """Chunks that several domains hold."""
    t = load(spark, d, "l2_dataset").where("text <> ''").select(F.sha1("text").alias("k"), F.lower(F.trim("domain")).alias("g"))
    return X.overlaps(t, F.col("k"), "g")


@query(
    """SELECT chunk_id, arg_max(doc_id, (length(text), doc_id)) AS doc_id, max(length(text)) AS n_chars FROM l2_dataset WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id"""
)
def longest_wins(spark, d):
    """One record per chunk."""
    t = load(spark, d, "l2_dataset").where("chunk_id is not null and text is not null").select("chunk_id", "doc_id", F.length("text").alias("n_chars"))
    return X.best_rows(t, ["chunk_id"], [F.col("n_chars"), F.col("doc_id")])


@query(
    """WITH t AS (SELECT doc_id, sha1(text) AS f, sha1(substr(text, 1, 120)) AS p FROM documents), a AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY doc_id) AS r FROM t),
        b AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY doc_id) AS q FROM a WHERE r = 1) SELECT doc_id FROM b WHERE q = 1"""
)
def two_level_dedup(spark, d):
    """Whole text, then opening."""
    t = load(spark, d, "documents").select("doc_id", F.sha1("text").alias("f"), F.sha1(F.substring("text", 1, 120)).alias("p"))
    return X.two_level(t, F.col("f"), F.col("p"), "doc_id").select("doc_id")


@query("SELECT sha1(text) AS chunk, count(DISTINCT doc_id) AS n FROM l2_dataset WHERE text <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def chunk_in_many(spark, d):
    """X16."""
    return X.in_many(load(spark, d, "l2_dataset").where("text <> ''").withColumn("chunk", F.sha1("text")), "chunk", "doc_id")


@query(
    """WITH a AS (SELECT DISTINCT doc_id || '#' || chunk_idx AS k, sha1(coalesce(text, '')) AS f FROM l2_dataset), b AS (SELECT DISTINCT parent_doc_id || '#' || chunk_idx AS k, min(sample_id) AS s FROM chunk_pool GROUP BY 1)
        SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN substr(a.f, 1, 16) = b.s THEN 'same' ELSE 'changed' END AS state FROM (SELECT k, min(f) AS f FROM a GROUP BY k) a FULL JOIN b ON a.k = b.k"""
)
def manifest_diff(spark, d):
    """Records against the pool that lists them."""
    a = load(spark, d, "l2_dataset").groupBy(F.concat_ws("#", "doc_id", "chunk_idx").alias("k")).agg(F.min(F.substring(F.sha1(F.coalesce("text", F.lit(""))), 1, 16)).alias("f"))
    b = load(spark, d, "chunk_pool").groupBy(F.concat_ws("#", "parent_doc_id", "chunk_idx").alias("k")).agg(F.min("sample_id").alias("f"))
    return X.compare_tables(a, b, "k", F.col("f"))


@query(
    """WITH c AS (SELECT DISTINCT sha1(text) AS chunk_id, doc_id FROM l2_dataset WHERE text <> ''), p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM c a JOIN c b ON a.chunk_id = b.chunk_id AND a.doc_id < b.doc_id),
        k AS (SELECT DISTINCT doc_id FROM score_ledger WHERE score > 3), n AS (SELECT substr(x, 1, 1) AS g, (CASE WHEN x IN (SELECT doc_id FROM k) THEN 1 ELSE 0 END) + (CASE WHEN y IN (SELECT doc_id FROM k) THEN 1 ELSE 0 END) AS n FROM p)
        SELECT g, count(*) FILTER (n = 2) AS both, count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 0) AS neither FROM n GROUP BY g"""
)
def kept_pairs(spark, d):
    """Pairs of documents with a common chunk, by how many of them score above 3."""
    c = load(spark, d, "l2_dataset").where("text <> ''").select(F.sha1("text").alias("chunk_id"), "doc_id").distinct()
    few = c.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id")
    c = c.join(few, "chunk_id")
    pairs = c.withColumnRenamed("doc_id", "x").join(c.withColumnRenamed("doc_id", "y"), "chunk_id").where("x < y").select("x", "y")
    return X.pair_presence(pairs, "x", "y", load(spark, d, "score_ledger").where("score > 3"), "doc_id", F.substring("x", 1, 1))


_OURS = "SELECT doc_id, max(lower(lang)) AS lang, max(model) AS model FROM score_ledger WHERE scorer_name = 'kenlm' GROUP BY doc_id"
_THEIRS = _OURS.replace("'kenlm'", "'fineweb-edu'")


@query(
    f"""WITH a AS ({_OURS}), b AS ({_THEIRS}) SELECT a.doc_id, 'lang' AS "column", a.lang AS ours, b.lang AS theirs FROM a JOIN b USING (doc_id) WHERE a.lang <> b.lang
        UNION ALL SELECT a.doc_id, 'model', a.model, b.model FROM a JOIN b USING (doc_id) WHERE a.model <> b.model"""
)
def ledger_conflicts(spark, d):
    """What two scorers' rows say differently about a document."""
    t = load(spark, d, "score_ledger")
    side = lambda s: t.where(F.col("scorer_name") == s).groupBy("doc_id").agg(F.max(F.lower("lang")).alias("lang"), F.max("model").alias("model"))
    return X.ledger_union(side("kenlm"), side("fineweb-edu"), "doc_id", ["lang", "model"])[1]


_WORDS = f"CASE WHEN {_collapse('lower(text)')} = '' THEN [] ELSE string_split({_collapse('lower(text)')}, ' ') END"
_G13 = "list_distinct(list_transform(range(1, greatest(0, len(ws) - 12) + 1), lambda i: array_to_string(ws[i:i+12], ' ')))"
_GATE = f"""p AS (SELECT item_id AS item, 'prompt' AS part, prompt AS text FROM eval_items UNION ALL SELECT item_id, 'answer', answer FROM eval_items WHERE answer IS NOT NULL),
    pw AS (SELECT item, part, {_WORDS} AS ws FROM p), pg AS (SELECT item, part, unnest({_G13}) AS gram FROM pw),
    gate AS (SELECT gram, min((item, part)) AS o FROM pg GROUP BY gram)"""
_HITS = f"""{_GATE}, dw AS (SELECT doc_id, source, {_WORDS} AS ws FROM documents), dg AS (SELECT doc_id, unnest({_G13}) AS gram FROM dw),
    hits AS (SELECT doc_id, count(*) AS n_grams, min(o) AS o FROM dg JOIN gate USING (gram) GROUP BY doc_id)"""


def _gate(spark, d):
    return H.gate_grams(H.gate_parts(load(spark, d, "eval_items"), "item_id", ["prompt", "answer"]))


@query(f"WITH {_HITS} SELECT doc_id, n_grams, o[1] AS item, o[2] AS part FROM hits".replace("o[1]", "struct_extract_at(o, 1)").replace("o[2]", "struct_extract_at(o, 2)"))
def decontam_ngram13(spark, d):
    """H5, H7, SRC10."""
    return H.gram_hits(load(spark, d, "documents"), "doc_id", "text", _gate(spark, d))


@query(f"WITH {_HITS} SELECT source, count(*) AS n, count(hits.doc_id) AS dropped, round(count(hits.doc_id) / count(*), 6) AS drop_fraction FROM documents LEFT JOIN hits USING (doc_id) GROUP BY source")
def decontam_by_source(spark, d):
    """H6, H16."""
    docs = load(spark, d, "documents")
    hits = H.gram_hits(docs, "doc_id", "text", _gate(spark, d)).select("doc_id", F.lit(1).alias("h"))
    return docs.select("doc_id", "source").join(hits, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("h").alias("dropped"), F.round(F.count("h") / F.count("*"), 6).alias("drop_fraction"))


@query(f"WITH {_HITS} SELECT 0 AS residual_hits, count(*) - (SELECT count(*) FROM hits) AS clean FROM documents")
def decontam_residual(spark, d):
    """After the drop a second scan finds nothing."""
    docs, gate = load(spark, d, "documents"), _gate(spark, d)
    rest = H.residual(docs, "doc_id", H.gram_hits(docs, "doc_id", "text", gate))
    again = H.gram_hits(rest, "doc_id", "text", gate).agg(F.count("*").cast("int").alias("residual_hits"))
    return again.join(rest.agg(F.count("*").alias("clean")))


_S13 = "list_distinct(list_transform(range(1, greatest(1, length(s) - 12) + 1), lambda i: substr(s, i, 13)))"


@query(
    f"""WITH p AS (SELECT item_id AS item, prompt AS text FROM eval_items), pn AS (SELECT DISTINCT item, g FROM (SELECT item, unnest({_S13.replace('s,', 's,')}) AS g FROM (SELECT item, {_SQUASH} AS s FROM p)) WHERE length(g) = 13 AND len(list_distinct(string_split(g, ''))) >= 4),
        dn AS (SELECT doc_id, g FROM (SELECT doc_id, unnest({_S13}) AS g FROM (SELECT doc_id, {_SQUASH} AS s FROM documents)) WHERE length(g) = 13)
        SELECT doc_id, item, count(*) AS n_grams FROM dn JOIN pn USING (g) GROUP BY doc_id, item"""
)
def char13_hits(spark, d):
    """H13."""
    parts = H.gate_parts(load(spark, d, "eval_items"), "item_id", ["prompt"])
    return H.char_gram_hits(load(spark, d, "documents"), "doc_id", "text", parts)


def _hkey(x: str) -> str:
    return f"substr(sha1({_rep(x, T.HOLDOUT_DROP)}), 1, 16)"


_BARE = _strip(f"regexp_replace(x, {lit(T.QA_PREFIX)}, '')")
_BODY = _strip(f"regexp_replace(string_split_regex(text, {lit(T.ANSWER_TAIL)})[1], {lit(T.QA_PREFIX)}, '')")


@query(
    f"""WITH l AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}) AS ls FROM documents),
        c AS (SELECT doc_id, list_concat([text, {_BODY}], list_filter(list_concat(ls, list_transform(ls, lambda x: {_BARE})), lambda x: x <> '' AND length(x) <= 500)) AS cs FROM l),
        k AS (SELECT DISTINCT {_hkey('line')} AS h FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE source = 'web_jorolk') WHERE {_rep('line', T.HOLDOUT_DROP)} <> '')
        SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(list_transform(cs, lambda x: {_hkey('x')})) AS h FROM c) JOIN k USING (h)"""
)
def holdout_lines(spark, d):
    """Documents that hold a line of one source's, taken as held out."""
    docs = load(spark, d, "documents")
    held = docs.where("source = 'web_jorolk'").select(F.explode(F.split("text", "\n")).alias("line"))
    return H.holdout_hits(docs, "doc_id", "text", held, "line")


def _bigrams(x: str) -> str:
    pairs = "list_distinct(list_transform(range(1, len(y)), lambda i: y[i] || ' ' || y[i+1]))"
    return f"(SELECT {pairs} FROM (SELECT CASE WHEN len(regexp_extract_all(lower({x}), '[\\x{{4e00}}-\\x{{9fff}}]')) > 0 THEN regexp_extract_all(lower({x}), '[\\x{{4e00}}-\\x{{9fff}}]') ELSE regexp_extract_all(lower({x}), '[a-z0-9]+') END AS y))"


_CONT = f"""hb AS (SELECT item_id AS item, len(bs) AS size, unnest(bs) AS g FROM (SELECT item_id, {_bigrams('prompt')} AS bs FROM eval_items)),
    db AS (SELECT doc_id, {_hkey('text')} AS h, unnest({_bigrams('text')}) AS g FROM documents WHERE text <> ''),
    df AS (SELECT g, count(*) AS df FROM db GROUP BY g), w AS (SELECT v.g, ln(((SELECT count(*) FROM documents WHERE text <> '') + 1) / (coalesce(df, 0) + 1)) + 1 AS w FROM (SELECT DISTINCT g FROM hb) v LEFT JOIN df USING (g)),
    mass AS (SELECT item, sum(w) AS mass, max(size) AS size FROM hb JOIN w USING (g) GROUP BY item),
    cont AS (SELECT doc_id, item, round(s / mass, 6) AS containment, size < 20 AS short FROM (SELECT doc_id, item, sum(w) AS s FROM db JOIN hb USING (g) JOIN w USING (g) WHERE h NOT IN (SELECT {_hkey('prompt')} FROM eval_items) GROUP BY doc_id, item) JOIN mass USING (item))"""


@query(f"WITH {_CONT} SELECT doc_id, item, round(containment, 4) AS containment, short FROM cont WHERE containment >= 0.2")
def idf_containment(spark, d):
    """H8, H9: pairs of a document and an item of containment 0.2 or more."""
    t = H.containment(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "prompt")
    return t.where("containment >= 0.2").select("doc_id", "item", F.round("containment", 4).alias("containment"), "short")


@query(
    f"""WITH {_CONT}, hit AS (SELECT DISTINCT doc_id FROM cont WHERE NOT short AND containment >= 0.5), ex AS (SELECT DISTINCT doc_id FROM documents WHERE {_hkey('text')} IN (SELECT {_hkey('prompt')} FROM eval_items)),
        g AS (SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(ex.doc_id) AS exact_hits, count(hit.doc_id) AS hit_rows FROM documents d LEFT JOIN hit USING (doc_id) LEFT JOIN ex USING (doc_id) GROUP BY source),
        r AS (SELECT *, hit_rows / (bytes / 1e9) AS p FROM g), b AS (SELECT coalesce(max(p), 0) AS base FROM r WHERE source = 'web_torlo')
        SELECT source, bytes, exact_hits, hit_rows, round(p, 3) AS per_gb, CASE WHEN exact_hits > 0 OR (CASE WHEN base = 0 THEN hit_rows > 0 ELSE p > 2 * base END) THEN 'REJECT' ELSE 'clean' END AS verdict FROM r, b"""
)
def contamination_verdict(spark, d):
    """H10, H11 with one source as the baseline."""
    docs, items = load(spark, d, "documents"), load(spark, d, "eval_items")
    hits = H.containment(docs, "doc_id", "text", items, "item_id", "prompt")
    keys = items.select(T.holdout_key("prompt").alias("h")).distinct()
    exact = docs.withColumn("h", T.holdout_key("text")).join(keys, "h", "left_semi")
    return H.verdict(hits, docs, "doc_id", "text", "source", exact, 0.5, "web_torlo")


_NUMS = "list_sort(regexp_extract_all({0}, '[0-9]+(?:\\.[0-9]+)?'))"


@query(
    f"""WITH a AS (SELECT doc_id, {_NUMS.format('text')} AS n FROM documents), b AS (SELECT doc_id AS other, {_NUMS.format('text')} AS n FROM documents WHERE source = 'math_savel')
        SELECT doc_id, other AS item FROM a JOIN b USING (n) WHERE len(n) >= 2"""
)
def number_screen(spark, d):
    """Documents of the same numbers as one of a mathematics source."""
    docs = load(spark, d, "documents")
    return H.number_matches(docs, "doc_id", "text", docs.where("source = 'math_savel'").withColumnRenamed("doc_id", "other"), "other", "text")


@query(
    """WITH h AS (SELECT doc_id, source, CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS b FROM documents)
        SELECT source, count(*) AS n, count(*) FILTER (b < 10) AS holdout FROM h GROUP BY source"""
)
def hash_split(spark, d):
    """A tenth held out by hash."""
    t = load(spark, d, "documents").withColumn("b", H.hash_bucket("doc_id"))
    return t.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("b") < 10).alias("holdout"))


@query(
    f"""WITH a AS (SELECT doc_id, {_collapse('text')} AS a FROM documents), b AS (SELECT item_id AS item, {_collapse('prompt')} AS b FROM eval_items)
        SELECT DISTINCT doc_id, item FROM a, b WHERE length(a) >= 20 AND length(b) >= 20 AND (contains(a, b) OR contains(b, a))"""
)
def containment_pairs(spark, d):
    """Documents and prompts of which one holds the other."""
    return H.contains_either_way(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "prompt")


_ARMS = {"plain": "text", "lower": "lower(text)", "squashed": _rep("lower(text)", T.NOT_WORD, " ")}


def _arm_sql(x: str) -> str:
    ws = f"CASE WHEN {_collapse(x)} = '' THEN [] ELSE string_split({_collapse(x)}, ' ') END"
    grams = f"list_distinct(list_transform(range(1, greatest(0, len(ws) - 7) + 1), lambda i: array_to_string(ws[i:i+7], ' ')))"
    return f"""SELECT count(DISTINCT doc_id) FROM (SELECT doc_id, unnest({grams}) AS g FROM (SELECT doc_id, {ws} AS ws FROM documents)) JOIN
        (SELECT DISTINCT unnest({grams}) AS g FROM (SELECT {ws} AS ws FROM (SELECT prompt AS text FROM eval_items))) USING (g)"""


@query(" UNION ALL ".join(f"SELECT '{k}' AS arm, ({_arm_sql(x)}) AS n_documents" for k, x in _ARMS.items()))
def normaliser_arms(spark, d):
    """Documents hit by 8-word grams under three normalisers."""
    arms = {"plain": lambda c: c, "lower": F.lower, "squashed": lambda c: F.regexp_replace(F.lower(c), T.NOT_WORD, " ")}
    docs, items = load(spark, d, "documents"), load(spark, d, "eval_items")
    out = None
    for name, f in arms.items():
        grams = lambda c: F.explode(T.word_grams(T.let(T.collapse(f(F.col(c))), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))), 8)).alias("g")  # noqa: B023, E731
        hit = docs.select("doc_id", grams("text")).join(items.select(grams("prompt")).distinct(), "g", "left_semi").agg(F.count_distinct("doc_id").alias("n_documents")).select(F.lit(name).alias("arm"), "n_documents")
        out = hit if out is None else out.unionByName(hit)
    return out


@query(
    f"""WITH {_HITS}, e AS (SELECT DISTINCT d.doc_id FROM documents d JOIN (SELECT {_KEY} AS k, min(doc_id) AS f FROM documents GROUP BY 1) x ON {_KEY} = x.k AND d.doc_id > x.f)
        SELECT doc_id, min(kind) AS kind FROM (SELECT doc_id, '1_gram' AS kind FROM hits UNION ALL SELECT doc_id, '2_duplicate' FROM e) GROUP BY doc_id"""
)
def cleanup_hits(spark, d):
    """What the combined pass removes, and why."""
    docs = load(spark, d, "documents")
    grams = H.gram_hits(docs, "doc_id", "text", _gate(spark, d))
    dups = X.duplicate_records(docs, "text", "source", "doc_id").select(F.col("ord").alias("doc_id"))
    return H.first_kind({"1_gram": grams, "2_duplicate": dups}, "doc_id")



@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_per_key(spark, d):
    """The first event of each user and type."""
    t = load(spark, d, "events").select("user_id", "event_type", "event_id")
    return X.first_rows(t, F.struct("user_id", "event_type"), ["event_id"])


@query(f"SELECT doc_id FROM documents WHERE sha1({_SQUASH}) NOT IN (SELECT sha1({_SQUASH}) FROM documents WHERE domain = 'news')")
def manifest_exclusion(spark, d):
    """Rows whose normalised sha1 a manifest does not list; one domain stands in for the manifest."""
    docs = load(spark, d, "documents").select("doc_id", "domain", F.sha1(T.squash("text")).alias("sha"))
    manifest = docs.where("domain = 'news'").select(F.col("sha").alias("content_sha1_norm"))
    return X.without_keys(docs, F.col("sha"), manifest, F.col("content_sha1_norm")).select("doc_id")
