"""Queries of quotas, samples and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sampling as Q
from ..session import load
from .registry import query

_DOM = "lower(trim(domain))"
_K1 = f"""k AS (SELECT {_DOM} AS domain, doc_id, max(score) AS value FROM score_ledger WHERE scorer_name = 'kenlm' AND scorer_version = 'k1' AND score IS NOT NULL AND isfinite(score) AND domain IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY value DESC, doc_id) AS rank, count(*) OVER (PARTITION BY domain) AS n FROM k),
    q AS (SELECT *, greatest(1, least(n, CAST(ceil(0.3 * n - 1e-9) AS BIGINT))) AS keep FROM r)"""


def _k1(spark, d):
    t = load(spark, d, "score_ledger").where("domain is not null").withColumn("domain", F.lower(F.trim("domain")))
    return Q.quota_rows(Q.pinned(t, "kenlm", "k1", ["domain"], Q.order_value()), ["domain"], 0.3)


@query(f"WITH {_K1} SELECT domain, max(n) AS n, max(keep) AS keep, round(min(value) FILTER (rank <= keep), 6) AS threshold FROM q GROUP BY domain")
def quota_threshold(spark, d):
    """Q1-Q3."""
    return _k1(spark, d).groupBy("domain").agg(F.max("group_rows").alias("n"), F.max("keep").alias("keep"), F.round(F.min(F.when(F.col("rank") <= F.col("keep"), F.col("value"))), 6).alias("threshold"))


@query(f"WITH {_K1} SELECT domain, doc_id, rank FROM q WHERE rank <= keep")
def quota_select(spark, d):
    """Q3."""
    return _k1(spark, d).where("rank <= keep").select("domain", "doc_id", "rank")


@query(f"WITH {_K1} SELECT domain, doc_id, rank, keep FROM q WHERE rank > keep - 2 AND rank <= keep + 2")
def review_boundary(spark, d):
    """Q5."""
    return Q.review_window(_k1(spark, d), 2).select("domain", "doc_id", "rank", "keep")


@query(f"""SELECT DISTINCT {_DOM} AS domain FROM score_ledger WHERE scorer_name = 'kenlm' AND domain IS NOT NULL
    EXCEPT SELECT {_DOM} FROM score_ledger WHERE scorer_name = 'kenlm' AND scorer_version = 'k2' AND domain IS NOT NULL""")
def uncovered_groups(spark, d):
    """Q4."""
    t = load(spark, d, "score_ledger").where("domain is not null").withColumn("domain", F.lower(F.trim("domain")))
    return Q.uncovered(t, "kenlm", "k2", ["domain"])


@query("""WITH g AS (SELECT domain, list_aggregate(map_values(rubric_dims), 'avg') AS m FROM score_ledger WHERE scorer_name = 'l3-rubric' AND rubric_dims IS NOT NULL AND domain IS NOT NULL)
    SELECT lower(trim(domain)) AS domain, count(*) AS n, round(avg(m), 4) AS mean_grade FROM g GROUP BY 1""")
def rubric_means(spark, d):
    """Q2: the order value of rubric rows."""
    t = load(spark, d, "score_ledger").where("scorer_name = 'l3-rubric' and rubric_dims is not null and domain is not null")
    return t.withColumn("m", Q.order_value(dims="rubric_dims")).groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.count("*").alias("n"), F.round(F.avg("m"), 4).alias("mean_grade"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1('s|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def stratified_sample(spark, d):
    """Q6, Q14, Q23."""
    return Q.per_stratum(load(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 5, "s")


@query("SELECT doc_id, md5(substr(text, 1, 300)) AS head FROM documents ORDER BY sha1('g|' || doc_id), doc_id LIMIT 350")
def global_reservoir(spark, d):
    """Q15: 350 heads; the sample's size is the operator's own."""
    return Q.global_sample(load(spark, d, "documents"), "doc_id", 350, "g").select("doc_id", F.md5(F.substring("text", 1, 300)).alias("head"))


@query("""WITH c AS (SELECT language, length_band, count(DISTINCT sample_id) AS n FROM chunk_pool GROUP BY ALL), b AS (SELECT *, least(3, n) AS base, n - least(3, n) AS space FROM c),
    s AS (SELECT *, sum(space) OVER () AS total, greatest(0, least(500 - sum(base) OVER (), sum(space) OVER ())) AS left_ FROM b),
    q AS (SELECT *, CASE WHEN total > 0 THEN CAST(left_ * space // total AS BIGINT) ELSE 0 END AS q FROM s), r AS (SELECT *, left_ * space - q * total AS rest FROM q)
    SELECT language, length_band, n, CAST(base + q + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, language NULLS FIRST, length_band NULLS FIRST) <= left_ - sum(q) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def quota_allocation(spark, d):
    """Q7, Q9: chunks per language and length band for a pool of 500."""
    counts = load(spark, d, "chunk_pool").groupBy("language", "length_band").agg(F.count_distinct("sample_id").alias("n"))
    return Q.allocate(counts, "n", 500, 3)


@query("""WITH v AS (SELECT language, ppl, row_number() OVER (PARTITION BY language ORDER BY ppl) AS r, count(*) OVER (PARTITION BY language) AS n FROM chunk_pool WHERE ppl IS NOT NULL),
    b AS (SELECT language, max(ppl) FILTER (r = least(n, CAST(floor(n / 3) AS BIGINT) + 1)) AS lo, max(ppl) FILTER (r = least(n, CAST(floor(2 * n / 3) AS BIGINT) + 1)) AS hi FROM v GROUP BY language)
    SELECT language, CASE WHEN ppl <= lo THEN 'low' WHEN ppl <= hi THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM v JOIN b USING (language) GROUP BY ALL""")
def ppl_bands(spark, d):
    """Q8."""
    t = load(spark, d, "chunk_pool").where("ppl is not null").select("language", "ppl")
    b = Q.tercile_bounds(t, ["language"], "ppl")
    return t.join(b, "language").groupBy("language", Q.band(F.col("ppl"), F.col("lo"), F.col("hi")).alias("band")).agg(F.count("*").alias("n"))


@query()
def word_window_chunks(spark, d):
    """Q10: chunk sizes; the pieces of a text joined are the text."""
    t = Q.chunked(load(spark, d, "documents"), "text", lambda x: Q.window_chunks(x, 64, 128), ["doc_id"])
    return t.select("doc_id", "chunk_idx", "n_chunks", F.length("chunk").alias("n_chars"))


@query()
def source_chunks(spark, d):
    """Q11 over the code records."""
    t = Q.chunked(load(spark, d, "l2_dataset").where("rubric_kind = 'code'").withColumnRenamed("chunk_idx", "part").dropDuplicates(["doc_id", "part"]), "text", Q.code_chunks, ["doc_id", "part"])
    return t.select("doc_id", "part", "chunk_idx", "n_chunks", F.length("chunk").alias("n_chars"))


@query("""SELECT CASE WHEN CAST('0x' || substr(sha256('v|' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0 < 0.1 THEN 'val' ELSE 'train' END AS side, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l2_dataset GROUP BY 1""")
def document_split(spark, d):
    """Q12: all records of a document on one side."""
    t = load(spark, d, "l2_dataset").withColumn("side", Q.split_side("doc_id", "v", 0.1))
    return t.groupBy("side").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("""WITH l AS (SELECT DISTINCT doc_id, chunk_idx, list_aggregate(labels, 'avg') AS g FROM l2_dataset WHERE labels IS NOT NULL), p AS (SELECT parent_doc_id AS doc_id, chunk_idx, min(language) AS language, count(DISTINCT source) AS sources FROM chunk_pool GROUP BY ALL)
    SELECT language, count(*) AS n, round(avg(g), 4) AS mean_grade, count(*) FILTER (sources > 1) AS ambiguous FROM l JOIN p USING (doc_id, chunk_idx) GROUP BY language""")
def labelled_chunks(spark, d):
    """Q13, 2.12 equi join: labels joined to their chunks."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    l2 = load(spark, d, "l2_dataset").where("labels is not null").select("doc_id", "chunk_idx", mean(F.col("labels")).alias("g")).distinct()
    pool = load(spark, d, "chunk_pool").groupBy(F.col("parent_doc_id").alias("doc_id"), "chunk_idx").agg(F.min("language").alias("language"), F.count_distinct("source").alias("sources"))
    return l2.join(pool, ["doc_id", "chunk_idx"]).groupBy("language").agg(F.count("*").alias("n"), F.round(F.avg("g"), 4).alias("mean_grade"), F.count_if(F.col("sources") > 1).alias("ambiguous"))


_BAND = "CASE WHEN length(text) < 240 THEN 0 WHEN length(text) < 700 THEN 1 WHEN length(text) < 1500 THEN 2 ELSE 3 END"


@query(f"""WITH b AS (SELECT doc_id, {_BAND} AS band FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY sha1('l|' || doc_id), doc_id) AS r FROM b)
    SELECT band, doc_id FROM r WHERE r <= CASE band WHEN 0 THEN 90 WHEN 1 THEN 70 WHEN 2 THEN 30 ELSE 10 END""")
def length_weighted_sample(spark, d):
    """Q16: 200 documents, .45/.35/.15/.05 over four length bands."""
    n = F.length("text")
    t = load(spark, d, "documents").select("doc_id", F.when(n < 240, 0).when(n < 700, 1).when(n < 1500, 2).otherwise(3).alias("band"), Q.hash_order("doc_id", "l").alias("h"))
    most = F.when(F.col("band") == 0, 90).when(F.col("band") == 1, 70).when(F.col("band") == 2, 30).otherwise(10)
    return t.withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy("h", "doc_id"))).where(F.col("r") <= most).select("band", "doc_id")


@query("""WITH s AS (SELECT floor(min(n) * 1.2) AS b FROM (SELECT count(*) AS n FROM documents GROUP BY domain)), r AS (SELECT domain, doc_id, row_number() OVER (PARTITION BY domain ORDER BY sha1('b|' || doc_id), doc_id) AS r FROM documents)
    SELECT domain, doc_id FROM r, s WHERE r <= b""")
def balanced_domains(spark, d):
    """Q17."""
    return Q.balanced(load(spark, d, "documents").select("domain", "doc_id"), "domain", "doc_id", 0.2, "b")


@query("""WITH r AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
    SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM r WHERE before < 20000 GROUP BY source""")
def char_budget(spark, d):
    """Each source up to a budget of 20,000 characters, the crossing row included."""
    t = load(spark, d, "documents").select("source", "doc_id", "n_chars")
    return Q.budget_rows(t, ["source"], [F.col("doc_id")], "n_chars", 20_000).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH c AS (SELECT domain, count(*) AS n FROM documents WHERE domain IN ('wiki', 'math') GROUP BY domain), m AS (SELECT min(n) AS m FROM c), r AS (SELECT domain, doc_id, row_number() OVER (PARTITION BY domain ORDER BY sha1('x|' || doc_id), doc_id) AS r FROM documents WHERE domain IN ('wiki', 'math'))
    SELECT domain, doc_id FROM r, m WHERE r <= m""")
def one_to_one_mix(spark, d):
    """Q20: as many of one domain as of the other."""
    t = load(spark, d, "documents").where("domain in ('wiki', 'math')").select("domain", "doc_id")
    return Q.balanced(t, "domain", "doc_id", 0.0, "x")


@query("""WITH h AS (SELECT domain, n_chars, CASE WHEN CAST('0x' || substr(sha1('k' || doc_id), 1, 8) AS BIGINT) % 100 < 20 THEN 'dev' ELSE 'main' END AS side FROM documents)
    SELECT side, domain, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY side), 6) AS share, CAST(quantile_disc(n_chars, 0.5) AS BIGINT) AS median_chars FROM h GROUP BY side, domain""")
def split_drift(spark, d):
    """Q21: does a hash split change the mixture."""
    from ..operators.decontam import hash_bucket

    t = load(spark, d, "documents").withColumn("side", F.when(hash_bucket("doc_id", "k") < 20, "dev").otherwise("main"))
    g = t.groupBy("side", "domain").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) within group (order by n_chars)").cast("long").alias("median_chars"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("side")), 6)).select("side", "domain", "n", "share", "median_chars")


@query("""WITH p AS (SELECT user_id, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS p FROM events GROUP BY user_id), b AS (SELECT CASE WHEN count(*) FILTER (p BETWEEN 0.2 AND 0.8) >= 30 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END AS lo FROM p)
    SELECT user_id, round(p, 6) AS p, lo FROM p, b WHERE p BETWEEN lo AND 1 - lo""")
def rate_band(spark, d):
    """Q22: users as tasks, a value above 50 as solved."""
    rates = load(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("p"))
    (lo, _), rows = Q.rate_band(rates, "p", [(0.2, 0.8), (0.05, 0.95)], 30)
    return rows.select("user_id", F.round("p", 6).alias("p"), F.lit(lo).alias("lo"))


@query("""SELECT item_id, e AS exposure, row_number() OVER (ORDER BY sha1('e|' || item_id || '|' || e), item_id, e) AS slot FROM eval_items, range(3) t(e)""")
def exposure_replicate(spark, d):
    """Q24: every item three times, in a seeded order."""
    from ..operators.ordered import ranked

    t = Q.exposures(load(spark, d, "eval_items").select("item_id"), "item_id", 3, "e").withColumnRenamed("slot", "h")
    return ranked(t, [], [F.col("h"), F.col("item_id"), F.col("exposure")]).select("item_id", F.col("exposure").cast("long").alias("exposure"), F.col("rank").alias("slot"))


@query("""SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS shard FROM documents""")
def striped_shards(spark, d):
    """SRC3, SRC8, M3: round robin over four shards."""
    from ..operators.ordered import ranked

    t = ranked(load(spark, d, "documents").select("doc_id"), [], [F.col("doc_id")])
    return t.select("doc_id", Q.stripe(F.col("rank"), 4).alias("shard"))
