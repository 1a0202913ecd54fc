"""Queries of statistics, ledgers and detectors. The star schema's tables stand in for predictions and losses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ledger as L
from ..operators import stats as A
from ..session import load
from .filter_queries import _count
from .registry import query

_TOK = _count("text", T.WORD)


@query(f"SELECT domain, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({_TOK} + 1) AS BIGINT) AS tokens, CAST(round(sum(length(text)) / 1.5) AS BIGINT) AS estimated FROM documents GROUP BY ROLLUP (domain)")
def domain_rollup(spark, d):
    """Counts per domain and in all (domain null)."""
    t = load(spark, d, "documents").withColumn("k", F.size(T.word_tokens("text")) + 1)
    return t.rollup("domain").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum("k").alias("tokens"), F.round(F.sum(F.length("text")) / 1.5).cast("long").alias("estimated"))


@query("""WITH s AS (SELECT domain, list_sort(list(n_chars)) AS v, count(*) AS n FROM documents GROUP BY domain)
    SELECT domain, v[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] AS nearest, v[CAST(floor(0.9 * (n - 1)) AS INT) + 1] AS floored, v[least(n - 1, CAST(floor(0.9 * n) AS INT)) + 1] AS cut,
    round(v[CAST(floor(0.9 * (n - 1)) AS INT) + 1] + (v[CAST(ceil(0.9 * (n - 1)) AS INT) + 1] - v[CAST(floor(0.9 * (n - 1)) AS INT) + 1]) * (0.9 * (n - 1) - floor(0.9 * (n - 1))), 6) AS linear FROM s""")
def percentile_rules(spark, d):
    """A3: the 90th percentile by four rules, from exact places."""
    from ..operators.ordered import ranked

    r = ranked(load(spark, d, "documents").select("domain", "n_chars", "doc_id"), ["domain"], [F.col("n_chars"), F.col("doc_id")])
    n, q = F.col("group_rows"), F.lit(0.9)
    at = lambda place: F.max(F.when(F.col("rank") == place + 1, F.col("n_chars")))
    low, high = F.floor(q * (n - 1)), F.ceil(q * (n - 1))
    g = r.groupBy("domain").agg(at(F.rint(q * (n - 1)).cast("long")).alias("nearest"), at(low).alias("floored"), at(F.least(n - 1, F.floor(q * n))).alias("cut"), at(high).alias("up"), F.max(q * (n - 1) - low).alias("f"))
    return g.select("domain", "nearest", "floored", "cut", F.round(F.col("floored") + (F.col("up") - F.col("floored")) * F.col("f"), 6).alias("linear"))


@query("""SELECT domain, CAST(CASE WHEN n_chars >= 3000 THEN 3000 WHEN n_chars >= 1200 THEN 1200 WHEN n_chars >= 400 THEN 400 WHEN n_chars >= 0 THEN 0 END AS DOUBLE) AS bin, count(*) AS n FROM documents WHERE n_chars >= 0 GROUP BY ALL""")
def length_histogram(spark, d):
    """A4."""
    return A.fixed_histogram(load(spark, d, "documents"), ["domain"], "n_chars", [0, 400, 1200, 3000])


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(spark, d):
    """A5."""
    return A.top_k(load(spark, d, "documents"), "source", 10)


@query("""SELECT domain, count(*) FILTER (truncated) AS truncated, count(*) FILTER (rubric_kind = 'code') AS code, count(*) FILTER (rubric_kind = 'natural_language') AS natural_language FROM l2_dataset GROUP BY domain""")
def group_profile(spark, d):
    """A6."""
    return load(spark, d, "l2_dataset").groupBy("domain").agg(F.count_if("truncated").alias("truncated"), F.count_if(F.col("rubric_kind") == "code").alias("code"), F.count_if(F.col("rubric_kind") == "natural_language").alias("natural_language"))


_P = "SELECT user_id AS task, count(*) FILTER (value > 50) AS hits, count(*) AS n FROM events GROUP BY user_id"


def _wilson_sql(sign: str) -> str:
    z = A.Z95
    return f"round((hits / n + {z * z} / (2 * n) {sign} {z} * sqrt(hits / n * (1 - hits / n) / n + {z * z} / (4 * n * n))) / (1 + {z * z} / n), 6)"


@query(f"SELECT task, n, hits, {_wilson_sql('-')} AS lo, {_wilson_sql('+')} AS hi FROM ({_P})".replace("(2 * n)", "(2.0 * n)").replace("(4 * n * n)", "(4.0 * n * n)"))
def wilson_intervals(spark, d):
    """Users as tasks, a value above 50 as a hit."""
    t = load(spark, d, "events").groupBy(F.col("user_id").alias("task")).agg(F.count_if(F.col("value") > 50).alias("hits"), F.count("*").alias("n"))
    lo, hi = A.wilson(F.col("hits"), F.col("n"))
    return t.select("task", "n", "hits", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


_AB = """a AS (SELECT user_id, bool_or(value > 90) AS a FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT user_id, bool_or(value > 90) AS b FROM events WHERE event_id % 2 = 1 GROUP BY user_id),
    ab AS (SELECT user_id, CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM a JOIN b USING (user_id))"""


def _arms(spark, d):
    t = load(spark, d, "events").withColumn("ok", F.col("value") > 90)
    arm = lambda k: t.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.bool_or("ok").cast("int").alias("ok"))
    return A.paired(arm(0), arm(1), ["user_id"], "ok")


@query(f"WITH {_AB} SELECT count(*) AS common, CAST(sum(a) AS BIGINT) AS hits_a, CAST(sum(b) AS BIGINT) AS hits_b, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b FROM ab")
def run_comparison(spark, d):
    """Two arms of the events on their common users."""
    return _arms(spark, d).agg(F.count("*").alias("common"), F.sum("a").alias("hits_a"), F.sum("b").alias("hits_b"), F.count_if(F.expr("a = 1 and b = 0")).alias("only_a"), F.count_if(F.expr("a = 0 and b = 1")).alias("only_b"))


@query(
    f"""WITH {_AB}, c AS (SELECT count(*) FILTER (a = 1 AND b = 0) AS x, count(*) FILTER (a = 0 AND b = 1) AS y FROM ab), t AS (SELECT x, y, x + y AS n, least(x, y) AS k FROM c)
    SELECT x AS only_a, y AS only_b, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END, 9) AS p FROM t"""
)
def mcnemar_test(spark, d):
    """A9 on the same arms."""
    c = _arms(spark, d).agg(F.count_if(F.expr("a = 1 and b = 0")).alias("only_a"), F.count_if(F.expr("a = 0 and b = 1")).alias("only_b"))
    return c.select("only_a", "only_b", F.round(A.mcnemar("only_a", "only_b"), 9).alias("p"))


@query()
def bootstrap_interval(spark, d):
    """A10 on the same arms."""
    return A.bootstrap(_arms(spark, d), "user_id", 200, 11).select(*(F.round(c, 6).alias(c) for c in ("lo", "mean", "hi")))


_BLOCKS = """x AS (SELECT l_suppkey AS block, sum(l_extendedprice) AS ca, sum(l_extendedprice * (1 - l_discount)) AS cb, CAST(sum(l_quantity) AS DOUBLE) AS n FROM lineitem GROUP BY l_suppkey), y AS (SELECT *, cb / n - ca / n AS x FROM x)"""


def _runs(spark, d):
    g = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("block")).agg(F.sum("l_extendedprice").alias("ca"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cb"), F.sum("l_quantity").cast("double").alias("n"))
    return g.select("block", F.col("ca").alias("ce_sum"), F.col("n").alias("n_tokens")), g.select("block", F.col("cb").alias("ce_sum"), F.col("n").alias("n_tokens"))


@query(f"""WITH {_BLOCKS} SELECT count(*) AS n_blocks, round(avg(x), 4) AS mean, round(stddev_samp(x) / sqrt(count(*)), 4) AS se, round(sum(cb - ca) / sum(n), 4) AS token_mean, count(*) FILTER (x > 0) AS positive, count(*) FILTER (x < 0) AS negative FROM y""")
def block_paired_delta(spark, d):
    """Suppliers as blocks, price with and without discount as the two runs."""
    r = A.block_paired(*_runs(spark, d), ["block"])
    return r.select("n_blocks", *(F.round(c, 4).alias(c) for c in ("mean", "se", "token_mean")), "positive", "negative")


@query(f"WITH {_BLOCKS}, m AS (SELECT sum((cb - ca) * n) / sum(n) AS mean, count(*) AS n_blocks, sum(n) AS total FROM y) SELECT n_blocks, round(mean, 2) AS mean, round(sqrt(sum(pow(n * (cb - ca - mean), 2))) / max(total), 2) AS se FROM y, m GROUP BY mean, n_blocks")
def weighted_paired_delta(spark, d):
    """A13 on the same blocks."""
    a, b = _runs(spark, d)
    p = a.select("block", F.col("ce_sum").alias("a"), F.col("n_tokens").alias("w")).join(b.select("block", F.col("ce_sum").alias("b")), "block")
    return A.weighted_delta(p, "w").select(F.col("n").alias("n_blocks"), F.round("mean", 2).alias("mean"), F.round("se", 2).alias("se"))


@query("""WITH a AS (SELECT avg(value) AS mean, count(value) AS n, var_samp(value) AS v FROM events), s AS (SELECT user_id, sum(value - mean) AS s FROM events, a GROUP BY user_id), g AS (SELECT sum(s * s) AS ss, count(*) AS clusters FROM s)
    SELECT round(mean, 6) AS mean, n, clusters, round(sqrt(v / n), 6) AS se, round(sqrt(ss) / n, 6) AS clustered_se, round(ss / n / v, 6) AS design_effect FROM a, g""")
def clustered_error(spark, d):
    """Events clustered by user."""
    r = A.clustered(load(spark, d, "events"), "user_id", "value")
    return r.select(F.round("mean", 6).alias("mean"), "n", "clusters", *(F.round(c, 6).alias(c) for c in ("se", "clustered_se", "design_effect")))


@query(f"""WITH p AS (SELECT hits / n AS p FROM ({_P})), t AS (SELECT count(*) AS tasks, avg(p) AS p_mean, min(p) AS p_min, max(p) AS p_max, count(*) FILTER (p = 0) AS none, count(*) FILTER (p = 1) AS "all", avg(1 - pow(p, 8) - pow(1 - p, 8)) AS mixed_fraction,
    avg(14.0 * p * (1 - p)) AS advantage_mass, 100 * avg(1 - pow(1 - p, 8) - p) AS hit_gain_pt FROM p)
    SELECT tasks, none, "all", round(p_mean, 6) AS p_mean, round(p_min, 6) AS p_min, round(p_max, 6) AS p_max, round(mixed_fraction, 6) AS mixed_fraction, round(advantage_mass, 6) AS advantage_mass, round(hit_gain_pt, 6) AS hit_gain_pt, round(1 - pow(1 - mixed_fraction, 4), 6) AS steps_with_gradient FROM t""")
def admission_table(spark, d):
    """A16."""
    t = load(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("p"))
    r = A.admission(t, "p", 8)
    return r.select("tasks", "none", "all", *(F.round(c, 6).alias(c) for c in ("p_mean", "p_min", "p_max", "mixed_fraction", "advantage_mass", "hit_gain_pt", "steps_with_gradient")))


@query()
def compression_anchors(spark, d):
    """A17 by domain."""
    t = load(spark, d, "documents").select("domain", A.compression("text").alias("c"))
    return t.groupBy("domain").agg(F.round(F.avg("c.gzip"), 6).alias("gzip_bits"), F.round(F.avg("c.bz2"), 6).alias("bz2_bits"))


@query(f"""WITH w AS (SELECT domain, list_filter(string_split_regex(substr(text, greatest(1, length(text) - 299)), '[{T.SPACE}]+'), lambda x: x <> '') AS ws FROM documents),
    g AS (SELECT domain, list_transform(range(1, greatest(0, len(ws) - 2) + 1), lambda i: array_to_string(ws[i:i+2], ' ')) AS gs FROM w)
    SELECT domain, count(*) AS n, count(*) FILTER (len(list_filter(list_distinct(gs), lambda x: len(list_filter(gs, lambda y: y = x)) >= 2)) > 0) AS degenerate FROM g GROUP BY domain""")
def degeneration_rate(spark, d):
    """A18 with runs of three words occurring twice."""
    t = load(spark, d, "documents").withColumn("x", A.degenerate("text", gram=3, times=2))
    return t.groupBy("domain").agg(F.count("*").alias("n"), F.count_if("x").alias("degenerate"))


@query()
def repeat_spans(spark, d):
    """A19 over the words of every document: spans of words, in blocks of documents."""

    @F.pandas_udf("struct<longest int, covered int, tail_period int>")
    def spans(words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([A.repeats(list(w)) for w in words], columns=["longest", "covered", "tail_period"])

    t = load(spark, d, "documents").select("doc_id", spans(T.spaced_words("text")).alias("s"))
    return t.select("doc_id", "s.*")


@query("""WITH w AS (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM w WHERE w <> '' GROUP BY w), r AS (SELECT ln(row_number() OVER (ORDER BY n DESC, w)) AS x, ln(n) AS y, n FROM c),
    f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt, sum(n) AS total, count(*) AS types FROM r)
    SELECT round(slope, 6) AS slope, types, round(sqrt(avg(pow(y - slope * x - icpt, 2))), 6) AS rms, round(ln(sum(pow(n / total, 2.5))) / (1 - 2.5) / ln(max(types)), 6) AS renyi FROM r, f GROUP BY slope, types""")
def zipf_fit(spark, d):
    """Word frequencies of all documents."""
    c = load(spark, d, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    return A.zipf(c).select(F.round("slope", 6).alias("slope"), "types", F.round("rms", 6).alias("rms"), F.round("renyi", 6).alias("renyi"))


@query("""SELECT p_brand, round(regr_intercept(p_retailprice, pow(CAST(p_size AS DOUBLE), -0.3)), 4) AS e, round(regr_slope(p_retailprice, pow(CAST(p_size AS DOUBLE), -0.3)), 4) AS b FROM part GROUP BY p_brand""")
def power_law_fit(spark, d):
    """A21 for a fixed exponent, on parts."""
    r = A.power_law(load(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice", 0.3)
    return r.select("p_brand", F.round("e", 4).alias("e"), F.round("b", 4).alias("b"))


@query("""WITH x AS (SELECT user_id, lag(value) OVER w - 2 * value + lead(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(sqrt(avg(d * d)) / sqrt(6), 6) AS noise, count(*) AS n FROM x WHERE d IS NOT NULL GROUP BY user_id""")
def series_noise(spark, d):
    """A22 per user."""
    t = load(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return A.second_difference_noise(t, ["user_id"], "o", "value").select("user_id", F.round("noise", 6).alias("noise"), "n")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(round(value) AS BIGINT) * 60 AS e FROM events WHERE value >= 0),
    f AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM e),
    i AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS island FROM f),
    g AS (SELECT user_id, island, min(s) AS s, max(e) AS e, sum(e - s) AS each FROM i GROUP BY user_id, island) SELECT user_id, CAST(sum(e - s) AS BIGINT) AS busy, count(*) AS islands, CAST(sum(each) AS BIGINT) AS total FROM g GROUP BY user_id""")
def busy_union(spark, d):
    """Each event lasts its value in minutes."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    t = load(spark, d, "events").where("value >= 0").select("user_id", s.alias("s"), (s + F.round("value").cast("long") * 60).alias("e"))
    return A.busy(t, ["user_id"], "s", "e")


@query("""WITH s AS (SELECT user_id AS step, round(avg(value), 6) AS v FROM events GROUP BY user_id) SELECT x.step, CAST(round(x.step * 1.5) AS BIGINT) AS at, x.v AS a, y.v AS b, (x.step >= 50) <> (CAST(round(x.step * 1.5) AS BIGINT) >= 80) AS other_phase FROM s x JOIN s y ON y.step = CAST(round(x.step * 1.5) AS BIGINT)""")
def equal_token_pairs(spark, d):
    """A series against itself at one and a half times the step."""
    s = load(spark, d, "events").groupBy(F.col("user_id").alias("step")).agg(F.round(F.avg("value"), 6).alias("v"))
    return A.pair_at_ratio(s, s, "step", "v", 1.5, 50, 80)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY 1")
def daily_metrics(spark, d):
    """A25."""
    return L.daily(load(spark, d, "events"), "ts", [F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value")])


@query()
def item_recompute(spark, d):
    """Every evaluation item's steps recomputed exactly."""

    @F.pandas_udf("string")
    def result(steps: pd.Series) -> pd.Series:
        return steps.map(lambda s: None if s is None else A.recompute([(x["op"], list(x["args"])) for x in s]))

    t = load(spark, d, "eval_items").select("item_id", "answer", result("checks").alias("result"))
    return t.withColumn("agrees", F.col("answer") == F.col("result"))


@query("""WITH p AS (SELECT user_id AS task, event_type AS sample, count(*) AS k FROM events GROUP BY ALL), t AS (SELECT task, count(*) AS m, sum(k - 1) AS d FROM p GROUP BY task), e AS (SELECT DISTINCT c_custkey AS task FROM customer)
    SELECT CAST(coalesce(sum(d), 0) AS BIGINT) AS duplicates, count(*) FILTER (m IS NULL) AS missing, count(*) FILTER (e.task IS NULL) AS unknown, count(*) FILTER (m <> 5) AS uneven FROM t FULL JOIN e USING (task)""".replace("e.task IS NULL", "etask IS NULL").replace("SELECT DISTINCT c_custkey AS task FROM", "SELECT DISTINCT c_custkey AS task, 1 AS etask FROM"))
def coverage_merge(spark, d):
    """Users as tasks, customers as the tasks expected."""
    preds = load(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("sample"))
    return A.coverage(preds, "task", "sample", load(spark, d, "customer").select(F.col("c_custkey").alias("task")), 5)


@query("""WITH c AS (SELECT lang, answer, count(*) AS n FROM eval_items WHERE answer IS NOT NULL GROUP BY ALL) SELECT lang, arg_min(answer, (-n, answer)) AS answer, round(max(n) / sum(n), 6) AS rate FROM c GROUP BY lang""")
def best_constant(spark, d):
    """A29."""
    return A.constant_baseline(load(spark, d, "eval_items"), ["lang"], "answer")


@query("""SELECT item_id, try_cast(replace(regexp_extract_all(prompt, '-?[0-9][0-9,]*(?:[.][0-9]+)?')[-1], ',', '') AS DOUBLE) AS number FROM eval_items""")
def last_numbers(spark, d):
    """The last number of each prompt."""
    return load(spark, d, "eval_items").select("item_id", A.last_number(F.col("prompt")).alias("number"))


_FOLD = """e AS (SELECT user_id AS name, event_type AS started, CASE event_id % 5 WHEN 0 THEN 'retracted' WHEN 1 THEN 'ok' WHEN 2 THEN 'fail' ELSE 'running' END AS status, event_id % 3 = 0 AS machine, event_id % 7 = 0 AS revives, event_id FROM events),
    r AS (SELECT *, max(CASE WHEN status = 'retracted' THEN event_id END) OVER (PARTITION BY name, started) AS gone FROM e),
    k AS (SELECT *, CASE WHEN revives AND event_id > gone THEN 4 WHEN status = 'retracted' THEN 3 WHEN status IN ('ok', 'fail') AND NOT machine THEN 2 WHEN status IN ('ok', 'fail') THEN 1 ELSE 0 END AS rank FROM r)"""


@query(f"WITH {_FOLD} SELECT name, started, arg_max(status, (rank, event_id)) AS status, arg_max(event_id, (rank, event_id)) AS event_id FROM k GROUP BY name, started")
def ledger_fold(spark, d):
    """L1: events as a ledger of runs (user, type)."""
    m = F.col("event_id") % 5
    t = load(spark, d, "events").select(
        F.col("user_id").alias("name"), F.col("event_type").alias("started"), F.when(m == 0, "retracted").when(m == 1, "ok").when(m == 2, "fail").otherwise("running").alias("status"),
        F.when(F.col("event_id") % 3 == 0, "monitor").otherwise("person").alias("writer"), (F.col("event_id") % 7 == 0).alias("revives"), "event_id",
    )
    return L.fold_events(t, ["name", "started"], "status", F.col("event_id"), F.col("writer"), F.col("revives")).select("name", "started", "status", "event_id")


@query("SELECT doc_id, scorer_name, scorer_version, ts, count(*) AS n FROM score_ledger GROUP BY doc_id, scorer_name, scorer_version, ts, score HAVING count(*) > 1".replace(", ts, count", ", ts, count").replace("GROUP BY doc_id, scorer_name, scorer_version, ts, score", "GROUP BY doc_id, scorer_name, scorer_version, ts"))
def ledger_repeats(spark, d):
    """L2: rows appended more than once."""
    return L.repeated_lines(load(spark, d, "score_ledger"), ["doc_id", "scorer_name", "scorer_version", "ts"])


@query("SELECT doc_id, scorer_name, scorer_version, count(DISTINCT score) AS n_values FROM score_ledger WHERE score IS NOT NULL GROUP BY ALL HAVING count(DISTINCT score) > 1")
def ledger_changes(spark, d):
    """L2: values that changed under one version."""
    return L.changed_values(load(spark, d, "score_ledger"), ["doc_id", "scorer_name", "scorer_version"], "score")


@query("""SELECT doc_id, sha256(array_to_string(list_filter(['backend=' || backend, 'doc_id=' || doc_id, 'model=' || model, 'ts=' || ts], lambda x: x IS NOT NULL), chr(10))) AS fp FROM score_ledger""")
def ledger_fingerprints(spark, d):
    """L3."""
    return load(spark, d, "score_ledger").select("doc_id", L.row_fingerprint(["doc_id", "ts", "model", "backend"]).alias("fp"))


@query("""WITH v AS (SELECT CASE WHEN trim(coalesce(doc_id, '')) = '' OR trim(coalesce(domain, '')) = '' OR trim(coalesce(scorer_name, '')) = '' OR trim(coalesce(scorer_version, '')) = '' THEN 'key'
    WHEN NOT regexp_matches(coalesce(ts, ''), '^[0-9]{4}-[0-9][0-9]-[0-9][0-9]T[0-9][0-9]:[0-9][0-9]:[0-9][0-9](?:[.][0-9]+)?Z$') THEN 'ts' WHEN score IS NOT NULL AND rubric_dims IS NOT NULL THEN 'both' WHEN score IS NULL AND rubric_dims IS NULL THEN 'neither'
    WHEN score IS NOT NULL AND NOT isfinite(score) THEN 'nonfinite' WHEN rubric_dims IS NOT NULL AND len(list_filter(map_values(rubric_dims), lambda x: x < 1 OR x > 5)) > 0 THEN 'grade'
    WHEN src_sha IS NOT NULL AND NOT regexp_matches(src_sha, '^[0-9a-f]{64}$') THEN 'sha' ELSE 'valid' END AS violation FROM score_ledger) SELECT violation, count(*) AS n FROM v GROUP BY violation""")
def ledger_violations(spark, d):
    """D7, SNK5, C7, C12."""
    t = load(spark, d, "score_ledger")
    return t.groupBy(F.coalesce(L.violations(t), F.lit("valid")).alias("violation")).agg(F.count("*").alias("n"))


_LINES = "SELECT event_id, 'step ' || (event_id % 400) || '/400 loss ' || value || ' gnorm ' || (event_id % 17) AS line FROM events"


@query(f"""WITH l AS ({_LINES}), p AS (SELECT event_id, CAST(regexp_extract(line, 'step ([0-9]+)', 1) AS BIGINT) AS step, 'loss' AS metric, try_cast(regexp_extract(line, 'loss ([0-9.eE+-]+)', 1) AS DOUBLE) AS value FROM l
    UNION ALL SELECT event_id, CAST(regexp_extract(line, 'step ([0-9]+)', 1) AS BIGINT), 'gnorm', try_cast(regexp_extract(line, 'gnorm ([0-9.eE+-]+)', 1) AS DOUBLE) FROM l)
    SELECT metric, step, arg_max(value, event_id) AS value FROM p WHERE value IS NOT NULL GROUP BY metric, step""")
def log_series(spark, d):
    """L4: log lines made of the events."""
    t = load(spark, d, "events").select("event_id", F.concat(F.lit("step "), (F.col("event_id") % 400).cast("string"), F.lit("/400 loss "), F.col("value").cast("string"), F.lit(" gnorm "), (F.col("event_id") % 17).cast("string")).alias("line"))
    return L.parse_log(t, "line", "event_id", {"loss": r"loss ([0-9.eE+-]+)", "gnorm": r"gnorm ([0-9.eE+-]+)"})


@query("""WITH x AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous, max(event_id) OVER (PARTITION BY user_id) AS last FROM events)
    SELECT user_id, event_id, value, previous, CASE WHEN previous IS NULL THEN 'new' WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'flat' END AS arrow FROM x WHERE event_id = last""")
def series_latest(spark, d):
    """L5."""
    return L.latest_with_previous(load(spark, d, "events"), ["user_id"], "event_id", "value")


@query("""WITH o AS (SELECT user_id, event_id AS step, value / 20 AS l, value / 8 AS g FROM events), t AS (SELECT *, sum(CASE WHEN g > 10 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run, row_number() OVER w AS seen, avg(l) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean FROM o WINDOW w AS (PARTITION BY user_id ORDER BY step)),
    r AS (SELECT user_id, step, CASE WHEN run >= 3 THEN 'gnorm' WHEN seen >= 20 AND mean > 3 THEN 'loss' END AS reason FROM t) SELECT user_id, min(step) AS step, arg_min(reason, step) AS reason FROM r WHERE reason IS NOT NULL GROUP BY user_id""")
def divergence_first(spark, d):
    """ST3 per user, with a window of 20."""
    t = load(spark, d, "events").select("user_id", F.col("event_id").alias("step"), F.col("event_id").alias("_n"), (F.col("value") / 20).alias("loss"), (F.col("value") / 8).alias("gnorm"))
    return L.divergence(t, ["user_id"], "step", "loss", "gnorm", window=20)


@query("""WITH c AS (SELECT user_id, event_id, 100 + value AS rate, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id = 0 OR event_id % 10 <> 0), g AS (SELECT user_id, count(*) AS n, min(rate) AS lo, max(rate) AS hi, median(rate) AS m FROM c WHERE r <= 5 GROUP BY user_id)
    SELECT user_id, n, hi = 0 OR (hi - lo) / hi <= 0.4 AS steady, CASE WHEN hi = 0 OR (hi - lo) / hi <= 0.4 THEN round(m, 6) END AS rate FROM g""")
def steady_rates(spark, d):
    """ST4 per user, over the last five readings."""
    t = load(spark, d, "events").withColumn("rate", F.col("value") + 100)
    return L.steady_rate(t, ["user_id"], "event_id", "rate", 10, tail=5, spread=0.4).withColumn("rate", F.round("rate", 6))


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type <> 'purchase' GROUP BY ALL)
    SELECT l.event_id, l.user_id, r.value AS as_of FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_value(spark, d):
    """2.12: each purchase with the user's last other value before it."""
    t = load(spark, d, "events")
    r = t.where("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return L.as_of(t.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), r, ["user_id"], "ts", "value").drop("ts")


@query("""WITH x AS (SELECT user_id, event_id, value > 50 AS up, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value > 50 ORDER BY event_id) AS g FROM events)
    SELECT user_id, max(n) AS longest FROM (SELECT user_id, up, g, count(*) AS n FROM x GROUP BY ALL) WHERE up GROUP BY user_id""")
def consecutive_runs(spark, d):
    """2.13: the longest run of values above 50 per user, by gaps and islands."""
    w = Window.partitionBy("user_id")
    t = load(spark, d, "events").withColumn("up", F.col("value") > 50)
    t = t.withColumn("g", F.row_number().over(w.orderBy("event_id")) - F.row_number().over(Window.partitionBy("user_id", "up").orderBy("event_id")))
    return t.where("up").groupBy("user_id", "g").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))
