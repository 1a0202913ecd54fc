"""Queries of near-duplicate reports, scorers and language models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import near as N
from ..operators import score as C
from ..operators.filters import SPAM_SCORE
from ..session import load, materialize
from .dedup_queries import _WORDS
from .registry import lit, query

_G5 = "list_distinct(list_transform(range(1, greatest(0, len(ws) - 4) + 1), lambda i: array_to_string(ws[i:i+4], ' ')))"
_NEAR = f"""g AS (SELECT doc_id, {_G5} AS s FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM g),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k, min(x.n) AS na, min(y.n) AS nb FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL), s AS (SELECT a, b, k / (na + nb - k) AS j FROM p)"""


@query(f"""WITH RECURSIVE {_NEAR}, t AS (SELECT a, b FROM s WHERE j >= 0.8 UNION SELECT b, a FROM s WHERE j >= 0.8), r(n, c) AS (SELECT a, a FROM t UNION SELECT t.b, r.c FROM r JOIN t ON t.a = r.n) SELECT n AS doc_id, min(c) AS component FROM r GROUP BY n""")
def near_dup_clusters(spark, d):
    """ND2-ND8, ND17: groups at five words and 0.8."""
    pairs = N.similar_pairs(load(spark, d, "documents"), "doc_id", "text")
    return N.clusters(pairs).select(F.col("node").alias("doc_id"), "component")


_GROUPS = f"""WITH RECURSIVE {_NEAR}, h(t, a, b, j) AS (SELECT t, a, b, j FROM s JOIN (VALUES (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) v(t) ON j >= t), u AS (SELECT t, a, b FROM h UNION SELECT t, b, a FROM h),
    r(t, n, c) AS (SELECT t, a, a FROM u UNION SELECT u.t, u.b, r.c FROM r JOIN u ON u.t = r.t AND u.a = r.n), k AS (SELECT t, n, min(c) AS c FROM r GROUP BY t, n)"""
_LARGEST = "w AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"


def _largest(docs) -> str | None:
    """The source of the most documents."""
    first = docs.where("source is not null").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").first()
    return first["source"] if first else None


@query(f"{_GROUPS} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT n FROM k WHERE t = 0.8 AND n <> c)")
def near_dup_survivors(spark, d):
    """ND11: documents left when each group keeps its first."""
    docs = load(spark, d, "documents")
    return N.survivors(docs.select("doc_id", "source"), "doc_id", N.clusters(N.similar_pairs(docs, "doc_id", "text")))


@query(
    f"""{_GROUPS}, y AS (SELECT t, count(*) AS participating, count(DISTINCT c) AS groups FROM k GROUP BY t), x AS (SELECT h.t, count(*) AS pairs, count(*) FILTER (p.source <> q.source) AS cr FROM h JOIN documents p ON h.a = p.doc_id JOIN documents q ON h.b = q.doc_id WHERE p.source IS NOT NULL AND q.source IS NOT NULL GROUP BY h.t),
    m AS (SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM s WHERE j >= 0.7 AND j < 0.85) AS band_pairs), z AS (SELECT t, coalesce(participating, 0) AS participating, coalesce(groups, 0) AS groups, coalesce(pairs, 0) AS pairs, cr, total, band_pairs, coalesce(participating, 0) / total AS p FROM (VALUES (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) v(t) LEFT JOIN y USING (t) LEFT JOIN x USING (t), m)
    SELECT t AS threshold, participating, participating - groups AS dropped, groups, round(p, 6) AS participation, pairs, CASE WHEN pairs > 0 THEN round(cr / pairs, 6) END AS cross_domain, band_pairs,
      round((p + 1.96 * 1.96 / (2 * total)) / (1 + 1.96 * 1.96 / total) - 1.96 * sqrt(p * (1 - p) / total + 1.96 * 1.96 / (4 * total * total)) / (1 + 1.96 * 1.96 / total), 6) AS low,
      round((p + 1.96 * 1.96 / (2 * total)) / (1 + 1.96 * 1.96 / total) + 1.96 * sqrt(p * (1 - p) / total + 1.96 * 1.96 / (4 * total * total)) / (1 + 1.96 * 1.96 / total), 6) AS high FROM z"""
)
def near_dup_report(spark, d):
    """ND8, ND9, ND13: participation and drop at three thresholds, similar pairs, and their share across sources."""
    docs = load(spark, d, "documents")
    pairs = materialize(N.similar_pairs(docs, "doc_id", "text", threshold=0.7), "pairs")
    return N.report(pairs, docs, "doc_id", "source", docs.count())


@query(
    f"""WITH {_NEAR}, c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS f FROM g WHERE len(s) > 0) SELECT a, b, round(j, 6) AS jaccard FROM s WHERE j >= 0.7 AND j < 1 AND a IN (SELECT f FROM c) AND b IN (SELECT f FROM c) ORDER BY j DESC, a, b LIMIT 20"""
)
def near_dup_top_pairs(spark, d):
    """ND9: the twenty most similar pairs of different texts."""
    pairs = N.similar_pairs(load(spark, d, "documents"), "doc_id", "text", threshold=0.7)
    return N.top_pairs(pairs).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(
    f"""WITH {_NEAR}, {_LARGEST}, x AS (SELECT a, b FROM s WHERE j >= 0.8 UNION SELECT b, a FROM s WHERE j >= 0.8)
    SELECT doc_id, source FROM documents d WHERE d.source IN (SELECT source FROM w) OR NOT EXISTS (SELECT 1 FROM x JOIN documents o ON o.doc_id = x.b JOIN w ON o.source = w.source WHERE x.a = d.doc_id)"""
)
def near_dup_keep_whole(spark, d):
    """ND12: the largest source kept whole."""
    docs = load(spark, d, "documents")
    pairs = materialize(N.similar_pairs(docs, "doc_id", "text"), "pairs")
    return N.keep_whole(docs.select("doc_id", "source"), "doc_id", "source", _largest(docs), pairs)


@query(
    f"""{_GROUPS}, {_LARGEST}, o AS (SELECT doc_id FROM documents JOIN w USING (source)) SELECT (SELECT count(*) FROM s WHERE j >= 0.8 AND a IN (SELECT doc_id FROM o) AND b IN (SELECT doc_id FROM o)) AS whole_pairs,
    (SELECT count(*) FROM k WHERE t = 0.8 AND n <> c AND n IN (SELECT doc_id FROM o)) AS spared"""
)
def near_dup_whole_check(spark, d):
    """ND12: similar pairs inside the source kept whole, and its rows that only the constraint spares."""
    docs = load(spark, d, "documents")
    pairs = materialize(N.similar_pairs(docs, "doc_id", "text"), "pairs")
    return N.whole_check(docs.select("doc_id", "source"), "doc_id", "source", _largest(docs), pairs, N.clusters(pairs))


@query()
def near_dup_calibration(spark, d):
    """ND5, ND10: the estimate against exact similarity, over all candidate pairs."""
    sig = N.signed(load(spark, d, "documents"), "doc_id", "text", 5, 96)
    s = N.similarity(N.candidates(sig, "doc_id", 24, 4), sig, "doc_id")
    return s.agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs(F.col("jaccard") - F.col("estimate"))), 6).alias("mae"), F.round(F.avg(N.recall_bound(F.col("jaccard"), 24, 4)), 6).alias("expected_recall"))


@query()
def minhash_seen(spark, d):
    """ND1: documents that share a bucket with an earlier one that was kept, on windows of five characters."""
    sig = N.signed_chars(load(spark, d, "documents"), "doc_id", "text")
    return N.seen_before(sig, "doc_id", 16, 8)


@query(
    f"""WITH {_NEAR}, n AS (SELECT a AS doc_id FROM s WHERE j >= 0.8 UNION SELECT b FROM s WHERE j >= 0.8), m AS (SELECT doc_id FROM documents ORDER BY sha1('n|' || doc_id), doc_id LIMIT 500)
    SELECT count(*) AS sampled, count(n.doc_id) AS near, round(count(n.doc_id) / count(*), 6) AS rate FROM m LEFT JOIN n USING (doc_id)"""
)
def near_rate_sample(spark, d):
    """ND15: the share of 500 sampled documents that have a near-duplicate among all; sampling is the operator."""
    from ..operators.sampling import global_sample

    docs = load(spark, d, "documents")
    return N.sampled_rate(docs, "doc_id", N.clusters(N.similar_pairs(docs, "doc_id", "text")), global_sample(docs.select("doc_id"), "doc_id", 500, "n"))


@query(
    f"""{_GROUPS}, z AS (SELECT c AS component, count(*) AS size, count(DISTINCT source) AS n_domains FROM k JOIN documents ON n = doc_id WHERE t = 0.8 GROUP BY c), b AS (SELECT *, CASE WHEN size = 2 THEN '2' WHEN size <= 5 THEN '3-5' ELSE '6+' END AS band FROM z)
    SELECT component, size, n_domains, band FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY sha1('r' || component), component) AS r FROM b) WHERE r <= 5"""
)
def cluster_sheet(spark, d):
    """ND18."""
    docs = load(spark, d, "documents")
    return N.reading_sheet(N.clusters(N.similar_pairs(docs, "doc_id", "text")), docs, "doc_id", "source", 5, "r")


_R8 = "list_transform(range(1, greatest(0, len(ws) - 7) + 1), lambda i: array_to_string(ws[i:i+7], ' '))"


@query(f"WITH w AS (SELECT {_WORDS} AS ws FROM documents), r AS (SELECT unnest({_R8}) AS g FROM w) SELECT count(*) AS runs, count(DISTINCT g) AS distinct_runs, round(count(DISTINCT g) / greatest(count(*), 1), 6) AS rate, (SELECT round((count(*) - count(DISTINCT sha1(substr(text, 1, 4096)))) / count(*), 6) FROM documents) AS same_head FROM r")
def self_repetition(spark, d):
    """ND16."""
    return N.self_repetition(load(spark, d, "documents"), "text")


@query(
    f"""WITH m AS (SELECT doc_id, text FROM documents ORDER BY sha1('s|' || doc_id), doc_id LIMIT 400), w AS (SELECT doc_id, list_distinct({_WORDS}) AS ws FROM m), e AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS x FROM w), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (min(a.n) + min(b.n) - count(*)) AS j FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    c AS (SELECT count(*) FILTER (j >= 0.3 AND j < 0.5) AS x, count(*) FILTER (j >= 0.5 AND j < 0.7) AS y, count(*) FILTER (j >= 0.7) AS z FROM p), k AS (SELECT count(*) FILTER (len(ws) > 0) AS n FROM w)
    SELECT CAST(n * (n - 1) // 2 AS BIGINT) AS pairs, x AS from_0_3, y AS from_0_5, z AS from_0_7, round((x + y) / greatest(n * (n - 1) // 2, 1), 6) AS reskin_rate FROM c, k"""
)
def reskin_bands(spark, d):
    """ND16, R2: pairs of 400 sampled documents by the similarity of their words; sampling is the operator."""
    from ..operators.sampling import global_sample

    return N.similarity_bands(global_sample(load(spark, d, "documents").select("doc_id", "text"), "doc_id", 400, "s"), "doc_id", "text")


@query()
def cluster_mass(spark, d):
    """ND16, R3: how much of 2,000 sampled documents the ten largest of fifty clusters hold; sampling is the operator."""
    from ..operators.sampling import global_sample

    return N.cluster_mass(global_sample(load(spark, d, "documents").select("doc_id", "text"), "doc_id", 2000, "c"), "text", 50)


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), g AS (SELECT doc_id, unnest(list_distinct({_R8})) AS g FROM w), r AS (SELECT doc_id, row_number() OVER (PARTITION BY g ORDER BY doc_id) AS r FROM g)
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE r > 3)""")
def gram_budget(spark, d):
    """ND14."""
    return N.gram_budget(load(spark, d, "documents"), "doc_id", "text").select("doc_id")


_LABELLED = "l AS (SELECT doc_id, chunk_idx, length(text) AS score, list_aggregate(labels, 'avg') >= 3 AS label, list_aggregate(labels, 'avg') AS grade FROM (SELECT DISTINCT doc_id, chunk_idx, text, labels FROM l2_dataset WHERE labels IS NOT NULL AND text IS NOT NULL))"


def _labelled(spark, d):
    mean = F.aggregate("labels", F.lit(0.0), lambda s, x: s + x) / F.size("labels")
    t = load(spark, d, "l2_dataset").where("labels is not null and text is not null").select("doc_id", "chunk_idx", "text", "labels").distinct()
    return t.select("doc_id", "chunk_idx", F.length("text").alias("score"), (mean >= 3).alias("label"), mean.alias("grade"))


@query(f"WITH {_LABELLED}, r AS (SELECT label, row_number() OVER (ORDER BY score, doc_id, chunk_idx) AS r FROM l) SELECT round((sum(r) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2) / (count(*) FILTER (label) * count(*) FILTER (NOT label)), 6) AS auc, count(*) FILTER (label) AS positives, count(*) FILTER (NOT label) AS negatives FROM r")
def auc_rank(spark, d):
    """Length as a score for good grades."""
    return C.rank_auc(_labelled(spark, d), "label", "score", ["doc_id", "chunk_idx"])


@query(f"WITH {_LABELLED}, x AS (SELECT row_number() OVER (ORDER BY score, doc_id, chunk_idx) AS a, row_number() OVER (ORDER BY grade, doc_id, chunk_idx) AS b FROM l) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM x")
def spearman_rho(spark, d):
    """C10."""
    return C.spearman(_labelled(spark, d), "score", "grade", ["doc_id", "chunk_idx"])


@query(f"WITH {_LABELLED}, e AS (SELECT quantile_cont(score, [0, 0.25, 0.5, 0.75, 1]) AS q FROM l), b AS (SELECT i AS band, q[i] AS lo, q[i+1] AS hi FROM e, range(1, 5) t(i)) SELECT CAST(band AS INT) AS band, count(*) AS n, round(avg(grade), 6) AS mean FROM l JOIN b ON score BETWEEN lo AND hi GROUP BY band")
def score_bands(spark, d):
    """Bands closed at both ends."""
    return C.quartile_bands(_labelled(spark, d), "score", "grade")


@query("WITH c AS (SELECT quantile_cont(n_chars, 0.6) AS cut FROM documents) SELECT cut, count(*) FILTER (n_chars >= cut) AS kept, count(n_chars) AS n FROM documents, c GROUP BY cut")
def quantile_keep(spark, d):
    """The longest 40 %."""
    return C.keep_by_quantile(load(spark, d, "documents"), "n_chars", 0.4)


@query(f"WITH {_LABELLED}, c AS (SELECT s AS share, (SELECT quantile_cont(score, 1 - s) FROM l) AS cut FROM (VALUES (CAST(0.2 AS DOUBLE)), (CAST(0.3 AS DOUBLE)), (CAST(0.4 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) v(s)) SELECT share, cut, round(avg(CAST(label AS INT)) FILTER (score >= cut), 6) AS rate FROM l, c GROUP BY share, cut".replace("(SELECT quantile_cont(score, 1 - s) FROM l)", "CASE s WHEN 0.2 THEN (SELECT quantile_cont(score, 0.8) FROM l) WHEN 0.3 THEN (SELECT quantile_cont(score, 0.7) FROM l) WHEN 0.4 THEN (SELECT quantile_cont(score, 0.6) FROM l) ELSE (SELECT quantile_cont(score, 0.5) FROM l) END"))
def keep_rate_table(spark, d):
    """C15."""
    return C.keep_rates(_labelled(spark, d), "score", "label", [0.2, 0.3, 0.4, 0.5])


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'a' WHEN p_size % 3 = 1 AND p_partkey % 2 = 1 THEN 'b' WHEN p_size % 3 = 2 AND p_partkey % 5 = 0 THEN 'tie' ELSE 'abstain' END AS verdict FROM part".replace("p_size % 3 = 0 AND p_partkey % 2 = 0", "o1 = 'first' AND o2 = 'second'").replace("p_size % 3 = 1 AND p_partkey % 2 = 1", "o1 = 'second' AND o2 = 'first'").replace("p_size % 3 = 2 AND p_partkey % 5 = 0", "o1 = 'tie' AND o2 = 'tie'").replace("FROM part", "FROM (SELECT p_partkey, ['first', 'second', 'tie'][p_size % 3 + 1] AS o1, ['second', 'first', 'tie'][p_partkey % 3 + 1] AS o2 FROM part)"))
def judge_verdicts(spark, d):
    """C11: parts as pairs."""
    names = lambda c, *v: F.get(F.array(*(F.lit(x) for x in v)), (F.col(c) % 3).cast("int"))
    return load(spark, d, "part").select("p_partkey", C.swap_verdict(names("p_size", "first", "second", "tie"), names("p_partkey", "second", "first", "tie")).alias("verdict"))


@query("SELECT event_id, props, try_cast(regexp_extract(props, '(-?[0-9]+(?:[.][0-9]+)?)', 1) AS DOUBLE) AS number FROM events")
def reply_numbers(spark, d):
    """The first number of each event's properties."""
    return load(spark, d, "events").select("event_id", "props", C.reply_number(F.col("props")).alias("number"))


@query(
    """WITH t AS (SELECT map_keys(rubric_dims) AS k, map_values(rubric_dims) AS v FROM score_ledger WHERE rubric_dims IS NOT NULL), d AS (SELECT list_sort(list(DISTINCT x)) AS d FROM (SELECT unnest(k) AS x FROM t))
    SELECT CAST(len(k) AS INT) AS n, count(*) AS rows, count(*) FILTER (list_sort(k) = d AND len(list_filter(v, lambda x: x IS NULL OR x < 1 OR x > 5)) = 0) AS parsed FROM t, d GROUP BY len(k)"""
)
def rubric_replies(spark, d):
    """The ledger's grades written as replies and read again, against all dimensions that it knows."""
    t = load(spark, d, "score_ledger").where("rubric_dims is not null")
    dims = [r[0] for r in t.select(F.explode(F.map_keys("rubric_dims")).alias("k")).distinct().collect()]  # the names of a rubric's dimensions
    back = t.select("doc_id", "ts", C.rubric_scores(F.to_json("rubric_dims"), dims).alias("g"), F.size("rubric_dims").alias("n"))
    return back.groupBy("n").agg(F.count("*").alias("rows"), F.count("g").alias("parsed"))


_W = [((i * 37) % 11 - 5) / 10 for i in range(256)]


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT vec_id, list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * (((i - 1) * 37) % 11 - 5) / 10.0)) / sqrt(list_sum(list_transform(e, lambda x: x * x))) + 0.05 AS s FROM v)
    SELECT vec_id, round(s, 6) AS score, s >= 0.1 AS kept FROM s""")
def embedding_head_cut(spark, d):
    """C16 with fixed weights."""
    t = load(spark, d, "embeddings")
    n = t.select(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    s = C.head_score(F.col("embedding"), _W[:n], 0.05)
    return t.select("vec_id", F.round(s, 6).alias("score"), (s >= 0.1).alias("kept"))


@query()
def embedding_logistic(spark, d):
    """A head trained on the embeddings; the area under its curve."""
    t = load(spark, d, "embeddings")
    _, scored = C.embedding_head(t, "embedding", F.col("label") % 2 == 0)
    return C.rank_auc(scored.withColumn("y", F.col("label") == 1.0), "y", "score", ["vec_id"])


def _head(spark, d, kind: str):
    """A head that tells code from prose, cross-validated; its area under the curve and the percentiles of its scores with the penalty."""
    t = load(spark, d, "l2_dataset").where("text is not null and doc_id is not null and rubric_kind is not null").select("doc_id", "chunk_idx", "text", (F.col("rubric_kind") == "code").alias("code")).distinct()
    scored = C.text_head(t, ["doc_id", "chunk_idx"], "text", F.col("code"), kind, 1 << 18).withColumn("y", F.col("label") == 1).withColumn("final", C.penalised(F.col("score"), "text", SPAM_SCORE))
    auc = C.rank_auc(scored.drop("text", "final"), "y", "score", ["doc_id", "chunk_idx"])
    return auc.join(C.score_percentiles(scored, "final"))


@query()
def text_quality_head(spark, d):
    """A head on hashed character grams, five folds."""
    return _head(spark, d, "chars")


@query()
def byte_word_head(spark, d):
    """A head on byte grams and a bag of words, five folds, in 2^18 slots."""
    return _head(spark, d, "bytes")


@query(
    f"WITH s AS (SELECT n_chars / 1000 - CASE WHEN regexp_matches(text, {lit(SPAM_SCORE)} || '|' || 'museum') THEN 5 ELSE 0 END AS s FROM documents) SELECT count(s) AS n, "
    + ", ".join(f"quantile_cont(s, {x}) AS p{round(100 * x)}" for x in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) + " FROM s"
)
def penalised_percentiles(spark, d):
    """C4 over all documents: length as the score; a word of this corpus stands beside the spam, of which it has none."""
    t = load(spark, d, "documents").withColumn("s", C.penalised(F.col("n_chars") / 1000, "text", SPAM_SCORE + "|museum"))
    return C.score_percentiles(t, "s")


_TOKS = f"regexp_extract_all(text, {lit(T.WORD)})"
_PAD = f"p AS (SELECT doc_id, list_concat(['<s>', '<s>'], {_TOKS}, ['</s>']) AS p FROM documents WHERE len({_TOKS}) > 0), t AS (SELECT doc_id, p[i-2] || ' ' || p[i-1] AS uv, p[i-1] AS v, p[i] AS w FROM (SELECT doc_id, p, unnest(range(3, len(p) + 1)) AS i FROM p))"


@query(f"WITH {_PAD}, c AS (SELECT 1 AS o, '' AS ctx, w AS word FROM t UNION ALL SELECT 2, v, w FROM t UNION ALL SELECT 3, uv, w FROM t) SELECT o, ctx, word, count(*) AS n FROM c GROUP BY ALL")
def ngram_counts(spark, d):
    """C6, SNK10: the counts that are the model."""
    return C.gram_counts(load(spark, d, "documents"), "text", 3)


@query(
    f"""WITH {_PAD}, c3 AS (SELECT uv, w, count(*) AS c3 FROM t GROUP BY ALL), c2 AS (SELECT v, w, count(*) AS c2 FROM t GROUP BY ALL), d AS (SELECT CASE WHEN count(*) FILTER (c3 <= 2) > 0 THEN count(*) FILTER (c3 = 1) / (count(*) FILTER (c3 = 1) + 2 * count(*) FILTER (c3 = 2)) ELSE 0.75 END AS d, (SELECT count(*) FROM c2) AS types FROM c3),
    l AS (SELECT w, count(*) AS l FROM c2 GROUP BY w), s3 AS (SELECT uv, sum(c3) AS tt, count(*) AS tk FROM c3 GROUP BY uv), s2 AS (SELECT v, sum(c2) AS bt, count(*) AS bk FROM c2 GROUP BY v),
    x AS (SELECT doc_id, (greatest(0, c3 - d) + d * tk * ((greatest(0, c2 - d) + d * bk * (l / types)) / bt)) / tt AS p FROM t JOIN c3 USING (uv, w) JOIN c2 USING (v, w) JOIN l USING (w) JOIN s3 USING (uv) JOIN s2 USING (v), d)
    SELECT doc_id, count(*) AS n_tokens, round(exp(-sum(ln(greatest(p, 1e-12))) / count(*)), 4) AS perplexity FROM x GROUP BY doc_id"""
)
def kn_perplexity(spark, d):
    """A trigram model of all documents, scored on them."""
    uses = materialize(C.trigram_uses(load(spark, d, "documents"), "text", "doc_id"), "uses")
    model = C.KneserNey(C.counts_of(uses))
    return model.perplexity(uses, "doc_id").select("doc_id", "n_tokens", F.round("perplexity", 4).alias("perplexity"))


@query(
    f"""WITH p AS (SELECT lang, list_concat(['<s>', '<s>'], {_TOKS}, ['</s>']) AS p FROM documents WHERE len({_TOKS}) > 0), t AS (SELECT lang, p[i-2] || ' ' || p[i-1] AS uv, p[i-1] AS v, p[i] AS w FROM (SELECT lang, p, unnest(range(3, len(p) + 1)) AS i FROM p)),
    a AS (SELECT * FROM t WHERE lang = 'en'), b AS (SELECT uv, v, w, count(*) AS times FROM t WHERE lang <> 'en' GROUP BY ALL),
    c3 AS (SELECT uv, w, count(*) AS n3 FROM a GROUP BY ALL), c2 AS (SELECT v, w, count(*) AS n2 FROM a GROUP BY ALL), c1 AS (SELECT w, count(*) AS n1 FROM a GROUP BY ALL),
    s3 AS (SELECT uv, count(*) AS t3 FROM a GROUP BY ALL), s2 AS (SELECT v, count(*) AS t2 FROM a GROUP BY ALL), s1 AS (SELECT count(*) AS t1 FROM a),
    j AS (SELECT times, 1e-9 + 0.6 * coalesce(n3 / t3, 0) + 0.3 * coalesce(n2 / t2, 0) + 0.1 * coalesce(n1 / t1, 0) AS p FROM b LEFT JOIN c3 USING (uv, w) LEFT JOIN s3 USING (uv) LEFT JOIN c2 USING (v, w) LEFT JOIN s2 USING (v) LEFT JOIN c1 USING (w), s1)
    SELECT round(sum(-log2(p) * times) / (SELECT sum(length(text)) FROM documents WHERE lang <> 'en'), 6) AS bits_per_char, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents WHERE lang <> 'en') AS chars FROM j"""
)
def bits_per_char(spark, d):
    """C17: English against the other languages of the documents under one model."""
    docs = load(spark, d, "documents")
    return C.bits_per_char(docs.where("lang = 'en'"), docs.where("lang <> 'en'"), "text")


@query("""WITH s AS (SELECT source, avg(n_chars) AS chars, count(*) AS n FROM documents GROUP BY source), x AS (SELECT *, (chars - min(chars) OVER ()) / (max(chars) OVER () - min(chars) OVER ()) AS a, 1 - (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) AS b FROM s) SELECT source, round((a + b) / 2, 6) AS score FROM x""")
def ranked_sources(spark, d):
    """C17: several metrics on one scale, over the few sources."""
    g = load(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("chars"), F.count("*").alias("n"))
    return C.min_max(g, {"chars": True, "n": False}).select("source", F.round("score", 6).alias("score"))


