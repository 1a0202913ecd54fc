"""Queries of the normalisers and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters as O
from ..operators import tables
from ..session import load
from .registry import lit, query

S = T.SPACE


def _rep(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def _strip(x: str) -> str:
    return _rep(x, rf"^[{S}]+|[{S}]+$")


def _collapse(x: str) -> str:
    return f"trim({_rep(x, f'[{S}]+', ' ')})"


def _lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"


_SQUASH = _rep("text", T.NOT_WORD)


@query(
    f"""SELECT doc_id, md5({_SQUASH}) AS squashed, md5({_strip(_rep('text', T.SPECIAL))}) AS plain, md5({_collapse('text')}) AS collapsed,
        md5({_collapse('lower(text)')}) AS skeleton, substr(sha1({_rep('text', T.HOLDOUT_DROP)}), 1, 16) AS holdout_key,
        substr(sha1({_SQUASH}), 1, 24) AS exact_key, {_count('text', T.BAD)} AS bad_chars FROM documents"""
)
def normalised_keys(spark, d):
    """N1-N5, N8, H1, X1 for every document."""
    t = load(spark, d, "documents")
    return t.select(
        "doc_id", F.md5(T.squash("text")).alias("squashed"), F.md5(T.strip_special("text")).alias("plain"), F.md5(T.collapse("text")).alias("collapsed"),
        F.md5(T.skeleton("text")).alias("skeleton"), T.holdout_key("text").alias("holdout_key"), T.exact_key("text").alias("exact_key"), T.bad_chars("text").alias("bad_chars"),
    )


@query()
def code_normalised(spark, d):
    """N6 over the code records."""
    t = load(spark, d, "l2_dataset").where("rubric_kind = 'code'")
    return t.select("doc_id", "chunk_idx", F.md5(T.code_norm("text")).alias("key"), F.length(T.code_norm("text")).alias("n"))


@query("SELECT doc_id, md5(translate(text, '图书馆长训练', '圖書館長訓練')) AS folded FROM documents")
def folded_script(spark, d):
    """N7 with a small table."""
    pairs = dict(zip("图书馆长训练", "圖書館長訓練"))
    return load(spark, d, "documents").select("doc_id", F.md5(T.fold_chars("text", pairs)).alias("folded"))


@query(
    f"""SELECT doc_id, md5({_strip(f"regexp_replace(regexp_extract(text, {lit('^((?s:.*?))(?:' + T.ANSWER_TAIL + '|$)')}, 1), {lit(T.QA_PREFIX)}, '')")}) AS body
        FROM documents WHERE domain = 'chat' AND NOT regexp_matches(text, {lit(T.ANSWER_TAIL)})
        UNION ALL SELECT doc_id, md5({_strip(f"regexp_replace(string_split_regex(text, {lit(T.ANSWER_TAIL)})[1], {lit(T.QA_PREFIX)}, '')")}) AS body
        FROM documents WHERE domain = 'chat' AND regexp_matches(text, {lit(T.ANSWER_TAIL)})""".replace(
        f"regexp_extract(text, {lit('^((?s:.*?))(?:' + T.ANSWER_TAIL + '|$)')}, 1)", "text"
    )
)
def question_bodies(spark, d):
    """N9 over the chats."""
    return load(spark, d, "documents").where("domain = 'chat'").select("doc_id", F.md5(T.question_body("text")).alias("body"))


@query(
    f"""SELECT string_split(source, '_')[-1] AS tag, CASE WHEN length(text) < 400 THEN 'xs' WHEN length(text) < 1200 THEN 's' WHEN length(text) < 3000 THEN 'm'
        WHEN length(text) < 8000 THEN 'l' ELSE 'xl' END AS band, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL"""
)
def length_band_profile(spark, d):
    """Documents by the source's tag and the length band."""
    t = load(spark, d, "documents")
    return t.groupBy(T.last_segment("source", "_").alias("tag"), T.length_band("text").alias("band")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    f"""SELECT doc_id, md5({_strip(_rep(_rep(_rep('text', chr(92) + 'x{1b}' + chr(92) + '[[0-9;]*[A-Za-z]'), '</?(?:local-command|command)-[a-z]+>'), chr(10) + '{3,}', chr(10) * 2))}) AS cleaned FROM documents"""
)
def cleaned_context(spark, d):
    """N16."""
    return load(spark, d, "documents").select("doc_id", F.md5(T.clean_context("text")).alias("cleaned"))


@query(
    f"""WITH w AS (SELECT doc_id, {_SQUASH} AS s, {_collapse('lower(text)')} AS k FROM documents),
        l AS (SELECT doc_id, s, CASE WHEN k = '' THEN [] ELSE string_split(k, ' ') END AS ws FROM w)
        SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(1, length(s) - 4) + 1), lambda i: substr(s, i, 5)))) AS char5,
        len(list_distinct(list_transform(range(1, greatest(0, len(ws) - 2) + 1), lambda i: array_to_string(ws[i:i+2], ' ')))) AS word3,
        len(list_distinct(list_transform(range(1, greatest(0, len(ws) - 12) + 1), lambda i: array_to_string(ws[i:i+12], ' ')))) AS word13 FROM l"""
)
def gram_counts(spark, d):
    """Sizes of three n-gram sets."""
    t = load(spark, d, "documents")
    words = T.spaced_words("text")
    return t.select("doc_id", F.size(T.char_grams(T.squash("text"), 5)).alias("char5"), F.size(T.word_grams(words, 3)).alias("word3"), F.size(T.word_grams(words, 13)).alias("word13"))


@query(
    """WITH g AS (SELECT item_id, regexp_extract_all(lower(prompt), '[\\x{4e00}-\\x{9fff}]') AS c, regexp_extract_all(lower(prompt), '[a-z0-9]+') AS w FROM eval_items),
        u AS (SELECT item_id, CASE WHEN len(c) > 0 THEN c ELSE w END AS x FROM g)
        SELECT item_id, len(list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i+1]))) AS bigrams FROM u"""
)
def item_bigrams(spark, d):
    """N18 over the evaluation items."""
    return load(spark, d, "eval_items").select("item_id", F.size(T.bigram_set("prompt")).alias("bigrams"))


@query(
    f"""SELECT doc_id, {_count('text', T.WORD)} AS tokens, md5(substr(text, 1, 600)) AS head FROM documents"""
)
def word_token_counts(spark, d):
    """N20, N21, M15."""
    return load(spark, d, "documents").select("doc_id", F.size(T.word_tokens("text")).alias("tokens"), F.md5(T.head("text", 600)).alias("head"))


@query(
    """SELECT i.item_id, len(list_filter(range(1, length(answer) - 1), lambda k: contains(prompt, substr(answer, k, 3)))) > 0 AND length(answer) >= 3 AS shared
        FROM eval_items i WHERE answer IS NOT NULL"""
)
def answer_in_prompt(spark, d):
    """Does an answer share three characters in a row with its prompt."""
    return load(spark, d, "eval_items").where("answer is not null").select("item_id", T.shares_span("answer", "prompt", 3).alias("shared"))


_LIGHT = f"CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) > 200000 THEN 'long' WHEN {_count('text', T.BAD)} > 0.001 * length(text) THEN 'bad_bytes' END"


@query(
    f"""WITH r AS (SELECT doc_id, {_LIGHT} AS reason, substr(sha1({_SQUASH}), 1, 24) AS k FROM documents),
        e AS (SELECT CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY reason, k ORDER BY doc_id) > 1 THEN 'exact_dup' ELSE 'kept' END AS reason FROM r)
        SELECT n.reason, count(e.reason) AS n FROM (VALUES ('short'), ('long'), ('bad_bytes'), ('exact_dup'), ('kept')) n(reason) LEFT JOIN e USING (reason) GROUP BY n.reason"""
)
def reject_histogram(spark, d):
    """The light tier, exact duplicates after it, and every reason counted."""
    t = load(spark, d, "documents").select("doc_id", O.light_reason("text").alias("reason"), T.exact_key("text").alias("key"))
    first = t.where("reason is null").groupBy("key").agg(F.count("*").alias("n"))
    dup = first.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("exact_dup").alias("reason"), "n")
    kept = first.agg(F.count("*").alias("n")).select(F.lit("kept").alias("reason"), "n")
    bad = t.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(k,) for k in ("short", "long", "bad_bytes", "exact_dup", "kept")], "reason string")
    return names.join(bad.unionByName(dup).unionByName(kept), "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


_SOLID = f"greatest(1, length({_rep('text', f'[{S}]')}))"
_LS = _lines("text")
GARBAGE = r"(学校|学院).{0,30}(是一所|位于|坐落于)|高尔夫.{0,40}(教练|挥杆|球场)"


@query(
    f"""WITH r AS (SELECT text, {_LS} AS ls, {_SOLID} AS solid, length(text) AS n FROM documents),
        x AS (SELECT CASE WHEN n < 200 THEN 'short' WHEN n > 50000 THEN 'long' WHEN {_count('text', T.CJK)} / solid < 0.6 THEN 'not_zh'
        WHEN {_count('text', T.BAD)} > 0.001 * n THEN 'bad_bytes' WHEN {_count('text', '[^' + chr(92) + 'p{L}_]')} / solid > 0.35 THEN 'symbols'
        WHEN {_count('text', chr(92) + 'p{Nd}')} / solid > 0.2 THEN 'digits' WHEN {_count('text', O.BOILER)} >= 3 THEN 'boilerplate'
        WHEN {_count('text', T.URL)} > 3 * n / 1000 THEN 'urls'
        WHEN len(ls) >= 5 AND len(list_filter(ls, lambda x: length(x) < 10)) / len(ls) > 0.5 THEN 'nav_menu'
        WHEN len(ls) >= 5 AND len(list_distinct(ls)) / len(ls) < 0.7 THEN 'dup_lines'
        WHEN n < 500 AND NOT regexp_matches(text, {lit(O.END_OK)}) THEN 'unfinished'
        WHEN regexp_matches(substr(text, 1, 600), {lit(GARBAGE)}) THEN 'garbage_topic' ELSE 'kept' END AS reason FROM r)
        SELECT n.reason, count(x.reason) AS n FROM (SELECT unnest(['short','long','not_zh','bad_bytes','symbols','digits','boilerplate','urls','nav_menu','dup_lines','unfinished','garbage_topic','kept']) AS reason) n
        LEFT JOIN x USING (reason) GROUP BY n.reason"""
)
def web_reject_histogram(spark, d):
    """The web tier; most of this corpus isn't Chinese."""
    known = ["short", "long", "not_zh", "bad_bytes", "symbols", "digits", "boilerplate", "urls", "nav_menu", "dup_lines", "unfinished", "garbage_topic"]
    t = load(spark, d, "documents").withColumn("reason", O.web_reason("text", GARBAGE))
    return O.histogram(t, "reason", known)


@query(
    f"""WITH s AS (SELECT doc_id, text, list_filter(string_split_regex(text, {lit(f'[{S}，,。；;]')}), lambda x: length(x) > 4) AS segs,
        list_filter(string_split_regex(text, '[。！？；!?;]'), lambda x: {_strip('x')} <> '') AS sents FROM documents),
        r AS (SELECT CASE WHEN regexp_matches(text, {lit(O.SPAM)}) THEN 'spam' WHEN length(text) < 200 THEN 'short'
        WHEN len(segs) >= 8 AND 1 - len(list_distinct(segs)) / len(segs) > 0.30 THEN 'repetitive'
        WHEN len(sents) >= 6 AND list_sum(list_transform(sents, lambda x: length(x))) < 9.0 * len(sents) THEN 'fragmented' ELSE 'kept' END AS reason FROM s)
        SELECT n.reason, count(r.reason) AS n FROM (SELECT unnest(['spam','short','repetitive','fragmented','kept']) AS reason) n LEFT JOIN r USING (reason) GROUP BY n.reason"""
)
def clean_histogram(spark, d):
    """F5."""
    t = load(spark, d, "documents").withColumn("reason", O.clean_reason("text"))
    return O.histogram(t, "reason", ["spam", "short", "repetitive", "fragmented"])


@query()
def autogenerated_files(spark, d):
    """N13, F6 over the code records."""
    t = load(spark, d, "l2_dataset").where("rubric_kind = 'code' and text is not null")
    return t.where(O.autogenerated("text")).select("doc_id", "chunk_idx").distinct()


@query(
    f"""WITH l AS (SELECT doc_id, unnest({_LS}) AS line FROM documents), c AS (SELECT line FROM l GROUP BY line HAVING count(DISTINCT doc_id) >= 8),
        h AS (SELECT doc_id, count(*) AS n_common FROM l WHERE line IN (SELECT line FROM c) GROUP BY doc_id)
        SELECT d.doc_id, len({_LS}) AS n_lines, coalesce(n_common, 0) AS n_common, coalesce(n_common, 0) > 0.5 * len({_LS}) AS boilerplate
        FROM documents d LEFT JOIN h USING (doc_id)"""
)
def boilerplate_lines(spark, d):
    """F10."""
    return O.boilerplate_share(load(spark, d, "documents"), "doc_id")


@query(
    f"""SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(substr(text, 1, 250), {lit(O.PLACEHOLDER)})) AS placeholders,
        count(*) FILTER ({_count('text', T.WORD)} < 50) AS below_floor, count(*) FILTER ({_count('text', T.WORD)} BETWEEN 800 AND 6000) AS chapter_sized FROM documents GROUP BY source"""
)
def placeholder_counts(spark, d):
    """placeholder openings and token bounds by source."""
    t = load(spark, d, "documents").withColumn("k", F.size(T.word_tokens("text")))
    return t.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(O.placeholder("text")).alias("placeholders"), F.count_if(F.col("k") < 50).alias("below_floor"), F.count_if(F.col("k").between(800, 6000)).alias("chapter_sized")
    )


@query(
    """SELECT lower(trim(domain)) AS domain, count(*) AS n, count(*) FILTER (floor(score) >= 4) AS kept FROM score_ledger
        WHERE scorer_name = 'fineweb-edu' AND score IS NOT NULL AND isfinite(score) GROUP BY lower(trim(domain))"""
)
def score_gate(spark, d):
    """rows of the upstream scorer whose integer score is 4 or more."""
    t = load(spark, d, "score_ledger").where("scorer_name = 'fineweb-edu' and score is not null and not isnan(score) and abs(score) <> double('infinity')")
    return t.groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.count("*").alias("n"), F.count_if(F.floor("score") >= 4).alias("kept"))


_MARKS = " + ".join(f"(length(text) - length(replace(text, {lit(m)}, ''))) // {len(m)}" for m in O.CODE_MARKS)


@query(
    f"""SELECT source, count(*) AS n, count(*) FILTER ({_MARKS} >= 4 OR regexp_matches(substr(text, 1, 400), {lit(O.ASKS_CODE)})) AS code,
        count(*) FILTER (regexp_matches(substr(text, 1, 600), {lit(O.MARKUP_HINT)}) OR {_count('substr(text, 1, 4000)', O.MARKUP_TAG)} >= 20) AS markup,
        count(*) FILTER (len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), '```'))) % 2 = 1) AS open_fences,
        count(*) FILTER (contains(text, '<|im_start|>')) AS chat_marks, count(*) FILTER (contains(text, 'User:')) AS user_marks FROM documents GROUP BY source"""
)
def format_flags(spark, d):
    """F20, F21, F23, F24, F28 by source."""
    t = load(spark, d, "documents")
    return t.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(O.asks_for_code("text")).alias("code"), F.count_if(O.markup_kind("text") == "markup").alias("markup"), F.count_if(~O.fences_balanced("text")).alias("open_fences"),
        F.count_if(F.contains("text", F.lit("<|im_start|>"))).alias("chat_marks"), F.count_if(F.contains("text", F.lit("User:"))).alias("user_marks"),
    )


PROBLEMS = tables.weighted(tables.PROBLEM_TYPES)
#: A small table of topics in this corpus's own words.
TOPICS = {
    "archive": [(r"\barchive", 3), (r"\brecords?\b", 2), (r"\blibrary\b", 2)],
    "training": [(r"\btraining\b", 3), (r"\bepoch\b", 2), (r"\bloss\b", 3), (r"\bcorpus\b", 2)],
    "town": [(r"\bbakery\b", 2), (r"\bmarket\b", 2), (r"\bcouncil\b", 2), (r"\bstation\b", 1)],
}


def _types_sql(table: dict, of: str) -> str:
    scores = {k: " + ".join(f"least({_count('t', p)}, 3) * {w}" for p, w in v) for k, v in table.items()}
    each = ", ".join(f"{{'s': -({v}), 'i': {i}, 'k': {lit(k)}}}" for i, (k, v) in enumerate(scores.items()))
    return f"""s AS ({of}), r AS (SELECT id, list_sort([{each}]) AS o FROM s)
        SELECT id, CASE WHEN o[1].s < 0 THEN o[1].k ELSE 'unclassified' END AS primary_type, CASE WHEN o[2].s < 0 AND -o[2].s >= 0.6 * -o[1].s THEN o[2].k END AS secondary_type, -o[1].s AS score FROM r"""


def _types(df, text: str, table: dict):
    t = df.withColumn("t", O.weighted_types(text, table))
    return t.select("id", F.col("t.primary").alias("primary_type"), F.col("t.secondary").alias("secondary_type"), F.col("t.score").alias("score"))


@query("WITH " + _types_sql(TOPICS, f"SELECT doc_id AS id, {_collapse('lower(text)')} AS t FROM documents"))
def text_types(spark, d):
    """F22 with a table of topics."""
    return _types(load(spark, d, "documents").withColumnRenamed("doc_id", "id"), "text", TOPICS)


@query("WITH " + _types_sql(PROBLEMS, f"SELECT item_id AS id, {_collapse('lower(prompt)')} AS t FROM eval_items"))
def problem_types(spark, d):
    """the items' kinds of problem by the whole table."""
    return _types(load(spark, d, "eval_items").withColumnRenamed("item_id", "id"), "prompt", PROBLEMS)


@query(
    f"""WITH q AS (SELECT item_id, prompt, answer, {_collapse('prompt')} AS c FROM eval_items)
        SELECT item_id, CASE WHEN c = '' THEN 'empty' WHEN length(c) < 200 THEN 'under_200' WHEN answer IS NULL OR {_strip('answer')} = '' THEN 'no_answer'
        WHEN {_count('substr(c, 1, 600)', '[^' + chr(92) + 'x{00}-' + chr(92) + 'x{7f}]')} > 0.1 * length(substr(c, 1, 600)) THEN 'not_english' END AS reason,
        {_strip('prompt')} = '' AS no_chain, {_strip('prompt')} <> '' AND length(c) < 200 AS too_short,
        {_strip('prompt')} <> '' AND regexp_matches(prompt, {lit(O.TRUNCATED)}) AS truncated FROM q"""
)
def chain_checks(spark, d):
    """F12, F26 with prompts as chains."""
    t = load(spark, d, "eval_items")
    return t.select("item_id", O.chain_reason("prompt", "answer").alias("reason"), *O.chain_flags("prompt", "answer")[:3])


@query()
def equation_steps(spark, d):
    """F18, F27 over every document."""
    t = load(spark, d, "documents")
    return t.select("doc_id", O.equation_check("text").alias("s"), O.equation_check("text", False).alias("p")).select("doc_id", "s.n", "s.wrong", F.col("p.n").alias("n_plain"), F.col("p.wrong").alias("wrong_plain"))


@query(
    f"""WITH f AS (SELECT coalesce({_LIGHT}, 'kept') AS reason FROM documents ORDER BY doc_id LIMIT 20000), c AS (SELECT reason, count(*) AS n FROM f GROUP BY reason)
        SELECT arg_min(reason, (-n, reason)) AS reason, round(max(n) / sum(n), 6) AS share, max(n) / sum(n) > 0.95 AND arg_min(reason, (-n, reason)) <> 'kept' AS abort FROM c"""
)
def early_abort(spark, d):
    """the limit of 20,000 rows is the rule itself."""
    return O.early_verdict(load(spark, d, "documents"), O.light_reason("text"), 20_000, "doc_id")


@query(
    f"""WITH h AS (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)', 1) AS host, doc_id FROM documents WHERE url IS NOT NULL),
        r AS (SELECT host, row_number() OVER (PARTITION BY host ORDER BY doc_id) AS k FROM h)
        SELECT host, count(*) AS n, count(*) FILTER (k <= 100) AS kept FROM r GROUP BY host"""
)
def host_cap(spark, d):
    """At most 100 documents per host."""
    t = load(spark, d, "documents").where("url is not null").select(T.host("url").alias("host"), "doc_id")
    kept = O.capped(t, "host", "doc_id", 100).groupBy("host").agg(F.count("*").alias("kept"))
    return t.groupBy("host").agg(F.count("*").alias("n")).join(kept.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).select("host", "n", "kept")
