"""Queries of scrubbing, conversations, code, mixes, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import code as K
from ..operators import conversations as V
from ..operators import mix as M
from ..operators import pii as P
from ..session import load
from ..sources import readers, sinks
from ..streaming import streams
from .filter_queries import _count, _rep, _strip
from .registry import lit, query

_SCRUB = "text"
for _p, _b in P.SCRUBS:
    _SCRUB = _rep(_SCRUB, _p, _b.replace("$1", "\\1"))
_TEXT = "text || ' /home/' || source || '/x mail me: u' || doc_id || '@example.org'"


@query(f"SELECT doc_id, md5({_SCRUB}) AS scrubbed, {_SCRUB} <> text AS touched FROM (SELECT doc_id, {_TEXT} AS text FROM documents)")
def pii_scrub(spark, d):
    """Every document with a path and an address appended, scrubbed."""
    t = load(spark, d, "documents").select("doc_id", F.expr(_TEXT).alias("text"))
    return t.select("doc_id", F.md5(P.scrub("text")).alias("scrubbed"), (P.scrub("text") != F.col("text")).alias("touched"))


_ENT = "list_sum(list_transform(list_distinct(string_split(t, '')), lambda c: -((length(t) - length(replace(t, c, ''))) / length(t)) * log2((length(t) - length(replace(t, c, ''))) / length(t))))"


@query(
    f"""SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, {lit(P.SCRUBS[-1][0])})) AS emails, count(*) FILTER (regexp_matches(text, '/(?:Users|home)/[A-Za-z0-9._-]+')) AS homes, count(*) FILTER (regexp_matches(text, {lit(P.KEYED)})) AS keyed,
    count(*) FILTER (len(list_filter(list_distinct(regexp_extract_all(text, {lit(P.TOKEN)})), lambda t: {_ENT} >= 4.5)) > 0) AS opaque FROM documents GROUP BY source"""
)
def secret_report(spark, d):
    """P3, P6, P7 by source."""
    return P.secret_report(load(spark, d, "documents"), "source", "text")


_HALF = f"CASE WHEN doc_id % 2 = 0 THEN {_TEXT} ELSE text END"


@query(
    f"""WITH a AS (SELECT {_HALF} AS orig FROM documents), b AS (SELECT orig, {_SCRUB} AS once FROM (SELECT orig, orig AS text FROM a)), c AS (SELECT orig, once, {_SCRUB} AS twice FROM (SELECT orig, once, once AS text FROM b))
    SELECT count(*) FILTER (once <> orig) AS before, count(*) FILTER (twice <> once) AS residual, count(*) AS n FROM c"""
)
def scrub_residue(spark, d):
    """Rows with something to scrub, of which every second is given some, and rows that still have some after scrubbing."""
    t = load(spark, d, "documents").select(F.expr(_HALF).alias("text"))
    return P.residue(t, "text").select(F.col("residual").alias("before")).join(P.residue(t.select(P.scrub("text").alias("text")), "text"))


@query()
def opaque_redaction(spark, d):
    """P3, P4, P5 over ledger hashes set into sentences: digests are harmless, bare tokens aren't."""
    t = load(spark, d, "score_ledger").where("src_sha is not null").select("doc_id", F.concat(F.lit("see "), F.base64(F.unhex("src_sha")), F.lit(" or sha256: "), "src_sha", F.lit(" --token=abcd1234efgh")).alias("text"))
    return t.select("doc_id", F.size(P.opaque_spans("text")).alias("spans"), F.md5(P.redact("text")).alias("redacted"), F.array_join(P.credential_classes(F.col("text")), ",").alias("classes"))


_MARK = "(?m)^(User|Assistant|System|Tool|问|答)[ \\t]*[:：][ \\t]?"
_MS = f"""c AS (SELECT doc_id, regexp_extract_all(replace(text, chr(13), ''), {lit(_MARK)}, 1) AS roles, list_transform(string_split_regex(replace(text, chr(13), ''), {lit(_MARK)})[2:], lambda x: {_strip('x')}) AS contents FROM documents WHERE domain = 'chat'),
    m AS (SELECT doc_id, i - 1 AS turn, CASE roles[i] WHEN 'User' THEN 'user' WHEN '问' THEN 'user' WHEN 'Assistant' THEN 'assistant' WHEN '答' THEN 'assistant' WHEN 'System' THEN 'system' ELSE 'tool' END AS role, contents[i] AS content FROM (SELECT *, unnest(range(1, len(roles) + 1)) AS i FROM c))"""


def _chats(spark, d):
    return load(spark, d, "documents").where("domain = 'chat'").select("doc_id", V.messages(F.replace("text", F.lit("\r"), F.lit(""))).alias("ms"))


@query(f"WITH {_MS} SELECT role, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, max(length(content)) AS longest FROM m GROUP BY role")
def message_stats(spark, d):
    """V3, A7."""
    return V.message_stats(_chats(spark, d), "ms")


_REN = "'<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10)"


@query(f"WITH {_MS} SELECT doc_id, md5(string_agg({_REN}, '' ORDER BY turn)) AS rendered FROM m GROUP BY doc_id")
def chat_render(spark, d):
    """V1."""
    return _chats(spark, d).where("size(ms) > 0").select("doc_id", F.md5(V.render(F.col("ms"))).alias("rendered"))


@query(
    f"""WITH {_MS}, w AS (SELECT doc_id, turn, role, content, coalesce(string_agg({_REN}, '') OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM m)
    SELECT doc_id, CAST(turn AS INT) AS turn, md5(before || '<|im_start|>assistant' || chr(10)) AS prompt, md5(content || '<|im_end|>') AS completion FROM w WHERE role = 'assistant'"""
)
def agentic_pairs(spark, d):
    """V2."""
    return V.agentic_pairs(_chats(spark, d), "doc_id", "ms").select("doc_id", "turn", F.md5("prompt").alias("prompt"), F.md5("completion").alias("completion"))


#: A message that is put before (place 0) or after a chat, so that every rule has cases in this corpus.
_PUT = ((0, 1, "assistant", "API Error: 500"), (1, 1, "tool", "tool use was rejected"), (2, 1, "user", "what is <|im_start|> for"), (3, 0, "user", "/compact"), (4, 0, "user", "<system-reminder> be brief"), (5, 1, "assistant", "<invoke name=x>"), (6, 0, "tool", "out"), (7, 1, "tool", "late"), (8, 1, "assistant", "You've reached your limit"))


@query(
    f"""WITH {_MS}, put(k, place, role, content) AS (VALUES {", ".join(f"({k}, {p}, {lit(r)}, {lit(c)})" for k, p, r, c in _PUT)}), x AS (SELECT doc_id, turn, role, content FROM m UNION ALL SELECT c.doc_id, CASE place WHEN 0 THEN -1 ELSE 1000000 END, role, content FROM c JOIN put ON c.doc_id % 12 = k),
    y AS (SELECT *, lag(role) OVER (PARTITION BY doc_id ORDER BY turn) AS before FROM x),
    g AS (SELECT doc_id, count(*) AS n, arg_min(role, turn) AS first, arg_min(content, turn) AS opener, bool_and(role <> 'assistant' OR regexp_matches(content, {lit(V.NON_ANSWER)})) AS mute, bool_or(role = 'assistant' AND regexp_matches(content, {lit(V.ERROR)})) AS error, bool_or(role = 'assistant' AND regexp_matches(content, {lit(V.MARKUP)})) AS call,
      bool_or(role = 'tool' AND regexp_matches(content, {lit(V.REFUSED)})) AS refused, bool_or(regexp_matches(content, '<\\|im_(?:start|end)\\|>')) AS marks, bool_or(role = 'assistant') AS any_answer, bool_or(role = 'tool' AND coalesce(before, '') <> 'assistant') AS orphan FROM y GROUP BY doc_id)
    SELECT doc_id, CASE WHEN coalesce(n, 0) < 2 THEN 'few_turns' WHEN first <> 'user' THEN 'opening_role' WHEN regexp_matches(opener, {lit(V.UNACTIONABLE.replace('*+', '*').replace('++', '+'))}) THEN 'unactionable' WHEN mute THEN 'no_answer' WHEN error THEN 'error' WHEN call THEN 'broken_call' WHEN refused THEN 'refused' WHEN marks THEN 'marks'
      WHEN regexp_matches(substr(opener, 1, 600), {lit(V.MACHINE)}) THEN 'machine' WHEN NOT any_answer THEN 'no_assistant' WHEN orphan THEN 'orphan_tool' END AS reason FROM c LEFT JOIN g USING (doc_id)"""
)
def conversation_reasons(spark, d):
    """Every chat's first reason; a message that a rule looks for is put before or after some."""
    t = _chats(spark, d)
    added = lambda place: F.coalesce(*(F.when(F.col("doc_id") % 12 == k, F.array(F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")))) for k, p, r, c in _PUT if p == place), F.array().cast("array<struct<role:string,content:string>>"))
    return t.select("doc_id", V.unusable(F.concat(added(0), F.coalesce("ms", F.array().cast("array<struct<role:string,content:string>>")), added(1))).alias("reason"))


@query(f"WITH {_MS}, k AS (SELECT doc_id, substr(arg_min(content, turn), 1, 120) AS a, substr(arg_max(content, turn), 1, 60) AS b FROM m GROUP BY doc_id) SELECT min(doc_id) AS doc_id, count(*) AS n FROM k GROUP BY a, b")
def episode_dedup(spark, d):
    """X14."""
    t = _chats(spark, d).where("size(ms) > 0").select("doc_id", V.episode_key(F.col("ms")).alias("k"))
    return t.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query(f"WITH {_MS}, r AS (SELECT doc_id, role, sum(length(content) + length(role) + 24) OVER (PARTITION BY doc_id ORDER BY turn) AS upto FROM m) SELECT c.doc_id, CAST(coalesce(max(upto) FILTER (role = 'assistant'), 0) AS INT) AS longest FROM c LEFT JOIN r USING (doc_id) GROUP BY c.doc_id")
def episode_lengths(spark, d):
    """V9."""
    return _chats(spark, d).select("doc_id", V.longest_turn(F.col("ms")).alias("longest"))


@query("SELECT item_id, md5('<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || steps || ' steps' || chr(10) || '</think>' || chr(10) || coalesce(answer, '') || '<|im_end|>') AS t FROM eval_items WHERE steps IS NOT NULL")
def thinking_format(spark, d):
    """V4."""
    t = load(spark, d, "eval_items").where("steps is not null")
    return t.select("item_id", F.md5(V.with_thinking(F.col("prompt"), F.concat(F.col("steps").cast("string"), F.lit(" steps")), F.coalesce("answer", F.lit("")))).alias("t"))


@query("SELECT event_id, CASE WHEN trim(coalesce(props, '')) = '' THEN 'empty' WHEN starts_with(trim(props), '{') AND NOT json_valid(props) THEN 'bad_json' WHEN starts_with(trim(props), '{') AND json_extract_string(props, '$.text') IS NULL THEN 'no_text' END AS reason FROM events")
def output_reasons(spark, d):
    """V5 over the events' properties."""
    return load(spark, d, "events").select("event_id", V.output_reason(F.col("props")).alias("reason"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE contains(text, '```')),
    f AS (SELECT *, regexp_matches(line, '^\\s*```') AS fence, sum(CASE WHEN regexp_matches(line, '^\\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l),
    o AS (SELECT doc_id, (k - 1) // 2 AS block, trim(trim(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '`')) AS lang FROM f WHERE fence AND k % 2 = 1), b AS (SELECT doc_id, (k - 1) // 2 AS block, sum(length(line)) + count(*) - 1 AS n FROM f WHERE NOT fence AND k % 2 = 1 GROUP BY ALL)
    SELECT doc_id, CAST(block AS INT) AS block, lang, CAST(coalesce(n, 0) AS INT) AS n_chars FROM o LEFT JOIN b USING (doc_id, block)"""
)
def fenced_blocks(spark, d):
    """V10, F21."""
    t = load(spark, d, "documents").where(F.contains("text", F.lit("```"))).select("doc_id", F.posexplode(V.code_blocks("text")).alias("block", "b"))
    return t.select("doc_id", "block", "b.lang", F.length("b.code").alias("n_chars"))


@query()
def docstring_pairs(spark, d):
    """V6, V7, V12 over the code records."""
    t = load(spark, d, "l2_dataset").where("rubric_kind = 'code' and text is not null").select("doc_id", "chunk_idx", "text").distinct()
    return t.select("doc_id", "chunk_idx", F.array_join(V.imports("text"), ",").alias("imports"), F.size(V.function_pairs("text")).alias("n_functions"))


@query()
def tests_and_modules(spark, d):
    """Code records that a test file of the same host imports."""
    pool = load(spark, d, "chunk_pool").where("kind = 'code' and url is not null").groupBy(F.col("parent_doc_id").alias("doc_id"), "chunk_idx").agg(F.min("url").alias("url"))
    t = load(spark, d, "l2_dataset").where("rubric_kind = 'code' and text is not null").join(pool, ["doc_id", "chunk_idx"])
    return V.tested_modules(t.select(T.host("url").alias("repo"), F.regexp_extract("url", r"://[^/]*/(.*)$", 1).alias("path"), "text"), "repo", "path", "text").distinct()


@query()
def prose_continuations(spark, d):
    """V8."""
    t = V.prose_pairs(load(spark, d, "documents"), "doc_id", "text")
    return t.select("doc_id", F.length("prompt").alias("prompt_chars"), F.length("completion").alias("completion_chars"))


@query()
def code_languages(spark, d):
    """Language or refusal of the code records, by domain."""
    t = load(spark, d, "l2_dataset").where("rubric_kind = 'code'").select(F.lower(F.trim("domain")).alias("domain"), K.language("text").alias("l"))
    return t.groupBy("domain", "l.lang", F.regexp_replace("l.reason", r"\d+", "N").alias("reason")).agg(F.count("*").alias("n"))


@query()
def syntax_gate(spark, d):
    """Code records that parse as Python, and why the others don't."""
    t = load(spark, d, "l2_dataset").where("rubric_kind = 'code'").select(K.parse_failure("text").alias("reason"))
    return t.groupBy(F.coalesce("reason", F.lit("parses")).alias("reason")).agg(F.count("*").alias("n"))


@query()
def answer_forms(spark, d):
    """The answers of the evaluation items."""
    return load(spark, d, "eval_items").select("item_id", K.answers("answer").alias("a")).select("item_id", "a.*")


_POOL = "SELECT lower(trim(domain)) AS domain, count(DISTINCT doc_id || '#' || chunk_idx) AS pool FROM l2_dataset WHERE domain IS NOT NULL GROUP BY 1"
_MIX = f"""f AS (SELECT floor(total_tokens / 1024) AS n, coalesce(anneal_frac, 0) AS a FROM mix_15b_stage1), e AS (SELECT unnest(map_entries(domains)) AS e FROM mix_15b_stage1), w AS (SELECT e.key AS domain, coalesce(e.value.weight, 0) AS weight, coalesce(e.value.epochs, 1) AS epochs, coalesce(e.value.anneal, e.value.weight, 0) AS anneal FROM e), q AS ({_POOL}),
    t AS (SELECT domain, pool, coalesce(pool, 0) * epochs AS cap, weight, anneal FROM w LEFT JOIN q USING (domain)), u AS (SELECT t.*, least(CAST(floor(f.n * (1 - f.a) * weight) AS BIGINT), cap) AS m FROM t, f), v AS (SELECT u.*, least(CAST(floor(f.n * f.a * anneal) AS BIGINT), cap - m) AS a FROM u, f),
    plan AS (SELECT 'main' AS phase, domain, pool, CAST(0 AS BIGINT) AS first, m AS n FROM v UNION ALL SELECT 'anneal', domain, pool, m, a FROM v)"""


def _plan(spark, d):
    pools = load(spark, d, "l2_dataset").where("domain is not null").groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.count_distinct(F.concat_ws("#", "doc_id", "chunk_idx")).alias("pool"))
    mix = load(spark, d, "mix_15b_stage1")
    whole = mix.first()
    return M.plan(mix, pools, int(whole["total_tokens"] // 1024), M.reconciled([whole["anneal_frac"]]))


@query(f"WITH {_MIX} SELECT phase, domain, pool, first, n FROM plan")
def mix_plan(spark, d):
    """M1, A26, D14."""
    return _plan(spark, d)


@query(
    f"""WITH {_MIX}, x AS (SELECT phase, domain, pool, unnest(range(first, first + n)) AS i FROM plan WHERE n > 0 AND pool > 0)
    SELECT phase, row_number() OVER (PARTITION BY phase ORDER BY sha1('m|' || phase || '|' || domain || '|' || i), domain, i) AS slot, domain, i % pool AS row FROM x"""
)
def mix_row_plan(spark, d):
    """M1-M3, D15."""
    return M.row_plan(_plan(spark, d), "m")


@query(f"WITH {_MIX} SELECT domain, CAST(sum(n) // 2 AS BIGINT) AS used, CAST(sum(n) - sum(n) // 2 AS BIGINT) AS left, false AS retired FROM plan GROUP BY domain")
def mix_resume(spark, d):
    """M5: half of the plan was read."""
    p = _plan(spark, d)
    return M.replay(p, p.groupBy("domain").agg(F.floor(F.sum("n") / 2).alias("used")))


@query(f"WITH q AS ({_POOL}), r AS (SELECT domain, pool, unnest(range(pool)) AS row FROM q) SELECT domain, count(*) AS n, count(*) FILTER (row < least(greatest(1, CAST(floor(pool * 0.02) AS BIGINT)), 5000)) AS held FROM r GROUP BY domain")
def validation_holdback(spark, d):
    """M4."""
    pools = load(spark, d, "l2_dataset").where("domain is not null").groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.count_distinct(F.concat_ws("#", "doc_id", "chunk_idx")).alias("pool"))
    rows = pools.select("domain", "pool", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pool") - 1)).alias("row"))
    return M.holdback(rows, 0.02).groupBy("domain").agg(F.count("*").alias("n"), F.count_if("held").alias("held"))


_N = _count("text", T.WORD)


@query(
    f"""WITH t AS (SELECT source, doc_id, {_N} AS tokens FROM documents), s AS (SELECT *, coalesce(sum(tokens + 1) OVER (PARTITION BY source ORDER BY sha1('t|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, sum(tokens + 1) OVER (PARTITION BY source) AS total FROM t)
    SELECT source, doc_id, tokens, CAST(o AS BIGINT) AS "offset", CAST(o // 257 AS BIGINT) AS first_row, CAST((o + tokens) // 257 AS BIGINT) AS last_row, (o + tokens) // 257 < total // 257 AS complete FROM s"""
)
def token_stream_rows(spark, d):
    """A seeded stream per source in rows of 257 tokens."""
    t = load(spark, d, "documents").select("source", "doc_id", F.size(T.word_tokens("text")).alias("tokens"), F.sha1(F.concat(F.lit("t|"), F.col("doc_id").cast("string"))).alias("h"))
    return M.token_rows(t, ["source"], [F.col("h"), F.col("doc_id")], "tokens", 256).drop("h")


@query()
def sft_packing(spark, d):
    """Chats packed unsplit into 1,024 word tokens; overlong ones are told apart."""
    t = load(spark, d, "documents").select("doc_id", F.size(T.word_tokens("text")).alias("tokens"))
    return M.sft_pack(t, "doc_id", "tokens", 1024)


@query(
    f"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, {lit(T.WORD)})) AS n FROM documents WHERE text IS NOT NULL AND n_chars > 0) SELECT CAST(sum(n + 1) AS BIGINT) AS tokens, CAST(sum(n + 1 - least(n // 3, n + 1)) AS BIGINT) AS loss_tokens, count(*) AS examples FROM t WHERE n + 1 <= 1024"""
)
def sft_rows(spark, d):
    """Texts as examples, the first third of each as its prompt, packed and padded; what the rows hold in all."""
    t = load(spark, d, "documents").where("text is not null and n_chars > 0").select("doc_id", F.transform(T.word_tokens("text"), lambda x: F.length(x)).alias("ids")).withColumn("n", F.floor(F.size("ids") / 3).cast("int"))
    rows = M.sft_rows(t, "doc_id", "ids", "n", 1024, 0)
    return rows.agg((F.sum(F.size(F.filter("input_ids", lambda x: x > 0))) + F.sum("n_examples")).alias("tokens"), F.sum(F.size(F.filter("labels", lambda x: x >= 0))).alias("loss_tokens"), F.sum("n_examples").alias("examples"))


@query(
    f"""WITH s AS (SELECT source, avg({_N}) AS mean, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS r FROM s),
    v AS (SELECT *, CASE WHEN r = 1 THEN 2.0 ELSE 1.0 END::DOUBLE / mean AS per FROM t WHERE r <= 3) SELECT source, CAST(floor(min(n / per) OVER () * per) AS INT) AS n FROM v"""
)
def composition_solve(spark, d):
    """Rows per source such that the tokens of the three largest sources stand 2 : 1 : 1."""
    s = load(spark, d, "documents").where("source is not null").groupBy("source").agg(F.avg(F.size(T.word_tokens("text"))).alias("mean"), F.count("*").alias("n"))
    top = s.orderBy(F.desc("n"), "source").limit(3).collect()
    got = M.composition({r["source"]: r["mean"] for r in top}, {r["source"]: r["n"] for r in top}, {r["source"]: 1.0 if k else 2.0 for k, r in enumerate(top)})
    return spark.createDataFrame(sorted(got.items()) or [], "source string, n int")


@query("SELECT round(coalesce(anneal_frac, 0), 9) AS anneal_frac FROM mix_15b_stage1")
def mix_anneal(spark, d):
    """M7: the anneal fraction that the mix file and the run's own setting (none here) agree on."""
    agreed = M.reconciled([load(spark, d, "mix_15b_stage1").first()["anneal_frac"], None])
    return spark.createDataFrame([(agreed,)], "anneal_frac double")


@query(f"""WITH c AS (SELECT source AS domain, CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents GROUP BY source), s AS (SELECT domain, CAST(tokens - (CASE WHEN domain LIKE 'web%' THEN 1 ELSE 0 END) AS BIGINT) AS tokens FROM c WHERE domain NOT LIKE 'chat%')
    SELECT coalesce(c.domain, s.domain) AS domain, CASE WHEN c.tokens IS NULL THEN 'missing' WHEN s.tokens IS NULL THEN 'unstamped' WHEN c.tokens = s.tokens THEN 'same' WHEN c.tokens > s.tokens THEN 'grown' ELSE 'shrunk' END AS state FROM c FULL JOIN s ON c.domain = s.domain""")
def recount_states(spark, d):
    """A recount against stamps that are partly stale."""
    c = load(spark, d, "documents").groupBy(F.col("source").alias("domain")).agg(F.sum("n_chars").alias("tokens"))
    s = c.where("domain not like 'chat%'").withColumn("tokens", F.col("tokens") - F.when(F.col("domain").like("web%"), 1).otherwise(0))
    return M.count_state(c, s)


@query("""WITH s AS (SELECT source AS domain, CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents GROUP BY source), r AS (SELECT domain, least(greatest(tokens / sum(tokens) OVER (), 0.01), 0.08) AS r FROM s) SELECT domain, round(r / sum(r) OVER (), 9) AS weight, CAST(floor(r / sum(r) OVER () * 1e6) AS BIGINT) AS tokens_wanted FROM r""")
def derived_weights(spark, d):
    """M16 over the few sources."""
    s = load(spark, d, "documents").groupBy(F.col("source").alias("domain")).agg(F.sum("n_chars").alias("tokens"))
    return M.spread(s, 1e6, 0.01, 0.08)


@query("SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (text = '') AS empty FROM documents GROUP BY source")
def jsonl_round_trip(spark, d):
    """SRC1, SRC4, SNK1, SNK2: documents written as shards of JSON lines and read again."""
    path = streams.out_folder(spark, "jsonl")
    sinks.jsonl_shards(load(spark, d, "documents").select(F.col("text").alias("content"), "source", "url"), path, 4000)
    t = readers.jsonl(spark, path)
    return t.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"), F.count_if(F.coalesce("content", F.lit("")) == "").alias("empty"))


@query("SELECT 'documents' AS source, count(*) AS n, count(url) AS urls FROM documents")
def parquet_spec(spark, d):
    """SRC2, SRC4: by spec, two columns read."""
    t = readers.from_spec(spark, f"parquet:{d}/documents.parquet")
    return t.groupBy(F.lit("documents").alias("source")).agg(F.count("*").alias("n"), F.count("url").alias("urls"))


@query("""WITH l AS (SELECT item_id, 'question' AS kind, prompt AS value FROM eval_items UNION ALL SELECT item_id, 'answer', answer FROM eval_items WHERE answer <> '') SELECT kind, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars FROM l WHERE value <> '' GROUP BY kind""")
def json_leaves(spark, d):
    """SRC11: items as JSON, walked."""
    t = load(spark, d, "eval_items").select(F.explode(readers.leaves(F.to_json(F.struct("prompt", F.struct("answer").alias("gold"))))).alias("l"))
    return t.groupBy("l.kind").agg(F.count("*").alias("n"), F.sum(F.length("l.value")).alias("chars"))


@query(
    """WITH c AS (SELECT doc_id AS key, regexp_extract(text, '(?s)(?:问|Q|Question|User)\\s*[：:]\\s*(.*?)\\n\\s*(?:答|A|Answer|Assistant)\\s*[：:]', 1) AS q, regexp_extract(text, '(?s)\\n\\s*(?:答|A|Answer|Assistant)\\s*[：:]\\s*(.*)$', 1) AS a FROM documents WHERE domain = 'chat')
    SELECT key, length(trim(nullif(q, ''))) AS question_chars, length(trim(nullif(a, ''))) AS answer_chars FROM c"""
)
def split_answers(spark, d):
    """SRC12, SRC13: question and answer of the chats."""
    t = readers.mapped(load(spark, d, "documents").where("domain = 'chat'"), {"key": "doc_id", "content": "text"})
    return t.select("key", readers.question_answer(F.col("content")).alias("x")).select("key", F.length("x.question").alias("question_chars"), F.length("x.answer").alias("answer_chars"))


@query("SELECT 'documents' AS domain, count(*) AS kept, CAST(sum(length(text)) AS BIGINT) AS kept_chars, CAST(round(sum(length(text)) / 1.5) AS BIGINT) AS kept_tokens, CAST(NULL AS BIGINT) AS tokens FROM documents")
def build_stamp(spark, d):
    """SNK3, D5."""
    return sinks.stamp(load(spark, d, "documents"), "documents", "text", {"short": 0, "long": 0}).drop("reasons")


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS documents FROM score_ledger WHERE scorer_name = 'l3-rubric' AND regexp_matches(ts, '^[0-9-]{10}T[0-9:]{8}([.][0-9]+)?Z$') AND score IS NULL AND rubric_dims IS NOT NULL")
def ledger_append(spark, d):
    """SNK5, SNK8: valid rows appended to a ledger and read again."""
    from ..operators.ledger import violations

    t = load(spark, d, "score_ledger").where("scorer_name = 'l3-rubric'")
    path = streams.out_folder(spark, "ledger")
    sinks.append_ledger(t.where(violations(t).isNull()), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def stream_ingest(spark, d):
    """ST1, ST2: the documents taken in as a stream, twice; the second run finds nothing new."""
    out = streams.out_folder(spark, "ingest")
    for _ in range(2):
        streams.run_idempotent(streams.file_stream(spark, f"{d}/documents.parquet"), out, "ingest")
    return spark.read.parquet(f"{out}/data").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH o AS (SELECT user_id, event_id AS step, value / 20 AS l, value / 8 AS g FROM events), t AS (SELECT *, sum(CASE WHEN g > 10 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run, row_number() OVER w AS seen, avg(l) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean FROM o WINDOW w AS (PARTITION BY user_id ORDER BY step)),
    r AS (SELECT user_id, step, CASE WHEN run >= 3 THEN 'gnorm' WHEN seen >= 20 AND mean > 3 THEN 'loss' END AS reason FROM t) SELECT user_id, min(step) AS step, arg_min(reason, step) AS reason FROM r WHERE reason IS NOT NULL GROUP BY user_id""")
def divergence_streamed(spark, d):
    """ST3 with state; the same SQL as its batch twin."""
    out = streams.out_folder(spark, "divergence")
    t = streams.file_stream(spark, f"{d}/events.parquet").select("user_id", F.col("event_id").alias("at"), (F.col("value") / 20).alias("loss"), (F.col("value") / 8).alias("gnorm"))
    streams.run_once(streams.divergence_stream(t, "user_id", "at", "loss", "gnorm", window=20), out, "divergence")
    return spark.read.parquet(f"{out}/data")


@query("SELECT CAST(1 AS BIGINT) AS files, CAST(sum(octet_length(encode(item_id)) + 1) AS BIGINT) AS bytes FROM eval_items")
def folder_fingerprint(spark, d):
    """The files of the items' table."""
    path = streams.out_folder(spark, "fp")
    load(spark, d, "eval_items").select("item_id").orderBy("item_id").coalesce(1).write.text(path)
    return sinks.directory_fingerprint(spark, path, "*.txt").select("files", "bytes")




@query(f"WITH {_MS}, k AS (SELECT DISTINCT substr(sha1({_rep('prompt', T.HOLDOUT_DROP)}), 1, 16) AS h FROM eval_items) SELECT count(*) AS prompts, count(*) FILTER (substr(sha1({_rep('content', T.HOLDOUT_DROP)}), 1, 16) IN (SELECT h FROM k)) AS held_out FROM m WHERE role = 'user'")
def packed_prompt_holdout(spark, d):
    """Prompts of the packed chats that are held-out items."""
    keys = load(spark, d, "eval_items").where("prompt is not null").select(T.holdout_key("prompt").alias("h"), F.lit(1).alias("hit")).distinct()
    t = _chats(spark, d).select(F.explode("ms").alias("m")).where("m.role = 'user'").select(T.holdout_key(F.col("m.content")).alias("h"))
    return t.join(keys, "h", "left").agg(F.count("*").alias("prompts"), F.count("hit").alias("held_out"))


@query("SELECT domain, count(*) - CAST(sum(CASE WHEN last THEN 1 ELSE 0 END) AS BIGINT) AS ids, CAST(sum(CASE WHEN last THEN 1 ELSE 0 END) AS BIGINT) AS torn FROM (SELECT domain, doc_id = max(doc_id) OVER (PARTITION BY domain) AS last FROM documents) GROUP BY domain")
def lenient_read(spark, d):
    """SRC6, SRC7: JSON lines in a folder per domain, the last line of each domain torn in its middle, read by id."""
    path = streams.out_folder(spark, "lenient")
    t = load(spark, d, "documents").select("doc_id", "text", F.coalesce("domain", F.lit("")).alias("domain"))
    line = F.to_json(F.struct("doc_id", "text"))
    last = t.groupBy("domain").agg(F.max("doc_id").alias("last"))
    lines = t.join(last, "domain").select("domain", "doc_id", F.when(F.col("doc_id") == F.col("last"), F.expr("substr(to_json(struct(doc_id, text)), 1, length(to_json(struct(doc_id, text))) div 2)")).otherwise(line).alias("value"))
    lines.sortWithinPartitions("domain", "doc_id").select("domain", "value").write.partitionBy("domain").text(path)
    got = readers.torn_tail(spark, path, "doc_id").withColumn("domain", F.url_decode(F.regexp_extract("file", "domain=([^/]*)/", 1)))
    return got.groupBy("domain").agg(F.count("id").alias("ids"), F.count_if("torn").alias("torn"))


@query("SELECT domain, count(*) AS n FROM documents WHERE domain IN ('wiki', 'math', 'news') GROUP BY domain")
def asserted_union(spark, d):
    """SNK7: parts joined under the expected number of rows."""
    docs = load(spark, d, "documents").select("doc_id", "domain")
    parts = [docs.where(F.col("domain") == x) for x in ("wiki", "math", "news")]
    return sinks.union_all(parts, docs.where("domain in ('wiki', 'math', 'news')").count()).groupBy("domain").agg(F.count("*").alias("n"))


@query(
    f"""WITH r AS (SELECT DISTINCT lower(trim(domain)) AS domain, doc_id, chunk_idx, text FROM l2_dataset WHERE text IS NOT NULL AND domain IS NOT NULL), t AS (SELECT domain, doc_id, chunk_idx, list_transform(regexp_extract_all(text, {lit(T.WORD)}), lambda x: length(x)) AS ids FROM r),
    p AS (SELECT domain, ids, coalesce(sum(len(ids)) OVER (PARTITION BY domain ORDER BY doc_id, chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM t), x AS (SELECT domain, unnest(ids) AS id, o + unnest(range(len(ids))) AS place FROM p)
    SELECT domain, CAST(place // 256 AS BIGINT) AS row, count(*) AS n, md5(array_to_string(list(id ORDER BY place), ',')) AS ids FROM x GROUP BY domain, place // 256"""
)
def packed_arrays(spark, d):
    """SNK9, D13: each domain's records end to end in rows of 256; word lengths stand for token ids."""
    t = load(spark, d, "l2_dataset").where("text is not null and domain is not null").select(F.lower(F.trim("domain")).alias("domain"), "doc_id", "chunk_idx", "text").distinct()
    t = t.select("domain", "doc_id", "chunk_idx", F.transform(T.word_tokens("text"), lambda x: F.length(x)).alias("ids"))
    return sinks.packed(t, ["domain"], [F.col("doc_id"), F.col("chunk_idx")], "ids", 256).select("domain", "row", F.size("ids").cast("long").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids"))
