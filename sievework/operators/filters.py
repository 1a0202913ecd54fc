"""Quality filters. Each gives a reason, the first rule that matches, or null for a text that is kept.

A null text counts as empty. Reasons partition their input: one row, at most one reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Marks of web boilerplate (fixed values).
BOILER = (
    "版权所有|ICP备|点击进入|免责声明|更多精彩|关注公众号|微信号|扫码|下载APP|本文来源|转载请|阅读全文|上一篇|下一篇|网友评论|登录后|"
    "立即注册|广告|友情链接|联系我们|站长统计|Copyright|All Rights Reserved"
)
#: How a finished text ends (fixed values).
END_OK = rf"[。！？!?…”」』）)》\]】][{T.SPACE}]*$|[。！？][{T.SPACE}]*[\"'”」]?[{T.SPACE}]*$"
#: Spam of the web tier's cleaning (fixed values).
SPAM = (
    r"彩票|賭場|赌场|赌博|博彩|真人娱乐|北京赛车|时时彩|老虎机|六合彩|百家乐|开户送|注册送"
    r"|威廉希尔|德赢vwin|杏彩|凯发k8|明陞|m88asia|BOSS真人|森林舞会游戏|助赢|大智彩票"
    r"|加微信|QQ[:：]?[0-9]{6,}|微信[:：]?[a-zA-Z0-9_]{5,}|电话[:：]?1[3-9][0-9]{9}"
    r"|阴道|裸体|情趣用品|一夜情|约炮"
)
#: Spam that lowers a quality score (fixed values).
SPAM_SCORE = (
    r"彩票|賭場|赌场|赌博|博彩|真人娱乐|北京赛车|时时彩|老虎机|六合彩|百家乐|开户送|注册送"
    r"|威廉希尔|德赢vwin|杏彩|凯发k8|明陞|m88asia|BOSS真人|森林舞会游戏|助赢|大智彩票|必威"
    r"|加微信|QQ[:：]?[0-9]{6,}|微信[:：]?[a-zA-Z0-9_]{5,}|电话[:：]?1[3-9][0-9]{9}"
)
#: Openings of a rewriter that found nothing to solve (fixed values).
PLACEHOLDER = "(?i)" + "|".join((
    r"there (?:is|are|was) no (?:specific |particular |actual |real |clear |single |actual )?(?:math\w*|mathematical)? ?(?:problem|question|task|calculation|exercise)s? to (?:solve|answer|be solved|be answered)",
    r"(?:the |this |that )?(?:provided|given|source|input|original)? ?text (?:does not|doesn't|did not) (?:contain|include|present|have|state|provide) (?:a |an |any |specific |particular |clear |single |real )?(?:math\w*|mathematical)? ?(?:problem|question|task|calculation|exercise)s?",
    r"does not contain (?:a |any |specific |particular )?(?:math\w*|mathematical) (?:problem|question|task|exercise)s?(?: to (?:solve|be solved))?",
    r"no (?:specific |particular |clear |actual )?(?:math\w*|mathematical) (?:problem|question|task|exercise)s? (?:is |was |are |has been )?(?:provided|presented|asked|given|included|stated|specified|offered)",
    r"there (?:is|was) no (?:specific |particular )?(?:question|problem|task) (?:presented|asked|provided|given|specified|stated)",
    r"no (?:specific |particular )?(?:math\w*|mathematical)? ?(?:problem|question|task)s? (?:or|/|and) (?:problem|question|task)s? to (?:be )?(?:solve|answer|solved|answered)",
))
#: Marks of a generated file and names of generators, markup hints, code marks and cut-off marks (fixed values).
GENERATED_MARK = r"(?i)auto[- ]?generated|generated\s+by|automatically\s+generated|this\s+(?:file|code)\s+is\s+(?:auto[- ]?)?generated|@generated\b"
GENERATOR = r"(?i)protoc(?:ol buffer)?|protobuf|django|autorest|swagger|openapi|thrift|grpc|cython|jinja|yacc|lex\b|swig|pb2\b|code generator|generated code|do\s+not\s+(?:edit|modify|delete)"
MARKUP_HINT = r"(?i)Generated by javadoc|<!DOCTYPE|<\?xml|NewPage|Generated by (?:Doxygen|Sphinx)"
MARKUP_TAG = r"<[a-zA-Z/!?][^>]{0,80}>"
CODE_MARKS = ("```", "\ndef ", "\nclass ", "import ", "return ", "    ")
ASKS_CODE = r"(?is)\bwrite\b.{0,60}\b(?:function|class|program|script)\b"
TRUNCATED = r"(?i)\.\.\.\s*$|truncat|\[\s*\.\.\.\s*\]"


def _t(text) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lines(text) -> Column:
    """The trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(_t(text), "\n"), T.strip_space), lambda x: x != "")


def light_reason(text) -> Column:
    """short, long or bad_bytes: checks that hold for any language (F1)."""
    t = _t(text)
    n = F.length(t)
    return F.when(n < 100, "short").when(n > 200_000, "long").when(T.bad_chars(t) > 0.001 * n, "bad_bytes")


def web_reason(text, garbage: str | None = None) -> Column:
    """The Chinese web tier: thirteen rules but for the holdout, in order (F2).

    garbage: an alternation of topics that a text's first 600 characters must not name (F3).
    """
    t = _t(text)
    n = F.length(t)
    solid = F.greatest(F.lit(1), F.length(F.regexp_replace(t, rf"[{T.SPACE}]", "")))
    ls = lines(t)
    many = F.size(ls) >= 5
    rule = (
        F.when(n < 200, "short").when(n > 50_000, "long")
        .when(T.count_matches(t, T.CJK) / solid < 0.6, "not_zh")
        .when(T.bad_chars(t) > 0.001 * n, "bad_bytes")
        .when(T.count_matches(t, r"[^\p{L}_]") / solid > 0.35, "symbols")
        .when(T.count_matches(t, r"\p{Nd}") / solid > 0.2, "digits")
        .when(T.count_matches(t, BOILER) >= 3, "boilerplate")
        .when(T.count_matches(t, T.URL) > 3 * n / 1000, "urls")
        .when(many & (F.size(F.filter(ls, lambda x: F.length(x) < 10)) / F.size(ls) > 0.5), "nav_menu")
        .when(many & (F.size(F.array_distinct(ls)) / F.size(ls) < 0.7), "dup_lines")
        .when((n < 500) & ~t.rlike(END_OK), "unfinished")
    )
    return rule.when(T.head(t, 600).rlike(garbage), "garbage_topic") if garbage else rule


def repetition(text) -> Column:
    """Share of the segments of more than four characters that repeat an earlier one; 0 for fewer than eight."""
    segs = F.filter(F.split(_t(text), rf"[{T.SPACE}，,。；;]"), lambda x: F.length(x) > 4)
    return F.when(F.size(segs) < 8, 0.0).otherwise(1 - F.size(F.array_distinct(segs)) / F.size(segs))


def fragmented(text) -> Column:
    """Six or more sentences of fewer than nine characters on average."""
    sents = F.filter(F.split(_t(text), r"[。！？；!?;]"), lambda x: T.strip_space(x) != "")
    total = F.aggregate(sents, F.lit(0), lambda a, x: a + F.length(x))
    return (F.size(sents) >= 6) & (total < 9.0 * F.size(sents))


def clean_reason(text, score: Column | None = None, cut: float | None = None, least: int = 200, most: float = 0.30) -> Column:
    """spam, short, repetitive, fragmented or low_score."""
    t = _t(text)
    rule = F.when(t.rlike(SPAM), "spam").when(F.length(t) < least, "short").when(repetition(t) > most, "repetitive").when(fragmented(t), "fragmented")
    return rule.when(score < cut, "low_score") if score is not None and cut is not None else rule


def leading_header(text) -> Column:
    """The comment lines and docstring before the first code line.

    A fold over the lines: the state holds how many lines belong to it so far, the open quote, and whether code has begun.
    """
    state = lambda n, quote, done: F.struct(n.alias("n"), quote.alias("quote"), done.alias("done"))
    none, no, yes = F.lit(""), F.lit(False), F.lit(True)

    def step(s, x):
        opens = F.regexp_extract(x, "^[rRuUbBfF]{0,2}(\"\"\"|''')", 1)
        closed = F.size(F.split(x, F.when(opens == "", "\u0000").otherwise(opens))) > 2
        more = s["n"] + 1
        return (
            F.when(s["done"], s)
            .when(s["quote"] != "", state(more, F.when(F.contains(x, s["quote"]), "").otherwise(s["quote"]), no))
            .when(opens != "", state(more, F.when(closed, "").otherwise(opens), no))
            .when(x.rlike(r"^(?:#|//|/\*|\*)"), state(more, none, no))
            .otherwise(state(s["n"], none, yes))
        )

    return T.let(lines(text), lambda ls: F.array_join(F.transform(F.slice(ls, F.lit(1), F.aggregate(ls, state(F.lit(0), none, no), step, lambda s: s["n"])), lambda x: F.concat(x, F.lit("\n"))), ""))


def autogenerated(text) -> Column:
    """The leading header names both a generator and that it generated the file."""
    h = leading_header(text)
    return h.rlike(GENERATED_MARK) & h.rlike(GENERATOR)


def high_frequency_lines(docs: DataFrame, key: str, text: str = "text", least: int = 8) -> DataFrame:
    """Lines that at least `least` documents hold: line, n_docs (F10). Pairs are made distinct before they are counted."""
    one = docs.select(key, F.explode(F.array_distinct(lines(text))).alias("line"))
    return one.groupBy("line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)


def boilerplate_share(docs: DataFrame, key: str, text: str = "text", least: int = 8, most: float = 0.5) -> DataFrame:
    """Per document: n_lines, n_common (lines that `least` documents hold), boilerplate (more than `most` of them).

    Documents without lines have none and aren't boilerplate. Lines are joined by their text, pre-counted per document.
    """
    per = docs.select(key, F.explode(lines(text)).alias("line")).groupBy(key, "line").agg(F.count("*").alias("k"))
    common = per.groupBy("line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)
    hit = per.join(common.select("line"), "line", "left_semi").groupBy(key).agg(F.sum("k").alias("n_common"))
    return (
        docs.select(key, F.size(lines(text)).alias("n_lines")).join(hit, key, "left")
        .select(key, "n_lines", F.coalesce("n_common", F.lit(0)).alias("n_common"), (F.coalesce("n_common", F.lit(0)) > most * F.col("n_lines")).alias("boilerplate"))
    )


def capped(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of every group by `order` (Q18); each task keeps no more of a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def placeholder(text) -> Column:
    """The first 250 characters say that there is nothing to solve."""
    return T.head(_t(text), 250).rlike(PLACEHOLDER)


def markup_kind(text, path=None) -> Column:
    """markup or code: by the name's ending, a hint in the first 600 characters, or 20 tags in the first 4000."""
    t = _t(text)
    ext = F.lower(F.regexp_extract(_t(path), r"(\.[A-Za-z0-9]+)$", 1)) if path is not None else F.lit("")
    known = [".html", ".htm", ".xhtml", ".xml", ".svg", ".rss", ".atom", ".wsdl", ".xsd", ".plist"]
    return F.when(ext.isin(known) | T.head(t, 600).rlike(MARKUP_HINT) | (T.count_matches(T.head(t, 4000), MARKUP_TAG) >= 20), "markup").otherwise("code")


def code_marks(text) -> Column:
    """How often the six marks of code occur, overlaps of one mark not counted."""
    t = _t(text)
    each = [(F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))) / len(m) for m in CODE_MARKS]
    return reduce(lambda a, b: a + b, each).cast("int")


def asks_for_code(text) -> Column:
    """Rubric router: four marks of code, or 'write ... function' in the first 400 characters."""
    return (code_marks(text) >= 4) | T.head(_t(text), 400).rlike(ASKS_CODE)


def chain_flags(chain, answer) -> list[Column]:
    """no_chain, too_short, truncated, dirty_answer of a reasoning chain and its answer."""
    c, a = _t(chain), _t(answer)
    none = T.strip_space(c) == ""
    return [
        none.alias("no_chain"), (~none & (F.length(T.collapse(c)) < 200)).alias("too_short"),
        (~none & c.rlike(TRUNCATED)).alias("truncated"), a.rlike(r"<\|(?:begin|end)_of_thought\|>").alias("dirty_answer"),
    ]


def chain_reason(chain, answer, kind: Column | None = None) -> Column:
    """Ordered keep rule: empty, under_200, tool_only, no_answer, not_english."""
    c = T.collapse(_t(chain))
    first = T.head(c, 600)
    rule = F.when(c == "", "empty").when(F.length(c) < 200, "under_200")
    if kind is not None:
        rule = rule.when(F.coalesce(kind, F.lit("")) != "text", "tool_only")
    return rule.when(T.strip_space(_t(answer)) == "", "no_answer").when(T.count_matches(first, r"[^\x{00}-\x{7f}]") > 0.1 * F.length(first), "not_english")


def weighted_types(text, table: dict[str, list[tuple[str, int]]], close: float = 0.6) -> Column:
    """Struct primary, secondary, score of the type whose patterns weigh most.

    A pattern counts at most three times. Ties go to the type named first; the second type is given if its score is
    at least `close` of the first's. A text without a match is 'unclassified'.
    """
    t = T.skeleton(_t(text))
    names = list(table)
    scores = [reduce(lambda a, b: a + b, [F.least(T.count_matches(t, p), F.lit(3)) * w for p, w in table[k]]) for k in names]
    ranked = F.sort_array(F.array(*(F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(zip(names, scores)))))
    one, two = ranked[0], ranked[1]
    return F.struct(
        F.when(one["s"] < 0, one["k"]).otherwise("unclassified").alias("primary"),
        F.when((two["s"] < 0) & (-two["s"] >= close * -one["s"]), two["k"]).alias("secondary"), (-one["s"]).alias("score"),
    )


_NUM = r"-?[0-9]+(?:\.[0-9]+)?"
EQUATION = rf"(?<![0-9./])({_NUM})\s*([+\-×÷*/])\s*({_NUM})\s*=\s*({_NUM})(?![0-9./])"
CHAINED = rf"{_NUM}(?:\s*[+\-×÷*/]\s*{_NUM}){{2,}}\s*="


def equation_check(text, skip_chains: bool = True) -> Column:
    """Struct n, wrong over the equations 'a op b = c' of a text (F27; with skip_chains false F18).

    Lines with chained operations are skipped. F27 tolerates 1e-6 * max(1, |result|), F18 1e-6; a division by zero is
    wrong in F27 and no equation in F18.
    """
    ls = F.split(_t(text), "\n")
    if skip_chains:
        ls = F.filter(ls, lambda x: ~x.rlike(CHAINED))
    found = F.flatten(F.transform(ls, lambda x: F.regexp_extract_all(x, F.lit(EQUATION), F.lit(0))))

    def check(e):
        part = lambda i: F.regexp_extract(e, EQUATION, i)
        a, b, c, op = part(1).cast("double"), part(3).cast("double"), part(4).cast("double"), part(2)
        r = F.when(op == "+", a + b).when(op == "-", a - b).when(op.isin("×", "*"), a * b).otherwise(F.try_divide(a, b))
        bound = F.lit(1e-6) * F.greatest(F.lit(1.0), F.abs(r)) if skip_chains else F.lit(1e-6)
        return F.when(r.isNull(), F.lit(1 if skip_chains else None)).otherwise((F.abs(r - c) > bound).cast("int"))

    marks = F.filter(F.transform(found, check), lambda x: x.isNotNull())
    return F.struct(F.size(marks).alias("n"), F.aggregate(marks, F.lit(0), lambda s, x: s + x).alias("wrong"))


def fences_balanced(text) -> Column:
    """An even number of lines that begin with a fence."""
    n = F.size(F.filter(F.split(_t(text), "\n"), lambda x: F.ltrim(x).startswith("```")))
    return n % 2 == 0


def marker_prevalence(docs: DataFrame, group: str, text: str, markers: dict[str, str]) -> DataFrame:
    """Per group: rows, and rows whose text holds each literal marker."""
    return docs.groupBy(group).agg(F.count("*").alias("n"), *(F.count_if(F.contains(_t(text), F.lit(m))).alias(k) for k, m in markers.items()))


def early_verdict(docs: DataFrame, reason: Column, rows: int, order: str, most: float = 0.95) -> DataFrame:
    """One row: the reason most frequent among the first `rows` rows, its share, and whether it aborts a build."""
    counts = docs.orderBy(order).limit(rows).select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.agg(F.min(F.struct((-F.col("n")).alias("m"), "reason")).alias("t")).select(F.col("t.reason").alias("reason"), (-F.col("t.m")).alias("n"))
    return top.join(total).select("reason", F.round(F.col("n") / F.col("total"), 6).alias("share"), ((F.col("n") / F.col("total") > most) & (F.col("reason") != "kept")).alias("abort"))


def histogram(df: DataFrame, reason: str, known: list[str], kept: str = "kept") -> DataFrame:
    """reason, n with a zero for every known reason that didn't occur (A1)."""
    counts = df.groupBy(F.coalesce(reason, F.lit(kept)).alias("reason")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    names = spark.createDataFrame([(k,) for k in [*known, kept]], "reason string")
    return names.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))
