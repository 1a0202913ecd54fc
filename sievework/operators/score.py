"""Scorers, rank statistics, an n-gram language model and classifier heads."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import text as T
from ..session import materialize
from .heads import cross_validated, gram_slots
from .ordered import ranked
from .similar import _mix

BOS, EOS = "<s>", "</s>"


def hashed_grams(text: str | None, first: int = 1000) -> np.ndarray:
    """Hashes of the character 2-, 3- and 4-grams of the first characters, repeats included (C1); none for a null text."""
    c = np.frombuffer((text or "")[:first].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    parts, h = [], _mix(c)
    for n in range(2, 5):
        if len(c) < n:
            break
        h = _mix(h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :])
        parts.append(h.view(np.int64))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def byte_and_word_hashes(text: str | None) -> np.ndarray:
    """The set of byte 2- to 5-grams, words and pairs of words of a text, each as a number (C5); none for a null text.

    A byte gram is its own bytes and its length; words are hashed. Grams are cut from whole arrays of bytes.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int64)
    parts, gram = [], raw
    for n in range(2, 6):
        if len(raw) < n:
            break
        gram = (gram[: len(raw) - n + 1] << 8) | raw[n - 1 :]
        parts.append(np.unique(gram | (n << 40)))
    words = re.findall(r"\w+", text or "")
    names = {f"W{w}" for w in words} | {f"W{a}_{b}" for a, b in zip(words, words[1:])}
    parts.append(np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1 for w in names), dtype=np.int64, count=len(names)))
    return np.concatenate(parts)


@F.pandas_udf(ArrayType(LongType()))
def byte_and_word_grams(texts: pd.Series) -> pd.Series:
    """byte_and_word_hashes() as a column."""
    return pd.Series([byte_and_word_hashes(t) for t in texts], dtype=object)


def penalised(score: Column, text: str, spam: str, by: float = 5.0) -> Column:
    """The score, less a penalty where the text holds spam, so the cut stays one number (C4)."""
    return score - F.when(F.coalesce(F.col(text), F.lit("")).rlike(spam), by).otherwise(0.0)


def score_percentiles(df: DataFrame, score: str, shares: Sequence[float] = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """One row: n and the percentiles p1, p10, ... of a score, linear between neighbours (C4)."""
    return df.agg(F.count(score).alias("n"), *(F.percentile(score, F.lit(s)).alias(f"p{round(100 * s)}") for s in shares))


def rank_auc(df: DataFrame, label: str, score: str, tie: Sequence[str]) -> DataFrame:
    """One row: auc, positives, negatives, by ordinal ranks without tie averaging (C3). Null if a class is missing."""
    r = ranked(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()), [], [F.col(score), *(F.col(t) for t in tie)])
    g = r.agg(F.sum(F.when(F.col(label), F.col("rank"))).alias("s"), F.count_if(F.col(label)).alias("positives"), F.count_if(~F.col(label)).alias("negatives"))
    p, n = F.col("positives"), F.col("negatives")
    return g.select(F.when((p > 0) & (n > 0), F.round((F.col("s") - p * (p + 1) / 2) / (p * n), 6)).alias("auc"), "positives", "negatives")


def keep_by_quantile(df: DataFrame, score: str, keep: float) -> DataFrame:
    """One row: the linear quantile at 1 - keep and the rows at or above it."""
    cut = df.agg(F.percentile(score, F.lit(1 - keep)).alias("cut"))
    return df.join(cut).groupBy("cut").agg(F.count_if(F.col(score) >= F.col("cut")).alias("kept"), F.count(score).alias("n"))


def keep_rates(df: DataFrame, score: str, label: str, shares: Sequence[float]) -> DataFrame:
    """Per share: the cut and the rate of positives above it."""
    cuts = df.agg(*(F.percentile(score, F.lit(1 - s)).alias(f"c{i}") for i, s in enumerate(shares)))
    t = df.join(cuts).select(score, label, F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.col(f"c{i}").alias("cut")) for i, s in enumerate(shares)))).alias("x")).select(score, label, "x.share", "x.cut")
    return t.groupBy("share", "cut").agg(F.round(F.avg(F.when(F.col(score) >= F.col("cut"), F.col(label).cast("int"))), 6).alias("rate"))


def spearman(df: DataFrame, a: str, b: str, tie: Sequence[str]) -> DataFrame:
    """One row: rho on ordinal ranks (C10), and n."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    keys = [F.col(k) for k in tie]
    ra = ranked(t.select(a, b, *tie), [], [F.col(a), *keys]).withColumnRenamed("rank", "ra").drop("group_rows")
    rb = ranked(ra, [], [F.col(b), *keys])
    return rb.agg(F.round(F.corr(F.col("ra").cast("double"), F.col("rank").cast("double")), 6).alias("rho"), F.count("*").alias("n"))


def quartile_bands(df: DataFrame, score: str, target: str) -> DataFrame:
    """Per quartile band of the score (closed at both ends, so bounds count twice): n and the target's mean."""
    e = df.agg(*(F.percentile(score, F.lit(q / 4)).alias(f"q{q}") for q in range(5)))
    bands = F.array(*(F.struct(F.lit(i + 1).alias("band"), F.col(f"q{i}").alias("lo"), F.col(f"q{i + 1}").alias("hi")) for i in range(4)))
    t = df.join(e).select(score, target, F.explode(bands).alias("x")).where(F.col(score).between(F.col("x.lo"), F.col("x.hi")))
    return t.groupBy("x.band").agg(F.count("*").alias("n"), F.round(F.avg(target), 6).alias("mean"))


def swap_verdict(ab: Column, ba: Column) -> Column:
    """The winner when both orders agree, else abstain (C11). ab names first or second; so does ba, of the swapped pair."""
    return F.when((ab == "first") & (ba == "second"), "a").when((ab == "second") & (ba == "first"), "b").when((ab == "tie") & (ba == "tie"), "tie").otherwise("abstain")


def rubric_scores(reply: Column, dims: Sequence[str]) -> Column:
    """The grades of a JSON reply if it names exactly the dimensions with integers 1 to 5, else null."""
    m = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1), "map<string,string>")
    ok = (F.array_sort(F.map_keys(m)) == F.array(*(F.lit(x) for x in sorted(dims)))) & F.forall(F.map_values(m), lambda v: v.rlike("^[1-5]$"))
    return F.when(ok, F.transform_values(m, lambda _, v: v.cast("int")))


def reply_number(reply: Column) -> Column:
    """The number of a model's reply, its thinking removed; null if there is none."""
    t = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    return F.regexp_extract(t, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def dot(vector: Column, weights: Sequence[float]) -> Column:
    """Scalar product with fixed weights."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    return F.aggregate(F.zip_with(vector, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def head_score(vector: Column, weights: Sequence[float], bias: float) -> Column:
    """The linear head on the L2-normalised vector."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot(vector, weights) / F.greatest(norm, F.lit(1e-12)) + bias


def _padded(text: str, left: int) -> Column:
    """The tokens of a text between its marks."""
    return F.concat(F.array(*(F.lit(BOS) for _ in range(left))).cast("array<string>"), T.word_tokens(text), F.array(F.lit(EOS)))


def _each(padded: Column, first: int, make) -> Column:
    """make(tokens, place) of every place from `first` on (counted from 1); the tokens are computed once a text."""
    return F.explode(T.let(padded, lambda p: F.transform(F.sequence(F.lit(first), F.size(p)), lambda i: make(p, i))))


def gram_counts(df: DataFrame, text: str, order: int) -> DataFrame:
    """o, ctx, word, n of every n-gram of orders 1..order with its padding.

    Only the longest grams are cut from the texts; shorter ones are added up from the longer ones' counts.
    """
    gram = lambda p, i: F.struct(F.array_join(F.slice(p, i - order + 1, F.lit(order - 1)), " ").alias("ctx"), F.get(p, i - 1).alias("word"))
    t = df.where(F.size(T.word_tokens(text)) > 0).select(_each(_padded(text, order - 1), order, gram).alias("g"))
    return _shorter(t.groupBy("g.ctx", "g.word").agg(F.count("*").alias("n")), order)


def _shorter(top: DataFrame, order: int) -> DataFrame:
    """o, ctx, word, n of orders 1..order from the counts ctx, word, n of the longest; every order is written before the next."""
    out, now = None, materialize(top, "grams")
    for o in range(order, 0, -1):
        if o < order:
            rest = F.when(F.instr("ctx", " ") > 0, F.expr("substr(ctx, instr(ctx, ' ') + 1)")).otherwise("")
            now = materialize(now.select(rest.alias("ctx"), "word", "n").groupBy("ctx", "word").agg(F.sum("n").alias("n")), "grams")
        level = now.select(F.lit(o).alias("o"), "ctx", "word", "n")
        out = level if out is None else level.unionByName(out)
    return out


def trigram_uses(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, uv, v, w, times: the words in their contexts, counted per key."""
    use = lambda p, i: F.struct(F.get(p, i - 1).alias("w"), F.get(p, i - 2).alias("v"), F.array_join(F.slice(p, i - 2, F.lit(2)), " ").alias("uv"))
    t = df.where(F.size(T.word_tokens(text)) > 0).select(*keys, _each(_padded(text, 2), 3, use).alias("u"))
    return t.groupBy(*keys, "u.uv", "u.v", "u.w").agg(F.count("*").alias("times"))


def counts_of(uses: DataFrame) -> DataFrame:
    """gram_counts() of order 3 from trigram_uses(), so that texts are cut once."""
    return _shorter(uses.groupBy(F.col("uv").alias("ctx"), F.col("w").alias("word")).agg(F.sum("times").alias("n")), 3)


class KneserNey:
    """Interpolated Kneser-Ney of order 3, trained and used by aggregation and join.

    p3(w | u v) = (max(0, c(uvw) - d) + d * n(uv.) * p2(w | v)) / c(uv.), p2 alike on p1, and p1 is w's number of
    different left neighbours over the number of bigram types. An unseen context falls back to the shorter one. The
    discount is n1 / (n1 + 2 n2) of the trigram counts, or 0.75.
    """

    def __init__(self, counts: DataFrame):
        two, three = counts.where("o = 2"), counts.where("o = 3")
        r = three.agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).first()
        d = r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] + r["n2"] else 0.75
        self.d = d if 0 < d < 1 else 0.75
        self.types = two.count()
        if not self.types:
            raise ValueError("a model of no tokens scores every text alike")
        self.left = two.groupBy("word").agg(F.count("*").alias("left"))
        totals = lambda t, p: t.groupBy("ctx").agg(F.sum("n").alias(f"{p}total"), F.count("*").alias(f"{p}types"))
        self.two, self.t2 = two.select("ctx", "word", F.col("n").alias("c2")), totals(two, "b")
        self.three, self.t3 = three.select("ctx", "word", F.col("n").alias("c3")), totals(three, "t")

    def scored(self, grams: DataFrame) -> DataFrame:
        """grams (uv, v, w, each once) with p, the model's probability of w after uv.

        Probabilities are worked out from the short contexts to the long: one row per word, then per bigram of the
        model, then per trigram asked for. So the rows that meet on a frequent word are distinct bigrams, not texts.
        """
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        step = lambda c, kinds, total, lower: F.when(F.col(total).isNull(), lower).otherwise((F.greatest(F.lit(0.0), zero(c) - self.d) + self.d * F.col(kinds) * lower) / F.col(total))
        p1 = F.when(F.col("left").isNull(), F.lit(1.0 / (self.types + 1))).otherwise(F.col("left") / self.types)
        two = grams.select("v", "w").distinct().join(self.left.withColumnRenamed("word", "w"), "w", "left").join(self.two.withColumnsRenamed({"ctx": "v", "word": "w"}), ["v", "w"], "left").join(self.t2.withColumnRenamed("ctx", "v"), "v", "left")
        two = two.select("v", "w", step("c2", "btypes", "btotal", p1).alias("p2"))
        three = grams.join(two, ["v", "w"]).join(self.three.withColumnsRenamed({"ctx": "uv", "word": "w"}), ["uv", "w"], "left").join(self.t3.withColumnRenamed("ctx", "uv"), "uv", "left")
        return three.select("uv", "w", step("c3", "ttypes", "ttotal", F.col("p2")).alias("p"))

    def perplexity(self, uses: DataFrame, key: str) -> DataFrame:
        """key, n_tokens, perplexity of every text of trigram_uses(), which is best a written table. Each distinct trigram is scored once."""
        p = self.scored(materialize(uses.select("uv", "v", "w").distinct(), "trigrams"))
        g = uses.join(p, ["uv", "w"]).groupBy(key).agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.log(F.greatest("p", F.lit(1e-12)))).alias("lp"))
        return g.select(key, "n_tokens", F.exp(-F.col("lp") / F.col("n_tokens")).alias("perplexity"))


def bits_per_char(train: DataFrame, test: DataFrame, text: str, lam: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> DataFrame:
    """One row: bits per character of test texts under interpolated 3-, 2- and 1-gram counts of the training texts (C17)."""
    c = gram_counts(train, text, 3)
    tot = c.groupBy("o", "ctx").agg(F.sum("n").alias("t"))
    uses = trigram_uses(test, text).select(F.col("uv").alias("c3"), F.col("v").alias("c2"), F.lit("").alias("c1"), "w", "times")
    p = F.lit(1e-9)
    for o, weight in zip((3, 2, 1), lam):
        k = c.where(F.col("o") == o).select(F.col("ctx").alias(f"c{o}"), F.col("word").alias("w"), F.col("n").alias(f"n{o}"))
        s = tot.where(F.col("o") == o).select(F.col("ctx").alias(f"c{o}"), F.col("t").alias(f"t{o}"))
        uses = uses.join(k, [f"c{o}", "w"], "left").join(s, f"c{o}", "left")
        p = p + weight * F.coalesce(F.col(f"n{o}") / F.col(f"t{o}"), F.lit(0.0))
    chars = test.agg(F.sum(F.length(text)).alias("chars"))
    return uses.agg(F.sum(-F.log2(p) * F.col("times")).alias("bits")).join(chars).select(F.round(F.col("bits") / F.col("chars"), 6).alias("bits_per_char"), "chars")


def min_max(df: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """Each metric scaled to 0..1 over all rows (true: higher is better), and their mean as score (C17)."""
    bounds = df.agg(*(f(m).alias(f"_{k}_{m}") for m in metrics for k, f in (("lo", F.min), ("hi", F.max))))
    out = df.join(bounds)  # one row
    for m, up in metrics.items():
        lo, hi = F.col(f"_lo_{m}"), F.col(f"_hi_{m}")
        x = (F.col(m) - lo) / (hi - lo)
        out = out.withColumn(f"{m}_scaled", F.when(hi == lo, 1.0).otherwise(x if up else 1 - x))
    score = sum((F.col(f"{m}_scaled") for m in list(metrics)[1:]), F.col(f"{list(metrics)[0]}_scaled")) / len(metrics)
    return out.withColumn("score", score).drop(*bounds.columns)


def embedding_head(df: DataFrame, vector: str, label: Column, seed: int = 7):
    """A logistic head on a vector column, by Spark's own learner (C2, C8). Returns the fitted model and the scored rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    t = df.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).withColumn("label", label.cast("double"))
    model = LogisticRegression(maxIter=30, regParam=0.01).fit(t)
    return model, model.transform(t).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def text_head(df: DataFrame, key: Sequence[str], text: str, label: Column, kind: str = "chars", dim: int | None = None) -> DataFrame:
    """key, text, label, score: the cross-validated score of a logistic head on the grams of a text.

    kind chars: character grams (C1, C2); bytes: byte grams and a bag of words (C5). dim is the number of slots, by
    default 2^18 and 2^20; every task of a fit holds some arrays of that length.
    """
    t = df.select(*key, text, label.cast("double").alias("label"))
    dim = dim or (1 << 18 if kind == "chars" else 1 << 20)
    return cross_validated(gram_slots(t, text, hashed_grams if kind == "chars" else byte_and_word_hashes, dim, kind == "bytes"), key, dim)


__all__ = [n for n in globals() if not n.startswith("_")]
