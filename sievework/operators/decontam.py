"""Holdout matching and decontamination against evaluation items.

Gates (items) are model-evaluation sets. They are joined, never collected; whether a side is small enough to be
broadcast is left to the planner, which checks its size. Documents are exploded to grams within a stage, and only the
grams that some gate holds go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

GRAM = 13


def gate_parts(items: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """One row per item and part with text: item, part, text (SRC10)."""
    return items.select(F.col(key).alias("item"), F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).cast("string").alias("text")) for p in parts))).alias("x")).select("item", "x.part", "x.text").where("text is not null")


def gate_grams(parts: DataFrame, n: int = GRAM) -> DataFrame:
    """gram, item, part: the first owner of every n-word gram of the gate (H7), by item and part."""
    g = parts.select("item", "part", F.explode(T.word_grams(T.spaced_words("text"), n)).alias("gram"))
    return g.groupBy("gram").agg(F.min(F.struct("item", "part")).alias("o")).select("gram", "o.item", "o.part")


def gram_hits(docs: DataFrame, key: str, text: str, gate: DataFrame, n: int = GRAM) -> DataFrame:
    """Documents that share an n-word gram with the gate: key, n_grams, item, part of the first owner (H5).

    Documents of fewer than n words have no gram and are never hit.
    """
    grams = docs.select(key, F.explode(T.word_grams(T.spaced_words(text), n)).alias("gram"))
    return grams.join(gate, "gram").groupBy(key).agg(F.count("*").alias("n_grams"), F.min(F.struct("item", "part")).alias("o")).select(key, "n_grams", "o.item", "o.part")


def char_gram_hits(docs: DataFrame, key: str, text: str, parts: DataFrame, n: int = GRAM, least_distinct: int = 4) -> DataFrame:
    """Documents that share an n-character window of the squashed text with the gate: key, item, n_grams.

    Windows of fewer than `least_distinct` different characters say nothing.
    """
    rich = lambda g: F.size(F.array_distinct(F.split(g, ""))) >= least_distinct
    whole = lambda g: F.length(g) == n
    needles = parts.select("item", F.explode(T.char_grams(T.squash("text"), n)).alias("gram")).where(whole("gram") & rich("gram")).distinct()
    grams = docs.select(key, F.explode(T.char_grams(T.squash(text), n)).alias("gram")).where(whole("gram"))
    return grams.join(needles, "gram").groupBy(key, "item").agg(F.count("*").alias("n_grams"))


def holdout_candidates(text: str, longest: int = 500, most_lines: int | None = None) -> Column:
    """Keys under which a text can be a held-out one: whole, its question, its lines (raw and without a role)."""
    c = F.coalesce(F.col(text), F.lit(""))
    ls = F.split(c, "\n")
    ls = F.slice(ls, 1, most_lines) if most_lines else ls
    ls = F.transform(ls, T.strip_space)
    bare = F.transform(ls, lambda x: T.strip_space(F.regexp_replace(x, T.QA_PREFIX, "")))
    ok = F.filter(F.concat(ls, bare), lambda x: (x != "") & (F.length(x) <= longest))
    return F.array_distinct(F.transform(F.concat(F.array(c, T.question_body(c)), ok), T.holdout_key))


def holdout_hits(docs: DataFrame, key: str, text: str, held: DataFrame, held_text: str, most_lines: int | None = None) -> DataFrame:
    """Keys of documents that hold a held-out text (H1-H4, H20, H22). Empty held-out texts match nothing."""
    keys = held.where(T.holdout_norm(held_text) != "").select(T.holdout_key(held_text).alias("h")).distinct()
    cands = docs.select(key, F.explode(holdout_candidates(text, most_lines=most_lines)).alias("h"))
    return cands.join(keys, "h", "left_semi").select(key).distinct()


def containment(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, prompt: str, idf: bool = True, least: int = 20) -> DataFrame:
    """Weighted share of an item's bigrams that a document holds: key, item, containment, short (H8, H9).

    idf = ln((n + 1) / (df + 1)) + 1 over all documents with text. Documents equal to an item (holdout form) are an
    exact channel of their own and left out. Items of fewer than `least` bigrams are marked short, not dropped. Only
    bigrams of some item leave the first stage.
    """
    held = items.where(F.col(prompt).isNotNull())
    hb = held.select(F.col(item).alias("item"), T.bigram_set(prompt).alias("bs")).select("item", F.size("bs").alias("size"), F.explode("bs").alias("g"))
    vocab = hb.select("g").distinct()
    exact = held.where(T.holdout_norm(prompt) != "").select(T.holdout_key(prompt).alias("h")).distinct()
    usable = docs.where(F.col(text).isNotNull() & (F.col(text) != ""))
    n = usable.agg(F.count("*").alias("n_docs"))
    inexact = usable.withColumn("h", T.holdout_key(text)).join(exact, "h", "left_anti")
    dg = inexact.select(key, F.explode(T.bigram_set(text)).alias("g")).join(vocab, "g", "left_semi")
    df = usable.select(F.explode(T.bigram_set(text)).alias("g")).join(vocab, "g", "left_semi").groupBy("g").agg(F.count("*").alias("df"))
    weight = vocab.join(df, "g", "left").join(n).select("g", (F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1 if idf else F.lit(1.0)).alias("w"))
    hw = hb.join(weight, "g")
    mass = hw.groupBy("item").agg(F.sum("w").alias("mass"), F.max("size").alias("size"))
    shared = dg.join(hw, "g").groupBy(key, "item").agg(F.sum("w").alias("s"))
    return shared.join(mass, "item").select(key, "item", F.round(F.col("s") / F.col("mass"), 6).alias("containment"), (F.col("size") < least).alias("short"))


def verdict(hits: DataFrame, docs: DataFrame, key: str, text: str, group: str, exact: DataFrame, threshold: float, baseline: str, ratio: float = 2.0) -> DataFrame:
    """Per group: bytes, exact hits, hit rows, hits per GB, REJECT or clean.

    An exact hit rejects; else a rate beyond `ratio` times that of the baseline group; with a baseline of no hits any
    hit rejects.
    """
    rows = hits.where(~F.col("short") & (F.col("containment") >= threshold)).select(key).distinct().withColumn("hit", F.lit(1))
    ex = exact.select(key).distinct().withColumn("exact", F.lit(1))
    t = docs.select(key, group, F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("b")).join(rows, key, "left").join(ex, key, "left")
    g = t.groupBy(group).agg(F.sum("b").alias("bytes"), F.count("exact").alias("exact_hits"), F.count("hit").alias("hit_rows"))
    g = g.withColumn("per_gb", F.when(F.col("bytes") > 0, F.col("hit_rows") / (F.col("bytes") / 1e9)).otherwise(0.0))
    base = g.where(F.col(group) == baseline).agg(F.coalesce(F.max("per_gb"), F.lit(0.0)).alias("base"))
    rejected = (F.col("exact_hits") > 0) | F.when(F.col("base") == 0, F.col("hit_rows") > 0).otherwise(F.col("per_gb") > ratio * F.col("base"))
    return g.join(base).select(group, "bytes", "exact_hits", "hit_rows", F.round("per_gb", 3).alias("per_gb"), F.when(rejected, "REJECT").otherwise("clean").alias("verdict"))


def number_sets(text: str) -> Column:
    """The sorted numbers of a text, repeats kept."""
    return F.array_sort(F.regexp_extract_all(F.col(text), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def number_matches(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, prompt: str, least: int = 2) -> DataFrame:
    """Documents whose numbers are exactly an item's, at least two."""
    a = docs.select(key, number_sets(text).alias("n")).where(F.size("n") >= least)
    b = items.select(F.col(item).alias("item"), number_sets(prompt).alias("n")).where(F.size("n") >= least)
    return a.join(b, "n").select(key, "item")


def hash_bucket(column: str, salt: str = "", buckets: int = 100) -> Column:
    """A bucket from the first 8 hex digits of sha1(salt | value)."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(salt), F.col(column).cast("string"))), 1, 8), 16, 10).cast("long") % buckets


def residual(docs: DataFrame, key: str, hits: DataFrame) -> DataFrame:
    """The documents that no hit names: the clean rest, over which a second scan must find nothing."""
    return docs.join(hits.select(key).distinct(), key, "left_anti")


def contains_either_way(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, prompt: str, least: int = 20) -> DataFrame:
    """Pairs where one collapsed text holds the other, both of at least `least` characters.

    Candidates share a window of `least` characters at a multiple of it in the shorter one, so every pair is found by
    an equality join; containment itself confirms.
    """
    a = docs.select(key, T.collapse(text).alias("a")).where(F.length("a") >= least)
    b = items.select(F.col(item).alias("item"), T.collapse(prompt).alias("b")).where(F.length("b") >= least)
    start = lambda c: F.substring(F.col(c), 1, least)
    windows = lambda c: T.char_grams(F.col(c), least)
    in_doc = a.select(key, F.explode(windows("a")).alias("w")).join(b.select("item", start("b").alias("w")), "w").select(key, "item")
    in_item = b.select("item", F.explode(windows("b")).alias("w")).join(a.select(key, start("a").alias("w")), "w").select(key, "item")
    pairs = in_doc.unionByName(in_item).distinct()
    return pairs.join(a, key).join(b, "item").where(F.contains("a", "b") | F.contains("b", "a")).select(key, "item")


def first_kind(hits: dict[str, DataFrame], key: str) -> DataFrame:
    """key, kind: of several hit lists the first that names a document."""
    parts = None
    for i, (kind, df) in enumerate(hits.items()):
        one = df.select(key, F.lit(i).alias("i"), F.lit(kind).alias("kind")).distinct()
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(key).agg(F.min(F.struct("i", "kind"))["kind"].alias("kind"))


def ranked_hits(hits: DataFrame, key: str, score: str, most: int) -> DataFrame:
    """The `most` items of highest score per document, a top-k report."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), "item")
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
