"""Near-duplicate reports by MinHash over character or word shingles: the reference family's batch operators.

Shingles are hashed JVM-side (xxhash64); the minima under (a h + b) mod 2^61, whose products ANSI arithmetic refuses,
come from Arrow batches in numpy. Groups, rates and cuts rest on all pairs of an exact join (similar.py); only the
estimate's calibration and the earlier-seen test use buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import discard, materialize
from . import similar
from .components import connected_components
from .ordered import ranked, stars

#: Words per shingle and similarity unless a caller says otherwise.
WORDS, SIMILAR = 5, 0.8


def shingle_hashes(words: Column, n: int = WORDS) -> Column:
    """64-bit hashes of the set of n-word shingles; fewer words give an empty set (ND2)."""
    return F.transform(T.word_grams(words, n), lambda g: F.xxhash64(g))


def coefficients(perms: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the permutations."""
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 62, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 62, perms, dtype=np.uint64)


def minhash(df: DataFrame, key: str, perms: int) -> DataFrame:
    """key, hashes, sig of a table key, hashes array<long>: perms minima of each set of hashes (ND3); empty sets are left out.

    Not a function of columns: the optimizer doesn't take a Python function out of a projection whose argument holds
    lambda functions, as hashes of shingles do.
    """
    a, b = coefficients(perms)
    mask = np.uint64((1 << 61) - 1)

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("hashes")), 0))
            if not batch.num_rows:
                continue
            lists = batch.column("hashes")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.cumsum(n) - n
            sig = np.stack([np.minimum.reduceat((x * flat + y) & mask, at) for x, y in zip(a, b)], axis=1).astype(np.int64)
            ends = np.arange(0, sig.size + 1, perms, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(key), lists, pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel()))], [key, "hashes", "sig"])

    return df.select(key, "hashes").where(F.size("hashes") > 0).mapInArrow(minima, f"{key} {df.schema[key].dataType.simpleString()}, hashes array<long>, sig array<long>")


def signed(df: DataFrame, key: str, text: str, words: int = WORDS, perms: int = 96) -> DataFrame:
    """key, hashes, sig of every text that has a shingle, written once."""
    return materialize(minhash(df.select(key, shingle_hashes(T.spaced_words(text), words).alias("hashes")), key, perms), "signed")


def candidates(sig: DataFrame, key: str, bands: int, rows: int) -> DataFrame:
    """a, b (a < b): every text of a bucket with the bucket's least key (ND4).

    One edge a text at most, whatever the bucket's size; nothing is capped, every bucket stays connected, and a
    bucket that holds most texts is shared among tasks.
    """
    b = sig.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows)))).alias("bucket"))
    return stars(b, "bucket", key).select(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b")).distinct()


def similarity(pairs: DataFrame, sig: DataFrame, key: str) -> DataFrame:
    """a, b, jaccard (exact) and estimate (share of equal minima) (ND7, ND9, ND10)."""
    x, y = sig.select(F.col(key).alias("a"), F.col("hashes").alias("ha"), F.col("sig").alias("sa")), sig.select(F.col(key).alias("b"), F.col("hashes").alias("hb"), F.col("sig").alias("sb"))
    both = F.size(F.array_intersect("ha", "hb"))
    same = F.aggregate(F.zip_with("sa", "sb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return pairs.join(x, "a").join(y, "b").select("a", "b", (both / (F.size("ha") + F.size("hb") - both)).alias("jaccard"), (same / F.size("sa")).alias("estimate"))


def similar_pairs(df: DataFrame, key: str, text: str, words: int = WORDS, threshold: float = SIMILAR) -> DataFrame:
    """a, b, jaccard of at least the threshold, exact (ND7).

    Texts of the same shingles are a class: its least key stands for it, and the others are tied to that key at 1.0.
    Every similar pair of classes is there, between their least keys; all pairs of texts follow from these.
    """
    t = df.select(F.col(key).alias("k"), T.skeleton(text).alias("t")).where("k is not null and t is not null")
    t = materialize(similar.word_sets(t, words), "shingles")
    names = materialize(t.groupBy("id").agg(F.min("k").alias("first")), "classes")
    order = similar.frequent(similar.sample(t).select(F.explode("h").alias("h")))
    met = materialize(similar.meeting(similar.keyed(t, order, threshold), threshold), "meeting")
    ends = met.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(names, "id")
    sets = materialize(t.join(ends.select(F.col("first").alias("k"), "id"), ["k", "id"], "left_semi").select("id", "h").dropDuplicates(["id"]), "sets")
    pairs = similar.exact(met, sets, threshold)
    x, y = names.select(F.col("id").alias("a"), F.col("first").alias("x")), names.select(F.col("id").alias("b"), F.col("first").alias("y"))
    across = pairs.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    within = t.select("k", "id").join(names, "id").where("k > first").select(F.col("first").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("jaccard")).distinct()
    return across.unionByName(within)


def clusters(pairs: DataFrame) -> DataFrame:
    """node, component: transitive groups, named by their least key (ND6)."""
    return connected_components(pairs, "a", "b")


def survivors(df: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """Rows that are the least of their group, or in none (ND7, ND11)."""
    drop = groups.where("node <> component").select(F.col("node").alias(key))
    return df.join(drop, key, "left_anti")


def _sides(df: DataFrame, key: str, domain: str, pairs: DataFrame) -> DataFrame:
    """k, c, d: every row's key, the key that stands for its class (that of equal shingles), and its domain."""
    first = pairs.where("jaccard = 1").groupBy(F.col("b").alias("k")).agg(F.min("a").alias("first"))
    return df.select(F.col(key).alias("k"), F.col(domain).alias("d")).join(first, "k", "left").select("k", F.coalesce("first", "k").alias("c"), "d")


def keep_whole(df: DataFrame, key: str, domain: str, whole: str, pairs: DataFrame) -> DataFrame:
    """Rows left when one domain is kept whole: only rows of others that are similar to one of it go (ND12).

    pairs: of similar_pairs. A row goes if its class or a similar class holds a row of the whole domain, whatever row
    stands for either class.
    """
    side = _sides(df, key, domain, pairs).withColumn("w", F.coalesce(F.col("d") == whole, F.lit(False)))
    held = side.where("w").select("c").distinct()
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reached = held.unionByName(both.join(held, F.col("a") == F.col("c")).select(F.col("b").alias("c"))).distinct()
    drop = side.where("not w").join(reached, "c", "left_semi").select(F.col("k").alias(key))
    return df.join(drop, key, "left_anti")


def _pair_counts(own: DataFrame, sides: DataFrame) -> DataFrame:
    """One row: pairs, the number of similar pairs of rows with a domain, and within, those of one domain; from the numbers of rows per class and domain."""
    n = sides.where("d is not null").groupBy("c", "d").agg(F.count("*").cast("decimal(38,0)").alias("n"))
    total = n.groupBy("c").agg(F.sum("n").alias("t"), F.sum(F.expr("n * (n - 1) / 2").cast("decimal(38,0)")).alias("s"))
    inside = total.select(F.expr("t * (t - 1) / 2").cast("decimal(38,0)").alias("t"), F.col("s").cast("decimal(38,0)").alias("s"))
    across = own.where("jaccard < 1").select("a", "b")
    x, y = total.select(F.col("c").alias("a"), F.col("t").alias("ta")), total.select(F.col("c").alias("b"), F.col("t").alias("tb"))
    every = across.join(x, "a").join(y, "b").select(F.expr("ta * tb").cast("decimal(38,0)").alias("t"), F.lit(0).cast("decimal(38,0)").alias("s"))
    x, y = n.select(F.col("c").alias("a"), "d", F.col("n").alias("na")), n.select(F.col("c").alias("b"), "d", F.col("n").alias("nb"))
    same = across.join(x, "a").join(y, ["b", "d"]).select(F.lit(0).cast("decimal(38,0)").alias("t"), F.expr("na * nb").cast("decimal(38,0)").alias("s"))
    return inside.unionByName(every).unionByName(same).agg(F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("within"))


def report(pairs: DataFrame, domains: DataFrame, key: str, domain: str, total: int, thresholds=(0.7, 0.8, 0.9), band: tuple[float, float] = (0.7, 0.85)) -> DataFrame:
    """Per threshold (ND8, ND9, ND13): texts in a group (participation, with its 95 % Wilson interval), texts dropped if
    each group keeps one, groups, similar pairs of texts, their share across domains, and band_pairs, the pairs whose
    similarity lies in [band), near the threshold."""
    from .stats import wilson

    out = None
    sides = _sides(domains, key, domain, pairs)
    close = pairs.where((F.col("jaccard") >= band[0]) & (F.col("jaccard") < min(band[1], 1.0)))
    # copies are pairs whatever the band, so they are taken off again
    near = _pair_counts(close, sides).join(_pair_counts(close.where("false"), sides).select(F.col("pairs").alias("copies"))).select((F.col("pairs") - F.col("copies")).alias("band_pairs"))
    for th in thresholds:
        own = pairs.where(F.col("jaccard") >= th)
        sized = clusters(own).groupBy("component").agg(F.count("*").alias("n"))
        a = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("participating"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped"), F.count("*").alias("groups"))
        low, high = wilson(F.col("participating"), F.lit(total), 1.96)
        row = a.join(_pair_counts(own, sides)).select(
            F.lit(th).alias("threshold"), "participating", "dropped", "groups", F.round(F.col("participating") / max(total, 1), 6).alias("participation"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"),
            "pairs", F.when(F.col("pairs") > 0, F.round((F.col("pairs") - F.col("within")) / F.col("pairs"), 6)).alias("cross_domain"),
        )
        out = row if out is None else out.unionByName(row)
    return out.join(near)


def top_pairs(pairs: DataFrame, n: int = 20) -> DataFrame:
    """The n most similar pairs of different texts, each by the least key of its copies (ND9): a top-k report."""
    return pairs.where("jaccard < 1").orderBy(F.desc("jaccard"), "a", "b").limit(n)


def whole_check(df: DataFrame, key: str, domain: str, whole: str, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row on keep_whole (ND12): whole_pairs, the similar pairs inside the whole domain (0 where its own dedup was done), and
    spared, its rows that are not the least of their group, which an order of keys alone would have dropped."""
    side = _sides(df, key, domain, pairs).where(F.col("d") == whole)
    inside = _pair_counts(pairs, side).select(F.col("pairs").alias("whole_pairs"))
    spared = groups.where("node <> component").join(side.select(F.col("k").alias("node")), "node").agg(F.count("*").alias("spared"))
    return inside.join(spared)


def self_repetition(df: DataFrame, text: str, n: int = 8) -> DataFrame:
    """One row: n-word runs, distinct ones, the rate of distinct ones, and the rate of texts whose first 4,096 characters an
    earlier text has (ND16, R1)."""
    t = df.select(F.coalesce(text, F.lit("")).alias("t"))
    g = t.select(F.explode(T.let(T.spaced_words("t"), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<bigint>")))).alias("g"))
    per = g.groupBy("g").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("runs"), F.count("*").alias("distinct_runs"))
    heads = t.groupBy(F.sha1(F.substring("t", 1, 4096)).alias("h")).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("texts"), F.count("*").alias("heads"))
    rate = F.round(F.col("distinct_runs") / F.greatest("runs", F.lit(1)), 6)
    return per.join(heads).select("runs", "distinct_runs", rate.alias("rate"), F.round((F.col("texts") - F.col("heads")) / F.greatest("texts", F.lit(1)), 6).alias("same_head"))


def similarity_bands(sample: DataFrame, key: str, text: str, edges: tuple[float, ...] = (0.3, 0.5, 0.7), block: int = 256) -> DataFrame:
    """One row: the pairs of a bounded sample of texts, how many have a similarity of their word sets in each band, and the
    rate of those in all bands but the last (ND16, R2: reskins are alike, but not copies).

    All pairs of a sample are counted, by pairs of blocks, never listed; the sample's size is the caller's bound. Texts
    without words are left out.
    """
    t = sample.select(F.col(key).alias("k"), F.array_distinct(T.spaced_words(F.coalesce(F.col(text), F.lit("")))).alias("w")).where("size(w) > 0")
    blocks = max(1, -(-t.count() // block))
    t = t.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    t = t.select("k", "w", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    names = [f"from_{x}".replace(".", "_") for x in edges]

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        number = {w: n for n, w in enumerate(sorted({w for ws in rows["w"] for w in ws}))}
        has = np.zeros((len(rows), len(number)), dtype=np.float32)
        for r, ws in enumerate(rows["w"]):
            has[r, [number[w] for w in ws]] = 1
        x, y = has[(rows["b"] == i).to_numpy()], has[(rows["b"] == j).to_numpy()]
        both = (x @ y.T).astype(np.float64)
        alike = both / (x.sum(axis=1)[:, None] + y.sum(axis=1)[None] - both)
        alike = alike[np.triu_indices(len(x), 1)] if i == j else alike.ravel()
        at = np.searchsorted(np.array(edges), alike, side="right")
        return pd.DataFrame([[alike.size, *((at == k).sum() for k in range(1, len(edges) + 1))]], columns=["pairs", *names])

    per = t.groupBy("i", "j").applyInPandas(count, "pairs long, " + ", ".join(f"{n} long" for n in names))
    sums = per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", *names)))
    return sums.withColumn("reskin_rate", F.round(sum((F.col(n) for n in names[1:-1]), F.col(names[0])) / F.greatest("pairs", F.lit(1)), 6))


def cluster_mass(sample: DataFrame, text: str, k: int = 200, top: int = 10, dim: int = 1 << 14, seed: int = 7) -> DataFrame:
    """One row: texts, the share of the `top` largest of k clusters by k-means over TF-IDF of character 2- and 3-grams, and that of the largest (ND16, R3)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    t = sample.select(F.col(text).alias("t")).where("t is not null and trim(t) <> ''")
    grams = F.concat(T.char_grams(F.col("t"), 2), T.char_grams(F.col("t"), 3))
    tf = HashingTF(inputCol="grams", outputCol="tf", numFeatures=dim).transform(t.select(grams.alias("grams")))
    x = IDF(inputCol="tf", outputCol="idf", minDocFreq=3).fit(tf).transform(tf)
    x = Normalizer(inputCol="idf", outputCol="features").transform(x).select("features")
    sizes = KMeans(k=k, seed=seed, maxIter=20).fit(x).transform(x).groupBy("prediction").agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n")).limit(top).agg(F.sum("n").alias("first"), F.max("n").alias("largest"))
    whole = sizes.agg(F.sum("n").alias("texts"))
    return whole.join(first).select("texts", F.round(F.col("first") / F.col("texts"), 4).alias("top_mass"), F.round(F.col("largest") / F.col("texts"), 4).alias("largest"))


def gram_budget(df: DataFrame, key: str, text: str, n: int = 8, most: int = 3) -> DataFrame:
    """Rows none of whose n-word runs occurs in more than `most` earlier rows by key (ND14, decided at once over all rows).

    The reference counts only rows that it kept; here all earlier rows count, so the outcome needs no order of
    processing. Rows of a hot run are numbered by many tasks.
    """
    g = df.select(key, F.explode(F.transform(T.word_grams(T.spaced_words(text), n), lambda x: F.xxhash64(x))).alias("g"))
    few = g.groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") > most).select("g")
    late = ranked(g.join(few, "g"), ["g"], [F.col(key)]).where(F.col("rank") > most).select(key).distinct()
    return df.join(late, key, "left_anti")


def recall_bound(jaccard: Column, bands: int, rows: int) -> Column:
    """1 - (1 - J^rows)^bands (ND5)."""
    return 1 - F.pow(1 - F.pow(jaccard, F.lit(rows)), F.lit(bands))


def signed_chars(df: DataFrame, key: str, text: str, n: int = 5, perms: int = 128) -> DataFrame:
    """key, sig of the n-character windows of every text that isn't empty, written once."""
    hashes = F.transform(T.char_grams(T.skeleton(text), n), lambda g: F.xxhash64(g))
    return materialize(minhash(df.select(key, hashes.alias("hashes")), key, perms).select(key, "sig"), "signed")


def seen_before(sig: DataFrame, key: str, bands: int, rows: int) -> DataFrame:
    """key, seen: whether a text shares a bucket with an earlier one by key that was itself not seen (ND1).

    This is the greedy in-stream rule, in rounds: a text that is the least undecided one of all its buckets is kept, and
    whoever shares a bucket with it is seen. A round decides at least the least text of every connected piece, so few are
    needed unless a long chain hangs each text on the one before. Buckets are folded to their least key map-side.
    """
    bucket = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows))))
    left = materialize(sig.select(F.col(key).alias("k"), bucket.alias("bucket")).distinct(), "undecided")
    done = []
    while not left.isEmpty():
        least = left.groupBy("bucket").agg(F.min("k").alias("first"))
        own = left.join(least, "bucket").groupBy("k").agg(F.min(F.col("k") == F.col("first")).alias("kept"))
        kept = materialize(own.where("kept").select("k"), "kept")
        near = left.join(left.join(kept, "k", "left_semi").select("bucket").distinct(), "bucket", "left_semi").select("k").distinct()
        seen = materialize(near.join(kept, "k", "left_anti"), "seen")
        done += [kept.withColumn("seen", F.lit(False)), seen.withColumn("seen", F.lit(True))]
        rest = materialize(left.join(kept.unionByName(seen), "k", "left_anti"), "undecided")
        discard(left)
        left = rest
    out = reduce(DataFrame.unionByName, done) if done else left.select("k", F.lit(False).alias("seen"))
    return out.select(F.col("k").alias(key), "seen")


def sampled_rate(df: DataFrame, key: str, groups: DataFrame, sample: DataFrame) -> DataFrame:
    """One row: sampled texts, how many are in a group, and the rate (ND15)."""
    t = sample.select(key).join(groups.select(F.col("node").alias(key), F.lit(1).alias("_in")), key, "left")
    return t.agg(F.count("*").alias("sampled"), F.count("_in").alias("near"), F.round(F.count("_in") / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"))


def reading_sheet(groups: DataFrame, domains: DataFrame, key: str, domain: str, per_band: int, seed: str) -> DataFrame:
    """component, band, size, n_domains of a few groups per size band, by hash order (ND18): a sheet to read by hand."""
    j = groups.join(domains.select(F.col(key).alias("node"), F.col(domain).alias("_d")), "node")
    g = j.groupBy("component").agg(F.count("*").alias("size"), F.count_distinct("_d").alias("n_domains"))
    g = g.withColumn("band", F.when(F.col("size") == 2, "2").when(F.col("size") <= 5, "3-5").otherwise("6+"))
    w = Window.partitionBy("band").orderBy(F.sha1(F.concat(F.lit(seed), F.col("component").cast("string"))), "component")
    return g.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_band).drop("_r")
