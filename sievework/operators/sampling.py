"""Quotas, deterministic samples and splits. Random choices are orders by a hash of a seed and the row's id."""

from __future__ import annotations

import ast
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranked


def order_value(score: str = "score", dims: str | None = None, dim: str | None = None) -> Column:
    """The score; or of a map of grades one of them, or their mean (Q2). NaN and infinite scores are null."""
    s = F.col(score)
    s = F.when(F.isnan(s) | (F.abs(s) == float("inf")), F.lit(None)).otherwise(s)
    if dims is None:
        return s
    grades = F.map_values(dims)
    mean = F.aggregate(grades, F.lit(0.0), lambda a, x: a + x) / F.size(grades)
    return F.coalesce(s, F.element_at(F.col(dims), dim).cast("double") if dim else F.when(F.size(grades) > 0, mean))


def pinned(ledger: DataFrame, scorer: str, version: str, group: Sequence[str], value: Column) -> DataFrame:
    """One row per group and document of one scorer and version: its highest value (Q1). Rows without a value are left out."""
    t = ledger.where((F.col("scorer_name") == scorer) & (F.col("scorer_version") == version)).withColumn("value", value).where("value is not null")
    return t.groupBy(*group, "doc_id").agg(F.max("value").alias("value"))


def quota_rows(scored: DataFrame, group: Sequence[str], quota: float) -> DataFrame:
    """scored with rank, group_rows and keep = clamp(ceil(quota * n - 1e-9), 1, n): rank <= keep is selected (Q3)."""
    if not 0 < quota <= 1:
        raise ValueError("a quota must be in (0, 1]")
    keep = F.greatest(F.lit(1), F.least(F.col("group_rows"), F.ceil(F.lit(quota) * F.col("group_rows") - 1e-9))).cast("long")
    return ranked(scored, group, [F.col("value").desc(), F.col("doc_id")]).withColumn("keep", keep)


def uncovered(ledger: DataFrame, scorer: str, version: str, group: Sequence[str]) -> DataFrame:
    """Groups that the scorer scored in some version but not in the pinned one (Q4)."""
    own = ledger.where(F.col("scorer_name") == scorer)
    return own.select(*group).distinct().join(own.where(F.col("scorer_version") == version).select(*group).distinct(), list(group), "left_anti")


def review_window(rows: DataFrame, per_group: int) -> DataFrame:
    """The rows around the cut, per_group on either side (Q5)."""
    return rows.where((F.col("rank") > F.col("keep") - per_group) & (F.col("rank") <= F.col("keep") + per_group))


def hash_order(key: str, seed: str) -> Column:
    """A seeded pseudo-random order: sha1 of seed and id."""
    return F.sha1(F.concat(F.lit(seed), F.lit("|"), F.col(key).cast("string")))


def per_stratum(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows per stratum by hash order (Q6, Q14, Q16, Q20, Q23); the window's top-n is cut before the shuffle."""
    w = Window.partitionBy(*strata).orderBy("_h", key)
    return df.withColumn("_h", hash_order(key, seed)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_h", "_r")


def global_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows of all by hash order (Q15)."""
    return df.withColumn("_h", hash_order(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def allocate(counts: DataFrame, n: str, target: int, floor: int) -> DataFrame:
    """counts with quota: a target shared among strata by what each has beyond its floor (Q7).

    counts has one row per stratum and its size n. A stratum gets min(floor, n), and of what is left of the target its
    part in proportion to n - min(floor, n), rounded by largest remainder (ties: larger n, then by the other columns),
    so quotas add up to the target, or to all there is, or to the floors if these are more. Whole numbers throughout.
    """
    names = [c for c in counts.columns if c != n]
    every = Window.partitionBy()  # over one row per stratum
    t = counts.withColumn("_base", F.least(F.lit(floor), F.col(n)).cast("decimal(19,0)")).withColumn("_space", (F.col(n) - F.col("_base")).cast("decimal(19,0)"))
    t = t.withColumn("_all", F.sum("_space").over(every)).withColumn("_left", F.greatest(F.lit(0), F.least(F.lit(target) - F.sum("_base").over(every), F.col("_all"))))
    part = F.col("_left") * F.col("_space")
    t = t.withColumn("_q", F.when(F.col("_all") > 0, F.floor(part / F.col("_all"))).otherwise(0).cast("long"))
    t = t.withColumn("_rest", part - F.col("_q") * F.col("_all"))
    order = Window.partitionBy().orderBy(F.desc("_rest"), F.desc(n), *names)
    t = t.withColumn("_extra", (F.row_number().over(order) <= F.col("_left") - F.sum("_q").over(every)).cast("int"))
    return t.select(*counts.columns, (F.col("_base") + F.col("_q") + F.col("_extra")).cast("long").alias("quota"))


def tercile_bounds(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """lo, hi per group: the values at the places int(n / 3) and int(2n / 3) of the sorted values (Q8)."""
    r = ranked(df.where(F.col(value).isNotNull()).select(*group, value, F.monotonically_increasing_id().alias("_i")), group, [F.col(value), F.col("_i")])
    at = lambda k: F.max(F.when(F.col("rank") == F.least(F.col("group_rows"), F.floor(F.lit(k / 3) * F.col("group_rows")) + 1), F.col(value)))
    return r.groupBy(*group).agg(at(1).alias("lo"), at(2).alias("hi"))


def band(value: Column, lo: Column, hi: Column) -> Column:
    """low up to lo, mid up to hi, high beyond (Q8)."""
    return F.when(value <= lo, "low").when(value <= hi, "mid").when(value > hi, "high")


def window_chunks(text: str, lo: int = 512, hi: int = 1024) -> list[str]:
    """A text in pieces of at most hi words, split at line ends where a piece has lo words, the tail rebalanced (Q10).

    The pieces joined are the text. A last piece of fewer than lo words is joined with the one before it, and halved if
    that is too long.
    """
    import re

    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    small: list[tuple[str, int]] = []
    for u in units:
        words = re.findall(r"\S+\s*|\s+", u)
        for i in range(0, len(words), hi):
            part = words[i : i + hi]
            small.append(("".join(part), sum(not w.isspace() for w in part)))
    out: list[list] = []
    for u, n in small:
        if out and out[-1][1] + n <= hi and out[-1][1] < lo:
            out[-1][0] += u
            out[-1][1] += n
        else:
            out.append([u, n])
    if len(out) > 1 and out[-1][1] < lo:
        u, n = out.pop()
        out[-1][0] += u
        out[-1][1] += n
        if out[-1][1] > hi:
            words = re.findall(r"\S+\s*|\s+", out[-1][0])
            half = len(words) // 2
            out[-1:] = [["".join(words[:half]), 0], ["".join(words[half:]), 0]]
    return [u for u, _ in out]


def code_chunks(text: str, most: int = 2000) -> list[str]:
    """Python source in pieces of about `most` characters, cut before top-level statements only (Q11).

    The pieces joined are the text. Source that does not parse is one piece.
    """
    try:
        starts = [min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) - 1 for n in ast.parse(text).body]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [text]
    rows = text.splitlines(keepends=True)
    cuts = sorted({0, *starts[1:], len(rows)})
    out: list[str] = []
    for a, b in zip(cuts, cuts[1:]):
        unit = "".join(rows[a:b])
        if out and len(out[-1]) + len(unit) <= most:
            out[-1] += unit
        else:
            out.append(unit)
    return out if "".join(out) == text else [text]


def chunked(df: DataFrame, text: str, split, keys: Sequence[str]) -> DataFrame:
    """keys, chunk_idx, n_chunks, chunk, by a function of a text (Q10, Q11). Null and empty texts give no chunk."""

    @F.pandas_udf("array<string>")
    def pieces(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split(t) if t else [])

    t = df.select(*keys, pieces(F.col(text)).alias("_p"))
    return t.select(*keys, F.size("_p").alias("n_chunks"), F.posexplode("_p").alias("chunk_idx", "chunk"))


def split_side(key: str, seed: str, share: float) -> Column:
    """val or train by the first 12 hex digits of sha256(seed | id); all rows of an id fall on one side (Q12)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.lit("|"), F.col(key).cast("string")), 256), 1, 12), 16, 10).cast("double")
    return F.when(h / float(16**12) < share, "val").otherwise("train")


def balanced(df: DataFrame, group: str, key: str, tolerance: float, seed: str) -> DataFrame:
    """Rows trimmed by hash until no group exceeds the smallest by more than the tolerance (Q17)."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    bound = sizes.agg(F.floor(F.min("_n") * (1 + tolerance)).alias("_b"))
    r = ranked(df.withColumn("_h", hash_order(key, seed)), [group], [F.col("_h"), F.col(key)])
    return r.join(bound).where("rank <= _b").select(*df.columns)


def budget_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], size: str, budget: float) -> DataFrame:
    """Rows in order until the running size reaches the budget, the crossing row included (Q19)."""
    return ranked(df, group, order, size).where(F.col("before") < budget)


def rate_band(rates: DataFrame, rate: str, bands: Sequence[tuple[float, float]], least: int) -> tuple[tuple[float, float], DataFrame]:
    """The first band that holds `least` rows (else the last), and its rows (Q22)."""
    counts = rates.agg(*(F.count_if(F.col(rate).between(lo, hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(bands))).first()
    at = next((i for i in range(len(bands)) if counts[i] >= least), len(bands) - 1)
    lo, hi = bands[at]
    return bands[at], rates.where(F.col(rate).between(lo, hi))


def exposures(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """Every row n times: exposure, and slot, its place in a seeded order of all (Q24)."""
    t = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("exposure"))
    return t.withColumn("slot", F.sha1(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col("exposure").cast("string"))))


def stripe(rank: Column, n: int) -> Column:
    """Round-robin assignment of ranked rows to n shards (SRC3, SRC8, M3)."""
    return F.pmod(rank - 1, F.lit(n))


def required(recall_at: float, bands: int, rows: int) -> float:
    """Theoretical recall of banded buckets at a similarity (ND5)."""
    return 1 - math.pow(1 - math.pow(recall_at, rows), bands)
