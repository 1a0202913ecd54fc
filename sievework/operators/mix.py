"""Mix plans, token streams and sequence packing as row plans."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ranked


class Drift(ValueError):
    """A mix that no longer fits its data."""


def weights(mix: DataFrame) -> DataFrame:
    """domain, weight, epochs, anneal, tokens of a mix file; a null anneal is the weight, a null epochs 1."""
    e = F.col("e")
    return mix.select(F.explode("domains").alias("domain", "e")).select("domain", F.coalesce(e["weight"], F.lit(0.0)).alias("weight"), F.coalesce(e["epochs"], F.lit(1)).alias("epochs"), F.coalesce(e["anneal"], e["weight"], F.lit(0.0)).alias("anneal"), F.coalesce(e["tokens"], F.lit(0)).alias("tokens"))


def plan(mix: DataFrame, pools: DataFrame, rows: int, anneal_frac: float) -> DataFrame:
    """phase, domain, first, n: rows wanted per phase, capped by pool * epochs over both phases.

    pools: domain, pool. The main phase takes int(rows * (1 - a) * weight), the anneal phase int(rows * a * anneal) of
    what is left; first is the place in the domain's repeated pool from which the phase reads on. Domains without a
    pool give nothing.
    """
    t = weights(mix).join(pools, "domain", "left").withColumn("cap", F.floor(F.coalesce("pool", F.lit(0)) * F.col("epochs")))
    main = F.least(F.floor(F.lit(float(rows)) * (1 - anneal_frac) * F.col("weight")), F.col("cap"))
    t = t.withColumn("m", main).withColumn("a", F.least(F.floor(F.lit(float(rows)) * anneal_frac * F.col("anneal")), F.col("cap") - F.col("m")))
    two = F.explode(F.array(F.struct(F.lit("main").alias("phase"), F.lit(0).cast("long").alias("first"), F.col("m").alias("n")), F.struct(F.lit("anneal").alias("phase"), F.col("m").alias("first"), F.col("a").alias("n"))))
    return t.select("domain", "pool", two.alias("p")).select("p.phase", "domain", "pool", "p.first", "p.n")


def row_plan(planned: DataFrame, seed: str) -> DataFrame:
    """phase, slot, domain, row: every planned row, wrapped around its pool, in a seeded order within its phase (M1-M3)."""
    t = planned.where("n > 0 and pool > 0").select("phase", "domain", "pool", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("i"))
    t = t.select("phase", "domain", F.pmod(F.col("i"), F.col("pool")).alias("row"), "i").withColumn("h", F.sha1(F.concat_ws("|", F.lit(seed), "phase", "domain", F.col("i").cast("string"))))
    return ranked(t, ["phase"], [F.col("h"), F.col("domain"), F.col("i")]).select("phase", F.col("rank").alias("slot"), "domain", "row")


def holdback(rows: DataFrame, share: float, most: int = 5000) -> DataFrame:
    """rows of (domain, row, pool) with a mark for the first min(max(1, int(pool * share)), most) of each domain (M4)."""
    n = F.least(F.greatest(F.lit(1), F.floor(F.col("pool") * share)), F.lit(most))
    return rows.withColumn("held", F.col("row") < n)


def replay(planned: DataFrame, done: DataFrame) -> DataFrame:
    """domain, used, left, retired: a mix resumed after rows were read (M5). done: domain, used.

    A domain that was read but is no longer planned is retired; one read beyond its plan is an error.
    """
    p = planned.groupBy("domain").agg(F.sum("n").alias("n"))
    t = p.join(done, "domain", "full_outer").select("domain", F.coalesce("used", F.lit(0)).alias("used"), F.greatest(F.coalesce("n", F.lit(0)) - F.coalesce("used", F.lit(0)), F.lit(0)).alias("left"), F.col("n").isNull().alias("retired"), (F.col("used") > F.col("n")).alias("over"))
    if not t.where("over").isEmpty():
        raise Drift("a domain was read beyond its plan")
    return t.drop("over")


def drift(stamped: DataFrame, live: DataFrame) -> DataFrame:
    """Domains whose fingerprint differs or is missing on a side: domain, stamped, live (M6)."""
    t = stamped.select("domain", F.col("fp").alias("stamped")).join(live.select("domain", F.col("fp").alias("live")), "domain", "full_outer")
    return t.where(~F.col("stamped").eqNullSafe(F.col("live")))


def reconciled(values: Sequence[float | None]) -> float:
    """The one fraction that all sources that name one agree on, 0 if none does (M7)."""
    named = {round(v, 9) for v in values if v is not None}
    if len(named) > 1:
        raise Drift(f"anneal fractions disagree: {sorted(named)}")
    return named.pop() if named else 0.0


def token_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], tokens: str, seq: int) -> DataFrame:
    """df with offset, first_row, last_row of a stream of (tokens + 1) cut into rows of seq + 1, and complete.

    The one is the end mark of each text; complete is false where the text reaches into the tail that is dropped.
    """
    t = ranked(df.withColumn("_n", F.col(tokens) + 1), group, order, "_n")
    total = t.groupBy(*group).agg(F.max(F.col("before") + F.col("_n")).alias("_total")) if group else t.agg(F.max(F.col("before") + F.col("_n")).alias("_total"))
    t = t.join(total, list(group)) if group else t.join(total)
    w = seq + 1
    last = F.floor((F.col("before") + F.col("_n") - 1) / w)
    return t.select(*df.columns, F.col("before").alias("offset"), F.floor(F.col("before") / w).alias("first_row"), last.alias("last_row"), (last < F.floor(F.col("_total") / w)).alias("complete"))


def pack_block(sizes: Sequence[int], seq: int, lookahead: int = 512) -> list[int]:
    """Row of each item: one row is filled at a time with the first of the next `lookahead` items that fits; when none does,
    a new row begins. -1 for an item longer than seq (M11)."""
    out = [-1] * len(sizes)
    coming = iter([k for k, s in enumerate(sizes) if s <= seq])
    window: list[int] = []
    row, room = -1, 0
    while True:
        window += itertools.islice(coming, lookahead - len(window))
        if not window:
            return out
        at = next((j for j, k in enumerate(window) if sizes[k] <= room), None)
        if at is None:
            row, room = row + 1, seq
        else:
            k = window.pop(at)
            out[k], room = row, room - sizes[k]


def sft_pack(df: DataFrame, key: str, size: str, seq: int, block: int = 20_000, lookahead: int = 512) -> DataFrame:
    """key, size, block, bin: examples packed unsplit within blocks of hash-ordered rows; overlong ones have bin -1.

    The rule depends on order, so the order is by hash and local to a block of bounded size.
    """
    n = df.agg(F.count("*").alias("n")).first()["n"]
    blocks = max(1, -(-n // block))
    t = df.select(key, F.col(size).cast("long").alias("size"), F.xxhash64(key).alias("_h")).withColumn("block", F.pmod("_h", F.lit(blocks)))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_h", key]).drop(columns="_h")
        return rows.assign(bin=pack_block(rows["size"].fillna(0).astype(int).tolist(), seq, lookahead))

    return t.groupBy("block").applyInPandas(pack, f"{key} {df.schema[key].dataType.simpleString()}, size long, block long, bin long").select(key, "size", "block", "bin")


def sft_rows(df: DataFrame, key: str, ids: str, n_prompt: str, seq: int, eos: int, mask: int = -100, **how) -> DataFrame:
    """block, bin, input_ids, labels, n_examples: the packed rows, each of seq tokens.

    An example is its ids and an end mark. Its prompt carries no loss, nor does the padding of end marks; overlong
    examples are left out, since a cut one would miss its question or its end. A row is bounded, so its parts are
    gathered in one group. keys must tell rows apart.
    """
    whole = df.where(F.col(ids).isNotNull()).select(key, F.concat(F.col(ids), F.array(F.lit(eos))).alias("_ids"), F.coalesce(n_prompt, F.lit(0)).alias("_p"))
    at = sft_pack(whole.withColumn("_n", F.size("_ids")), key, "_n", seq, **how).where("bin >= 0")
    blank = lambda n, x: F.when(n > 0, F.array_repeat(F.lit(x), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    labels = F.concat(blank(F.least("_p", F.size("_ids")), mask), F.slice("_ids", F.least(F.col("_p"), F.size("_ids")) + 1, F.size("_ids")))
    t = whole.join(at.select(key, "block", "bin"), key).select("block", "bin", F.struct(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.col("_ids").alias("ids"), labels.alias("labels")).alias("x"))
    g = t.groupBy("block", "bin").agg(F.sort_array(F.collect_list("x")).alias("x"))
    pad = lambda c, fill: F.concat(c, blank(seq - F.size(c), fill))
    flat = lambda f: F.flatten(F.transform("x", lambda e: e[f]))
    return g.select("block", "bin", pad(flat("ids"), eos).alias("input_ids"), pad(flat("labels"), mask).alias("labels"), F.size("x").alias("n_examples"))


def composition(means: dict[str, float], supply: dict[str, int], ratios: dict[str, float]) -> dict[str, int]:
    """Examples per source such that their tokens stand in the ratios, as many as the scarcest source allows."""
    per = {k: ratios[k] / means[k] for k in ratios if ratios[k] > 0}
    scale = min((supply[k] / v for k, v in per.items()), default=0)
    return {k: int(scale * v) for k, v in per.items()}


def count_state(counted: DataFrame, stamped: DataFrame) -> DataFrame:
    """domain, state: what a recount says about a stamp: same, grown, shrunk, missing, unstamped."""
    t = counted.select("domain", F.col("tokens").alias("c")).join(stamped.select("domain", F.col("tokens").alias("s")), "domain", "full_outer")
    return t.select("domain", F.when(F.col("c").isNull(), "missing").when(F.col("s").isNull(), "unstamped").when(F.col("c") == F.col("s"), "same").when(F.col("c") > F.col("s"), "grown").otherwise("shrunk").alias("state"))


def spread(supplies: DataFrame, total: float, floor: float, cap: float) -> DataFrame:
    """domain, weight: in proportion to supply, clamped to [floor, cap] once and rescaled."""
    from pyspark.sql import Window

    w = Window.partitionBy()
    raw = F.least(F.greatest(F.col("tokens") / F.sum("tokens").over(w), F.lit(floor)), F.lit(cap))
    t = supplies.withColumn("_r", raw)
    return t.select("domain", F.round(F.col("_r") / F.sum("_r").over(w), 9).alias("weight"), F.floor(F.col("_r") / F.sum("_r").over(w) * total).alias("tokens_wanted"))
