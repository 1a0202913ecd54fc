"""Problem 7: mixing sources to target weights, by the cube method.

A source that must fill T tokens and holds A is used floor(T / A) times in full, and each of its rows once more with
probability p = T / A - floor(T / A). The cube method turns these probabilities into 0 or 1 such that both the number
of rows and the sum of their tokens stay at p times their total: it moves the vector of probabilities along the
null space of the two constraints until a coordinate hits 0 or 1, again and again, until at most two are undecided
(the landing problem). Blocks of rows take their flights side by side; what they leave undecided (two rows a block)
is pooled into new blocks, until one block per source is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tokenizer import token_counter

#: Rows per flight; a block of this size is one task's work at most.
BLOCK = 20_000
#: Rows of a block's lane.
LANE = 128
#: A share is reached if it is within this fraction of its target.
CLOSE = 0.01


def flight(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but for at most two; sum(p) and sum(p * size) are kept.

    Three undecided rows at a time span a direction in which both sums stand still: (s2 - s3, s3 - s1, s1 - s2).
    Rows of equal size are moved in pairs, (1, -1). Many rows first fly in lanes side by side; what those leave
    undecided, two rows each at most, flies on as one.
    """
    p, size = np.array(p, dtype=float), np.asarray(size, dtype=float)
    if len(p) >= 4 * LANE:
        p = _lanes(p, size)
    tiny = 1e-9
    p[p <= tiny], p[p >= 1 - tiny] = 0, 1
    left = np.flatnonzero((p > 0) & (p < 1))
    p[left] = _fly_on(p[left].tolist(), size[left].tolist())
    return p


def _lanes(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The flight of len(p) // LANE lanes of LANE rows; rows beyond them stay as they are."""
    n = len(p) // LANE
    out = p.copy()
    rows = np.arange(n * LANE).reshape(LANE, n)
    lane = np.arange(n)
    q, s, at = np.zeros((3, n)), np.zeros((3, n)), np.full((3, n), -1)  # up to three undecided rows a lane
    for k in range(LANE):
        free = (at < 0).argmax(axis=0)
        q[free, lane], s[free, lane], at[free, lane] = p[rows[k]], size[rows[k]], rows[k]
        full = (at >= 0).all(axis=0)
        u = np.stack([s[1] - s[2], s[2] - s[0], s[0] - s[1]])
        same = (u == 0).all(axis=0)
        u[0, same], u[1, same] = 1, -1
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf))
        hit = room.argmin(axis=0)
        q += np.where(full, room[hit, lane], 0) * u
        q[hit[full], lane[full]] = np.round(q[hit[full], lane[full]])
        settled = (at >= 0) & ((q < 1e-9) | (q > 1 - 1e-9))
        out[at[settled]] = np.round(q[settled])
        at[settled] = -1
    held = at >= 0
    out[at[held]] = q[held]
    return out


def _fly_on(p: list[float], size: list[float]) -> list[float]:
    """The flight row by row."""
    tiny = 1e-9
    held: list[int] = []
    for i in range(len(p)):
        if not tiny < p[i] < 1 - tiny:
            p[i] = round(p[i])
            continue
        held.append(i)
        while len(held) >= 3 or len(held) == 2 and size[held[0]] == size[held[1]]:
            if len(held) >= 3:
                a, b, c = held[:3]
                u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
                who = (a, b, c)
                if u == (0.0, 0.0, 0.0):
                    who, u = (a, b), (1.0, -1.0)
            else:
                who, u = (held[0], held[1]), (1.0, -1.0)
            step = min((1 - p[k]) / d if d > 0 else -p[k] / d for k, d in zip(who, u) if d)
            for k, d in zip(who, u):
                p[k] += step * d
            still = []
            for k in held:
                if p[k] < tiny:
                    p[k] = 0.0
                elif p[k] > 1 - tiny:
                    p[k] = 1.0
                else:
                    still.append(k)
            if len(still) == len(held):  # rounding kept all afloat: settle the nearest
                k = min(who, key=lambda k: min(p[k], 1 - p[k]))
                p[k] = float(round(p[k]))
                still = [j for j in held if j != k]
            held = still
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few undecided rows settled such that the sum of tokens is off by the least (then the number of rows)."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        want, rows = float((p[open_] * size[open_]).sum()), float(p[open_].sum())
        choices = [[(m >> j) & 1 for j in range(len(open_))] for m in range(1 << len(open_))]
        p[open_] = min(choices, key=lambda c: (abs(np.dot(c, size[open_]) - want), abs(sum(c) - rows)))
    return p


class Mix:
    """Rows to use and how often, per source, for the target shares.

    documents: doc_id, source, text; targets: source, weight, max_repeats, total_tokens. Rows of a source without a
    target, without a source or without doc_id are not used. A target whose source has no rows stays empty. Null weights ask for
    nothing; null max_repeats allow one use. Rows of no tokens fill nothing and are not used. Repeated target rows of
    one source are added up (weight) or the larger one holds (max_repeats).
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, vocab: DataFrame):
        n = token_counter(vocab)
        want = (
            targets.where("source is not null")
            .groupBy("source")
            .agg(F.sum(F.coalesce("weight", F.lit(0.0)) * F.coalesce("total_tokens", F.lit(0.0))).alias("want"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
        )
        self.rows = materialize(documents.where("source is not null and doc_id is not null").select("doc_id", "source", n("text").alias("n_tokens")), "mix")
        have = self.rows.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("n_rows"), F.count_if(F.col("n_tokens") > 0).alias("n_full"))
        times = F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0)
        self.plan = (
            want.join(have, "source", "left")
            .select("source", "want", "max_repeats", F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_full", F.lit(0)).alias("n_full"))
            .withColumn("times", F.least(F.col("max_repeats").cast("double"), times))
        )

    def selection(self) -> DataFrame:
        """doc_id, source, n_tokens, n_uses of the rows to use."""
        plan = self.plan.select("source", F.floor("times").cast("int").alias("full"), (F.col("times") - F.floor("times")).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BLOCK)).cast("long").alias("blocks"))
        rows = self.rows.where("n_tokens > 0").join(plan, "source").select(F.col("doc_id").cast("long"), "source", "n_tokens", "full", "p", "blocks")
        blocks = plan.agg(F.max("blocks").alias("n")).first()["n"] or 1
        columns = "doc_id long, source string, n_tokens long, full int, p double, blocks long"
        done = None
        while True:
            flown = rows.groupBy("source", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).applyInPandas(_fly(blocks == 1), columns)
            if blocks == 1:
                done = flown if done is None else done.unionByName(flown)
                break
            flown = materialize(flown, "flight")
            settled = flown.where("p = 0 or p = 1")
            done = settled if done is None else done.unionByName(settled)
            rows = flown.where("p > 0 and p < 1").withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK))
            blocks = -(-blocks * 2 // BLOCK)
        uses = (F.col("full") + F.col("p").cast("int")).cast("int")
        return done.select("doc_id", "source", "n_tokens", uses.alias("n_uses")).where("n_uses > 0")

    def shares(self) -> DataFrame:
        """Per source: target and reached tokens and shares of the whole, rows used, and whether it falls short.

        A source falls short if its selected rows miss the target though every row that has tokens is used max_repeats
        times.
        """
        got = self.selection().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens"), F.sum("n_uses").alias("uses"), F.count("*").alias("n_used"))
        whole = Window.partitionBy()  # over one row per source
        tokens, uses = F.coalesce("tokens", F.lit(0)), F.coalesce("uses", F.lit(0))
        return self.plan.join(got, "source", "left").select(
            "source", "max_repeats", "have", "n_rows", F.round("want", 6).alias("target_tokens"), tokens.alias("tokens"), uses.alias("uses"), F.coalesce("n_used", F.lit(0)).alias("rows_used"),
            F.round(F.try_divide(F.col("want"), F.sum("want").over(whole)), 6).alias("target_share"), F.round(F.try_divide(tokens, F.sum(tokens).over(whole)), 6).alias("share"),
            ((tokens < F.col("want")) & (uses == F.col("n_full") * F.col("max_repeats"))).alias("short"),
        )


def _fly(last: bool):
    """The flight of one block; in the last round the landing too."""

    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n_tokens"], kind="stable").reset_index(drop=True)
        order = np.random.default_rng(17).permutation(len(rows))
        p, size = rows["p"].to_numpy()[order], rows["n_tokens"].to_numpy(dtype=float)[order]
        p = flight(p, size)
        if last:
            p = landing(p, size)
        rows.loc[order, "p"] = p
        return rows

    return fly
