"""Exact similarity join of sets of hashes, by prefix filtering.

All sets are put into one order, frequent hashes last. Two sets of Jaccard similarity s or more share a hash among the
first |x| - ceil(s |x|) + 1 of each, so sets that share none of those need no comparison, and no other pair is left out.
The order only decides how many candidates there are, so the frequent hashes are taken from a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Sets in the sample of frequent hashes, and how many hashes are kept of it.
SAMPLE, FREQUENT = 20_000, 65_536
#: Rows of one hash that are compared at once; more are compared block by block, over all pairs of blocks.
BLOCK = 512

_MET = "a long, b long, key long, size int, pos int, block int"


_U = np.uint64
_ids: dict[str, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _word(w: str) -> int:
    if len(_ids) > 500_000:
        _ids.clear()
    if (h := _ids.get(w)) is None:
        h = _ids[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return h


def word_sets(df: DataFrame, n: int) -> DataFrame:
    """k, id, h of a table k, t: the set of hashes of n words of t, split at single spaces, and one id per set; texts of fewer words are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.split(" ") if t else [] for t in batch.column("t").to_pylist()]
            m = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            flat = np.fromiter((_word(w) for ws in words for w in ws), dtype=np.uint64, count=int(m.sum()))
            doc = np.repeat(np.arange(len(words)), m)
            if len(flat) < n:
                continue
            last = len(flat) - n + 1
            h = _mix(flat[:last])
            for i in range(1, n):
                h = _mix(h * _U(0x9E3779B97F4A7C15) + flat[i : i + last])
            inside = doc[:last] == doc[n - 1 :]
            doc, h = doc[:last][inside], h[inside].view(np.int64)
            by = np.lexsort((h, doc))
            doc, h = doc[by], h[by]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            real, doc = np.unique(doc[new], return_inverse=True)
            h = h[new]
            ids = np.zeros(len(real), dtype=np.uint64)
            np.add.at(ids, doc, _mix(h.view(np.uint64) ^ _U(0x5851F42D4C957F2D)))
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(real)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(real)), pa.array(ids.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h))], ["k", "id", "h"])

    return df.mapInArrow(cut, f"k {df.schema['k'].dataType.simpleString()}, id long, h array<long>")


def sample(df: DataFrame) -> DataFrame:
    """About SAMPLE rows."""
    return df.sample(min(1.0, SAMPLE / max(df.count(), 1)), seed=1)


def frequent(hashes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent values of a column h that occur twice or more, sorted, and their ranks, the rarest 1."""
    rows = hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    h = np.array([r.h for r in rows], dtype=np.int64)
    at = np.argsort(h)
    return h[at], np.arange(len(h), 0, -1)[at]


def prefixes(doc: np.ndarray, h: np.ndarray, n: int, order: tuple[np.ndarray, np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set number, hash, place) of each set's first hashes in order, and all sets' sizes; repeats count once."""
    known, ranks = order
    rank = np.zeros(len(h), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        rank = np.where(known[at] == h, ranks[at], 0)
    by = np.lexsort((h, (doc.astype(np.int64) << 20) | rank))
    doc, h = doc[by], h[by]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    size = np.bincount(doc, minlength=n)
    place = np.arange(len(h)) - (np.cumsum(size) - size)[doc]
    inside = place < (size - np.ceil(share * size - 1e-9) + 1)[doc]
    return doc[inside], h[inside], place[inside], size


def keyed(sets: DataFrame, order: tuple[np.ndarray, np.ndarray], share: float) -> DataFrame:
    """key, id, size, pos of the prefixes of sets: id long, h array<long>."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column("h"), batch.column("id").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            doc, h, place, size = prefixes(doc, lists.flatten().to_numpy(zero_copy_only=False), len(ids), order, share)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[doc]), pa.array(size[doc].astype(np.int32)), pa.array(place.astype(np.int32))], ["key", "id", "size", "pos"])

    return sets.select("id", "h").mapInArrow(cut, "key long, id long, size int, pos int")


def meeting(keys: DataFrame, share: float, block: int = BLOCK) -> DataFrame:
    """a, b (a < b), distinct: sets that share a key and can be similar by their sizes and by what follows the key.

    keys: key, id, size, pos. Of a key of many sets every pair of blocks is a group of its own, so no task gets an
    unbounded group and no pair is dropped.
    """
    met = materialize(keys.repartition("key").sortWithinPartitions("key", "size", "id").mapInArrow(lambda x: _meet(x, share, block), _MET), "met")
    hot = met.where("key is not null").select("key", F.col("a").alias("id"), "size", "pos", "block")
    blocks = hot.groupBy("key").agg(F.max("block").alias("last"))
    spread = hot.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "size", "pos")
    across = spread.groupBy("key", "i", "j").applyInPandas(lambda x: _across(x, share), "a long, b long")
    return met.where("key is null").select("a", "b").unionByName(across).distinct()


def _possible(sa, sb, pa_, pb, share: float):
    """Whether sets of these sizes whose first common hash is at these places can be similar."""
    rest = np.minimum(sa - pa_, sb - pb)
    return (np.minimum(sa, sb) >= share * np.maximum(sa, sb) - 1e-9) & (rest >= share / (1 + share) * (sa + sb) - 1e-9)


def _meet(batches: Iterator[pa.RecordBatch], share: float, block: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of keys of up to `block` rows; the rows of other keys with their block's number."""
    rest = [np.zeros(0, dtype=np.int64)] * 4
    hot, blocks = None, 0  # the key whose rows are handed on, and its blocks so far

    def handed(part):
        nonlocal blocks
        n = len(part[0])
        number = blocks + np.arange(n) // block
        blocks += -(-n // block)
        return pa.RecordBatch.from_arrays([pa.array(part[1]), pa.nulls(n, pa.int64()), pa.array(part[0]), pa.array(part[2].astype(np.int32)), pa.array(part[3].astype(np.int32)), pa.array(number.astype(np.int32))], ["a", "b", "key", "size", "pos", "block"])

    def compared(part):
        key, ids, size, pos = part
        out, at = [], np.arange(len(key))
        d = 1
        while len(at := at[at + d < len(key)]):
            to = at + d
            on = (key[at] == key[to]) & (size[at] >= share * size[to] - 1e-9)  # sizes ascend, so a set that fails here fails further on
            at, to = at[on], to[on]
            ok = _possible(size[at], size[to], pos[at], pos[to], share) & (ids[at] != ids[to])
            out.append((np.minimum(ids[at[ok]], ids[to[ok]]), np.maximum(ids[at[ok]], ids[to[ok]])))
            d += 1
        if not out or not sum(len(a) for a, _ in out):
            return None
        a, b = np.unique(np.stack([np.concatenate(x) for x in zip(*out)]), axis=1)
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.int32()) for _ in range(3))], ["a", "b", "key", "size", "pos", "block"])

    for batch in _and_end(batches):
        if batch is None:
            part, rest = rest, None
        else:
            part = [np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, ("key", "id", "size", "pos"))]
            new = np.ones(len(part[0]), dtype=bool)
            new[1:] = (part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1])
            part = [x[new] for x in part]
        if not len(part[0]):
            continue
        starts = np.flatnonzero(np.append(True, part[0][1:] != part[0][:-1]))
        ends = np.append(starts[1:], len(part[0]))
        if hot is not None and part[0][0] == hot:
            yield handed([x[: ends[0]] for x in part])
            starts, ends = starts[1:], ends[1:]
        if not len(starts):
            rest = [x[:0] for x in part]
            continue
        if batch is not None and ends[-1] - starts[-1] <= block:  # the last key may go on
            rest = [x[starts[-1] :] for x in part]
            starts, ends = starts[:-1], ends[:-1]
        elif batch is not None:
            rest = [x[:0] for x in part]
        many = ends - starts > block
        for s, e in zip(starts[many], ends[many]):
            hot, blocks = part[0][s], 0
            yield handed([x[s:e] for x in part])
        few = np.zeros(len(part[0]) + 1, dtype=np.int64)
        pick = ~many & (ends - starts > 1)
        np.add.at(few, starts[pick], 1)
        np.add.at(few, ends[pick], -1)
        inside = np.cumsum(few[:-1]) > 0
        if inside.any() and (found := compared([x[inside] for x in part])) is not None:
            yield found


def _and_end(batches):
    yield from batches
    yield None


def _across(rows: pd.DataFrame, share: float) -> pd.DataFrame:
    """The possible pairs of two blocks, or within one."""
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]
    x = rows[rows["block"] == i]
    y = rows[rows["block"] == j]
    ok = _possible(x["size"].to_numpy()[:, None], y["size"].to_numpy()[None], x["pos"].to_numpy()[:, None], y["pos"].to_numpy()[None], share)
    p, q = np.nonzero(ok)
    a, b = x["id"].to_numpy()[p], y["id"].to_numpy()[q]
    two = np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b]
    a, b = np.unique(two, axis=1) if two.size else two
    return pd.DataFrame({"a": a, "b": b})


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n and 512 bits of each set: a bit tells whether an odd number of hashes falls on it."""
    for batch in batches:
        lists, ids = batch.column("h"), batch.column("id")
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(n)), n) * 512 + (lists.flatten().to_numpy(zero_copy_only=False) & 511)
        odd = (np.bincount(at, minlength=512 * len(n)) & 1).astype(np.uint8).reshape(len(n), 512)
        words = np.packbits(odd, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int32)), *(pa.array(words[:, j].copy()) for j in range(8))], ["id", "n", *(f"w{j}" for j in range(8))])


def exact(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """a, b, jaccard of the pairs that are similar; sets: id, h array<long> without repeats.

    Two sets differ in at least as many hashes as their bits do, so pairs whose bits differ too much are dropped before
    any set is sent around; the rest are compared in whole.
    """
    bits = materialize(sets.select("id", "h").mapInArrow(_bits, "id long, n int, " + ", ".join(f"w{j} long" for j in range(8))), "bits")
    side = lambda name, p: bits.select(F.col("id").alias(name), *(F.col(c).alias(p + c) for c in bits.columns[1:]))
    differ = sum((F.bit_count(F.col(f"x_w{j}").bitwiseXOR(F.col(f"y_w{j}"))) for j in range(1, 8)), F.bit_count(F.col("x_w0").bitwiseXOR(F.col("y_w0"))))
    both_n = F.col("x_n") + F.col("y_n")
    left = pairs.join(side("a", "x_"), "a").join(side("b", "y_"), "b").where((both_n - differ) / 2 >= both_n * (share / (1 + share)) - 1e-9).select("a", "b")
    left = materialize(left, "left")
    x, y = sets.select(F.col("id").alias("a"), F.col("h").alias("x")), sets.select(F.col("id").alias("b"), F.col("h").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = left.join(x, "a").join(y, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("jaccard"))
    return found.where(F.col("jaccard") >= share - 1e-12)
