"""Problem 5: filling fixed-capacity containers, by variable-capacity best-fit over the histogram of lengths.

Best-fit-decreasing looks only at lengths, so it runs on the counts per length: at most as many entries as the
largest capacity, whatever the number of records. It yields a plan of segments, each a run of equally long items put
the same way into a run of bins. Every item then finds its bin from its length and its rank among the items of that
length; ranks come from counts per (length, hash bucket) and a prefix sum, so a length that a third of all records
share is spread over many tasks.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tokenizer import token_counter

#: Items of one length per hash bucket, about; the number of buckets follows the data.
BUCKET_ITEMS = 200_000


class PackingPlan:
    """Best-fit-decreasing over {length: count} with several permitted bin sizes.

    An item goes into the open bin with the least room that holds it. Where none does, a bin of the least cost is
    opened: among the permitted sizes that hold the item, the one with the least unfillable room per token of size,
    where room counts as fillable as far as shorter items are left (ties: the larger size). At the end each bin is
    downsized to the smallest permitted size that holds its contents.

    segments: (length, first rank, first bin, items per bin, offset of the first item), ordered by length and rank.
    bins: (first bin, number of bins, used, size).
    """

    def __init__(self, counts: dict[int, int], capacities: Sequence[int]):
        self.capacities = sorted(set(int(c) for c in capacities))
        if not self.capacities or self.capacities[0] <= 0:
            raise ValueError("capacities must be positive")
        if counts and (min(counts) <= 0 or max(counts) > self.capacities[-1]):
            raise ValueError("lengths must be within 1 and the largest capacity")
        self.segments: list[tuple[int, int, int, int, int]] = []
        rooms: list[int] = []  # ascending; the rooms for which bins are open
        open_bins: dict[int, list[tuple[int, int, int]]] = {}  # room: (first bin, bins, used)
        self.n_bins = 0
        left = sum(n * c for n, c in counts.items())

        def put(room: int, first: int, bins: int, used: int) -> None:
            if bins > 0:
                if room not in open_bins:
                    bisect.insort(rooms, room)
                    open_bins[room] = []
                open_bins[room].append((first, bins, used))

        for length in sorted(counts, reverse=True):
            todo, rank = counts[length], 0
            left -= length * todo
            while todo:
                at = bisect.bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, bins, used = open_bins[room].pop()
                    if not open_bins[room]:
                        del open_bins[room]
                        rooms.pop(at)
                else:
                    room = self._size(length, todo, left)
                    first, bins, used = self.n_bins, -(-todo // (room // length)), 0
                    self.n_bins += bins
                each = room // length
                full = min(bins, todo // each)
                if full:
                    self.segments.append((length, rank, first, each, used))
                    put(room - each * length, first, full, used + each * length)
                    rank, todo = rank + full * each, todo - full * each
                rest = bins - full
                if rest and todo:  # fewer than `each` are left: one bin takes them
                    self.segments.append((length, rank, first + full, each, used))
                    put(room - todo * length, first + full, 1, used + todo * length)
                    put(room, first + full + 1, rest - 1, used)
                    todo = 0
                elif rest:
                    put(room, first + full, rest, used)
        fit = lambda used: self.capacities[bisect.bisect_left(self.capacities, used)]
        self.bins = sorted((first, bins, used, fit(used)) for groups in open_bins.values() for first, bins, used in groups)
        self.segments.sort()

    def _size(self, length: int, todo: int, left: int) -> int:
        """The size of the least cost for items of this length, when `left` tokens of shorter items are to come."""
        best, size = None, 0
        for capacity in self.capacities:
            if capacity >= length:
                room = capacity - min(todo, capacity // length) * length
                bins = max(1, -(-todo // (capacity // length)))
                waste = max(0.0, room - left / bins) / capacity
                if best is None or waste <= best:
                    best, size = waste, capacity
        return size

    def unused(self) -> tuple[int, int]:
        """Room left in bins of the largest size, and after downsizing."""
        return (
            sum(bins * (self.capacities[-1] - used) for _, bins, used, _ in self.bins),
            sum(bins * (size - used) for _, bins, used, size in self.bins),
        )


def split_records(records: DataFrame, vocab: DataFrame, capacity: int) -> DataFrame:
    """Pieces to place: doc_id, chunk_idx, n_tokens, n_pieces, piece, size.

    One record per distinct (doc_id, chunk_idx); delivered twice it counts once (should the texts differ, the longer
    one). A record of up to `capacity` tokens is one piece. A longer one is split into full pieces and a rest, so only
    such records have n_pieces > 1. A record of no tokens has one piece of size 0. Texts are counted once: the counts
    are written, and the plan and the placing read them.
    """
    n = token_counter(vocab)
    sized = materialize(records.select("doc_id", "chunk_idx", n("text").alias("n_tokens")).groupBy("doc_id", "chunk_idx").agg(F.max("n_tokens").alias("n_tokens")), "tokens")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    return (
        sized.withColumn("n_pieces", pieces)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("size", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int"))
    )


def pack(pieces: DataFrame, keys: Sequence[str], capacities: Sequence[int]) -> tuple[DataFrame, PackingPlan]:
    """Each piece with its container: the input's columns and bin, bin_offset, bin_size; and the plan.

    pieces needs a column size (0 to the largest capacity) and keys that tell its rows apart; rows that agree in all
    keys are told apart arbitrarily. Pieces of size 0 or null need no container: bin, bin_offset and bin_size are null.
    The plan is made of the counts per size, so at most max(capacities) numbers come to the driver.
    """
    counts = {r["size"]: r["n"] for r in pieces.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}
    plan = PackingPlan(counts, capacities)
    buckets = max(1, -(-max(counts.values(), default=1) // BUCKET_ITEMS))
    items = pieces.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    order = [F.col(k) for k in keys]
    if buckets > 1:
        per = items.where("size > 0").groupBy("size", "bucket").agg(F.count("*").alias("n"))
        prior = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        items = items.join(per.select("size", "bucket", prior.alias("before")), ["size", "bucket"], "left")
    else:
        items = items.withColumn("before", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("size", "bucket").orderBy(*order)) - 1 + F.coalesce("before", F.lit(0))
    seg = np.array(plan.segments, dtype=np.int64).reshape(-1, 5)
    ends = np.array(plan.bins, dtype=np.int64).reshape(-1, 4)
    shared = pieces.sparkSession.sparkContext.broadcast((seg, ends))

    @F.pandas_udf("struct<bin long, bin_offset int, bin_size int>")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seg, ends = shared.value
        length = size.fillna(0).to_numpy(dtype=np.int64)
        rank = rank.to_numpy(dtype=np.int64)
        real = length > 0
        out = pd.DataFrame({"bin": pd.array([None] * len(length), dtype="Int64"), "bin_offset": pd.array([None] * len(length), dtype="Int32"), "bin_size": pd.array([None] * len(length), dtype="Int32")})
        if real.any():
            step = int(seg[:, 1].max()) + int(rank.max()) + 2
            at = np.searchsorted(seg[:, 0] * step + seg[:, 1], length[real] * step + rank[real], side="right") - 1
            within = rank[real] - seg[at, 1]
            bins = seg[at, 2] + within // seg[at, 3]
            out.loc[real, "bin"] = bins
            out.loc[real, "bin_offset"] = seg[at, 4] + within % seg[at, 3] * length[real]
            out.loc[real, "bin_size"] = ends[np.searchsorted(ends[:, 0], bins, side="right") - 1, 3]
        return out

    placed = items.withColumn("rank", rank).withColumn("place", place("size", "rank"))
    return placed.select(*pieces.columns, "place.bin", "place.bin_offset", "place.bin_size"), plan


def training_rows(records: DataFrame, vocab: DataFrame, capacities: Sequence[int] = (256, 512, 1024)) -> DataFrame:
    """The training row of each record: doc_id, chunk_idx, n_tokens, piece, n_pieces, size, bin, bin_offset, bin_size.

    A record is split only if it is longer than the largest capacity, the length of a training row; the smaller
    capacities are sizes to which a row may be cut down at the end.
    """
    pieces = split_records(records, vocab, max(capacities))
    return pack(pieces, ["doc_id", "chunk_idx", "piece"], capacities)[0]


def split_by_packing(rows: DataFrame) -> DataFrame:
    """doc_id, chunk_idx of the records of training_rows() that lie in more than one training row."""
    return rows.groupBy("doc_id", "chunk_idx").agg(F.min("bin").alias("first"), F.max("bin").alias("last")).where("first < last").select("doc_id", "chunk_idx")
