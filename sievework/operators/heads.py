"""Logistic heads on hashed grams, cross-validated, in little memory.

Spark's own learner keeps every feature vector as a block of doubles, fold by fold; of grams that is some fifty times
the text. Here a text's slots are written once, as the bytes between sorted slots, and every pass over them serves all
folds: a task holds one batch of texts, the weights and the gradients. Objective, scaling and search are the learner's.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

#: Texts that are cut at once, bytes of packed slots that are unpacked at once, and the most tasks of a pass (each makes gradients of its own).
BLOCK, BYTES, PARTS = 512, 1 << 20, 24
_U = np.uint32


def slots_of(values: np.ndarray, dim: int) -> np.ndarray:
    """The slot of each 64-bit number, by Murmur3 with seed 42, as HashingTF has it."""
    v = values.astype(np.int64).view(np.uint64)
    h = np.full(len(v), 42, dtype=_U)
    turn = lambda x, k: (x << _U(k)) | (x >> _U(32 - k))
    for part in ((v & np.uint64(0xFFFFFFFF)).astype(_U), (v >> np.uint64(32)).astype(_U)):
        h = turn(h ^ (turn(part * _U(0xCC9E2D51), 15) * _U(0x1B873593)), 13) * _U(5) + _U(0xE6546B64)
    h ^= _U(8)
    h = (h ^ (h >> _U(16))) * _U(0x85EBCA6B)
    h = (h ^ (h >> _U(13))) * _U(0xC2B2AE35)
    return (h ^ (h >> _U(16))).view(np.int32).astype(np.int64) % dim


def packed(slots: np.ndarray) -> bytes:
    """Sorted slots as gaps of one byte; 255 stands for 255 more."""
    gap = np.diff(slots, prepend=0)
    more = gap // 255
    out = np.full(len(gap) + int(more.sum()), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = gap % 255
    return out.tobytes()


def unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All slots of an array of packed() lists, and each list's number of slots."""
    ends = np.frombuffer(lists.buffers()[1], dtype=np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    raw = np.frombuffer(lists.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    at, last = np.cumsum(raw, dtype=np.int64), raw != 255
    known = np.append(0, np.cumsum(last))[ends]
    base = np.append(0, at)[ends[:-1]]
    n = np.diff(known)
    return at[last] - np.repeat(base, n), n


def gram_slots(df: DataFrame, text: str, grams: Callable[[str | None], np.ndarray], dim: int, binary: bool) -> DataFrame:
    """df with slots, times, norm: the slots of a text's grams (packed), their counts (16 bits each; null: 1 each), and the length of that vector."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                rows = []
                for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                    slots, n = np.unique(slots_of(grams(t), dim), return_counts=True)
                    many = len(n) and n.max() > 65_535
                    if many and not binary:
                        raise ValueError("a gram occurs more than 65,535 times in one text")
                    rows.append((packed(slots), None if binary else n.astype("<u2").tobytes(), float(np.sqrt(len(n) if binary else (n.astype(np.float64) ** 2).sum()))))
                slots, times, norm = zip(*rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slots, pa.binary()), pa.array(times, pa.binary()), pa.array(norm, pa.float64())], [*batch.schema.names, "slots", "times", "norm"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(cut, f"{kinds}, slots binary, times binary, norm double")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows with all their slots, the values there, and the number of each row's slots."""
    for whole in batches:
        size = np.cumsum(pc.binary_length(whole.column(whole.schema.get_field_index("slots"))).to_numpy(zero_copy_only=False))
        edges = [0]
        while edges[-1] < whole.num_rows:
            done = size[edges[-1] - 1] if edges[-1] else 0
            edges.append(max(edges[-1] + 1, int(np.searchsorted(size, done + BYTES, side="right"))))
        for start, end in zip(edges, edges[1:]):
            batch = whole.slice(start, end - start)
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            slots, n = unpacked(column("slots"))
            value = np.repeat(1 / np.maximum(column("norm").to_numpy(), 1e-300), n)
            if not column("times").null_count:
                value = value * np.frombuffer(b"".join(column("times").to_pylist()), dtype="<u2")
            yield batch, slots, value, n


def _margins(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray, value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The margin of each row under each head."""
    out = np.repeat(bias[:, None], len(n), axis=1)
    full = n > 0
    starts = (np.cumsum(n) - n)[full]
    if len(starts):
        for k, w in enumerate(weights):
            out[k, full] += np.add.reduceat(w[slots] * value, starts)
    return out


def _summed(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of an array that each of a few tasks makes of its rows; the driver reads them one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([task(batches).tobytes()], pa.binary())], ["x"])

    parts = min(PARTS, rows.sparkSession.sparkContext.defaultParallelism)
    each, out = materialize(rows.coalesce(parts).mapInArrow(run, "x binary"), "sums"), np.zeros(1)
    for r in each.toLocalIterator():
        out = out + np.frombuffer(r.x, dtype=np.float64)
    discard(each)
    return out


def minimised(x: np.ndarray, steps: int, memory: int = 10, tolerance: float = 1e-6) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS (past steps in single precision) with a line search of the strong Wolfe conditions: yields points, is sent value and gradient there, returns the best point."""
    f, g = yield x
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(steps):
        d, kept = -g, []
        for s, y in reversed(past):
            kept.append(a := (s @ d) / float(s @ y))
            d -= a * y
        if past:
            s, y = past[-1]
            d *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(past, reversed(kept)):
            d += s * (a - (y @ d) / float(s @ y))
        slope = g @ d
        if not slope < 0:
            break
        low, high = (0.0, f, slope), None  # the best end so far and the other end: step, value, slope
        t, found = 1.0 if step else 1 / np.linalg.norm(d), None
        for _ in range(20):
            ft, gt = yield x + t * d
            st = gt @ d
            if ft <= f + 1e-4 * t * slope and (found is None or ft < found[1]):
                found = (t, ft, gt)
            if ft > f + 1e-4 * t * slope or ft >= low[1] and low[0]:
                high = (t, ft, st)
            elif abs(st) <= 0.9 * abs(slope):
                found = (t, ft, gt)
                break
            else:
                if st * ((high[0] if high else np.inf) - low[0]) >= 0:
                    high = low
                low = (t, ft, st)
            t = t * 4 if high is None else (low[0] + high[0]) / 2
        if found is None:
            break
        t, ft, gt = found
        new = x + t * d
        if (new - x) @ (gt - g) > 0:
            past = [*past[1 - memory :], ((new - x).astype(np.float32), (gt - g).astype(np.float32))]
        done = abs(f - ft) <= tolerance * max(abs(f), abs(ft), 1e-6) or np.linalg.norm(gt) <= tolerance
        x, f, g = new, ft, gt
        if done:
            break
    return x


def cross_validated(df: DataFrame, key: Sequence[str], dim: int, folds: int = 5, steps: int = 10, penalty: float = 1e-4) -> DataFrame:
    """df (key, slots, times, norm, label 0 or 1) with score, each row's by a logistic head fitted on the other folds.

    Folds go by a hash of the key, so rows of one key stay together. A fold's head needs both labels on the other side;
    without them its rows score 0. The result rests on a written table.
    """
    spark = df.sparkSession
    rows = materialize(df.withColumn("_fold", F.pmod(F.xxhash64(*key), F.lit(folds)).cast("int")), "slots")
    have = {(r["_fold"], r["label"]): r["count"] for r in rows.groupBy("_fold", "label").count().collect()}
    if any(y not in (0, 1) for _, y in have):
        raise ValueError("labels are 0 or 1")
    total = {k: sum(n for (f, _), n in have.items() if f != k) for k in range(folds)}
    good = {k: sum(n for (f, y), n in have.items() if f != k and y) for k in range(folds)}
    fits = [k for k in range(folds) if 0 < good[k] < total[k]]
    weights, bias = np.zeros((folds, dim)), np.zeros(folds)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, folds, dim))
        for batch, slots, value, n in _blocks(batches):
            fold = np.repeat(batch.column(batch.schema.get_field_index("_fold")).to_numpy(), n)
            for k in range(folds):
                own = fold == k
                out[0, k] += np.bincount(slots[own], value[own], dim)
                out[1, k] += np.bincount(slots[own], value[own] ** 2, dim)
        return out

    def gradients(shared, on: list[int]) -> Callable[[Iterator[pa.RecordBatch]], np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            w, b = shared.value
            out = np.zeros((len(on), dim + 2))
            for batch, slots, value, n in _blocks(batches):
                y, fold = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("label", "_fold"))
                for k, m in enumerate(_margins(w, b, slots, value, n)):
                    m, others = np.where(y == 1, m, -m), fold != on[k]
                    out[k, dim + 1] += np.logaddexp(0, -m)[others].sum()
                    off = np.where(others, np.where(y == 1, -1.0, 1.0) * np.exp(-np.logaddexp(0, m)), 0.0)
                    out[k, dim] += off.sum()
                    out[k, :dim] += np.bincount(slots, value * np.repeat(off, n), dim)
            return out

        return run

    if fits:
        small = rows.select("slots", "times", "norm", "label", "_fold")
        m = _summed(small, moments).reshape(2, folds, dim)
        total_m = m.sum(axis=1)
        scale, mean, states, points = {}, {}, {}, {}
        for k in fits:
            n = total[k]
            first, second = (total_m[i] - m[i, k] for i in (0, 1))
            std = np.sqrt(np.maximum((second - first**2 / n) / max(n - 1, 1), 0))
            scale[k] = np.divide(1, std, out=np.zeros(dim), where=std > 1e-12)
            mean[k] = first / n * scale[k]
            start = np.zeros(dim + 1)
            start[dim] = np.log(good[k] / (n - good[k]))
            states[k] = minimised(start, steps)
            points[k] = next(states[k])
        del m, total_m
        while points:
            on = list(points)
            w = np.stack([points[k][:dim] * scale[k] for k in on])
            b = np.array([points[k][dim] - points[k][:dim] @ mean[k] for k in on])
            shared = spark.sparkContext.broadcast((w, b))
            sums = _summed(small, gradients(shared, on)).reshape(len(on), dim + 2)
            shared.destroy()
            for k, s, own in zip(on, sums, w):
                g = np.append((s[:dim] * scale[k] - s[dim] * mean[k]) / total[k] + penalty * own * scale[k], s[dim] / total[k])
                try:
                    points[k] = states[k].send((s[dim + 1] / total[k] + penalty / 2 * (own @ own), g))
                except StopIteration as end:
                    x = end.value
                    weights[k], bias[k] = x[:dim] * scale[k], x[dim] - x[:dim] @ mean[k]
                    del points[k]

    shared = spark.sparkContext.broadcast((weights, bias))
    names = [c for c in df.columns if c not in ("slots", "times", "norm")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch, slots, value, n in _blocks(batches):
            fold = batch.column(batch.schema.get_field_index("_fold")).to_numpy()
            s = np.choose(fold, _margins(w, b, slots, value, n)) if folds <= 32 else _margins(w, b, slots, value, n)[fold, np.arange(len(fold))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(s)], [*names, "score"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    out = materialize(rows.mapInArrow(scored, f"{kinds}, score double"), "scored")
    discard(rows)
    shared.destroy()
    return out
