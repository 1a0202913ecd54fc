"""Problem 1: near-duplicate records, by one-permutation hashing with optimal densification.

1. Each text becomes the set of its runs of three words. One hash per run fills BANDS * ROWS bins with their minimum;
   an empty bin copies the value of a bin drawn for it by a fixed series of draws (optimal densification).
2. ROWS bins each make a band's key. Within a bucket every text is tied to the one with the least key only, a star, so
   a bucket of m texts gives m - 1 candidate edges. Buckets are found by a range sort, so a hot one is many tasks' work.
3. A sketch of one bit per bin drops edges between texts that merely share stock phrases.
4. The components of what is left are small groups; within each, all pairs are compared exactly, which also finds
   pairs that no bucket holds. The texts of components beyond GROUP are joined by an exact prefix filter instead, so no
   pair is left out, no task gets an unbounded group, and no work grows with the square of a component.
Texts with the same runs are one class from the start. Pairs between classes are expanded to documents as long as
both classes have at most COPIES documents; of a larger class the first document stands for the others, to which it
is paired.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import similar
from ..operators.components import connected_components
from ..operators.ordered import stars
from ..session import materialize, temporary

WORDS = 3
SIMILAR = 0.6
BANDS, ROWS = 64, 6
#: Sketch bits that may differ: texts of similarity 0.6 agree in 205 +- 6.4 of 256, unrelated ones in 140 +- 8.
SKETCH, DIFFER = 256, 80
GROUP = 512
COPIES = 32

_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_U = np.uint64


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of three words, in order, repeats included."""
    words = [_WORD.findall(t.lower()) for t in texts]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.fromiter(map(_words.__getitem__, itertools.chain.from_iterable(words)), dtype=np.uint64, count=int(n.sum()))
    doc = np.repeat(np.arange(len(texts)), n)
    if len(flat) < WORDS:
        return doc[:0], flat[:0]
    h = flat[:-2] * _U(0x9E3779B97F4A7C15) + (flat[1:-1] ^ (flat[1:-1] >> _U(29))) * _U(0xBF58476D1CE4E5B9) + (flat[2:] ^ (flat[2:] >> _U(31))) * _U(0x94D049BB133111EB)
    inside = doc[2:] == doc[:-2]
    return doc[:-2][inside], _mix(h[inside])


def class_keys(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """One key per text from its runs in any order; texts of the same runs have the same key."""
    key = np.zeros(n, dtype=np.uint64)
    np.add.at(key, doc, _mix(h ^ _U(0x5851F42D4C957F2D)))
    return key


def signatures(doc: np.ndarray, h: np.ndarray, n: int, bins: int = BANDS * ROWS) -> np.ndarray:
    """One-permutation minima [texts, bins]; every text needs at least one run."""
    empty = _U(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * bins, empty, dtype=np.uint64)
    at = ((h >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
    np.minimum.at(sig, doc * bins + at, h)
    sig = sig.reshape(n, bins)
    drawn = sig.copy()
    holes = np.argwhere(sig == empty)
    turn = 0
    while len(holes):
        if turn < 200:
            source = (_mix(holes[:, 1].astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U((turn + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) % _U(bins)).astype(np.int64)
        else:  # a text of very few runs: walk on from the bin
            source = (holes[:, 1] + turn - 199) % bins
        value = sig[holes[:, 0], source]
        full = value != empty
        drawn[holes[full, 0], holes[full, 1]] = value[full]
        holes = holes[~full]
        turn += 1
    return drawn


def band_keys(sig: np.ndarray) -> np.ndarray:
    """[texts, BANDS] keys; the band's number is part of the key."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def sketches(sig: np.ndarray) -> np.ndarray:
    """[texts, SKETCH / 64] words of one bit per bin."""
    bits = (_mix(sig[:, :SKETCH] + _U(0x2545F4914F6CDD1D)) >> _U(63)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


def _signed(batches: Iterator[pa.RecordBatch], texts_at: str = "text"):
    """Per batch: the batch, the numbers of its texts that have runs, their class keys and signatures."""
    for batch in batches:
        texts = [t or "" for t in batch.column(texts_at).to_pylist()]
        doc, h = runs(texts)
        if len(doc):
            real, dense = np.unique(doc, return_inverse=True)
            yield batch, real, class_keys(dense, h, len(real)), signatures(dense, h, len(real))


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).reshape(-1).view(np.int64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, chunk_idx, rid, s0..s3, bands) of every record; a class that recurs in a task has its bands once."""
    seen: set[int] = set()
    for batch, real, rid, sig in _signed(batches):
        fresh = np.zeros(len(rid), dtype=bool)
        fresh[np.unique(rid, return_index=True)[1]] = True
        fresh &= np.fromiter((r not in seen for r in rid.tolist()), dtype=bool, count=len(rid))
        if len(seen) < 2_000_000:
            seen.update(rid[fresh].tolist())
        s, rows = sketches(sig), pa.array(real)
        ends = np.concatenate([[0], np.cumsum(np.where(fresh, BANDS, 0))]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), _long(band_keys(sig[fresh])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), batch.column("chunk_idx").take(rows), _long(rid), *(_long(s[:, j]) for j in range(s.shape[1])), bands],
            ["doc_id", "chunk_idx", "rid", "s0", "s1", "s2", "s3", "bands"],
        )


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact pairs within groups; rows come sorted by group, and a group may span batches."""
    rest: pd.DataFrame | None = None
    for rows in itertools.chain(batches, [None]):
        if rows is None:
            done, rest = rest, None
        else:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            rows = rows.drop_duplicates(ignore_index=True)  # a record delivered very often is one text
            if not len(rows):
                continue
            last = rows["comp"] == rows["comp"].iloc[-1]
            done, rest = rows[~last], rows[last]
        if done is not None and len(done):
            yield _pairs(done.reset_index(drop=True))


def _pairs(rows: pd.DataFrame) -> pd.DataFrame:
    doc, h = runs(rows["text"].tolist())
    n = len(rows)
    keys = class_keys(doc, h, n).view(np.int64)
    cut = np.searchsorted(doc, np.arange(n + 1))
    true = keys == rows["rid"].to_numpy()
    out_a, out_b, out_s = [], [], []
    for at in rows.groupby("comp", sort=False).indices.values():
        sets: dict[int, set[int]] = {}
        for k in at:
            if true[k] and keys[k] not in sets:
                sets[keys[k]] = set(h[cut[k] : cut[k + 1]].tolist())
        for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
            small, large = (len(x), len(y)) if len(x) < len(y) else (len(y), len(x))
            if small >= SIMILAR * large:
                both = len(x & y)
                if both >= SIMILAR * (small + large - both) - 1e-9:
                    out_a.append(a)
                    out_b.append(b)
                    out_s.append(both / (small + large - both))
    return pd.DataFrame({"a": np.array(out_a, dtype=np.int64), "b": np.array(out_b, dtype=np.int64), "similarity": np.array(out_s, dtype=float)})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, h: the set of runs of each text whose class is the one asked for."""
    for batch in batches:
        doc, h = runs([t or "" for t in batch.column("text").to_pylist()])
        keys = class_keys(doc, h, batch.num_rows).view(np.int64)
        by = np.lexsort((h, doc))
        doc, h = doc[by], h[by]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
        real = keys == batch.column("rid").to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(keys), lists], ["id", "h"]).filter(pa.array(real))


class NearDuplicates:
    """Pairs of classes of similarity SIMILAR or more, and the documents of each class.

    records: doc_id, chunk_idx, text; other columns don't matter. Records without doc_id, with a null text or of fewer
    than three words are similar to nothing. A record delivered twice is one record.
    """

    def __init__(self, records: DataFrame):
        usable = records.where("doc_id is not null and text is not null").select("doc_id", F.coalesce("chunk_idx", F.lit(-1)).cast("int").alias("chunk_idx"), "text")
        self.signed = materialize(usable.mapInArrow(_sign, "doc_id string, chunk_idx int, rid long, s0 long, s1 long, s2 long, s3 long, bands array<long>"), "signed")
        with temporary() as keep:
            bands = self.signed.select("rid", F.explode("bands").alias("key"))
            tied = stars(bands, "key", "rid").withColumnRenamed("member", "rid")
            bits = self.signed.groupBy("rid").agg(*(F.first(f"s{j}").alias(f"s{j}") for j in range(4)))
            left, right = bits, bits.select(F.col("rid").alias("hub"), *(F.col(f"s{j}").alias(f"t{j}") for j in range(4)))
            differ = sum((F.bit_count(F.col(f"s{j}").bitwiseXOR(F.col(f"t{j}"))) for j in range(1, 4)), F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))))
            edges = tied.join(left, "rid").join(right, "hub").where(differ <= DIFFER).select(F.col("hub").alias("u"), F.col("rid").alias("v"))
            self.pairs = keep(materialize(self._verified(usable, connected_components(edges)), "pairs"))

    def _verified(self, usable: DataFrame, groups: DataFrame) -> DataFrame:
        """a, b, similarity of the similar classes (a < b).

        A component of up to GROUP classes is one task's group, compared in all pairs. Larger ones are joined exactly by
        prefix filtering, whose work follows the texts that share rare runs and not the square of a component.
        """
        sized = materialize(groups.groupBy("component").agg(F.count("*").alias("n")), "sizes")
        one = self.signed.groupBy("rid").agg(F.min(F.struct("doc_id", "chunk_idx")).alias("at"))
        wanted = groups.join(sized, "component").select(F.col("node").alias("rid"), F.col("component").alias("comp"), (F.col("n") > GROUP).alias("large")).join(one, "rid")
        texts = usable.join(wanted.select("at.doc_id", "at.chunk_idx", "rid", "comp", "large"), ["doc_id", "chunk_idx"])
        few = texts.where("not large").select("comp", "rid", "text").repartition("comp").sortWithinPartitions("comp").mapInPandas(_compare, "a long, b long, similarity double")
        if sized.where(F.col("n") > GROUP).isEmpty():
            return few.distinct()
        sets = materialize(texts.where("large").select("rid", "text").mapInArrow(_sets, "id long, h array<long>").dropDuplicates(["id"]), "sets")
        order = similar.frequent(similar.sample(sets).select(F.explode("h").alias("h")))
        met = materialize(similar.meeting(similar.keyed(sets, order, SIMILAR), SIMILAR), "meeting")
        many = similar.exact(met, sets, SIMILAR).select("a", "b", F.col("jaccard").alias("similarity"))
        return few.unionByName(many).distinct()

    def classes(self) -> DataFrame:
        """rid, n, first, members: the documents of each class, listed up to COPIES, else only the first."""
        docs = self.signed.select("rid", "doc_id").distinct()
        sized = docs.groupBy("rid").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
        few = docs.join(sized.where(f"n > 1 and n <= {COPIES}").select("rid"), "rid").groupBy("rid").agg(F.sort_array(F.collect_list("doc_id")).alias("members"))
        return sized.join(few, "rid", "left").select("rid", "n", "first", F.coalesce("members", F.array("first")).alias("members"))

    def _listed(self, classes: DataFrame) -> DataFrame:
        """x, y (in some order) of every two documents of one class or of similar classes, as far as `members` lists them."""
        within = classes.where("size(members) > 1").select(F.explode("members").alias("x"), "members").select("x", F.explode("members").alias("y"))
        a = classes.select(F.col("rid").alias("a"), F.col("members").alias("x"))
        b = classes.select(F.col("rid").alias("b"), F.col("members").alias("y"))
        across = self.pairs.select("a", "b").join(a, "a").join(b, "b").select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y"))
        return within.unionByName(across).where("x <> y")

    def document_pairs(self) -> DataFrame:
        """doc_id_a, doc_id_b (the smaller first) of every two documents with similar records."""
        classes = self.classes()
        docs = self.signed.select("rid", "doc_id").distinct()
        large = docs.join(classes.where(f"n > {COPIES}").select("rid", "first"), "rid").select(F.col("first").alias("x"), F.col("doc_id").alias("y")).where("x <> y")
        both = self._listed(classes).unionByName(large)
        return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()

    def groups(self) -> DataFrame:
        """One row per document that has a similar one: doc_id, group_id (its group's first document), n_links.

        n_links is the number of documents that are similar to it, also where document_pairs() gives a large class's
        pairs for its first document only: a class of more than COPIES documents counts with all of them, once for each
        record of the document that is similar to it.
        """
        classes = materialize(self.classes(), "classes")
        docs = self.signed.select("rid", "doc_id").distinct()
        one_way = self._listed(classes.where(f"n <= {COPIES}"))
        few = one_way.unionByName(one_way.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().groupBy(F.col("x").alias("doc_id")).agg(F.count("*").alias("links"))
        size = lambda r, n: classes.select(F.col("rid").alias(r), F.col("n").alias(n))
        met = self.pairs.select("a", "b").join(size("a", "na"), "a").join(size("b", "nb"), "b").where(f"na > {COPIES} or nb > {COPIES}")
        of_class = (
            met.select(F.col("a").alias("rid"), F.col("nb").alias("links")).unionByName(met.select(F.col("b").alias("rid"), F.col("na").alias("links")))
            .unionByName(classes.where(f"n > {COPIES}").select("rid", (F.col("n") - 1).alias("links"))).groupBy("rid").agg(F.sum("links").alias("links"))
        )
        links = few.unionByName(docs.join(of_class, "rid").select("doc_id", "links")).groupBy("doc_id").agg(F.sum("links").alias("n_links"))
        found = connected_components(self.document_pairs(), "doc_id_a", "doc_id_b").select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))
        return found.join(links, "doc_id").select("doc_id", "group_id", "n_links")
