"""Problem 6: evaluation texts leaking into training text, by Wu-Manber multi-pattern search.

Texts are folded (NFKC, lower case, letters and digits only). A text that shares a run of `need` characters with an
item holds one of the item's aligned pieces: pieces of need - step + 1 characters, one every step. These pieces are
the patterns. The search runs over many stretches of text at once (lanes): at each lane's place the last block of
characters gives a shift from the table; most blocks are in no pattern and skip the whole pattern length. At shift 0
the bucket of that suffix block names the patterns to compare, and an occurrence is extended to both sides against
the item itself, so a hit is a confirmed run of at least `need` equal characters.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DROP = re.compile(r"[\W_]+")
#: Characters per lane; longer texts are cut into overlapping lanes.
LANE = 2048
#: Item characters per search; more items are searched in several passes over the corpus.
PASS_CHARS = 20_000_000


def fold(text: str) -> str:
    """NFKC, lower case, letters and digits only."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _DROP.sub("", text.lower())


def needed(lang: str | None) -> int:
    """Shared characters that make a leak: 25 for a Chinese item, else 50."""
    return 25 if (lang or "").strip().lower().startswith("zh") else 50


class WuManber:
    """All items that need the same number of characters.

    items: (name, folded text). An item shorter than `need` cannot leak.
    """

    def __init__(self, items: Iterable[tuple[str, str]], need: int):
        self.need = need
        self.size = need - need // 2 + (need % 2 == 0)  # pattern length; with the step below every run holds one
        self.step = need - self.size + 1
        self.items = [(name, text) for name, text in items if len(text) >= need]
        codes = [np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) for _, text in self.items]
        rows, owner, start = [], [], []
        for i, code in enumerate(codes):
            for at in range(0, len(code) - self.size + 1, self.step):
                rows.append(code[at : at + self.size])
                owner.append(i)
                start.append(at)
        self.owner, self.start = np.array(owner, dtype=np.int64), np.array(start, dtype=np.int64)
        self.patterns = np.array(rows, dtype=np.uint32).reshape(-1, self.size)
        # the more blocks the patterns hold, the longer a block and the larger the table, so that most blocks of text are in no pattern
        blocks = max(1, len(self.patterns) * self.size)
        self.block = block = min(self.size, max(4, math.ceil(math.log(2 * blocks, 26))))
        self.bits = min(26, max(16, math.ceil(math.log2(4 * blocks))))
        self.shift = np.full(1 << self.bits, self.size - block + 1, dtype=np.int16)
        if len(self.patterns):
            for end in range(block, self.size + 1):
                h = self._hash(self.patterns[:, end - block : end])
                np.minimum.at(self.shift, h, self.size - end)
            suffix = self._hash(self.patterns[:, self.size - block :])
            order = np.argsort(suffix, kind="stable")
            self.order, self.suffix = order, suffix[order]

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        h = np.zeros(len(blocks), dtype=np.uint64)
        for j in range(self.block):
            h = h * np.uint64(0x9E3779B1) + blocks[:, j].astype(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, texts: list[str]) -> set[tuple[int, int]]:
        """(text number, item number) of each leak."""
        found: set[tuple[int, int]] = set()
        if not len(self.patterns):
            return found
        kept = [(i, t) for i, t in enumerate(texts) if len(t) >= self.need]
        if not kept:
            return found
        whole = np.frombuffer("".join(t for _, t in kept).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lens = np.array([len(t) for _, t in kept], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(lens)[:-1]])
        lanes = np.maximum(1, -(-(lens - self.size + 1) // LANE))
        doc = np.repeat(np.arange(len(kept)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first = begins[doc] + nth * LANE
        at = first + self.size  # the place after the window's last character
        stop = np.minimum(first + LANE + self.size - 1, begins[doc] + lens[doc])
        hash_of, shift_of = self._hash, self.shift
        window = np.arange(-self.block, 0)
        while len(at):
            h = hash_of(whole[at[:, None] + window])
            shift = shift_of[h].astype(np.int64)
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                self._confirm(kept, begins, whole, at[hit], doc[hit], h[hit], found)
            at = at + np.maximum(shift, 1)
            live = at <= stop
            at, stop, doc = at[live], stop[live], doc[live]
        return found

    def _confirm(self, kept, begins, whole, at, doc, h, found) -> None:
        lo, hi = np.searchsorted(self.suffix, h, side="left"), np.searchsorted(self.suffix, h, side="right")
        n = hi - lo
        which = np.repeat(np.arange(len(at)), n)
        cand = self.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        for part in range(0, len(which), 100_000):
            w, c = which[part : part + 100_000], cand[part : part + 100_000]
            same = (whole[at[w][:, None] + np.arange(-self.size, 0)] == self.patterns[c]).all(axis=1)
            for k, p in zip(w[same], c[same]):
                d, i = int(doc[k]), int(self.owner[p])
                if (kept[d][0], i) in found:
                    continue
                text, item = kept[d][1], self.items[i][1]
                t0, i0 = int(at[k] - begins[d]) - self.size, int(self.start[p])
                left = 0
                while left < min(t0, i0) and text[t0 - left - 1] == item[i0 - left - 1]:
                    left += 1
                right = self.size
                most = min(len(text) - t0, len(item) - i0)
                while right < most and text[t0 + right] == item[i0 + right]:
                    right += 1
                if left + right >= self.need:
                    found.add((kept[d][0], i))


_searchers: dict[int, list[WuManber]] = {}


def _machines(key: int, items: list[tuple[str, str, int]]) -> list[WuManber]:
    """The worker's tables, built at its first batch."""
    if key not in _searchers:
        _searchers.clear()
        _searchers[key] = [WuManber([(n, t) for n, t, k in items if k == need], need) for need in sorted({k for _, _, k in items})]
    return _searchers[key]


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Each document and item that share a run of 50 (Chinese items: 25) folded characters: doc_id, item_id.

    Null texts and prompts, and prompts shorter than the run, match nothing. A document that is listed twice, or an
    item listed twice, gives one row. The corpus is read where it lies; nothing of it is shuffled but the hits. Items
    come to the driver in passes of PASS_CHARS characters, so their number is not limited.
    """
    spark = documents.sparkSession
    prompts = items.where("prompt is not null and item_id is not null").select("item_id", "lang", "prompt").distinct()
    size = prompts.agg(F.sum(F.length("prompt")).alias("n")).first()["n"] or 0
    passes = max(1, -(-size // PASS_CHARS))
    hits = None
    for k in range(passes):
        block = prompts if passes == 1 else prompts.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        rows = sorted({(r.item_id, fold(r.prompt), needed(r.lang)) for r in block.collect()})
        one = _search(documents, spark.sparkContext.broadcast(rows), hash(tuple(rows)))
        hits = one if hits is None else hits.unionByName(one)
    return hits.distinct()


def _search(documents: DataFrame, shared, key: int) -> DataFrame:
    kind = documents.schema["doc_id"].dataType

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [fold(t) for t in rows["text"]]
            ids = rows["doc_id"].to_numpy()
            out = [(ids[d], m.items[i][0]) for m in _machines(key, shared.value) for d, i in sorted(m.search(texts))]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return documents.where("text is not null and doc_id is not null").select("doc_id", "text").mapInPandas(scan, f"doc_id {kind.simpleString()}, item_id string")
