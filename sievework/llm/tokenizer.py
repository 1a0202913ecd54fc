"""Longest-piece tokenizer: exact token counts in vectorized batches, the vocabulary loaded once per worker.

Reading from the left, the longest piece that fits is one token; a character that starts no fitting piece is one
token per UTF-8 byte. A piece can reach across the border before a character only if that character stands inside
some piece, so a text falls apart into units (one character and the run of inner characters after it) that are
counted on their own. Units recur, and each worker remembers their counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Units whose counts a worker remembers at most; beyond that it starts anew.
MEMO_UNITS = 500_000
#: A vocabulary is a model file, not data: more pieces than this are refused rather than sent to every worker.
MAX_PIECES = 4_000_000


class PieceTokenizer:
    """Greedy longest-match tokenizer over a fixed set of pieces."""

    def __init__(self, pieces: Iterable[str], ids: Iterable[int] | None = None):
        pieces = [p for p in pieces]
        numbers = list(ids) if ids is not None else range(len(pieces))
        self.ids = {p: i for p, i in zip(pieces, numbers) if p}
        self.longest: dict[str, int] = {}
        inner: set[str] = set()
        for p in self.ids:
            self.longest[p[0]] = max(self.longest.get(p[0], 0), len(p))
            inner.update(p[1:])
        members = "".join(re.escape(c) for c in sorted(inner))
        self.unit = re.compile(f"(?s).[{members}]*" if members else "(?s).")
        self.memo = _Memo(self)

    def pieces_of(self, text: str) -> list[str | bytes]:
        """The tokens in order: a piece, or one byte of a character outside the vocabulary."""
        out: list[str | bytes] = []
        at, end, ids, longest = 0, len(text), self.ids, self.longest
        while at < end:
            for size in range(min(longest.get(text[at], 0), end - at), 0, -1):
                if text[at : at + size] in ids:
                    out.append(text[at : at + size])
                    at += size
                    break
            else:
                raw = text[at].encode("utf-8", "surrogatepass")
                out.extend(raw[i : i + 1] for i in range(len(raw)))
                at += 1
        return out

    def encode(self, text: str) -> list[int]:
        """Token ids; bytes count from -1 downwards (-1 - value), as the vocabulary gives them no id."""
        return [self.ids[p] if isinstance(p, str) else -1 - p[0] for p in self.pieces_of(text)]

    def count(self, text: str | None) -> int:
        """Number of tokens; a null text has none."""
        if not text:
            return 0
        return sum(map(self.memo.__getitem__, self.unit.findall(text)))


class _Memo(dict):
    """Counts by unit."""

    def __init__(self, tokenizer: PieceTokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, unit: str) -> int:
        if len(self) >= MEMO_UNITS:
            self.clear()
        n = len(self.tokenizer.pieces_of(unit))
        if len(unit) <= 64:
            self[unit] = n
        return n


_loaded: dict[int, PieceTokenizer] = {}


def _tokenizer(handle) -> PieceTokenizer:
    """The worker's tokenizer, built at its first batch."""
    if handle.id not in _loaded:
        _loaded[handle.id] = PieceTokenizer(*handle.value)
    return _loaded[handle.id]


class _Handle:
    """A broadcast vocabulary that knows its own key."""

    def __init__(self, spark: SparkSession, vocab: tuple[list[str], list[int]]):
        self.id = hash((tuple(vocab[0]), tuple(vocab[1])))
        self.shared = spark.sparkContext.broadcast(vocab)

    @property
    def value(self):
        return self.shared.value


def token_counter(vocab: DataFrame):
    """A function from a text column to its exact token count under the vocabulary (token_id, piece).

    Null pieces are left out; of a piece listed twice the least id counts.
    """
    spark = vocab.sparkSession
    rows = vocab.where("piece is not null and piece <> ''").groupBy("piece").agg(F.min("token_id").alias("id")).limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"a vocabulary of more than {MAX_PIECES} pieces")
    rows.sort(key=lambda r: (r.id is None, r.id or 0, r.piece))
    handle = _Handle(spark, ([r.piece for r in rows], [-1 if r.id is None else r.id for r in rows]))

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        count = _tokenizer(handle).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    def of(text: str | Column) -> Column:
        return n_tokens(F.col(text) if isinstance(text, str) else text)

    return of
