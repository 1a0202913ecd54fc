"""Scrubbing of identifiers and detection of secrets. Rules apply in order; a null text stays null."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Pattern and placeholder, longest paths first (P1; fixed values).
SCRUBS = (
    (r"/Users/[A-Za-z0-9._-]+", "<HOME>"), (r"/home/[A-Za-z0-9._-]+", "<HOME>"), (r"[A-Za-z]:\\Users\\[A-Za-z0-9._-]+", "<HOME>"),
    (r"(-Users-)[A-Za-z0-9._]+", "$1<USER>"), (r"(-home-)[A-Za-z0-9._]+", "$1<USER>"), (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<EMAIL>"),
)
#: Shape and entropy of an opaque token (fixed values).
TOKEN = r"[A-Za-z0-9_\-.]{32,}"
ENTROPY = 4.5
#: What stands left of a long token that is no secret: a path, an address, a digest's name, a data block.
HARMLESS = re.compile(r"(?:https?://\S*|[\w.-]*/[\w./-]*|\b(?:sha\d*|md5|commit|digest|hash|uuid|data:[\w/;,+-]*)\W{0,3})$", re.I)
CREDENTIAL = (
    ("flag", r"--(?:password|token|api[-_]?key|secret)[= ](\S+)"), ("env", r"\b[A-Z][A-Z0-9_]*(?:PASSWORD|TOKEN|API_?KEY|SECRET)\s*=\s*['\"]?(\S+)"), ("bearer", r"(?i)\bbearer\s+([A-Za-z0-9._~+/-]{8,}=*)"),
)
PLACEHOLDER = r"(?i)^(?:x+|\*+|\.+|your[-_ ]?.*|example.*|changeme|dummy|test|none|null|<.*>|\{.*\})$"
REFERENCE = r"\$[{(]?[A-Za-z_]|%[A-Za-z_][A-Za-z0-9_]*%|<[^>]{1,40}>"
KEYED = r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})\b"


def scrub(text, hosts: Sequence[str] = ()) -> Column:
    """Paths, project names, e-mail addresses and addresses on the named hosts replaced."""
    t = F.col(text) if isinstance(text, str) else text
    for pattern, by in SCRUBS:
        t = F.regexp_replace(t, pattern, by)
    if hosts:
        names = "|".join(re.escape(h) for h in hosts)
        t = F.regexp_replace(t, rf"https?://[A-Za-z0-9.-]*(?:{names})(?:/[^\s\"'>)\]}},]*)?", "<INTERNAL_DOC>")
        t = F.regexp_replace(t, rf"\b[A-Za-z0-9.-]*(?:{names})(?:/[^\s\"'>)\]}},]*)?", "<INTERNAL_DOC>")
    return t


def entropy(s: str) -> float:
    """Shannon entropy of a string's characters, in bits."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def spans(text: str | None) -> list[tuple[int, int]]:
    """Places of opaque tokens: 32 characters or more, high entropy, nothing harmless to their left."""
    if not text:
        return []
    return [m.span() for m in re.finditer(TOKEN, text) if entropy(m.group()) >= ENTROPY and not HARMLESS.search(text[max(0, m.start() - 80) : m.start()])]


_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(_SPANS)
def opaque_spans(text: pd.Series) -> pd.Series:
    """spans() of each text."""
    return text.map(lambda t: [{"start": a, "end": b} for a, b in spans(t)])


@F.pandas_udf(StringType())
def redact(text: pd.Series) -> pd.Series:
    """Opaque tokens replaced; a text with one of more than 200 characters is dropped to null."""

    def one(t):
        found = spans(t)
        if t is None or any(b - a > 200 for a, b in found):
            return None
        for a, b in reversed(found):
            t = t[:a] + "<OPAQUE>" + t[b:]
        return t

    return text.map(one)


def high_entropy_tokens(text: Column) -> Column:
    """Tokens of 32 characters or more and high entropy, without regard to context, JVM-side."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)))

    def h(s):
        n = F.length(s)
        return F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise((n - F.length(F.replace(s, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(s, c, F.lit("")))) / n)))

    return F.filter(found, lambda s: h(s) >= ENTROPY)


def credential_classes(text: Column) -> Column:
    """Which shapes of credential a text holds, placeholders and references apart (P5)."""
    hits = []
    for name, pattern in CREDENTIAL:
        values = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), lambda v: F.regexp_replace(v, r"[,;)\]}>`.'\"]+$", ""))
        hits.append(F.when(F.exists(values, lambda v: (F.length(v) >= 8) & ~v.rlike(PLACEHOLDER) & ~v.rlike(REFERENCE)), F.lit(name)))
    return F.array_compact(F.array(*hits))


def secret_report(df: DataFrame, group: str, text: str) -> DataFrame:
    """Per group: rows, and rows with an e-mail address, a home path, a keyed secret, an opaque token."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(t.rlike(SCRUBS[-1][0])).alias("emails"), F.count_if(t.rlike(r"/(?:Users|home)/[A-Za-z0-9._-]+")).alias("homes"), F.count_if(t.rlike(KEYED)).alias("keyed"), F.count_if(F.size(high_entropy_tokens(F.col(text))) > 0).alias("opaque")
    )


def residue(df: DataFrame, text: str) -> DataFrame:
    """One row: rows in which something that scrub removes is still there; zero after scrubbing."""
    t = F.coalesce(F.col(text), F.lit(""))
    any_ = F.lit(False)
    for pattern, by in SCRUBS:
        any_ = any_ | (F.regexp_replace(t, pattern, by) != t)
    return df.agg(F.count_if(any_).alias("residual"), F.count("*").alias("n"))
