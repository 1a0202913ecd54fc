"""Scalar text functions as Column expressions: normalisers, counters, n-grams, keys.

All of them map null to null unless said otherwise, work on code points, and take whole texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace knows it, as a class that Java's and RE2's syntax share.
SPACE = r"\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Patterns that must equal the reference's (fixed values).
SPECIAL = r"<\|[A-Za-z0-9_]+\|>"
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
BAD = r"[\x{fffd}\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]"
URL = r"https?://|www\.|[\w.-]+@[\w-]+\.\w+"
NOT_WORD = r"[^\p{L}\p{N}]+"
HOLDOUT_DROP = rf"[{SPACE}：:，,。.、？（）()]"
QA_PREFIX = rf"^[{SPACE}]*(?:<\|im_start\|>(?:user|assistant|system)[{SPACE}]*|问题?|答案?|Question|Answer|Q|A)[{SPACE}]*[：:]?[{SPACE}]*"
ANSWER_TAIL = rf"(?:<\|im_end\|>|\n[{SPACE}]*(?:答案?|Answer|A)[{SPACE}]*[：:])"
WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Words that the code normaliser keeps (fixed values).
CODE_WORDS = (
    "and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield True False None self cls int float str bool list "
    "dict set tuple range len min max sum abs print"
)


def _c(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, which a lambda inside f would not see to on its own."""
    return F.transform(F.array(value), f)[0]


def count_matches(text, pattern: str) -> Column:
    """Occurrences of a pattern."""
    return F.regexp_count(_c(text), F.lit(pattern))


def squash(text) -> Column:
    """Letters and numbers only."""
    return F.regexp_replace(_c(text), NOT_WORD, "")


def strip_space(text) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_c(text), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def strip_special(text) -> Column:
    """Control tokens <|x|> removed, ends trimmed."""
    return strip_space(F.regexp_replace(_c(text), SPECIAL, ""))


def collapse(text) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(text), rf"[{SPACE}]+", " "))


def skeleton(text) -> Column:
    """Lower-cased and collapsed."""
    return collapse(F.lower(_c(text)))


def holdout_norm(text) -> Column:
    """Without white space and the eleven punctuation marks that holdout keys ignore."""
    return F.regexp_replace(_c(text), HOLDOUT_DROP, "")


def holdout_key(text) -> Column:
    """First 16 hex digits of the sha1 of the holdout form (H1)."""
    return F.substring(F.sha1(holdout_norm(text)), 1, 16)


def exact_key(text) -> Column:
    """First 24 hex digits of the sha1 of the squashed text."""
    return F.substring(F.sha1(squash(text)), 1, 24)


def code_norm(text) -> Column:
    """Source without comments and strings, numbers as #, names as @ but for common words.

    Comments go first, so a comment mark inside a string cuts it, as in the reference.
    """
    t = F.regexp_replace(_c(text), r"(?s)#[^\n]*|/\*.*?\*/|//[^\n]*", " ")
    # possessive, since a choice repeated over a long literal overflows the stack
    t = F.regexp_replace(t, r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'""", " ")
    t = F.regexp_replace(t, r"\b\d[\d_.]*\b", "#")
    t = F.regexp_replace(t, rf"\b(?!(?:{'|'.join(CODE_WORDS.split())})\b)[a-zA-Z_]\w*\b", "@")
    return F.regexp_replace(t, r"\s+", " ")


def fold_chars(text, pairs: dict[str, str]) -> Column:
    """Characters replaced one for one by a table, such as traditional to simplified script."""
    return F.translate(_c(text), "".join(pairs), "".join(pairs.values()))


def bad_chars(text) -> Column:
    """Replacement and control characters."""
    return count_matches(text, BAD)


def question_body(text) -> Column:
    """The question of a question-answer text: up to the answer's mark, without a leading role."""
    head = F.split(_c(text), ANSWER_TAIL, 2).getItem(0)
    return strip_space(F.regexp_replace(head, QA_PREFIX, ""))


def last_segment(source, mark: str = "/") -> Column:
    """The part after the last mark of a source name."""
    return F.element_at(F.split(_c(source), re.escape(mark)), -1)


def length_band(text) -> Column:
    """xs, s, m, l, xl by length: below 400, 1200, 3000, 8000 characters, and above."""
    n = F.length(_c(text))
    return F.when(n < 400, "xs").when(n < 1200, "s").when(n < 3000, "m").when(n < 8000, "l").when(n >= 8000, "xl")


def clean_context(text) -> Column:
    """ANSI codes and command wrappers removed, at most two line ends in a row."""
    t = F.regexp_replace(_c(text), r"\x{1b}\[[0-9;]*[A-Za-z]", "")
    t = F.regexp_replace(t, r"</?(?:local-command|command)-[a-z]+>", "")
    return strip_space(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def _windows(parts: Column, n: int, mark: str, short: Column) -> Column:
    """The set of n neighbouring parts, joined; `short` for fewer parts. Linear in the number of parts."""
    return let(
        parts,
        lambda a: F.when(F.size(a) < n, short).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), mark)))
        ),
    )


def char_grams(text, n: int) -> Column:
    """The set of n-character windows; a shorter text is one window."""
    t = _c(text)
    return F.when(t.isNull(), F.lit(None)).otherwise(_windows(F.split(t, ""), n, "", F.array(t)))


def word_grams(words: Column, n: int) -> Column:
    """The set of n-word windows of an array, joined by spaces; fewer words give none."""
    return _windows(words, n, " ", F.array().cast("array<string>"))


def spaced_words(text) -> Column:
    """Words of the collapsed, lower-cased text, split at spaces; an empty text has none."""
    t = skeleton(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def bigram_set(text) -> Column:
    """Pairs of neighbouring Chinese characters if there are any, else of neighbouring [a-z0-9]+ words."""
    t = F.lower(_c(text))
    chars = F.regexp_extract_all(t, F.lit(r"[\x{4e00}-\x{9fff}]"), F.lit(0))
    words = F.regexp_extract_all(t, F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.when(F.size(chars) > 0, word_grams(chars, 2)).otherwise(word_grams(words, 2))


def host(url) -> Column:
    """Host and port of an address."""
    h = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)", 1)
    return F.when(h == "", F.lit(None)).otherwise(h)


def word_tokens(text) -> Column:
    """Words and single marks."""
    return F.regexp_extract_all(_c(text), F.lit(WORD), F.lit(0))


def head(text, n: int) -> Column:
    """The first n characters."""
    return F.substring(_c(text), 1, n)


def shares_span(a, b, n: int) -> Column:
    """Whether two texts share n characters in a row."""
    other = _c(b)
    return (F.length(_c(a)) >= n) & F.exists(char_grams(a, n), lambda g: F.contains(other, g))
