"""Problem 8: missing or wrong language labels, by a bidirectional gated recurrent network over bytes.

The network is trained on a bounded sample of labelled rows, wrong labels included. It then labels every byte of
every sentence; a sentence's language is the pooled one, sentences of one line that don't clearly differ share the
line's, and a document's languages are those of its letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bigru import PAD, Network

LANGUAGES = ("en", "zh", "de", "fr", "es", "pt")
#: The training sample: labelled rows per language and windows per row, at most; bytes per window; training steps.
TRAIN_ROWS, TRAIN_WINDOWS, WINDOW, STEPS = 400, 64, 64, 600
#: Shares of training windows that are shorter, and in which the language changes (of the others); most invented words among the words of a line.
SHORT, MIXED, DENSE = 0.25, 0.5, 0.3
#: Share of a document's letters that makes a language one of its own.
SHARE = 0.2
#: Confidence below which a sentence takes one of the languages that are sure in its document.
SURE = 0.95
#: Log-odds that a change of language within a line must be worth.
APART = 8
#: Lead of the best language, a byte, below which a sentence is labelled byte by byte; bytes of a part of one, about.
LEAD, PART = 5.0, 20

# Codes and names of the six languages as they are written in labels (fixed values).
CODES = {
    "en": "en", "eng": "en", "english": "en", "zh": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "de": "de", "deu": "de", "ger": "de", "german": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "es": "es", "spa": "es", "spanish": "es", "pt": "pt", "por": "pt", "portuguese": "pt",
}

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_ADDRESS = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\w+|\$\$.*?\$\$|`[^`\n]*`", re.S)
_QUOTE = re.compile(r"[“„«»「『][^“”„«»」』\n]{1,240}[”“»«」』]")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|={2,}\s).*$", re.M)
_NOT_LETTER = re.compile(r"[\W\d_]+")
_EIGHT = re.compile(r"(?:[^\W\d_][\W\d_]*){8}")
#: What each byte of a text is: part of a letter, a gap, the end of a sentence, of a line, of a text.
_LETTER, _GAP, _END, _LINE, _TEXT = range(5)
_KIND = np.full(256, _GAP, np.uint8)
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[0x80:] = _LETTER
_KIND[[ord(c) for c in ".!?"]] = _END
_KIND[ord("\n")] = _LINE
_KIND[0] = _TEXT


def label_language(label: str | None) -> str | None:
    """The language a label names, or None for a missing one or another language."""
    return CODES.get(re.split(r"[-_\s]", (label or "").strip().lower())[0])


def prose(text: str) -> str:
    """The text without code, addresses, formulas, quotations and headings; with them, if nothing else is left."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    bare = _ADDRESS.sub(" ", _FENCE.sub("\n", text)) if "`" in text or "://" in text or "@" in text or "$" in text or "~" in text or "www" in text else text
    less = bare if bare.isascii() else _QUOTE.sub(" ", bare)
    if "#" in less or "==" in less:
        less = _HEADING.sub("", less)
    for t in (less, bare):
        if _EIGHT.search(t):
            return t
    return text


def _mark(raw: np.ndarray, kind: np.ndarray) -> None:
    """Gaps and ends of sentences among the characters beyond ASCII, by the first bytes of their blocks.

    General punctuation and symbols (E2), CJK punctuation (E3 80), full-width forms (EF BC, EF BD), Latin-1 marks (C2) and
    pictographs (F0 9F) are no letters; the full-width stop, exclamation and question marks end a sentence.
    """
    first = np.flatnonzero(raw >= 0xC2)
    lead, then = raw[first], raw[np.minimum(first + 1, len(raw) - 1)]
    for which, size in (
        (lead == 0xC2, 2), (lead == 0xE2, 3), ((lead == 0xE3) & (then == 0x80), 3), ((lead == 0xEF) & ((then == 0xBC) | (then == 0xBD)), 3), ((lead == 0xF0) & (then == 0x9F), 4),
    ):
        at = first[which]
        for k in range(size):
            kind[at + k] = _GAP
        if size == 3 and len(at):
            last = raw[at + 2]
            kind[at[((raw[at] == 0xE3) & (last == 0x82)) | ((raw[at] == 0xEF) & (raw[at + 1] == 0xBC) & ((last == 0x81) | (last == 0x9F)))]] = _END


class Sentences:
    """The sentences of many texts, as ranges of one array of bytes that holds letters with single spaces.

    begin, lens: each sentence's range in flat; letters, line, text: its letters, and the numbers of its line and text.
    Stretches of fewer than 16 characters join their neighbour on the line.
    """

    def __init__(self, texts: list[str]):
        bodies = [prose(t).replace("\0", " ").lower() for t in texts]
        raw = np.frombuffer(("\0" + "\0".join(bodies)).encode("utf-8", "ignore"), dtype=np.uint8)
        kind = _KIND[raw]
        _mark(raw, kind)
        letter = kind == _LETTER
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1  # a text begins and ends outside of letters
        start, stop = edge[::2], edge[1::2] if len(edge) % 2 == 0 else np.append(edge[1::2], len(raw))
        keep = letter.copy()
        keep[start - 1] = True  # one gap before each run of letters
        flat = np.where(letter, raw, np.uint8(32))[keep]
        offset = np.cumsum(stop - start + 1) - (stop - start + 1)
        marks = np.flatnonzero(kind >= _END)
        unit, line, text = (np.searchsorted(marks[kind[marks] >= k], start) for k in (_END, _LINE, _TEXT))
        run = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else unit
        at, line, text = offset[run], line[run], text[run]
        chars = np.add.reduceat((flat & 0xC0) != 0x80, at, dtype=np.int64) if len(at) else at
        gaps = np.diff(np.append(run, len(start)))
        first = np.ones(len(at), dtype=bool)  # sentences that begin here; the others join the one before
        last_line, last_size = -1, 0
        for k, (own, size) in enumerate(zip(line.tolist(), chars.tolist())):
            if own == last_line and (size < 16 or last_size < 16):
                first[k] = False
                last_size += size
            else:
                last_line, last_size = own, size
        head = np.flatnonzero(first)
        self.flat, self.begin = flat, at[head]
        self.lens = np.diff(np.append(self.begin, len(flat)))
        self.letters = np.add.reduceat(chars - gaps, head) if len(head) else head
        self.line, self.text = line[head], text[head] - 1


def letters_of(sentence: str) -> str:
    """What the network reads: lower case, letters with single spaces."""
    return _NOT_LETTER.sub(" ", sentence).lower()


def nonsense(r: np.random.Generator) -> str:
    """An invented name of random syllables; such words belong to no language."""
    c = lambda: "bcdfghjklmnpqrstvwxyz"[r.integers(21)]
    v = lambda: "aeiouy"[r.integers(6)]
    syllable = lambda: (c() if r.random() < 0.8 else "") + (c() if r.random() < 0.3 else "") + v() + (c() if r.random() < 0.7 else "") + (c() if r.random() < 0.15 else "")
    return "".join(syllable() for _ in range(r.integers(2, 5)))


def training_windows(text: str, r: np.random.Generator, most: int = TRAIN_WINDOWS) -> list[np.ndarray]:
    """Windows [WINDOW] of a text's bytes, short ones filled up with PAD: all of them, or `most` spread over the whole text.

    A third of the texts loses its diacritics, as texts may; in half of the lines invented words take the place of
    some words or stand between them, so that they tell nothing about the language.
    """
    body = prose(text)
    if r.random() < 1 / 3:
        body = "".join(c for c in unicodedata.normalize("NFD", body) if not unicodedata.combining(c))
    out = []
    for line in body.split("\n"):
        words = letters_of(line).split()
        if r.random() < 0.5:
            often = r.random() * DENSE
            draw = r.random(len(words))
            words = [w if d > often else f"{w} {nonsense(r)}" if d > 0.4 * often else nonsense(r) for w, d in zip(words, draw)]
        raw = np.frombuffer((" " + " ".join(words)).encode("utf-8", "ignore"), dtype=np.uint8)
        for at in range(0, max(1, len(raw) - 6), WINDOW * 2):
            part = raw[at : at + (WINDOW if r.random() > SHORT else r.integers(6, WINDOW))]
            if len(part) >= 6:
                out.append(np.concatenate([part.astype(np.int16), np.full(WINDOW - len(part), PAD, np.int16)]))
    if len(out) > most:
        out = [out[k] for k in np.linspace(0, len(out) - 1, most).astype(int)]
    return out


def training_set(rows: list[tuple[str, str]], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows [n, WINDOW] and class numbers from (text, language)."""
    x, y = [], []
    for k, (text, lang) in enumerate(rows):
        own = training_windows(text, np.random.default_rng([seed, k]))
        x += own
        y += [LANGUAGES.index(lang)] * len(own)
    return np.array(x, dtype=np.intp).reshape(-1, WINDOW), np.array(y, dtype=np.intp)


def fit(documents: DataFrame, train_rows: int = TRAIN_ROWS, steps: int = STEPS) -> Network | None:
    """A network trained on at most train_rows labelled rows per language; None if there are no labelled rows.

    The rows are those of the least hash, found by counting the labels and reading the texts of a matching hash range
    only, so the sample is the same wherever the rows lie. Windows are made where the rows are, from whole texts; at
    most 6 * train_rows * TRAIN_WINDOWS windows come to the driver.
    """
    language = F.create_map(*(F.lit(v) for kv in CODES.items() for v in kv))
    named = F.element_at(language, F.regexp_extract(F.lower(F.trim("lang")), r"^[a-z]+", 0))
    labelled = documents.select("doc_id", "text", named.alias("own")).where("own is not null and text is not null")
    counts = {r["own"]: r["n"] for r in labelled.groupBy("own").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    scale = 1 << 30
    bound = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, int(min(scale, scale * 1.2 * train_rows / n + 1)))))
    near = labelled.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(scale))).where(F.col("at") < F.element_at(bound, F.col("own")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            own = [training_windows(t, np.random.default_rng([5, int(at)])) for t, at in zip(rows["text"], rows["at"])]
            yield pd.DataFrame({"own": rows["own"], "at": rows["at"], "windows": [np.array(w, dtype=np.int16).tobytes() for w in own]})

    rows = near.mapInPandas(cut, "own string, at long, windows binary").collect()
    x, y = [np.zeros((0, WINDOW), np.int16)], []
    for k, lang in enumerate(LANGUAGES):
        for r in sorted((r for r in rows if r["own"] == lang), key=lambda r: (r["at"], bytes(r["windows"])))[:train_rows]:
            x.append(np.frombuffer(bytes(r["windows"]), dtype=np.int16).reshape(-1, WINDOW))
            y += [k] * len(x[-1])
    return trained(np.concatenate(x).astype(np.intp), np.array(y, dtype=np.intp), steps)


def trained(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Network | None:
    """A network trained on windows x [n, WINDOW] of languages y [n], drawn so that all count alike; None if there are none.

    In a share MIXED of the windows the language changes somewhere, as it may within a sentence.
    """
    if not len(x):
        return None
    share = np.bincount(y, minlength=len(LANGUAGES))[y]
    r = np.random.default_rng(1)
    draw = lambda n: r.choice(len(x), size=n, p=(1 / share) / (1 / share).sum())
    even = draw(max(len(x), 4096))
    x, y, joined = x[even], np.repeat(y[even, None], WINDOW, axis=1), int(MIXED * len(even))
    head, tail, at = x[:joined], np.roll(x[:joined], 1, axis=0), r.integers(WINDOW // 4, 3 * WINDOW // 4, joined)
    ends = np.where((head == 32) | (head >= 0xC0), np.arange(WINDOW), 0)  # a change comes before a gap or a character
    at = np.where(np.arange(WINDOW) <= at[:, None], ends, 0).max(axis=1)[:, None]
    back = np.arange(WINDOW) - at
    mixed = np.where(back < 0, head, np.take_along_axis(tail, np.maximum(back, 0), axis=1))
    lang = np.where(back < 0, y[:joined], np.roll(y[:joined], 1, axis=0))
    net = Network(len(LANGUAGES))
    net.train(np.concatenate([x, mixed]), np.concatenate([y, lang]), steps)
    return net


def _best_path(score: np.ndarray, group: np.ndarray, cost: float) -> np.ndarray:
    """Per row the class on the best path through its group's rows, each change of class costing `cost`.

    score: [rows, classes], rows of one group in a row. All groups step side by side.
    """
    out = np.zeros(len(score), dtype=np.int64)
    if not len(score):
        return out
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(start, len(score)))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    best, back = score[start].copy(), []
    for t in range(1, size[0]):
        live = int((size > t).sum())
        top = best[:live].argmax(axis=1)
        change = best[np.arange(live), top][:, None] - cost
        stay = best[:live] >= change
        back.append(np.where(stay, np.arange(score.shape[1]), top[:, None]))
        best[:live] = np.where(stay, best[:live], change) + score[start[:live] + t]
    own = best.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        live = int((size > t).sum())
        out[start[:live] + t] = own[:live]
        if t:
            own[:live] = back[t - 1][np.arange(live), own[:live]]
    return out


def _evidence(logits: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Log-odds of pooled logits: neighbouring bytes tell much the same, so ten of them count as one observation."""
    n = np.maximum(lens, 1)[:, None]
    return logits.astype(np.float64) / n * np.minimum(np.maximum(n / 10, 1), 30)


class Labelled:
    """The passages of many texts, in order: text, letters, lang (its number) and sure, the confidence.

    Passages are sentences, or parts of one where the language changes within. A language holds over a line unless a
    change is worth APART; passages that are not sure take one of the languages that are sure in their text.
    """

    def __init__(self, net: Network, texts: list[str]):
        s = Sentences(texts)
        logits = net.pooled(s.flat, s.begin, s.lens)
        begin, lens, letters, line, text = self._cut(net, s, logits)
        score = _evidence(logits if begin is s.begin else self.logits, lens)
        own = _best_path(score, line, APART)
        at = np.arange(len(own))
        prob = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
        prob /= prob.sum(axis=1, keepdims=True)
        firm = (prob[at, own] >= SURE) & (letters >= 20)
        known = np.zeros((len(texts), len(LANGUAGES)), dtype=bool)
        known[text[firm], own[firm]] = True
        weak = np.flatnonzero(~firm & known[text].any(axis=1))
        own[weak] = np.where(known[text[weak]], score[weak], -np.inf).argmax(axis=1)
        full = letters > 0
        self.text, self.letters, self.lang, self.sure = text[full], letters[full], own[full], prob[at, own][full]

    def _cut(self, net: Network, s: Sentences, logits: np.ndarray):
        """Sentences whose best language leads by little a byte are labelled byte by byte, and cut where that changes."""
        top = np.partition(logits, -2, axis=1) if len(logits) else logits
        lead = (top[:, -1] - top[:, -2]) / np.maximum(s.lens, 1) if len(logits) else np.zeros(0)
        mixed = np.flatnonzero((lead < LEAD) & (s.lens >= 2 * PART))
        if not len(mixed):
            return s.begin, s.lens, s.letters, s.line, s.text
        words_at, words_of, words = [], [], []
        for k, each in zip(mixed.tolist(), net.labelled(s.flat, s.begin[mixed], s.lens[mixed])):
            raw = s.flat[s.begin[k] : s.begin[k] + s.lens[k]]
            at = np.flatnonzero((raw == 32) | (raw >= 0xE0))  # words, and the characters of scripts without gaps
            at = np.append(0, at[at > 0])
            words_at.append(at)
            words_of.append(np.full(len(at), k))
            words.append(np.add.reduceat(each, at, axis=0))
        per, at, of = np.concatenate(words), np.concatenate(words_at), np.concatenate(words_of)
        lang = _best_path(per.astype(np.float64) / 10, of, APART)
        new = np.append(True, (of[1:] != of[:-1]) | (lang[1:] != lang[:-1]))
        head = np.flatnonzero(new)
        parts = np.bincount(of[head], minlength=len(s.begin))
        parts[parts == 0] = 1
        owner = np.repeat(np.arange(len(s.begin)), parts)
        begin, out = s.begin[owner].copy(), logits[owner].copy()
        cut = np.isin(owner, mixed)
        begin[cut] += at[head]
        out[cut] = np.add.reduceat(per, head, axis=0)
        lens = np.diff(np.append(begin, len(s.flat)))
        chars = np.add.reduceat(((s.flat & 0xC0) != 0x80) & (s.flat != 32), begin, dtype=np.int64)
        self.logits = out
        return begin, lens, chars, s.line[owner], s.text[owner]


def _shares(found: Labelled, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """[texts, languages]: the share of the letters, and the mean confidence."""
    k = len(LANGUAGES)
    at = found.text * k + found.lang
    letters = np.bincount(at, weights=found.letters, minlength=n_texts * k).reshape(-1, k)
    sure = np.bincount(at, weights=found.letters * found.sure, minlength=n_texts * k).reshape(-1, k)
    return letters / np.maximum(letters.sum(axis=1, keepdims=True), 1), sure / np.maximum(letters, 1)


def _run(documents: DataFrame, net: Network, make, schema: str) -> DataFrame:
    """make(found, rows) of every batch of doc_id, text, lang."""
    shared = documents.sparkSession.sparkContext.broadcast(net.p)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Network(len(LANGUAGES))
        own.p = shared.value
        for rows in batches:
            for part in _portions(rows):
                yield make(Labelled(own, part["text"].tolist()), part)

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text", "lang").mapInPandas(each, schema)


def _portions(rows: pd.DataFrame, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Runs of rows of about `most` characters in all, so that the memory needed doesn't grow with the texts' number."""
    size = rows["text"].str.len().cumsum().to_numpy()
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield rows.iloc[at:end]
        at = end


def document_languages(documents: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, lang, share, confidence, as_labelled: one row per language that fills a fifth of a document's letters.

    as_labelled says whether the label names that language and it is the only one; false marks a missing label (null,
    empty, a placeholder), one that names no language of the text, and every text in several languages. Null and empty
    texts, and texts without letters, have no language. Code blocks, addresses, formulas, headings and quotations
    don't count where anything else is there.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, share double, confidence double, as_labelled boolean"
    net = net or fit(documents)
    if net is None:
        return documents.sparkSession.createDataFrame([], schema)

    def make(found: Labelled, rows: pd.DataFrame) -> pd.DataFrame:
        share, sure = _shares(found, len(rows))
        doc, lang = np.nonzero(share >= SHARE)
        named = np.array([LANGUAGES.index(x) if (x := label_language(v)) else -1 for v in rows["lang"]], dtype=np.int64)
        right = (named[doc] == lang) & (np.bincount(doc, minlength=len(rows))[doc] == 1)
        return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[doc], "lang": np.array(LANGUAGES, dtype=object)[lang], "share": share[doc, lang], "confidence": sure[doc, lang], "as_labelled": right})

    return _run(documents, net, make, schema)


def passage_languages(documents: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, passage, lang, n_letters, confidence: the runs of one language, in order."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, passage int, lang string, n_letters int, confidence double"
    net = net or fit(documents)
    if net is None:
        return documents.sparkSession.createDataFrame([], schema)

    def make(found: Labelled, rows: pd.DataFrame) -> pd.DataFrame:
        new = np.ones(len(found.text), dtype=bool)
        new[1:] = (found.text[1:] != found.text[:-1]) | (found.lang[1:] != found.lang[:-1])
        at = np.flatnonzero(new)
        add = lambda x: np.add.reduceat(x, at) if len(at) else x[:0]
        doc, letters = found.text[at], add(found.letters)
        passage = np.arange(len(at)) - np.searchsorted(doc, doc)
        return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[doc], "passage": passage.astype(np.int32), "lang": np.array(LANGUAGES, dtype=object)[found.lang[at]], "n_letters": letters.astype(np.int32), "confidence": add(found.letters * found.sure) / np.maximum(letters, 1)})

    return _run(documents, net, make, schema)
