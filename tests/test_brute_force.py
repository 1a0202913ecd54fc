"""Queries without SQL against plain Python over the smallest tables, in whole."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pytest

from sievework.operators import filters
from sievework.plans import catalog


@pytest.fixture(scope="module")
def run(spark, small):
    return lambda name: catalog.queries()[name](spark, small).toPandas()


@pytest.fixture(scope="module")
def docs(small):
    return pd.read_parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def code(small):
    t = pd.read_parquet(f"{small}/l2_dataset.parquet")
    return t[(t.rubric_kind == "code") & t.text.notna()].drop_duplicates(["doc_id", "chunk_idx", "text"])


def words(text):
    return text.lower().split()


def test_equation_steps(run, docs):
    number = r"-?[0-9]+(?:\.[0-9]+)?"
    one = re.compile(rf"(?<![0-9./])({number})\s*([+\-×÷*/])\s*({number})\s*=\s*({number})(?![0-9./])")
    chain = re.compile(rf"{number}(?:\s*[+\-×÷*/]\s*{number}){{2,}}\s*=")
    got = run("equation_steps").set_index("doc_id")
    for d, text in zip(docs.doc_id, docs.text):
        n = wrong = plain = plain_wrong = 0
        for line in (text or "").split("\n"):
            for a, op, b, c in one.findall(line):
                a, b, c = float(a), float(b), float(c)
                r = a + b if op == "+" else a - b if op == "-" else a * b if op in "×*" else a / b if b else None
                plain += r is not None
                plain_wrong += r is not None and abs(r - c) > 1e-6
                if not chain.search(line):
                    n += 1
                    wrong += r is None or abs(r - c) > 1e-6 * max(1.0, abs(r))
        assert tuple(got.loc[d]) == (n, wrong, plain, plain_wrong), d


def test_autogenerated_files(run, code):
    def head(text):
        out, quote = [], ""
        for line in (x.strip() for x in text.split("\n")):
            if not line:
                continue
            opens = re.match(r"[rRuUbBfF]{0,2}(\"\"\"|''')", line)
            if quote:
                out.append(line)
                quote = "" if quote in line else quote
            elif opens:
                out.append(line)
                quote = opens[1] if line.count(opens[1]) < 2 else ""
            elif re.match(r"#|//|/\*|\*", line):
                out.append(line)
            else:
                break
        return "\n".join(out)

    want = {(d, k) for d, k, t in zip(code.doc_id, code.chunk_idx, code.text) if re.search(filters.GENERATED_MARK, head(t)) and re.search(filters.GENERATOR, head(t))}
    assert set(run("autogenerated_files").itertuples(index=False, name=None)) == want


def test_chunks_add_up(run, docs, code):
    sizes = run("word_window_chunks").groupby("doc_id").n_chars.sum()
    assert sizes.to_dict() == {d: len(t) for d, t in zip(docs.doc_id, docs.text) if t}
    pieces = run("source_chunks")
    assert (pieces.groupby(["doc_id", "part"]).chunk_idx.max() + 1 == pieces.groupby(["doc_id", "part"]).n_chunks.first()).all()
    assert pieces.n_chars.sum() == code.drop_duplicates(["doc_id", "chunk_idx"]).text.str.len().sum()


def test_repeat_spans(run, docs):
    got = run("repeat_spans").set_index("doc_id")
    for d, text in zip(docs.doc_id, docs.text):
        w = words(text or "")
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
        assert got.covered[d] == len(inside)
        n = int(got.longest[d])
        for size, twice in ((n, True), (n + 1, False)):
            if 0 < size < len(w):
                runs = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
                assert (len(set(runs)) < len(runs)) == twice


def test_prose_continuations(run, docs):
    text = dict(zip(docs.doc_id, docs.text))
    got = run("prose_continuations")
    assert len(got) and (got.prompt_chars + got.completion_chars == got.doc_id.map(lambda d: len(text[d]))).all()
    assert (got.prompt_chars >= 200).all() and (got.completion_chars >= 200).all()
    for d, at in zip(got.doc_id, got.prompt_chars):
        assert re.search(r"\n\s*\n$", text[d][:at]) or re.match(r"\s*", text[d][at:])


def test_estimate_is_close(run):
    (r,) = run("near_dup_calibration").itertuples(index=False)
    assert r.pairs == 0 or r.mae < 0.1


def test_syntax_gate(run, code):
    import ast
    import warnings

    def parses(t):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(t)
            return bool(t.strip())
        except (SyntaxError, ValueError):
            return False

    got = run("syntax_gate").set_index("reason").n
    t = pd.read_parquet  # every record counts, repeated ones too
    assert got.get("parses", 0) > 0 and got.sum() >= len(code) and t is not None
    per = {d: parses(x) for d, x in zip(code.index, code.text)}
    assert got.get("parses", 0) >= sum(per.values())


def test_lossless_kinds(run, docs):
    seen = run("minhash_seen")
    assert set(seen.doc_id) == {d for d, t in zip(docs.doc_id, docs.text) if t and t.strip()}
    packed = run("sft_packing")
    fit = packed[packed["bin"] >= 0].groupby(["block", "bin"])["size"].sum()
    assert len(packed) == len(docs) and (fit <= 1024).all()


LONG = ["x = \"" + "a" * 300_000 + "\"", "'" + "\\n" * 200_000, "[Image: a]" * 30_000, "/*" + " *" * 200_000, "1 + 1 = 2 " * 40_000, "User: hi\nAssistant: yes\n" * 15_000, "<b>" * 100_000, "-Users-a" * 40_000 + " a@b" * 40_000, "\x1b[0m" * 60_000, "（）" * 150_000, " " * 300_000, "问：甲\n" * 60_000, "# a\n" * 60_000]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_long_texts_end(spark, text):
    """No pattern recurses with the length of a text; an overflow of the stack would end the session."""
    from pyspark.sql import functions as F

    from sievework.functions import text as T
    from sievework.operators import conversations, pii, tables
    from sievework.sources import readers

    t = spark.createDataFrame([(text,)], "t string")
    made = [T.code_norm("t"), T.clean_context("t"), T.question_body("t"), T.squash("t"), T.skeleton("t"), pii.scrub("t"), filters.leading_header("t"), readers.question_answer(F.col("t"))["answer"]]
    rules = [filters.light_reason("t"), filters.web_reason("t"), filters.clean_reason("t"), filters.chain_reason("t", "t"), filters.markup_kind("t"), filters.weighted_types("t", tables.weighted(tables.PROBLEM_TYPES))["primary"], F.size(T.word_tokens("t")), F.size(pii.high_entropy_tokens(F.col("t"))), F.array_join(pii.credential_classes(F.col("t")), ",")]
    struct = F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("t").alias("content")))
    row = t.select(*(F.length(c).alias(f"c{k}") for k, c in enumerate(made)), *(r.alias(f"r{k}") for k, r in enumerate(rules)), conversations.unusable(struct).alias("u"), filters.equation_check("t").alias("e")).first()
    assert row is not None
