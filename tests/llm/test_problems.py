"""The eight problems on small fixtures: brute force, round trips and the awkward cases."""

from __future__ import annotations

import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import budget, cutoff, handwritten, languages, leaks, mixing, neardup, packing
from sievework.llm.tokenizer import PieceTokenizer

L2 = "doc_id string, chunk_idx int, text string, labels array<double>, rubric_kind string, domain string, chunk_id string, truncated boolean, rid string, comp string, n_tokens string, size string, bin string"
DOCS = "doc_id long, text string, lang string, source string, block string, n_tokens string, p string, lang_ string"
VOCAB = [(i, p) for i, p in enumerate([*"abcdefghij .,\n", " ab", "abc", "abcd", " bcd", "ij"])]


def l2(spark, rows):
    """rows of (doc_id, chunk_idx, text, kind, domain); the rest are columns that clash with the operators' own names."""
    return spark.createDataFrame([(d, c, t, None, k, m, "x", False, "r", "c", "n", "s", "b") for d, c, t, k, m in rows], L2)


def docs(spark, rows):
    return spark.createDataFrame([(d, t, g, s, "b", "n", "p", "l") for d, t, g, s in rows], DOCS)


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([*VOCAB, (999, None), (998, "ij")], "token_id int, piece string")


def slow_count(text):
    pieces, n, i = {p for _, p in VOCAB}, 0, 0
    while i < len(text):
        k = max((k for k in range(1, 6) if text[i : i + k] in pieces and len(text[i : i + k]) == k), default=0)
        n, i = n + (1 if k else len(text[i].encode())), i + (k or 1)
    return n


# 1


def jaccard(a, b):
    def runs(t):
        w = neardup._WORD.findall(t.lower())
        return set(zip(w, w[1:], w[2:]))

    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x and y else 0


def test_p1_pairs_equal_brute_force(spark):
    r = np.random.default_rng(1)
    word = lambda: "w" + str(r.integers(3000))
    rows = []
    for g in range(40):
        base = [word() for _ in range(60)]
        for k in range(4):
            w = list(base)
            for _ in range(3 * k):
                w[r.integers(60)] = word()
            rows.append((f"d{g:02d}_{k}", 0, " ".join(w), "x", "y"))
    rows += [("z1", 0, "中文字符测试文本内容重复", "x", "y"), ("z2", 0, "中文字符测试文本内容重复。", "x", "y"), ("n", 0, None, "x", "y"), ("e", 0, "", "x", "y"), ("t", 0, "two words", "x", "y"), ("u", None, "a_b c d e", "x", "y"), (None, 0, "a b c d e", "x", "y")]
    rows += rows[:5] + [("d00_0", 1, "something else here entirely", "x", "y")]
    got = {(x.doc_id_a, x.doc_id_b) for x in neardup.NearDuplicates(l2(spark, rows)).document_pairs().collect()}
    want = set()
    texts = [(d, t) for d, _, t, _, _ in rows if d and t]
    for i, (d, t) in enumerate(texts):
        for e, s in texts[i + 1 :]:
            if d != e and jaccard(t, s) >= 0.6:
                want.add((min(d, e), max(d, e)))
    assert got <= want and len(got) >= 0.98 * len(want) and ("z1", "z2") in got


def test_p1_hot_copies_stay_linked_without_all_pairs(spark):
    rows = [(f"c{i:04d}", 0, "the very same text in many copies of it", "x", "y") for i in range(200)]
    found = neardup.NearDuplicates(l2(spark, rows))
    pairs = found.document_pairs().collect()
    assert len(pairs) == 199 and {p.doc_id_a for p in pairs} == {"c0000"}
    groups = found.groups().collect()
    assert len(groups) == 200 and {g.group_id for g in groups} == {"c0000"} and {g.n_links for g in groups} == {199}


def test_p1_links_of_large_classes_are_counted_in_full(spark):
    """Two similar classes of 50 and 3 documents, and a chain of unlike ends behind them."""
    base = [f"word{i}" for i in range(40)]
    rows = [(f"a{i:02d}", 0, " ".join(base), "x", "y") for i in range(50)] + [(f"b{i}", 0, " ".join([*base, "more"]), "x", "y") for i in range(3)] + [("lone", 0, "nothing like the others here", "x", "y")]
    got = {g.doc_id: g.n_links for g in neardup.NearDuplicates(l2(spark, rows)).groups().collect()}
    assert got == {f"a{i:02d}": 52 for i in range(50)} | {f"b{i}": 52 for i in range(3)}


def test_p1_chain_loses_no_pair(spark, monkeypatch):
    """Sixty texts, each like its next two only: a component far larger than a block."""
    monkeypatch.setattr(neardup, "GROUP", 8)
    words = [f"word{i}" for i in range(1000)]
    rows = [(f"g{i:02d}", 0, " ".join(words[12 * i : 12 * i + 100]), "x", "y") for i in range(60)]
    found = neardup.NearDuplicates(l2(spark, rows))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and jaccard(a[2], b[2]) >= 0.6}
    assert len(want) == 117 and {(p.doc_id_a, p.doc_id_b) for p in found.document_pairs().collect()} == want
    assert len({g.group_id for g in found.groups().collect()}) == 1


def test_p1_large_group_is_cut_but_linked(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 8)
    base = [f"word{i}" for i in range(80)]
    rows = [(f"g{i:02d}", 0, " ".join([*base[:40], f"odd{i}", *base[40:]]), "x", "y") for i in range(40)]
    groups = neardup.NearDuplicates(l2(spark, rows)).groups().collect()
    assert len(groups) == 40 and {g.group_id for g in groups} == {"g00"}


def test_p1_large_group_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 8)
    base = [f"word{i}" for i in range(80)]
    rows = [(f"g{i:02d}", 0, " ".join([*base[: i + 20], f"odd{i}", *base[i + 20 :]]), "x", "y") for i in range(40)]
    pairs = neardup.NearDuplicates(l2(spark, rows)).document_pairs().collect()
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and jaccard(a[2], b[2]) >= 0.6}
    assert len(want) == 780 and {(p.doc_id_a, p.doc_id_b) for p in pairs} == want


def test_densification_keeps_similarity():
    a = " ".join(f"k{i}" for i in range(42))
    b = " ".join([*(f"k{i}" for i in range(36)), *(f"z{i}" for i in range(6))])
    doc, h = neardup.runs([a, b])
    sig = neardup.signatures(doc, h, 2)
    assert abs((sig[0] == sig[1]).mean() - jaccard(a, b)) < 0.15 and (sig != np.uint64(2**64 - 1)).all()


# 2

HAND = "import os\n\n\ndef area(w, h):\n    # the rows generated by the sampler are checked here, as the ticket asks us to do\n    return w * h\n\n\ndef name(x):\n    return os.path.basename(x)\n"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("// Code generated by fooc 1.2. DO NOT EDIT.\npackage x\n", "generated"), ("/*\n * @generated by fooc from a.y\n */\nint x;\n", "generated"), ("# 本文件由 foo 自动生成，请勿手工修改。\nx = 1\n", "generated"),
        ('"""Generated by foo tool 3.1 on 2026-01-02."""\nx = 1\n', "generated"), ("x = 1\n# This file was automatically generated from a.yaml.\n", "generated"), ("# third_party/a/b.py - imported unchanged from release 1.0.0\nx = 1\n", "vendored"),
        ("/*! lib v1.2.3 */\n", "vendored"), ("# Foo -- single-file build, version 2.0.1\nx = 1\n", "vendored"), ("# Copyright 2020 the Foo team\n# Part of the foo project, see LICENSE.\nx = 1\n", None),
        ("# Replaces the old auto generated names of foo.\nx = 1\n", None), ("x = 'Code generated by fooc 1.2. DO NOT EDIT.'\n", None), ("# do not edit the cut without asking Ann first\n", None), ("# Drop-in for the vendored foo we removed last year; rewritten from scratch.\n", None), (HAND, None), ("", None),
        # wordings that no rule lists as a whole
        ("# Emitted by barc 2.0 from bar.idl\nx = 1\n", "generated"), ("// Machine-generated from schema/a.proto\n", "generated"), ("# This file was generated by foo\nx = 1\n", "generated"), ("# Written by Ann and Bob\nx = 1\n", None), ("// Created by Ann on 2024-01-02.\nint x;\n", None), ("# Built with numpy 1.26\nx = 1\n", None), ("# Written by Ann in 2024-01-02\nx = 1\n", None), ("# Derived from the sum of rows\nx = 1\n", None), ("// Never modify this file directly.\nint x;\n", "generated"), ("# Edits will be discarded at the next build.\n", "generated"), ("# Ne pas modifier. Généré par outil 3.2\n", "generated"),
        ("// Mirrored from libfoo at 9f3c2ab1\nint x;\n", "vendored"), ("# Snapshot of foo, release 2.4.1\nx = 1\n", "vendored"), ("/*\n * Taken from external/foo/bar.c\n * Local patches: none\n */\n", "vendored"), ("# forked; report bugs to upstream\n# revision 1a2b3c4d5e\n", "vendored"),
        # statements on other things than the file
        ("# needs numpy 1.26 or later\nx = 1\n", None), ("# Licensed under the MIT licence, see LICENSE.\n# Copyright 2021 the Foo team\n", None), ("# the generated tables are rebuilt by make\nx = 1\n", None), ("# copy the rows before sorting\nx = 1\n", None), ("# changed in 2024-01-02: reads the old format too\n", None),
    ],
)
def test_p2_headers(text, kind):
    assert handwritten.header_kind(text) == kind


def test_p2_files(spark):
    table = "data = [\n" + "\n".join(f"    {i}, {i * 7}, -{i * 3}, {i + 1000}," for i in range(60)) + "\n]\n"
    small = HAND + "TABLE = [1, 2, 3, 4]\n" + HAND.replace("area", "volume")
    mini = "".join(f"var a{i}=b[{i}],c=!{i};if(c<{i})throw c;" for i in range(80))
    getters = "\n".join(f"    public int get{n}() {{ return {n.lower()}_; }}\n    public B set{n}(int v) {{ {n.lower()}_ = v; bits |= {1 << i}; return this; }}" for i, n in enumerate("Alpha Beta Gamma Delta Epsilon Zeta Eta".split()))
    rows = [("hand", 0, HAND, "code", "a"), ("hand", 0, HAND, "code", "a"), ("table", 0, table, "code", "a"), ("small", 0, small, "code", "a"), ("mini", 0, mini, "code", "a"), ("getters", 0, getters, "code", None), ("empty", 0, "", "code", "a"), ("null", 0, None, "code", "a"), (None, 0, table, "code", "a"), ("prose", 0, table, "natural_language", "a")]
    rows += [("late", 0, HAND, "code", "a"), ("late", 1, "// Code generated by x 1. DO NOT EDIT.\n", "code", "a"), ("v1", 0, HAND + "# one", "code", "a"), ("v2", 0, HAND + "# two", "code", "a"), ("w1", 0, HAND + "# one", "code", "a"), ("w2", 0, HAND + "# two", "code", "a"), ("s1", 0, HAND + "# lone", "code", "a"), ("s2", 0, HAND + "# lone", "code", "a")]
    pool = spark.createDataFrame(
        [("v1", "https://one.example/lib/a.py"), ("v2", "https://one.example/lib/b.py"), ("w1", "https://two.example/deps/a.py"), ("w2", "https://two.example/deps/b.py"), ("s1", "https://one.example/x/a.py"), ("s2", "https://two.example/y/a.py"), ("hand", None), (None, "https://x.example/a")],
        "parent_doc_id string, url string",
    )
    got = {r.doc_id: r.reason for r in handwritten.not_handwritten(l2(spark, rows), pool).collect()}
    assert got == {"table": "data", "mini": "minified", "getters": "generated", "late": "generated", "v1": "vendored", "v2": "vendored", "w1": "vendored", "w2": "vendored"}


def test_p2_deep_trees(spark):
    """A subtree that two repositories hold at different depths, below directories of other names."""
    rows = [(f"a{k}", "one", f"src/x/y/z/lib/{'sub/' * k}f{k}.py", k) for k in range(4)] + [(f"b{k}", "two", f"deps/{'sub/' * k}f{k}.py", k) for k in range(4)]
    rows += [("c0", "three", "lib/f0.py", 0), ("c1", "three", "lib/sub/f1.py", 99), ("d", "two", "main.py", 7), ("e", None, "a/b.py", 1), ("f", "two", None, 1)]
    got = {r.doc_id for r in handwritten.shared_directories(spark.createDataFrame(rows, "doc_id string, repo string, path string, leaf long")).collect()}
    assert got == {f"{x}{k}" for x in "ab" for k in range(4)}


# 3, 5


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdij .,\nxyzé中😀", max_size=60))
def test_counts_equal_slow_reading(text):
    t = PieceTokenizer([p for _, p in VOCAB])
    assert t.count(text) == slow_count(text) == len(t.pieces_of(text)) == len(t.encode(text))
    assert b"".join(p.encode() if isinstance(p, str) else p for p in t.pieces_of(text)).decode() == text


def test_p3_supply(spark, vocab):
    rows = [("a", 0, "abc ab", "x", "Web "), ("a", 0, "abc ab", "x", "web"), ("b", 0, "é" * 3, "x", " WEB"), ("c", 0, None, "x", "web"), ("d", 0, "", "x", "web"), ("e", 0, "abcd", "x", None), ("f", 0, "ij " * 50_000, "x", "books")]
    mix = spark.sql("""select map('web', named_struct('weight', 0.5D, 'epochs', 2, 'anneal', cast(null as double), 'role', 'r', 'tokens', 17L, 'source', 's', 'supply', cast(null as string), 'status', 's'),
        'books', named_struct('weight', 0.5D, 'epochs', 1, 'anneal', 0.1D, 'role', 'r', 'tokens', 100000L, 'source', 's', 'supply', 'x', 'status', 's'),
        'none', named_struct('weight', 0.5D, 'epochs', cast(null as int), 'anneal', 0.1D, 'role', 'r', 'tokens', 1L, 'source', 's', 'supply', 'x', 'status', 's')) as domains""")
    got = {r.domain: (r.supply, r.short) for r in budget.domain_supply(l2(spark, rows), vocab, mix).collect()}
    assert got == {"web": (slow_count("abc ab") + 6, True), "books": (100_000, False), "none": (0, True)}


def test_p3_cube(spark, vocab):
    rows = [("a", 0, "abc", "x", "web"), ("a", 1, "abcd", "x", "web"), ("b", 0, "ij", "x", None)]
    pool = spark.createDataFrame([("a", 0, "s1"), ("a", 0, "s1"), ("a", 1, None)], "parent_doc_id string, chunk_idx int, source string")
    ledger = spark.createDataFrame([("a", "en-US"), ("a", "EN"), ("a", "de"), ("b", None)], "doc_id string, lang string")
    cube = {(r.source, r.lang, r.domain): (r.n_tokens, r.n_records) for r in budget.token_cube(l2(spark, rows), pool, ledger, vocab).collect()}
    assert cube[None, None, None] == (3, 3) and cube["s1", "en", "web"] == (1, 1) and cube["unknown", "en", "web"] == (1, 1) and cube[None, "unknown", "unknown"] == (1, 1)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20), st.sampled_from([(64,), (16, 32, 64), (40, 64)]))
def test_packing_plan_is_sound(counts, capacities):
    plan = packing.PackingPlan(counts, capacities)
    load, placed = np.zeros(plan.n_bins, dtype=int), {}
    segs = sorted(plan.segments, key=lambda s: (-s[0], s[1]))
    for i, (length, rank, first, each, offset) in enumerate(segs):
        end = segs[i + 1][1] if i + 1 < len(segs) and segs[i + 1][0] == length else counts[length]
        for k in range(rank, end):
            b = first + (k - rank) // each
            assert load[b] == offset + (k - rank) % each * length
            load[b] += length
        placed[length] = placed.get(length, 0) + end - rank
    assert placed == counts
    sizes = np.concatenate([np.full(n, s) for f, n, u, s in plan.bins])
    used = np.concatenate([np.full(n, u) for f, n, u, s in plan.bins])
    assert (used == load).all() and (used <= sizes).all() and set(sizes) <= set(capacities)
    if len(capacities) == 1:  # no two bins of best fit are half empty
        assert plan.n_bins <= 2 * -(-sum(k * n for k, n in counts.items()) // capacities[0])


def test_p5_rows(spark, vocab):
    rows = [(f"d{i}", 0, "a" * (i % 50 + 1), "x", "y") for i in range(300)] + [("long", 0, "b" * 150, "x", "y"), ("exact", 0, "b" * 64, "x", "y"), ("none", 0, None, "x", "y"), ("void", 1, "", "x", "y"), (None, None, "ij", "x", "y")]
    rows += rows[:40]
    got = packing.training_rows(l2(spark, rows), vocab, (16, 32, 64)).collect()
    by_bin: dict = {}
    for r in got:
        if r.bin is None:
            assert r.size == 0 and r.doc_id in ("none", "void")
        else:
            by_bin.setdefault(r.bin, []).append(r)
    assert len(got) == 300 + 3 + 1 + 2 + 1
    for b in by_bin.values():
        at = 0
        for r in sorted(b, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.size
        assert at <= b[0].bin_size <= 64
    assert {(r.doc_id, r.n_pieces) for r in got if r.n_pieces > 1} == {("long", 3)}
    assert [tuple(r) for r in packing.split_by_packing(packing.training_rows(l2(spark, rows), vocab, (16, 32, 64))).collect()] == [("long", 0)]
    assert len(by_bin) <= 1.05 * sum(r.size for r in got) / 64 + 1


def test_p5_ranks_over_hash_buckets(spark, vocab, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ITEMS", 7)
    rows = [(f"d{i}", 0, "a" * 30, "x", "y") for i in range(100)]
    got = packing.training_rows(l2(spark, rows), vocab, (64,)).collect()
    assert sorted((r.bin, r.bin_offset) for r in got) == sorted((b, o) for b in range(50) for o in (0, 30))


# 4

LEDGER = "doc_id string, domain string, scorer_name string, scorer_version string, ts string, score double, quota string, edge string"


def test_p4_cutoffs(spark):
    rows = [(f"d{i:02d}", ["Web", " web ", "WEB"][i % 3], "k", "1", "2026-01-01T00:00:00Z", float(i // 4)) for i in range(20)]
    rows += [("d00", "web", "k", "1", "2026-01-02 00:00:00", 99.0), ("d19", "web", "k", "1", "2026-01-01T23:59:59.5+00:00", -5.0), ("d01", "web", "k", "1", "2026-01-01T00:00:00Z", 3.0), ("d18", "web", "k", "2", "2026-02-01T00:00:00Z", 100.0)]
    rows += [("n", "web", "k", "1", "2026-01-01T00:00:00Z", None), ("q", "web", "k", "1", "2026-01-01T00:00:00Z", float("nan")), ("i", "web", "k", "1", "2026-01-01T00:00:00Z", float("inf")), (None, "web", "k", "1", "2026-01-01T00:00:00Z", 1.0), ("z", None, "k", "1", "2026-01-01T00:00:00Z", 1.0)]
    ledger = spark.createDataFrame([(*r, "q", "e") for r in rows + rows[:3]], LEDGER)
    targets = spark.createDataFrame([("web", "k", "1", 0.35), ("web", "k", "1", 0.35), ("gone", "k", "1", 0.5)], "domain string, scorer_name string, scorer_version string, quota double")
    c = cutoff.Cutoffs(cutoff.deciding_scores(ledger, targets), 3)
    score = {f"d{i:02d}": float(i // 4) for i in range(20)} | {"d00": 99.0, "d19": -5.0, "d01": 3.0}
    want = sorted(score, key=lambda k: (-score[k], k))[:7]
    assert sorted(r.doc_id for r in c.kept().collect()) == sorted(want)
    (rep,) = c.report().collect()
    assert (rep.domain, rep.n, rep.kept, rep.cutoff) == ("web", 20, 7, score[want[-1]])


@pytest.mark.parametrize(("text", "seconds"), [("2026-01-01T00:00:00Z", 1767225600), ("2026-01-01 00:00:00", 1767225600), ("2026-01-01T01:00:00+0100", 1767225600), ("2026-01-01T00:00:00 UTC", 1767225600), ("1767225600", 1767225600), ("soon", None), (None, None)])
def test_p4_instants(spark, text, seconds):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        row = spark.createDataFrame([(text,)], "ts string").selectExpr("ts").select(cutoff.instant("ts").cast("long").alias("t")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.t == seconds


# 6


def fold(t):
    return "".join(c for c in unicodedata.normalize("NFKC", t).lower() if c.isalnum())


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_p6_search_equals_brute_force(data):
    need = data.draw(st.sampled_from([25, 50]))
    r = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    item = lambda n: "".join("abcdé中1"[k] for k in r.integers(0, 7, n))
    items = [(str(i), item(int(r.integers(10, 160)))) for i in range(6)]
    texts = []
    for _ in range(12):
        t = item(int(r.integers(0, 300)))
        _, src = items[r.integers(6)]
        n, at = int(r.integers(need - 4, need + 4)), int(r.integers(0, max(1, len(src) - need)))
        k = int(r.integers(0, len(t) + 1))
        texts.append(t[:k] + src[at : at + n] + t[k:])
    m = leaks.WuManber(items, need)
    got = {(t, m.items[i][0]) for t, i in m.search(texts)}
    want = {(k, name) for k, t in enumerate(texts) for name, s in items if any(s[a : a + need] in t for a in range(len(s) - need + 1))}
    assert got == want


def test_p6_tables_grow_with_the_items():
    r = np.random.default_rng(6)
    text = lambda n: "".join(chr(97 + k) for k in r.integers(0, 26, n))
    items = [(f"i{k}", text(300)) for k in range(3000)]
    few, many = leaks.WuManber(items[:10], 50), leaks.WuManber(items, 50)
    assert many.block > few.block and many.bits > few.bits and (many.shift > 1).mean() > 0.5
    texts = [text(500) + items[k][1][100:150] + text(400) for k in range(0, 3000, 500)] + [text(3000), items[7][1][:49]]
    assert many.search(texts) == {(n, k) for n, k in enumerate(range(0, 3000, 500))}


def test_p6_long_texts_cross_lanes():
    piece = "qwertyuiopasdfghjklzxcvbnm0123456789qwertyuiopasdfghjkl"
    m = leaks.WuManber([("a", piece)], 50)
    for at in range(leaks.LANE - 60, leaks.LANE + 10):
        assert m.search(["x" * at + piece[2:53] + "y" * 5000]) == {(0, 0)}


def test_p6_leaks(spark):
    long = "The quick brown fox jumps over the lazy dog and then goes home to sleep for nine hours"
    zh = "甲有三百二十五个苹果又买来七百六十八个再平均分给四十五位小朋友每位得几个"
    items = spark.createDataFrame([("i1", "en", long), ("i1", "en", long), ("i2", "zh", zh), ("i3", None, "short"), ("i4", "en", None), (None, "en", long)], "item_id string, lang string, prompt string")
    full = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in long)
    rows = [(1, "xx " + long[10:80].upper().replace(" ", "-- ") + " yy", "en", "s"), (2, full, "en", "s"), (3, zh[:24], "zh", "s"), (4, "前" + zh[3:30] + "后", "zh", "s"), (5, None, "en", "s"), (6, "", "en", "s"), (7, long[:40], "en", "s"), (None, long, "en", "s"), (1, "xx " + long[10:80], "en", "s"), (8, "z" * 300_000 + long, "en", "s")]
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs(spark, rows), items).collect()}
    assert got == {(1, "i1"), (2, "i1"), (4, "i2"), (8, "i1")}


# 7


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=400), st.floats(0.02, 0.98))
def test_p7_flight_keeps_sums(sizes, p):
    size = np.array(sizes, dtype=float)
    start = np.full(len(size), p)
    end = mixing.flight(start, size)
    assert ((end > 0) & (end < 1)).sum() <= 2
    assert abs(end.sum() - start.sum()) < 1e-4 and abs((end * size).sum() - (start * size).sum()) < 1e-2
    landed = mixing.landing(end, size)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (start * size).sum()) <= size.max() + 1e-2


def test_p7_lanes_keep_sums():
    r = np.random.default_rng(8)
    for size in (r.integers(1, 900, 5000).astype(float), r.integers(1, 4, 5000).astype(float), np.full(700, 7.0)):
        start = r.random(len(size))
        end = mixing.flight(start, size)
        assert ((end > 0) & (end < 1)).sum() <= 2 and ((end >= 0) & (end <= 1)).all()
        assert abs(end.sum() - start.sum()) < 1e-4 and abs((end * size).sum() - (start * size).sum()) < 1e-1


def test_p7_mix(spark, vocab, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = [(i, "a" * (i % 17 + 1), "en", "big") for i in range(300)] + [(1000 + i, "b" * 10, "en", "small") for i in range(3)] + [(2000, None, "en", "big"), (2001, "", "en", "void"), (2002, "aa", "en", None), (None, "aa", "en", "big"), (2003, "aa", "en", "other")]
    targets = spark.createDataFrame([("big", 0.5, 2, 2000.0), ("small", 0.4, 4, 2000.0), ("void", 0.1, 1, 2000.0), ("gone", None, None, 2000.0), (None, 0.3, 1, 2000.0)], "source string, weight double, max_repeats int, total_tokens double")
    mix = mixing.Mix(docs(spark, rows), targets, vocab)
    shares = {r.source: r for r in mix.shares().collect()}
    assert {k: r.short for k, r in shares.items()} == {"big": False, "small": True, "void": True, "gone": False}
    assert abs(shares["big"].tokens - 1000) <= 20 and shares["small"].tokens == 120 and shares["void"].tokens == 0
    used = mix.selection().collect()
    assert len({r.doc_id for r in used}) == len(used) and all(1 <= r.n_uses <= {"big": 2, "small": 4}[r.source] for r in used)


# 8

WORDS = {
    "en": "the of and harbour council was opened because nobody had asked which window would close first in spring", "de": "der die und nicht gestern haben wir über den großen Markt gesprochen weil niemand die Schlüssel fand", "fr": "le la les dans une ville où personne n'avait demandé pourquoi la fenêtre était encore ouverte hier soir",
    "es": "el los que una ventana abierta porque nadie había preguntado cuándo cerraría la estación del puerto ayer", "pt": "o os não uma janela aberta porque ninguém tinha perguntado quando fecharia a estação do porto ontem à noite", "zh": "因为没有人问过什么时候关窗所以港口的车站昨天晚上还开着门大家都很高兴",
}


def sentence(lang, r, n=14):
    words = list(WORDS["zh"]) if lang == "zh" else WORDS[lang].split()
    return ("" if lang == "zh" else " ").join(words[k] for k in r.integers(0, len(words), n)) + ("。" if lang == "zh" else ". ")


@pytest.fixture(scope="module")
def trained():
    r = np.random.default_rng(2)
    rows = [("".join(sentence(g, r) for _ in range(6)), g) for g in languages.LANGUAGES for _ in range(40)]
    return languages.trained(*languages.training_set(rows), 250)


def languages_in(net, texts):
    share = languages._shares(languages.Labelled(net, texts), len(texts))[0]
    return [{languages.LANGUAGES[k] for k in np.flatnonzero(x >= languages.SHARE)} for x in share]


def test_p8_held_out_accuracy(trained):
    r = np.random.default_rng(9)
    truth = [g for g in languages.LANGUAGES for _ in range(25)]
    got = languages_in(trained, ["".join(sentence(g, r) for _ in range(4)) for g in truth])
    assert np.mean([f == {g} for f, g in zip(got, truth)]) > 0.97


def test_p8_change_within_a_line_and_a_sentence(trained):
    r = np.random.default_rng(11)
    pairs = [(a, b) for a in languages.LANGUAGES for b in languages.LANGUAGES if a != b and "zh" not in (a, b)]
    bare = lambda g: sentence(g, r).rstrip(". ")
    by_line = languages_in(trained, [sentence(a, r) + sentence(b, r) for a, b in pairs])
    within = languages_in(trained, [bare(a) + " " + bare(b) for a, b in pairs])
    assert np.mean([f == {*p} for f, p in zip(by_line, pairs)]) > 0.9
    assert np.mean([f == {*p} for f, p in zip(within, pairs)]) > 0.6


def test_p8_best_path_is_the_best():
    import itertools

    r = np.random.default_rng(3)
    score, group = r.normal(size=(12, 3)) * 3, np.repeat([0, 1, 2], [5, 1, 6])
    got = languages._best_path(score, group, 2.0)
    for g in range(3):
        own = score[group == g]
        worth = lambda p: sum(own[k, c] for k, c in enumerate(p)) - 2 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
        assert abs(worth(got[group == g]) - max(map(worth, itertools.product(range(3), repeat=len(own))))) < 1e-9


def test_p8_gradient_is_right():
    r = np.random.default_rng(4)
    net = languages.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, y = r.integers(0, 256, (7, 5)), r.integers(0, 3, (7, 5, 1))

    def logp():
        z = net.logits_of(net.states(x)[0])
        z = z - z.max(axis=2, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=2, keepdims=True))

    loss = lambda: -np.take_along_axis(logp(), y, axis=2).mean()
    h, tape = net.states(x)
    p = np.exp(logp())
    np.put_along_axis(p, y, np.take_along_axis(p, y, axis=2) - 1, axis=2)
    p /= 35
    dh = np.stack([p @ net.p["V"][0].T, p[::-1] @ net.p["V"][1].T], axis=1)
    grad = net.backward(x, tape, dh)
    for k in ("U", "c", "W"):
        for at in (0, 3, 7, 20) if k != "W" else [((g * 2 + d) * 257 + int(x[2, 1])) * 16 + 3 for g in range(3) for d in range(2)]:
            flat = net.p[k].reshape(-1)
            old = flat[at]
            flat[at] = old + 1e-2
            up = loss()
            flat[at] = old - 1e-2
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-2 - grad[k].reshape(-1)[at]) < 2e-4, k


def test_p8_reading_equals_training_pass(trained):
    x = np.random.default_rng(1).integers(0, 257, (20, 9))
    h = trained.states(x)[0]
    assert np.allclose(h, trained.read(x, True), atol=1e-4) and np.allclose(h.sum(axis=0), trained.read(x, False), atol=1e-3)
    pieces = [b"nobody had asked", b"", "window é".encode(), b"a" * 700]
    flat, lens = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
    begin = np.cumsum(lens) - lens
    one = trained.pooled(flat, begin, lens)
    alone = np.concatenate([trained.pooled(flat, begin[k : k + 1], lens[k : k + 1]) for k in range(4)])
    each = np.stack([x.sum(axis=0) for x in trained.labelled(flat, begin, lens)])
    assert np.allclose(one, alone, atol=1e-3) and np.allclose(one, each, atol=1e-2) and (one[1] == 0).all()


@pytest.mark.parametrize(("label", "lang"), [("en-US", "en"), ("EN_gb", "en"), (" por ", "pt"), ("zh-Hans", "zh"), ("ger", "de"), ("und", None), ("", None), (None, None), ("it", None), ("unk", None)])
def test_p8_labels(label, lang):
    assert languages.label_language(label) == lang


def test_p8_documents(spark, trained):
    r = np.random.default_rng(5)
    text = lambda g, n=5: "".join(sentence(g, r) for _ in range(n))
    code = "\n```\n" + "def f(x):\n    return the_value_of_and_council(x)\n" * 20 + "```\n"
    rows = [(1, text("en"), "en-GB", "s"), (2, text("de"), "fr", "s"), (3, text("pt"), None, "s"), (4, text("en") + "\n\n" + text("zh", 12), "en", "s"), (5, text("fr", 12) + "“" + sentence("de", r) + "”", "fr", "s"), (6, None, "en", "s"), (7, "", "en", "s"), (8, "1234 5678", "en", "s"), (9, text("es") + code, "es", "s"), (None, text("en"), "en", "s"), (10, text("de", 400), "DEU", "s")]
    got = {}
    for x in languages.document_languages(docs(spark, rows), trained).collect():
        got.setdefault(x.doc_id, []).append((x.lang, x.as_labelled))
    assert {k: sorted(v) for k, v in got.items()} == {1: [("en", True)], 2: [("de", False)], 3: [("pt", False)], 4: [("en", False), ("zh", False)], 5: [("fr", True)], 9: [("es", True)], 10: [("de", True)]}
    runs = [(x.passage, x.lang) for x in languages.passage_languages(docs(spark, rows[3:4]), trained).orderBy("passage").collect()]
    assert runs == [(0, "en"), (1, "zh")]


# empty tables


def test_empty_tables(spark, vocab):
    none, no_docs = l2(spark, []), docs(spark, [])
    pool = spark.createDataFrame([], "parent_doc_id string, chunk_idx int, source string, url string")
    assert neardup.NearDuplicates(none).groups().count() == 0
    assert handwritten.not_handwritten(none, pool).count() == 0
    assert budget.token_cube(none, pool, spark.createDataFrame([], "doc_id string, lang string"), vocab).count() <= 1
    assert packing.training_rows(none, vocab).count() == 0
    assert leaks.leaks(no_docs, spark.createDataFrame([], "item_id string, lang string, prompt string")).count() == 0
    empty = cutoff.deciding_scores(spark.createDataFrame([], LEDGER), spark.createDataFrame([], "domain string, scorer_name string, scorer_version string, quota double"))
    assert cutoff.Cutoffs(empty).kept().count() == 0
    assert mixing.Mix(no_docs, spark.createDataFrame([], "source string, weight double, max_repeats int, total_tokens double"), vocab).shares().count() == 0
    assert languages.document_languages(no_docs).count() == 0 and languages.passage_languages(no_docs).count() == 0
