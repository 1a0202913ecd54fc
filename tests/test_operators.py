"""Operators on small tables: known answers, refusals, and rows that are null, empty, long, tied or repeated."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import code, components, conversations, decontam, dedup, filters, ledger, mix, near, pii, sampling, score, similar, stats
from sievework.operators.ordered import ranked, stars
from sievework.sources import readers, sinks
from sievework.streaming.streams import FRESH, first_divergence


def one(spark, column, text=None):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


# text


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.squash, "A b_c-9½!", "Abc9½"), (T.strip_special, " <|im_end|>x\u3000", "x"), (T.collapse, "\u3000a \n\t b\u2003", "a b"), (T.skeleton, "A  B", "a b"), (T.holdout_norm, "问：a, (b)？", "问ab"), (T.question_body, "问：多少？\n答：三", "多少？"),
        (T.question_body, "Question: why?\nAnswer: so", "why?"), (T.length_band, "x" * 400, "s"), (T.length_band, "x" * 8000, "xl"), (T.host, "https://u@a.example:80/x?y", "a.example:80"), (T.host, "nothing", None), (T.squash, None, None), (T.collapse, "", ""),
        (T.clean_context, "\x1b[31mred\x1b[0m\n\n\n\nx", "red\n\nx"), (T.code_norm, 'x = foo(1) # note\nreturn "s"', "@ = @(#) return "),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, f("text"), text) == want


def test_grams(spark):
    assert one(spark, T.char_grams("text", 5), "abc") == ["abc"] and one(spark, T.char_grams("text", 3), "ababa") == ["aba", "bab"]
    assert one(spark, T.word_grams(T.spaced_words("text"), 3), "a b") == [] and one(spark, T.word_grams(T.spaced_words("text"), 2), "a b a b") == ["a b", "b a"]
    assert one(spark, T.char_grams("text", 5), None) is None and one(spark, T.spaced_words("text"), "") == []
    assert one(spark, F.size(T.char_grams("text", 5)), "abcdefghij" * 20_000) == 10
    assert one(spark, T.bigram_set("text"), "甲乙 ab") == ["甲 乙"] and one(spark, T.bigram_set("text"), "a1 b2 c") == ["a1 b2", "b2 c"]


# filters


@pytest.mark.parametrize(("text", "want"), [(None, "short"), ("", "short"), ("x" * 99, "short"), ("x" * 100, None), ("x" * 200_001, "long"), ("x" * 150 + "\x00", "bad_bytes"), ("x" * 99 + "\x00" * 5, "bad_bytes")])
def test_light(spark, text, want):
    assert one(spark, filters.light_reason("text"), text) == want


ZH = "今天天气很好我们一起去公园散步看到很多人在那里跑步唱歌跳舞大家都很高兴。"


@pytest.mark.parametrize(("text", "want"), [(ZH * 8, None), ("word " * 60, "not_zh"), (ZH * 8 + "广告 扫码 上一篇", "boilerplate"), ("\n".join(["短行", "短行二"] * 4) + ZH * 6, "nav_menu"), ("\n".join([ZH] * 8), "dup_lines"), (ZH[:-1] * 8, "unfinished"), (ZH, "short")])
def test_web(spark, text, want):
    assert one(spark, filters.web_reason("text"), text) == want


def test_clean_and_headers(spark):
    assert one(spark, filters.clean_reason("text"), "加微信 " + ZH * 10) == "spam"
    assert one(spark, filters.clean_reason("text"), "重复的一段话，" * 60) == "repetitive"
    assert one(spark, filters.clean_reason("text"), "".join(f"词{i}。" for i in range(90))) == "fragmented"
    assert one(spark, filters.leading_header("text"), '#!/x\n\n"""doc\nmore"""\nimport os\n# late') == '#!/x\n"""doc\nmore"""\n'
    assert one(spark, filters.autogenerated("text"), "# Generated by the protocol buffer compiler (protoc). DO NOT EDIT!\nx = 1")
    assert not one(spark, filters.autogenerated("text"), "autogenerated = False\n# do not modify")
    assert one(spark, filters.markup_kind("text"), "<!doctype html><p>") == "markup" and one(spark, filters.markup_kind("text"), "a < b") == "code"


@pytest.mark.parametrize(("text", "n", "wrong"), [("3 + 4 = 7", 1, 0), ("3 × 4 = 13\n8 / 0 = 1", 2, 2), ("1 + 2 + 3 = 6", 0, 0), ("", 0, 0), (None, 0, 0), (".2 + 3 = 9", 0, 0), ("v1.2 + 3 = 9", 1, 1)])
def test_equations(spark, text, n, wrong):
    r = one(spark, filters.equation_check("text"), text)
    assert (r.n, r.wrong) == (n, wrong)


def test_chain_and_types(spark):
    assert one(spark, filters.chain_reason("text", F.lit("7")), "short") == "under_200"
    assert one(spark, filters.chain_reason("text", F.lit(None).cast("string")), "long enough " * 30) == "no_answer"
    r = one(spark, filters.weighted_types("text", {"a": [("x", 1)], "b": [("y", 2)]}), "x x x x x y")
    assert (r.primary, r.secondary, r.score) == ("a", "b", 3)
    assert one(spark, filters.weighted_types("text", {"a": [("x", 1)], "b": [("y", 2)]}), None).primary == "unclassified"


# dedup and decontamination


def test_first_rows(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, "z"), (1, "a", "x")], "ord int, key string, v string")
    assert sorted(r.ord for r in dedup.first_rows(t, "key", ["ord"]).collect()) == [1, 1, 3, 4]
    assert dedup.first_rows(t.limit(0), "key", ["ord"]).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_dedup_ignores_partitioning(spark, parts):
    t = spark.createDataFrame([(i, f"text {i % 7}!", f"s{i % 3}") for i in range(60)], "id long, text string, source string").repartition(parts)
    got = sorted(tuple(r) for r in dedup.duplicate_records(t, "text", "source", "id").collect())
    assert len(got) == 53 and all(r[3] == f"s{[i for i in range(7) if i % 7 == r[1] % 7][0] % 3}" for r in got)


def test_compare_and_union(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", None)], "k string, v string")
    b = spark.createDataFrame([("p", "1"), ("q", "3"), ("s", "4")], "k string, v string")
    assert {r.key: r.state for r in dedup.compare_tables(a, b, "k", dedup.fingerprint("v")).collect()} == {"p": "same", "q": "changed", "r": "missing", "s": "extra"}
    merged, conflicts = dedup.ledger_union(a, b, "k", ["v"])
    assert {r.k: r.v for r in merged.collect()} == {"p": "1", "q": "2", "r": None, "s": "4"} and [tuple(r) for r in conflicts.collect()] == [("q", "v", "2", "3")]


def test_decontam(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    gate = decontam.gate_grams(decontam.gate_parts(spark.createDataFrame([("h1", text, None), ("h2", "too short", "")], "id string, prompt string, answer string"), "id", ["prompt", "answer"]))
    docs = spark.createDataFrame([(1, "xx " + text.upper()), (2, "one two three"), (3, None), (4, "")], "id long, text string")
    hits = decontam.gram_hits(docs, "id", "text", gate).collect()
    assert [(h.id, h.item, h.part, h.n_grams) for h in hits] == [(1, "h1", "prompt", 2)]
    assert decontam.gram_hits(decontam.residual(docs, "id", spark.createDataFrame([(1,)], "id long")), "id", "text", gate).count() == 0
    held = spark.createDataFrame([("多少钱？",), ("",), (None,)], "q string")
    asked = spark.createDataFrame([(1, "问：多少钱？\n答：三元"), (2, "前文\n多少 钱\n后文"), (3, "别的"), (4, None)], "id long, text string")
    assert sorted(r.id for r in decontam.holdout_hits(asked, "id", "text", held, "q").collect()) == [1, 2]


def test_containment_separates(spark):
    prompt = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, prompt + " tail"), (2, " ".join(f"v{i}" for i in range(60))), (3, None), (4, prompt)], "id long, text string")
    items = spark.createDataFrame([("i", prompt), ("s", "a b c"), ("n", None)], "item string, prompt string")
    got = {(r.id, r.item): r.containment for r in decontam.containment(docs, "id", "text", items, "item", "prompt").collect()}
    assert got == {(1, "i"): 1.0}


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)] + [(500, 500 + i) for i in range(1, 300)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(500, 800)} == {500} and len(got) == 51 + 3 + 300
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near(spark):
    base = [f"w{i}" for i in range(60)]
    other = [*base[:30], "new", *base[30:]]
    t = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(f"v{i}" for i in range(60))), (4, None), (5, ""), (6, "a b"), (7, " ".join(base))], "id long, text string")
    pairs = near.similar_pairs(t, "id", "text")
    assert {(r.a, r.b) for r in pairs.collect()} >= {(1, 2), (1, 7)}
    groups = near.clusters(pairs)
    assert sorted(r.id for r in near.survivors(t, "id", groups).collect()) == [1, 3, 4, 5, 6]


def jaccard5(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y) if x and y else 0


def test_near_pairs_equal_brute_force(spark):
    r = np.random.default_rng(5)
    texts = []
    for g in range(12):
        base = [f"w{r.integers(5000)}" for _ in range(200)]
        for _ in range(10):
            w = list(base)
            for at in r.choice(200, 2, replace=False):
                w[at] = f"x{r.integers(5000)}"
            texts.append(" ".join(w))
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard5(texts[i], texts[j]) >= 0.8}
    assert len(want) > 50
    assert {(r.a, r.b) for r in near.similar_pairs(t, "id", "text").collect()} == want


def test_keep_whole_and_cross_share_see_all_pairs(spark):
    copy, new = " ".join(f"w{i}" for i in range(60)), " ".join([*(f"w{i}" for i in range(60)), "new"])
    rows = [(1, copy, "other"), (2, copy, "whole"), (3, copy, "other"), (4, new, "third"), (5, " ".join(f"v{i}" for i in range(60)), "other")]
    t = spark.createDataFrame(rows, "id long, text string, domain string")
    pairs = near.similar_pairs(t, "id", "text")
    assert sorted(r.id for r in near.keep_whole(t, "id", "domain", "whole", pairs).collect()) == [2, 5]
    r = near.report(pairs, t, "id", "domain", 5, (0.8,), (0.8, 0.99)).first()
    assert (r.participating, r.dropped, r.groups, r.cross_domain, r.pairs, r.band_pairs) == (4, 3, 1, round(5 / 6, 6), 6, 3) and r.low < 0.8 < r.high
    assert [(x.a, x.b) for x in near.top_pairs(pairs).collect()] == [(1, 4)]
    check = near.whole_check(t, "id", "domain", "other", pairs, near.clusters(pairs)).first()
    assert (check.whole_pairs, check.spared) == (1, 1)
    empty = near.report(pairs.where("false"), t.where("false"), "id", "domain", 0).collect()
    assert len(empty) == 3 and all(x.participating == 0 and x.pairs == 0 for x in empty)


def test_seen_is_greedy(spark):
    r = np.random.default_rng(5)
    sigs = [[int(x) for x in r.integers(0, 4, 6)] for _ in range(120)] + [[9, 9, 9, 9, 9, 9]] * 5
    kept, want = [], {}
    for k, s in enumerate(sigs):
        mine = {(i, *s[2 * i : 2 * i + 2]) for i in range(3)}
        want[k] = any(mine & other for other in kept)
        if not want[k]:
            kept.append(mine)
    t = spark.createDataFrame(list(enumerate(sigs)), "id long, sig array<long>")
    assert {x.id: x.seen for x in near.seen_before(t, "id", 3, 2).collect()} == want
    assert near.seen_before(t.where("false"), "id", 3, 2).count() == 0


@pytest.mark.parametrize("block", [3, 256])
def test_similarity_bands_equal_all_pairs(spark, block):
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 14, 12)) for _ in range(23)] + ["", None]
    sets = [set(t.split()) for t in texts if t]
    alike = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
    got = near.similarity_bands(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", block=block).first()
    count = lambda lo, hi: sum(lo <= x < hi for x in alike)
    assert (got.pairs, got.from_0_3, got.from_0_5, got.from_0_7) == (len(alike), count(0.3, 0.5), count(0.5, 0.7), count(0.7, 2))


@pytest.mark.parametrize("block", [1, 3, 512])
def test_meeting_loses_no_pair(spark, block):
    r = np.random.default_rng(6)
    sets = [sorted({int(x) for x in r.integers(0, 14, 8)}) for _ in range(150)]
    t = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, h array<long>")
    order = similar.frequent(t.select(F.explode("h").alias("h")))
    pairs = similar.exact(similar.meeting(similar.keyed(t, order, 0.6), 0.6, block), t, 0.6)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if 10 * len({*sets[i]} & {*sets[j]}) >= 6 * len({*sets[i]} | {*sets[j]})}
    assert sorted((x.a, x.b) for x in pairs.collect()) == sorted(want)


def test_containment_of_whole_prompts(spark, tmp_path):
    from sievework.plans import catalog

    prompt = " ".join(f"word{i}" for i in range(40))
    rows = [(1, prompt[90:150]), (2, prompt[:60] + " and something else"), (3, "so: " + prompt), (4, "nothing of the kind in this text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", prompt)], "item_id string, prompt string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert sorted((r.doc_id, r.item) for r in catalog.queries()["containment_pairs"](spark, str(tmp_path)).collect()) == [(1, "a"), (3, "a")]


# ranks, quotas, samples


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 5)), min_size=0, max_size=40))
def test_ranked(spark, rows):
    t = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], "g string, v int, i int")
    got = {r.i: (r["rank"], r.before, r.group_rows) for r in ranked(t, ["g"], [F.col("v").desc(), F.col("i")], "v").collect()}
    for g in "ab":
        own = sorted(((v, i) for i, (h, v) in enumerate(rows) if h == g), key=lambda x: (-x[0], x[1]))
        total = 0
        for k, (v, i) in enumerate(own):
            assert got[i] == (k + 1, total, len(own))
            total += v


def test_ranked_with_null_groups(spark):
    t = spark.createDataFrame([(None, 1), (None, 2), ("a", None)], "g string, v int")
    assert sorted((r.g or "", r["rank"], r.before) for r in ranked(t, ["g"], [F.col("v")], "v").collect()) == [("", 1, 0), ("", 2, 1), ("a", 1, 0)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30)), max_size=80))
def test_stars_tie_buckets_over_partitions(spark, rows):
    t = spark.createDataFrame([*rows, (None, 1), (2, None)], "b long, m long")
    for df in (t, t.selectExpr("cast(b as string) b", "cast(m as string) m")):
        edges = [(int(r.hub), int(r.member)) for r in stars(df, "b", "m").collect()]
        assert len(set(edges)) == len(edges) and all(a != b for a, b in edges)
        for k in {b for b, _ in rows}:
            own = {m for b, m in rows if b == k}
            seen, todo = set(), [min(own)]
            while todo:
                x = todo.pop()
                seen.add(x)
                todo += [b if a == x else a for a, b in edges if x in (a, b) and {a, b} <= own and (b if a == x else a) not in seen]
            assert own == seen
        assert len(edges) <= sum(len({m for b, m in rows if b == k}) for k in {b for b, _ in rows}) + 16


def test_quota_ties_and_bounds(spark):
    t = spark.createDataFrame([("g", f"d{i}", 1.0) for i in range(10)], "g string, doc_id string, value double")
    assert sorted(r.doc_id for r in sampling.quota_rows(t, ["g"], 0.3).where("rank <= keep").collect()) == ["d0", "d1", "d2"]
    with pytest.raises(ValueError):
        sampling.quota_rows(t, ["g"], 0.0)


@pytest.mark.parametrize(("sizes", "target", "floor"), [({"a": 60, "b": 3, "c": 0, "d": 17}, 40, 5), ({"a": 60, "b": 3}, 500, 5), ({"a": 9, "b": 9, "c": 9}, 4, 3), ({"a": 7, "b": 7, "c": 7}, 10, 0), ({"a": 0}, 5, 1), ({}, 5, 1)])
def test_allocation(spark, sizes, target, floor):
    got = {r.k: r.quota for r in sampling.allocate(spark.createDataFrame(list(sizes.items()), "k string, n long"), "n", target, floor).collect()}
    assert got.keys() == sizes.keys() and all(min(floor, sizes[k]) <= v <= sizes[k] for k, v in got.items())
    assert sum(got.values()) == max(sum(min(floor, n) for n in sizes.values()), min(target, sum(sizes.values())))
    even = {k: v for k, v in got.items() if sizes[k] == max(sizes.values(), default=0)}
    assert not even or max(even.values()) - min(even.values()) <= 1


@given(st.text(alphabet="ab \n", max_size=400))
def test_chunks_join_to_the_text(text):
    assert "".join(sampling.window_chunks(text, 3, 8)) == text
    assert "".join(sampling.code_chunks(text, 20)) == text


def test_code_chunks():
    src = "import a\n\n\n@d\ndef f():\n    return 1\n\n\nclass B:\n    x = 2\n"
    assert sampling.code_chunks(src, 12) == ["import a\n\n\n", "@d\ndef f():\n    return 1\n\n\n", "class B:\n    x = 2\n"]


# statistics


def test_closed_forms(spark):
    assert stats.binomial_tail(10, 2) == pytest.approx(56 / 1024)
    t = spark.createDataFrame([(0, 0), (1, 9), (5, 5)], "b long, c long")
    assert [round(r.p, 6) for r in t.select(stats.mcnemar("b", "c").alias("p")).collect()] == [1.0, round(2 * 11 / 1024, 6), 1.0]
    v = one(spark, F.struct(*(stats.percentile_place(F.array(*(F.lit(float(i)) for i in range(1, 5))), 0.5, r).alias(r) for r in ("nearest", "floor", "cut", "linear"))))
    assert tuple(v) == (3.0, 2.0, 3.0, 2.5)
    assert one(spark, stats.percentile_place(F.array().cast("array<double>"), 0.5, "linear")) is None


def test_refusals(spark):
    a = spark.createDataFrame([("x", 1.0, 10.0)], "k string, ce_sum double, n_tokens double")
    with pytest.raises(stats.Refused):
        stats.block_paired(a, spark.createDataFrame([("y", 1.0, 10.0)], "k string, ce_sum double, n_tokens double"), ["k"])
    with pytest.raises(stats.Refused):
        stats.block_paired(a, spark.createDataFrame([("x", 1.0, 11.0)], "k string, ce_sum double, n_tokens double"), ["k"])
    with pytest.raises(stats.Refused):
        stats.equal_samples(spark.createDataFrame([("a",), ("a",), ("b",)], "task string"), "task")


def test_bootstrap_covers_and_repeats(spark):
    r = np.random.default_rng(3)
    t = spark.createDataFrame([(i, float(a), float(a + 0.5 + r.normal(0, 0.1))) for i, a in enumerate(r.normal(0, 1, 80))], "k long, a double, b double")
    x, y = stats.bootstrap(t, "k", 100, 1).first(), stats.bootstrap(t.repartition(7), "k", 100, 1).first()
    assert x.lo < 0.5 < x.hi and math.isclose(x.lo, y.lo, abs_tol=1e-9)


@pytest.mark.parametrize(("steps", "want"), [([("+", ["3", "4"]), ("*", ["step0", "2"])], "14"), ([("/", ["7", "2"])], "7/2"), ([("/", ["1", "0"])], None), ([("^", ["1", "2"])], None), ([], None), ([("-", ["step1", "2"])], None)])
def test_recompute(steps, want):
    assert stats.recompute(steps) == want


@given(st.text(alphabet="ab", max_size=40), st.integers(2, 5))
def test_repeats_equal_brute_force(text, gram):
    n = len(text)
    runs = lambda k: [text[i : i + k] for i in range(n - k + 1)]
    longest = max((k for k in range(1, n) if len(set(runs(k))) < n - k + 1), default=0)
    twice = [i for i, g in enumerate(runs(gram)) if runs(gram).count(g) > 1]
    tail = next((p for p in range(1, n + 1) for r in [next(r for r in range(n // p, 0, -1) if text.endswith(text[n - p :] * r))] if r >= 3 and p * r >= 6), 0)
    assert stats.repeats(list(text), gram, least_span=6) == (longest, len({i + k for i in twice for k in range(gram)}), tail)


def test_slots_of_heads(spark):
    from pyspark.ml.feature import HashingTF

    from sievework.operators import heads

    r = np.random.default_rng(3)
    values = r.integers(-(1 << 62), 1 << 62, 50)
    t = HashingTF(inputCol="g", outputCol="f", numFeatures=1 << 18, binary=True).transform(spark.createDataFrame([([int(v) for v in values],)], "g array<long>"))
    assert sorted(set(heads.slots_of(values, 1 << 18))) == [int(i) for i in t.first().f.indices]  # the slots are HashingTF's
    lists = [np.unique(r.integers(0, 1 << 18, n)) for n in (0, 5, 3000, 1, 0, 40)]
    slots, n = heads.unpacked(pa.array([heads.packed(x) for x in lists], pa.binary()).slice(1, 4))
    assert list(n) == [len(x) for x in lists[1:5]] and list(slots) == list(np.concatenate(lists[1:5]))
    search, by = heads.minimised(np.ones(9), 60), np.arange(1.0, 10)
    x = next(search)
    try:
        while True:
            x = search.send((by @ x**2 / 2 - x.sum(), by * x - 1))
    except StopIteration as end:
        assert np.allclose(end.value, 1 / by, atol=1e-2)


def test_byte_grams_leave_python_packed(spark):
    from sievework.operators import heads

    t = spark.createDataFrame([(k, f"text {k} of some words " * 5 if k else None) for k in range(600)], "id int, t string").coalesce(1)
    rows = heads.gram_slots(t, "t", score.byte_and_word_hashes, 1 << 18, True).collect()
    for r in rows[::97]:
        want = np.unique(heads.slots_of(score.byte_and_word_hashes(r.t), 1 << 18))
        slots, n = heads.unpacked(pa.array([bytes(r.slots)], pa.binary()))
        assert list(slots) == list(want) and r.norm == pytest.approx(math.sqrt(len(want))) and r.times is None
        assert len(r.slots) <= len(want) + (1 << 18) // 255  # 8 bytes a gram before
    assert len(rows) == 600


def test_wilson_of_many_trials(spark):
    low, high = one(spark, F.struct(*(x.alias(c) for x, c in zip(stats.wilson(F.lit(10), F.lit(100_000), 1.96), "lh"))))
    p, n, z = 1e-4, 100_000, 1.96
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    assert (low, high) == (pytest.approx(mid - half), pytest.approx(mid + half))
    pairs, t = spark.createDataFrame([(1, 2, 0.9)], "a long, b long, jaccard double"), spark.createDataFrame([(1, "x"), (2, "y")], "id long, domain string")
    assert near.report(pairs, t, "id", "domain", 100_000, (0.8,)).first().participation == 2e-5  # a corpus of 100,000 texts


def test_repeats_of_a_long_text():
    words = [str(x) for x in np.random.default_rng(0).integers(0, 50_000, 200_000)]
    assert stats.repeats(words + words[:500])[0] >= 500  # in seconds, not hours


def test_quality_heads(spark):
    r = np.random.default_rng(1)
    word = lambda letters: "".join(letters[k] for k in r.integers(0, len(letters), 5))
    rows = [(k, " ".join(word("abcde" if k % 2 else "vwxyz") for _ in range(12)), k % 2 == 1) for k in range(60)] + [(60, None, True), (61, "", False)]
    t = spark.createDataFrame(rows, "id int, t string, good boolean")
    for kind in ("chars", "bytes"):
        scored = score.text_head(t, ["id"], "t", F.col("good"), kind)
        auc = score.rank_auc(scored.where("id < 60").withColumn("y", F.col("label") == 1), "y", "score", ["id"]).first()
        assert auc.auc == 1.0 and auc.positives == 30 and scored.count() == 62
    assert {x.score for x in score.text_head(t.where("good"), ["id"], "t", F.col("good")).collect()} == {0.0}
    grams = one(spark, score.byte_and_word_grams(F.col("text")), "ab ab")
    raw = b"ab ab"
    want = {int.from_bytes(raw[i : i + n], "big") | n << 40 for n in range(2, 6) for i in range(len(raw) - n + 1)}
    assert want <= set(grams) and len(grams) == len(set(grams)) == len(want) + 2  # the word ab, and ab after ab
    p = score.score_percentiles(spark.range(101).withColumn("t", F.when(F.col("id") == 100, "必威")).select(score.penalised(F.col("id").cast("double"), "t", "必威").alias("s")), "s").first()
    assert (p.n, p.p1, p.p50, p.p99) == (101, 1.0, 50.0, 98.0)


def test_sft_rows(spark):
    rows = [(k, list(range(1, k % 9 + 2)), k % 4) for k in range(200)] + [(900, list(range(50)), 3), (901, None, 1), (902, [5, 6], 9)]
    got = mix.sft_rows(spark.createDataFrame(rows, "id long, ids array<int>, p int"), "id", "ids", "p", 24, 0, block=60).collect()
    assert all(len(r.input_ids) == len(r.labels) == 24 for r in got)
    seen = []
    for r in got:
        ids, labels = list(r.input_ids), list(r.labels)
        for _ in range(r.n_examples):
            end = ids.index(0)
            seen.append((ids[: end + 1], labels[: end + 1]))
            ids, labels = ids[end + 1 :], labels[end + 1 :]
        assert set(ids) <= {0} and set(labels) <= {-100}
    want = [([*i, 0], [-100] * min(p, len(i) + 1) + [*i, 0][p:]) for k, i, p in rows if i and k != 900]
    assert sorted(seen) == sorted(want)


def test_packed_rows(spark):
    t = spark.createDataFrame([("g", k, list(range(10 * k, 10 * k + k))) for k in range(30)] + [("h", 0, [7]), ("h", 1, None), ("h", 2, []), (None, 1, [1, 2])], "g string, k int, ids array<int>")
    got = {(r.g, r.row): r.ids for r in sinks.packed(t, ["g"], [F.col("k")], "ids", 7).collect()}
    flat = [x for k in range(30) for x in range(10 * k, 10 * k + k)]
    assert got == {("g", i): flat[7 * i : 7 * i + 7] for i in range(-(-len(flat) // 7))} | {("h", 0): [7], (None, 0): [1, 2]}


def test_steps_are_removed(spark):
    import os

    from sievework.session import discard, materialize, temporary

    there = lambda df: os.path.isdir(df.written_to.removeprefix("file:"))
    with temporary() as keep:
        a, b = materialize(spark.range(3)), materialize(spark.range(4))
        with temporary() as keep_inside:
            c, d = materialize(spark.range(5)), keep_inside(materialize(spark.range(6)))
        assert not there(c) and there(d) and there(a)
        keep(b)
    assert not there(a) and there(b) and not there(d) and b.count() == 4
    discard(b)
    assert not there(b)


def test_repeats_and_outputs(spark):
    assert stats.repeats(list("abcdefghXabcdefgh"))[:2] == (8, 16) and stats.repeats(list("start") + list("xy") * 20)[2] == 2 and stats.repeats([]) == (0, 0, 0)
    f = lambda a, b, tol=None: one(spark, stats.stdout_equal(F.lit(a), F.lit(b), tol))
    assert f("1 \n2\n\n", "1\n2") and not f("1", "2") and f("0.3333", "0.33334", 1e-3) and not f("a 1", "b 1", 1e-3) and f(None, "")
    assert one(spark, stats.last_number(F.lit("so 1,234.5 apples"))) == 1234.5 and one(spark, stats.last_number(F.lit("none"))) is None


# ledgers


def test_fold_is_free_of_order(spark):
    rows = [("r", "s", "running", 1, None, None), ("r", "s", "ok", 2, None, None), ("r", "s", "running", 3, None, None), ("m", "s", "ok", 1, None, None), ("m", "s", "ok", 2, "monitor", None), ("x", "s", "retracted", 2, None, None), ("x", "s", "ok", 3, None, None), ("y", "s", "retracted", 2, None, None), ("y", "s", "ok", 3, None, True)]
    schema = "name string, started string, status string, n int, writer string, un boolean"
    for order in (rows, rows[::-1]):
        t = ledger.fold_events(spark.createDataFrame(order, schema), ["name", "started"], "status", F.col("n"), F.col("writer"), F.col("un"))
        assert {r.name: (r.status, r.n) for r in t.collect()} == {"r": ("ok", 2), "m": ("ok", 1), "x": ("retracted", 2), "y": ("ok", 3)}


def test_log_and_detector(spark):
    lines = spark.createDataFrame([(1, "step 1/9 loss 2.0"), (2, "step 1/9 loss 3.0"), (3, "step 2/9 loss nan"), (4, "noise"), (5, None)], "n int, line string")
    assert [tuple(r) for r in ledger.parse_log(lines, "line", "n", {"loss": r"loss (\S+)"}).collect()] == [("loss", 1, 3.0)]
    series = [(1, 1.0, 11.0), (1, 1.0, 11.0), (2, 1.0, 1.0), (3, 1.0, 12.0), (4, 1.0, 12.0), (5, 99.0, 99.0)]
    for cut in range(len(series) + 1):  # the answer doesn't depend on how the readings come in
        held, hits = FRESH, []
        for part in (series[:cut], series[cut:]):
            held, hit = first_divergence(held, *(np.array([r[k] for r in part]) for k in range(3)), in_a_row=2, window=3, mean_above=5)
            hits += [hit] if hit else []
        assert hits == [(4, "gnorm")]
    one = lambda *r, **k: first_divergence(FRESH, *(np.array([x]) for x in r), **k)[1]
    assert one(1, float("nan"), 1.0) == (1, "nonfinite") and one(1, 1.0, float("inf")) == (1, "nonfinite") and one(1, 9.0, 1.0, window=1) == (1, "loss") and one(1, 9.0, 1.0) is None
    rows = spark.createDataFrame([("r", s, float(x), float(g), s) for s, x, g in [(1, 1, 11), (2, 1, 1), (3, 1, 12), (4, 1, 12), (5, 9, 9)]], "k string, step int, loss double, gnorm double, _n int")
    assert [tuple(r) for r in ledger.divergence(rows, ["k"], "step", "loss", "gnorm", g_consec=2).collect()] == [("r", 4, "gnorm")]


def test_append_refuses(spark, tmp_path):
    schema = "doc_id string, domain string, scorer_name string, scorer_version string, ts string, score double, rubric_dims map<string,int>, src_sha string"
    good = ("d", "x", "s", "1", "2026-01-01T00:00:00Z", 1.0, None, None)
    assert sinks.append_ledger(spark.createDataFrame([good], schema), f"{tmp_path}/l") == 1
    for bad in [("", *good[1:]), (*good[:4], "2026-01-01", *good[5:]), (*good[:5], None, None, None), (*good[:5], float("nan"), None, None), (*good[:5], None, {"a": 9}, None), (*good[:7], "zz")]:
        with pytest.raises(ValueError):
            sinks.append_ledger(spark.createDataFrame([bad], schema), f"{tmp_path}/l")
    assert spark.read.parquet(f"{tmp_path}/l").count() == 1


# scorers


def test_kneser_ney_sums_to_one(spark):
    train = spark.createDataFrame([("a b a c",), ("a b b",), ("c a b",)], "text string")
    model = score.KneserNey(score.gram_counts(train, "text", 3))
    assert 0 < model.d < 1
    p = {r.id: r.perplexity for r in model.perplexity(score.trigram_uses(spark.createDataFrame([(1, "a b"), (2, "z z z"), (3, ""), (4, None)], "id int, text string"), "text", "id"), "id").collect()}
    assert set(p) == {1, 2} and p[1] < p[2]
    with pytest.raises(ValueError):
        score.KneserNey(score.gram_counts(train.limit(0), "text", 3))


def test_rubric(spark):
    assert one(spark, score.rubric_scores(F.lit('so: {"a": 3, "b": 5}'), ["a", "b"])) == {"a": 3, "b": 5}
    for bad in ('{"a": 3}', '{"a": 3, "b": 6}', '{"a": 3, "b": 2.5}', "none", None):
        assert one(spark, score.rubric_scores(F.lit(bad).cast("string"), ["a", "b"])) is None
    assert one(spark, score.reply_number(F.lit("<think>7</think> 4.5"))) == 4.5


# conversations, code, secrets


def test_conversations(spark):
    text = "User: hi\nthere\nAssistant: hello\n\nUser: bye"
    assert [m["content"] for m in conversations.parse(text)] == ["hi\nthere", "hello", "bye"] and conversations.parse(None) == [] and conversations.parse("no roles") == []
    t = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a"), ("tool", "r"), ("assistant", "b")]), (2, [("assistant", "x")]), (3, [("user", "q"), ("user", "z")]), (4, [("user", "/compact"), ("assistant", "a")]), (5, [("user", "q"), ("tool", "t"), ("assistant", "a")]), (6, [])], "id int, ms array<struct<role:string,content:string>>")
    assert {r.id: r.x for r in t.select("id", conversations.unusable(F.col("ms")).alias("x")).collect()} == {1: None, 2: "few_turns", 3: "no_answer", 4: "unactionable", 5: "orphan_tool", 6: "few_turns"}
    pairs = conversations.agentic_pairs(t.where("id = 1"), "id", "ms").orderBy("turn").collect()
    assert [p.turn for p in pairs] == [1, 3] and pairs[1].prompt.count("<|im_start|>") == 4 and pairs[0].completion == "a<|im_end|>"


def test_code():
    assert conversations.fences("x\n```py\na = 1\n```\n```\nopen") == [{"lang": "py", "code": "a = 1"}, {"lang": "", "code": "open"}]
    assert conversations.top_imports("import a.b, c\nfrom d.e import f\nfrom . import g") == ["a", "c", "d"] and conversations.top_imports("(") == []
    (p,) = conversations.python_functions('def f(x):\n    """Doc."""\n    return x\n\ndef g():\n    pass\n')
    assert p["name"] == "f" and p["stub"] + p["body"] == 'def f(x):\n    """Doc."""\n    return x' and p["body"].strip() == "return x"
    assert code.parses("x = 1") and not code.parses("x = (") and not code.parses("") and not code.parses(None)
    fails = {"print 'x'": "python2", "x = 0777": "python2", "def f(": "cut_off", "if x:\n": "cut_off", "x = 1": None, "": "empty", "x = \u201c1\u201d\n": "character", "if x:\n  y\n z\n": "indentation", "x = {{ name }} +\ny = {% if %}\n": "template"}
    fails |= {"#include <stdio.h>\nint main(void) { printf(\"x\"); return 0; }\n": "other_language", "This is how we count the boxes in the hall\nx = 1\n": "prose", "x = = 1\ny = 2\n": "broken", None: "empty"}
    assert {k: code.failure(k) for k in fails} == fails
    assert code.strip("a /* b\n */ 'c' // d\ne") == ("a     \n" + " " * 12 + "\ne", True) and code.strip("x /* y")[1] is False and code.strip("x = `a\nb`", "js") == ("x =   \n  ", True)
    pad = "\n// and some more text, so that it is long enough to be judged at all, whatever it holds\n"
    assert [code.code_language(t + pad)[0] for t in ("function f(a) { const b = a => a === 1; console.log(b); module.exports = f; }", "#include <stdio.h>\nint main(void) { printf(\"%zu\", sizeof(size_t)); return 0; }")] == ["js", "c"]
    assert [code.code_language(t + pad)[1] for t in ("package main\nfunc f() error { x := errors.New(\"a\"); defer g(); return nil }", "<div>\n<p>a</p>\n<p>b</p>\n</div>", "a = 1\nb = 2\nc: 3\n[d]", "x\0y" * 9, "words of no language")] == ["foreign:go", "markup", "settings", "binary", "unclear"]
    java = "package a.b;\nimport java.util.List;\npublic class A {\n  private int x = 1;\n  public void f() { System.out.println(\"(\"); }\n}\n"
    assert code.code_language(java)[0] == "java" and code.code_language(java[:-4])[1] == "unbalanced" and code.code_language("x")[1] == "too_short"
    assert code.code_language("#include <vector>\nnamespace a {\nstd::vector<int> f() { std::vector<int> v; return v; }\n}\n// more text to be long enough\n")[0] == "cpp"


@pytest.mark.parametrize(("text", "want"), [(r"so \boxed{\frac{1}{2}} then", r"\frac{1}{2}"), (r"\boxed{1} \boxed{2}", "2"), (r"\boxed{1", None), ("none", None), (None, None)])
def test_boxed(text, want):
    assert code.boxed(text) == want


@pytest.mark.parametrize(("a", "b", "same"), [(r"\frac{1}{2}", "0.5", True), ("1,000", "1000", True), ("3/6", "1/2", True), ("12元", "12", True), ("0.33333", "1/3", True), ("x", "y", False), (None, "1", False), ("1/0", "1", False)])
def test_answers(a, b, same):
    assert code.same_answer(a, b) is same


def test_secrets(spark):
    secret = "aB3dE5fG7hI9jK1lM2nO4pQ6rS8tU0vWxYz"
    assert len(pii.spans(f"key {secret} end")) == 1 and pii.spans(f"sha256: {secret}") == [] and pii.spans("a" * 40) == [] and pii.spans(None) == []
    assert one(spark, pii.redact("text"), f"key {secret} end") == "key <OPAQUE> end" and one(spark, pii.redact("text"), "x" * 10) == "x" * 10
    assert one(spark, pii.scrub("text", ["corp.example"]), "/home/ann/x -Users-ann- a.b@c.de https://x.corp.example/y") == "<HOME>/x -Users-<USER>- <EMAIL> <INTERNAL_DOC>"
    assert one(spark, pii.credential_classes(F.col("text")), "--token=abcd1234efgh API_KEY=$KEY PASSWORD=<your-password>") == ["flag"]


# mixes, sources


def test_mix():
    assert mix.pack_block([6, 5, 4, 11, 5], 10) == [0, 1, 0, -1, 1]
    assert mix.pack_block([9, 5, 4, 1], 10, 1) == [0, 1, 1, 1] and mix.pack_block([9, 5, 4, 1], 10, 4) == [0, 1, 1, 0] and mix.pack_block([], 10) == []
    assert mix.composition({"a": 10.0, "b": 20.0}, {"a": 100, "b": 10}, {"a": 1.0, "b": 1.0}) == {"a": 20, "b": 10}
    assert mix.reconciled([0.1, None, 0.1]) == 0.1 and mix.reconciled([]) == 0.0
    with pytest.raises(mix.Drift):
        mix.reconciled([0.1, 0.2])


def test_replay_and_drift(spark):
    plan = spark.createDataFrame([("a", 10), ("b", 5)], "domain string, n long")
    got = {r.domain: (r.used, r.left, r.retired) for r in mix.replay(plan, spark.createDataFrame([("a", 4), ("z", 3)], "domain string, used long")).collect()}
    assert got == {"a": (4, 6, False), "b": (0, 5, False), "z": (3, 0, True)}
    with pytest.raises(mix.Drift):
        mix.replay(plan, spark.createDataFrame([("a", 11)], "domain string, used long"))
    f = lambda *r: spark.createDataFrame(r, "domain string, fp string")
    assert {r.domain for r in mix.drift(f(("a", "1"), ("b", "2")), f(("a", "1"), ("b", "3"), ("c", "4"))).collect()} == {"b", "c"}


def test_jsonl(spark, tmp_path):
    (tmp_path / "web.v1.jsonl").write_text('{"content": "a\u2028b", "url": "u"}\n\n{"text": "t"}\n{"instruction": "q", "output": "r"}\n{"content": ""}\nbroken\n', encoding="utf-8")
    rows = readers.jsonl(spark, str(tmp_path))
    got = sorted((r.content or "", r.source, r.bad) for r in rows.collect())
    assert [g[0] for g in got] == ["", "", "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nr<|im_end|>", "a\u2028b", "t"] and {g[1] for g in got} == {"web"} and sum(g[2] for g in got) == 1
    assert tuple(readers.accounted(rows).first()) == (5, 1, 1)
    with pytest.raises(ValueError):
        readers.from_spec(spark, "hub:x")


def test_torn_tail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n{"id": "2"}\n{"id": "3', encoding="utf-8")
    assert sorted((r.id or "", r.torn) for r in readers.torn_tail(spark, str(tmp_path), "id").collect()) == [("", True), ("1", False), ("2", False)]
    (tmp_path / "a.jsonl").write_text('{"id": \n{"id": "2"}\n', encoding="utf-8")
    with pytest.raises(ValueError):
        readers.torn_tail(spark, str(tmp_path), "id")


def test_union_refuses(spark):
    a = spark.createDataFrame([(1,)], "x int")
    assert sinks.union_all([a, a], 2).count() == 2
    with pytest.raises(ValueError):
        sinks.union_all([a, a], 3)
