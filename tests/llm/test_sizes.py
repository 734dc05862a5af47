"""Tokens, packing and mixing."""

import itertools
import os
import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from triloom.llm import mixing, packing, tokenizer

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokenizer.vocabulary_path()), reason="no vocabulary file here")
PIECES = st.sampled_from(["a", "the", "Déjà", "12", "'s", "…", "日本", "\t", "\n", " ", "  ", "\r\n", " ", " ", "\x1c", "!", "-", "x" * 50])


@needs_vocabulary
@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_counts_are_exact(text):
    c = tokenizer.counter(tokenizer.vocabulary_path())
    assert c(text) == len(c.encode(text))


@needs_vocabulary
def test_tokens_of_a_table(spark):
    long = "word " * 50_000
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", None), (4, long, "z")], "id int, text string, other string")
    got = tokenizer.with_tokens(df)
    assert got.columns == ["id", "other", "tokens"]
    c = tokenizer.counter(tokenizer.vocabulary_path())
    assert rows(got, "id", "tokens") == [(1, 2), (2, 0), (3, 0), (4, len(c.encode(long)))]
    assert tokenizer.with_tokens(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="already"):
        tokenizer.with_tokens(df, into="other")


def fewest(sizes, capacity):
    best = len(sizes)
    for order in itertools.permutations(sizes):
        room, n = 0, 0
        for s in order:
            if s > room:
                room, n = capacity, n + 1
            room -= s
        best = min(best, n)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=7))
def test_packing_is_near_the_best(sizes):
    bins = packing.pack(sizes, 30)
    load: dict = {}
    for s, b in zip(sizes, bins, strict=True):
        load[b] = load.get(b, 0) + s
    assert all(v <= 30 for v in load.values())
    assert sorted(load) == list(range(len(load)))
    assert len(load) <= fewest(sizes, 30) + 1 if sizes else not load


def test_large_items_are_matched_in_pairs():
    assert packing.pack([9, 6, 5, 4, 1], 10) == [0, 1, 2, 1, 0]
    assert packing.pack([10, 10], 10) == [0, 1]
    assert packing.pack([], 10) == []


def test_packed_table(spark):
    r = random.Random(1)
    sizes = [(i, r.choice([0, 3, 10, 40, 70, 99, 100, 101, 250, 1000]), "c") for i in range(3000)] + [(None, 5, "c"), (5000, None, "c")]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint, container string")
    kinds = spark.createDataFrame([("big", 1000), ("small", 100), ("none", 0)], "container string, capacity_tokens int")
    p = packing.packed(df, kinds, group_items=500)
    got = p.collect()
    want = {i: n or 0 for i, n, _ in sizes if i is not None}
    for c, cap in (("big", 1000), ("small", 100)):
        own = [x for x in got if x.container == c]
        load: dict = {}
        parts: dict = {}
        for x in own:
            load[x.bin_id] = load.get(x.bin_id, 0) + x.tokens
            parts.setdefault(x.doc_id, []).append((x.size_from, x.size_to))
            assert x.size_to - x.size_from == x.tokens
        assert max(load.values()) <= cap
        assert set(parts) == set(want)
        for i, ps in parts.items():
            ps.sort()
            assert ps[0][0] == 0
            assert ps[-1][1] == want[i]
            assert all(a[1] == b[0] for a, b in itertools.pairwise(ps))
            assert len(ps) == max(1, -(-want[i] // cap))  # split only if larger
    f = {x.container: x for x in packing.fill(p, kinds).collect()}
    assert f["big"].used == f["small"].used == sum(want.values())
    assert f["big"].filled > 0.98
    assert rows(p) == rows(packing.packed(df.repartition(7), kinds, group_items=500))
    assert packing.packed(df.limit(0), kinds).count() == 0
    assert packing.packed(df, kinds.limit(0)).count() == 0


TARGETS = "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def corpus_sizes(spark):
    r = random.Random(2)
    data = [(i, ("web" if i % 3 else "law") if i < 5000 else "rare", r.randrange(1, 400), f"d{i // 2}" if i % 5 == 0 else None) for i in range(5100)]
    data += [(9000, None, 50, None), (9001, "other", 50, None), (9002, "web", 0, None), (9003, "web", None, None)]
    return spark.createDataFrame(data, "doc_id bigint, source string, tokens bigint, docket string").repartition(4)


def test_shares_are_reached_within_the_caps(spark, corpus_sizes):
    targets = spark.createDataFrame([("web", 0.5, 1), ("law", 0.2, 2), ("rare", 0.1, 8), ("absent", 0.2, 9)], TARGETS)
    docs = mixing.version_weights(corpus_sizes, "doc_id", "docket")
    m = mixing.mixed(docs, targets)
    got = m.collect()
    assert len({x.doc_id for x in got}) == len(got)
    cap = {"web": 1, "law": 2, "rare": 8}
    assert all(1 <= x.copies <= cap[x.source] for x in got)
    s = {x.source: x for x in mixing.shares(m, targets).collect()}
    assert s["absent"].documents == 0
    for k, want in (("web", 0.5 / 0.8), ("law", 0.2 / 0.8), ("rare", 0.1 / 0.8)):
        assert abs(s[k].reached_share - want) < 0.01
    total = sum(x.copies * x.tokens for x in got)
    size = {k: sum(x.tokens or 0 for x in corpus_sizes.where(f"source = '{k}'").collect()) for k in cap}
    most = min(size[k] * cap[k] / w for k, w in (("web", 0.625), ("law", 0.25), ("rare", 0.125)))
    assert abs(total - most) < 0.01 * most  # the source that limits the total gives all it may
    assert rows(mixing.mixed(docs.repartition(2), targets)) == sorted(tuple(x) for x in got)
    assert rows(mixing.mixed(docs, targets, seed=1)) != sorted(tuple(x) for x in got)


def test_a_stated_total_and_sources_too_small(spark, corpus_sizes):
    targets = spark.createDataFrame([("web", 0.5, 1), ("rare", 0.5, 2)], TARGETS)
    docs = mixing.version_weights(corpus_sizes, "doc_id", "docket")
    small = mixing.mixed(docs, targets, total=20_000.0)
    assert abs(sum(x.copies * x.tokens for x in small.collect()) - 20_000) < 800
    large = mixing.mixed(docs, targets, total=1e9).collect()
    rare = [x for x in large if x.source == "rare"]
    assert {x.copies for x in rare} == {2}
    assert len(rare) == 100


def test_inclusion_follows_the_weights(spark):
    docs = spark.createDataFrame([(i, "a", 10, 0.5 if i % 2 else 1.0) for i in range(8000)], "doc_id bigint, source string, tokens bigint, weight double")
    m = mixing.mixed(docs, spark.createDataFrame([("a", 1.0, 1)], TARGETS), total=30_000.0)
    odd = m.where("doc_id % 2 = 1").count()
    even = m.where("doc_id % 2 = 0").count()
    assert odd + even == 3000
    assert 1.75 < even / odd < 2.25


def test_nothing_to_mix(spark, corpus_sizes):
    none = spark.createDataFrame([("absent", 1.0, 3), (None, 0.5, 1)], TARGETS)
    docs = mixing.version_weights(corpus_sizes, "doc_id", "docket")
    assert mixing.mixed(docs, none).count() == 0
    assert mixing.mixed(docs.limit(0), none).count() == 0
    assert rows(mixing.shares(mixing.mixed(docs, none), none), "source", "reached_share") == [(None, 0.0), ("absent", 0.0)]


def test_versions_share_a_weight(spark):
    d = spark.createDataFrame([(i, "x") for i in range(4)] + [(9, None), (8, "y")] + [(100 + i, "z") for i in range(20)], "doc_id int, docket string")
    got = dict(rows(mixing.version_weights(d, "doc_id", "docket"), "doc_id", "weight"))
    assert (got[0], got[9], got[8], got[100]) == (0.25, 1.0, 1.0, 1 / 20)
    assert len(got) == 26
