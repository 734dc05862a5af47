"""Pairs, percentiles and term counts."""

import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ROOT, rows
from pyspark.sql import functions as F

from triloom.llm import digest, frequency, pairs

PAIR = "walk_id bigint, center int, context int, extra string"


def brute_pairs(data):
    together, alone, walks = defaultdict(set), defaultdict(set), set()
    for w, a, b, *_ in data:
        if w is None or a is None or b is None or a < 0 or b < 0:
            continue
        walks.add(w)
        alone[a].add(w)
        alone[b].add(w)
        if a != b:
            together[min(a, b), max(a, b)].add(w)
    return {k: len(v) for k, v in together.items()}, {k: len(v) for k, v in alone.items()}, len(walks)


def some_pairs(seed, walks, rows_):
    r = random.Random(seed)
    data = [(r.choice(walks), r.choice([0, 0, 0, *range(12)]), r.randrange(12), "x") for _ in range(rows_)]
    return data + data[:40] + [(None, 1, 2, "x"), (1, None, 2, "x"), (1, -1, 2, "x"), (1, 5, 5, None)]


def state(t):
    return {(r.a, r.b): r.n for r in t.pairs().collect()}, {r.x: r.n for r in t.items().collect()}, t.records


def test_pair_table_is_the_brute_count(spark):
    data = some_pairs(1, range(60), 900)
    t = pairs.temporary(spark, bucket_rows=20).apply(spark.createDataFrame(data, PAIR))
    assert t.buckets == 4
    assert state(t) == brute_pairs(data)
    s = {(r.a, r.b): r for r in t.scores().collect()}
    n, alone, w = brute_pairs(data)
    assert all(abs(s[k].lift - n[k] * w / (alone[k[0]] * alone[k[1]])) < 1e-9 for k in n)


def test_changes_merge_to_the_same_as_counting_anew(spark, tmp_path):
    old = some_pairs(2, range(50), 600)
    df = lambda x: spark.createDataFrame(x, PAIR)
    folder = str(tmp_path / "table")
    pairs.PairTable(spark, folder, bucket_rows=50).apply(df(old), load="day 1")
    before = [r for r in old if r[0] in (3, 4, 5)]
    after = [(3, 1, 2, "x"), (4, 7, 8, "x"), (77, 9, 10, "x")]  # 3 and 4 changed, 5 removed, 77 new
    t = pairs.PairTable(spark, folder, bucket_rows=50)
    assert t.affected().count() > 0
    was = state(t)
    assert was == brute_pairs(old)
    t.apply(df(after), df(before), load="day 2")
    new = [r for r in old if r[0] not in (3, 4, 5)] + after
    assert state(t) == brute_pairs(new)
    t.apply(df(after), df(before), load="day 2")  # merged before
    assert state(pairs.PairTable(spark, folder)) == brute_pairs(new)
    moved = {k for k in {*was[0], *state(t)[0]} if was[0].get(k) != state(t)[0].get(k)}
    items = {k for k in {*was[1], *state(t)[1]} if was[1].get(k) != state(t)[1].get(k)}
    want = {k for k in state(t)[0] if k in moved or items & set(k)}
    assert {(r.a, r.b) for r in t.affected().collect()} == want
    t.vacuum()
    assert state(pairs.PairTable(spark, folder)) == brute_pairs(new)
    assert sum(n.startswith("manifest") for n in os.listdir(folder)) == 1


def test_everything_removed_and_buckets_that_grow(spark):
    t = pairs.temporary(spark, bucket_rows=10)
    df = lambda x: spark.createDataFrame(x, PAIR)
    few, many = [(1, 1, 2, "x")], [(w, w, w + 1, "x") for w in range(2, 200)]
    t.apply(df(few))
    assert t.buckets == 1
    t.apply(df(many))
    assert t.buckets > 16
    assert state(t) == brute_pairs(few + many)
    t.apply(df([]), df(few + many))
    assert state(t) == ({}, {}, 0)
    t.apply(df(few))
    assert state(t) == brute_pairs(few)


_LATER = """
import sys
from pyspark.sql import SparkSession
from triloom.llm import pairs
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
t = pairs.PairTable(spark, sys.argv[1])
assert t.records == 2, t.records
t.apply(spark.createDataFrame([(9, 1, 2)], "walk_id bigint, center int, context int"), spark.createDataFrame([(2, 1, 3)], "walk_id bigint, center int, context int"))
"""


def test_another_process_goes_on(spark, tmp_path):
    folder = str(tmp_path / "table")
    first = [(1, 1, 2, ""), (2, 1, 3, "")]
    pairs.PairTable(spark, folder).apply(spark.createDataFrame(first, PAIR))
    code = subprocess.run([sys.executable, "-c", _LATER, folder], cwd=ROOT, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(ROOT)})
    assert code.returncode == 0, code.stderr[-2000:]
    assert state(pairs.PairTable(spark, folder)) == brute_pairs([(1, 1, 2, ""), (9, 1, 2, "")])


def test_one_record_holds_most_rows(spark):
    r = random.Random(7)
    data = [(1 if i % 3 else i, r.randrange(60), r.randrange(60), "x") for i in range(6000)]
    t = pairs.temporary(spark).apply(spark.createDataFrame(data, PAIR))
    assert state(t) == brute_pairs(data)
    t.apply(spark.createDataFrame(data[:10], PAIR), spark.createDataFrame(data, PAIR))
    assert state(t) == brute_pairs(data[:10])


def test_no_pairs(spark):
    t = pairs.temporary(spark).apply(spark.createDataFrame([], PAIR))
    assert state(t) == ({}, {}, 0)
    assert pairs.far_above_chance(t, 1, 1).count() == 0


def test_far_above_chance(spark):
    data = [(w, 1, 2, "") for w in range(15)] + [(w, 3, 4, "") for w in range(15, 2000)]
    t = pairs.temporary(spark).apply(spark.createDataFrame(data, PAIR))
    assert rows(pairs.far_above_chance(t, 12, 20), "a", "b") == [(1, 2)]
    assert pairs.far_above_chance(t, 16, 20).count() == 0


@pytest.fixture(scope="module")
def numbers(spark):
    r = np.random.default_rng(5)
    data = [("n", float(x)) for x in r.normal(size=6000)] + [("ties", float(x)) for x in r.integers(0, 4, 1500)] + [("one", 7.5), ("two", 1.0), ("two", 2.0)]
    data += [("heavy", float(x)) for x in np.exp(r.normal(size=900) * 5)] + [(None, 1.0), ("n", None), ("n", float("nan")), ("n", float("inf")), ("none", None)]
    return spark.createDataFrame(data, "g string, v double").repartition(6), data


def test_digests_merge_with_bounded_error(numbers):
    df, data = numbers
    whole = digest.merged(digest.digests(df, "g", "v"), "g", fan_in=2)
    days = [digest.merged(digest.digests(df.where(F.pmod(F.hash("v"), F.lit(2)) == i), "g", "v"), "g") for i in (0, 1)]
    for d in (whole, digest.merged(days[0].unionByName(days[1]), "g")):
        sizes = {r.g: (r.n, len(r.means)) for r in d.collect()}
        assert {g: n for g, (n, _) in sizes.items()} == {"n": 6000, "ties": 1500, "one": 1, "two": 2, "heavy": 900}
        assert all(k <= 210 for _, k in sizes.values())
        c = digest.certified(df, "g", "v", digest.estimated(d, "g", [0.01, 0.25, 0.5, 0.75, 0.99])).collect()
        assert all(r.rank_error <= 0.01 for r in c if r.g in ("n", "heavy"))
        median = next(r.estimate for r in c if r.g == "n" and r.q == 0.5)
        assert abs(median - np.median([v for g, v in data if g == "n" and v is not None and abs(v) < 1e308])) < 0.05


@pytest.mark.parametrize("most", [200_000, 40])
def test_exact_quantiles(numbers, most):
    df, data = numbers
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.q): r.quantile for r in digest.exact_quantiles(df, "g", "v", qs, most=most).collect()}
    for g in ("n", "ties", "one", "two", "heavy"):
        own = [v for k, v in data if k == g and v is not None and abs(v) < 1e308]
        for q in qs:
            assert got[g, q] == pytest.approx(np.quantile(own, q), rel=1e-12)
    assert len(got) == 5 * len(qs)


def test_quantiles_when_the_first_bracket_misses(numbers):
    df, data = numbers
    got = {(r.g, r.q): r.quantile for r in digest.exact_quantiles(df, "g", "v", [0.5], delta=2.0, reach=0.0).collect()}
    own = [v for k, v in data if k == "heavy"]
    assert got["heavy", 0.5] == pytest.approx(np.quantile(own, 0.5))


def test_no_numbers(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert digest.exact_quantiles(none, "g", "v", [0.5]).count() == 0
    assert digest.merged(digest.digests(none, "g", "v"), "g").count() == 0


def test_far_outliers(spark):
    df = spark.createDataFrame([("a", float(i), i) for i in range(9)] + [("a", 100.0, 99)], "g string, v double, g2 int")
    q = digest.exact_quantiles(df, "g", "v", [0.25, 0.75])
    assert rows(digest.far_outliers(df, q, "g", "v"), "g2") == [(99,)]


def test_clusters_stay_in_order_and_range():
    v = np.sort(np.r_[np.full(50, 1e308), np.full(50, -1e308), np.arange(1000.0)])
    m, w = digest.cluster(v, np.ones(len(v)), 50)
    assert w.sum() == len(v)
    assert np.all(np.diff(m) >= 0)
    assert np.isfinite(m).all()


def test_term_counts_are_the_brute_counts(spark):
    r = random.Random(3)
    data = [(r.randrange(40), r.randrange(6), r.choice([0] * 6 + list(range(20)))) for _ in range(4000)]
    data += data[:300] + [(1, None, 5), (1, None, 5), (None, 0, 5), (2, 0, None)]
    df = spark.createDataFrame([(*d, "x") for d in data], "walk_id int, pos int, token int, occurrences string").repartition(5)
    got = {r.token: (r.occurrences, r.records, r.last_record) for r in frequency.term_counts(df).collect()}
    distinct = {d for d in data if d[2] is not None}
    for t, n in Counter(d[2] for d in distinct).items():
        own = {d[0] for d in distinct if d[2] == t and d[0] is not None}
        assert got[t] == (n, len(own), max(own))
    assert len(got) == len({d[2] for d in distinct})


def test_marks(spark):
    data = [(w, 0, 1) for w in range(20)] + [(0, 1, 2)] + [(w, 2, 3) for w in range(2)] + [(0, 3, 9)]
    df = spark.createDataFrame(data, "walk_id int, pos int, token int")
    vocabulary = spark.createDataFrame([(t, "w") for t in (1, 2, 3, 4, 4, None)], "token int, word string")
    got = rows(frequency.marked_terms(frequency.term_counts(df), vocabulary, 20), "token", "occurrences", "records", "mark")
    assert got == [(1, 20, 20, "common"), (2, 1, 1, "rare"), (3, 2, 2, "rare"), (4, 0, 0, "rare"), (9, 1, 1, None)]


def test_no_terms(spark):
    none = spark.createDataFrame([], "walk_id int, pos int, token int")
    assert frequency.term_counts(none).count() == 0
