import pytest
from conftest import rows
from pyspark.sql import functions as F

from triloom.operators import corpus, graph, literals, skew, vocab, walks
from triloom.plans import kg


def edges(spark, data, weights=None):
    data = [(*e, w) for e, w in zip(data, weights, strict=True)] if weights else data
    return spark.createDataFrame(data, "subject int, predicate int, object int" + (", weights double" if weights else ""))


def test_vocabulary_and_encoding(spark):
    t = spark.createDataFrame([("A", "likes", "B"), ("B", "likes", "C"), (None, "likes", "A"), ("A", "é", "likes"), ("A", "likes", "B")], "subject string, predicate string, object string")
    v = vocab.vocabulary(t)
    assert rows(v, "token", "word") == [(0, "A"), (1, "B"), (2, "C"), (3, "likes"), (4, "é")]
    assert v.columns == ["token", "word"]
    e = vocab.encoded(t, v)
    assert rows(e) == [(0, 3, 1), (0, 3, 1), (0, 4, 3), (1, 3, 2)]
    assert dict(e.dtypes)["subject"] == "int"
    assert rows(vocab.decoded(e, v)) == rows(t.dropna())


def test_empty_triples(spark):
    t = spark.createDataFrame([], "subject string, predicate string, object string")
    v = vocab.vocabulary(t)
    assert v.count() == 0
    e = vocab.encoded(t, v)
    assert e.count() == 0
    assert graph.metrics(e).first()["number_nodes"] == 0
    assert walks.random_walks(e, depth=2, walk_number=1).count() == 0
    assert walks.bfs_walks(e, depth=2).count() == 0


def test_literals(spark):
    p = ["http://a/v", "http://b#v", "flat"]
    t = spark.createDataFrame(
        [("s", p[0], str(x)) for x in (1, 2, 3, 4)] + [("s", p[0], "none"), ("s", p[0], None), ("s", p[1], "7"), ("s", "flat", "5"), ("s", "flat", "5.0"), ("s", "other", "x"), ("s", None, "9")],
        "subject string, predicate string, object string",
    )
    assert rows(literals.dropped(t, p), "predicate", "object") == [(None, "9"), ("other", "x")]
    assert literals.dropped(t, []).count() == t.count()
    q = rows(literals.binned(t, p, 2), "predicate", "object")
    assert q == [(None, "9"), ("flat", "flat_bin_0"), ("flat", "flat_bin_0"), (p[0], "v_bin_0"), (p[0], "v_bin_0"), (p[0], "v_bin_1"), (p[0], "v_bin_1"), (p[1], "v_bin_0"), ("other", "x")]
    u = rows(literals.binned(t, p, 3, "uniform").where(F.col("predicate") == p[0]), "object")
    assert u == [("v_bin_0",), ("v_bin_0",), ("v_bin_1",), ("v_bin_2",)]  # 2 lies on the first inner edge: lower bin
    assert rows(literals.binned(t, ["absent"], 3)) == rows(t)
    with pytest.raises(ValueError, match="strategy"):
        literals.binned(t, p, 2, "best")


def test_parallel_and_repeated_edges_fan_out(spark):
    e = edges(spark, [(0, 9, 1), (0, 8, 1), (0, 8, 1)])
    starts = spark.createDataFrame([(0,)], "v int")
    assert rows(walks.random_walks(e, starts, 3, 1)) == [(0, 0, 0, 8, 1), (0, 0, 0, 8, 1), (0, 0, 0, 9, 1)]
    assert walks.random_walks(e, starts, 3, 1, multi_edge="sample").count() == 1


def test_sinks_loops_and_cycles(spark):
    e = edges(spark, [(1, 9, 1), (2, 9, 3), (3, 9, 2), (4, 9, 5)])
    got = walks.random_walks(e, None, 3, 1)
    assert rows(got.where("walk_id = 1"), "step", "src", "dst") == [(0, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert rows(got.where("walk_id = 2"), "src", "dst") == [(2, 3), (2, 3), (3, 2)]
    assert got.where("walk_id = 5").count() == 0
    assert got.where("walk_id = 4").count() == 1


def test_uniform_walks_hold_their_invariants(spark):
    data = [(i % 40, 100 + i % 3, (i * 7 + 1) % 40) for i in range(200)]
    e = edges(spark, data)
    got = walks.random_walks(e, None, 4, 3, multi_edge="sample").collect()
    there = set(data)
    last = {}
    for r in sorted(got, key=lambda r: (r.walk_id, r.step)):
        assert (r.src, r.predicate, r.dst) in there
        assert r.step < 4
        assert r.src == (r.walk_id // 3 if r.step == 0 else last[r.walk_id])
        last[r.walk_id] = r.dst
    assert rows(walks.random_walks(e, None, 4, 3, multi_edge="sample")) == sorted(tuple(r) for r in got)
    other = walks.random_walks(e, None, 4, 3, seed=7, multi_edge="sample", hashing="xxhash64")
    assert rows(other) != sorted(tuple(r) for r in got)


def test_weights_steer_the_walk(spark):
    e = edges(spark, [(0, 9, 1), (0, 9, 2), (0, 9, 3), (4, 9, 1)], [0.0, 3.0, 1.0, None])
    starts = spark.createDataFrame([(0,), (4,)], "v int")
    got = dict(rows(walks.random_walks(e, starts, 1, 2000, weighted=True).groupBy("src", "dst").count().select(F.concat_ws("-", "src", "dst"), "count")))
    assert set(got) == {"0-2", "0-3"}  # weight 0 and null are never drawn
    assert 1380 < got["0-2"] < 1620
    with pytest.raises(Exception, match="negative"):
        walks.random_walks(edges(spark, [(0, 9, 1)], [-1.0]), starts, 1, 1, weighted=True).count()


def test_bfs_diamond(spark):
    e = edges(spark, [(0, 9, 1), (0, 9, 2), (1, 9, 3), (2, 8, 3), (3, 9, 0)])
    starts = spark.createDataFrame([(0,), (0,), (None,)], "v int")
    assert rows(walks.bfs_leaves(e, starts, 4)) == [(0, 2, 1), (0, 3, 2)]
    w = 3
    assert rows(walks.bfs_walks(e, starts, 4).where(F.col("walk_id") == w)) == [(w, 0, 0, 9, 1), (w, 1, 1, 9, 3)]
    assert rows(walks.bfs_leaves(e, starts, 1)) == [(0, 1, 1), (0, 2, 1)]
    assert rows(walks.bfs_walks(e, None, 4, starts_a_block=1)) == rows(walks.bfs_walks(e, None, 4))
    back = walks.bfs_walks(edges(spark, [(5, 9, 1), (1, 9, 7)]), spark.createDataFrame([(5,)], "v int"), 4, "subject")
    assert rows(back, "step", "src", "dst") == [(0, 1, 7), (1, 5, 1)]


def test_sink_start_has_no_bfs_rows(spark):
    e = edges(spark, [(0, 9, 1)])
    assert rows(walks.bfs_leaves(e, spark.createDataFrame([(1,)], "v int"), 2)) == [(1, 1, 0)]
    assert walks.bfs_walks(e, spark.createDataFrame([(1,)], "v int"), 2).count() == 0


def test_tokens_and_pairs(spark):
    hops = spark.createDataFrame([(1, 0, 10, 90, 11), (1, 1, 11, 91, 12)], "walk_id bigint, step int, src int, predicate int, dst int")
    t = corpus.tokens(hops)
    assert rows(t) == [(1, 0, 10), (1, 1, 90), (1, 2, 11), (1, 3, 91), (1, 4, 12)]
    p = rows(corpus.skipgram_pairs(t, 2), "center", "context")
    assert len(p) == 2 * (4 + 3)
    assert sorted((b, a) for a, b in p) == p
    d = rows(corpus.skipgram_pairs_with_distance(t, 1), "center", "context", "distance")
    assert (10, 90, 1) in d
    assert (90, 10, -1) in d
    c = {r.center: (r.context, r.distance) for r in corpus.cbow_contexts(t, 2).collect()}
    assert c[11] == ([10, 90, 91, 12], [-2, -1, 1, 2])
    with pytest.raises(ValueError, match="window"):
        corpus.skipgram_pairs(t, 0)


def test_min_count_leaves_gaps(spark):
    t = spark.createDataFrame([(1, 0, 5), (1, 1, 7), (1, 2, 5)], "walk_id bigint, pos int, token int")
    kept = corpus.frequent(t, 2)
    assert rows(kept) == [(1, 0, 5), (1, 2, 5)]
    assert corpus.skipgram_pairs(kept, 1).count() == 0
    assert rows(corpus.frequent(t, 0)) == rows(t)


def test_equal_centers_share_a_row(spark):
    t = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (1, 1, 7)], "walk_id bigint, pos int, token int")
    assert rows(corpus.cbow_contexts(t, 1), "pos", "center", "context") == [(0, 5, [7, 7]), (1, 7, [5, 5])]


def test_betweenness_of_a_path(spark):
    e = edges(spark, [(0, 9, 1), (1, 9, 2), (2, 9, 3), (1, 8, 2), (3, 9, 3)])
    assert rows(graph.betweenness(e)) == [(0, 0.0), (1, 2.0), (2, 2.0), (3, 0.0)]
    assert rows(graph.betweenness(e, sources_a_block=2)) == rows(graph.betweenness(e))
    m = graph.graph_statistics(e).first().asDict()
    assert (m["mean_betweenness"], m["betweenness_error"], m["number_nodes"]) == (1.0, 0.0, 4)
    part = graph.graph_statistics(e, sources=2, sources_a_block=1).first()
    assert part["betweenness_error"] >= 0
    assert graph.graph_statistics(e.limit(0)).first()["mean_betweenness"] is None
    two = edges(spark, [(0, 9, 1), (0, 9, 2), (1, 9, 3), (2, 9, 3)])
    assert rows(graph.betweenness(two)) == [(0, 0.0), (1, 0.5), (2, 0.5), (3, 0.0)]


def test_metrics(spark):
    m = graph.metrics(edges(spark, [(0, 9, 1), (0, 9, 1), (1, 9, 2)])).first()
    assert (m.number_nodes, m.number_edges, m.min_degree, m.max_degree) == (3, 3, 1, 3)
    assert m.density == 0.5
    assert rows(graph.degree_distribution(edges(spark, [(0, 9, 1)]))) == [(1, 2)]
    assert rows(graph.top_k_by_degree(edges(spark, [(0, 9, 1), (0, 9, 2)]), 1), "vertex", "degree") == [(0, 2)]


def test_imported_sequences(spark):
    v = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, -1), (2, 0, 6), (2, 1, 5), (2, 2, None)], "walk_id bigint, pos int, vertex int")
    assert rows(walks.from_sequences(v)) == [(1, 0, 5, 6), (2, 0, 6, 5)]
    t = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (1, 1, None), (1, 2, -1)], "walk_id bigint, pos int, token int")
    assert rows(corpus.unpadded(t)) == [(1, 0, 5)]


def test_pair_totals_count_parallel_edges_before_tokens_meet(spark, tmp_path, monkeypatch):
    one = [("a", "p", "b", 1.0)] * 2000 + [("a", "q", "b", 1.0)] * 1000
    spark.createDataFrame(one, "subject string, predicate string, object string, weights double").write.parquet(str(tmp_path / "edge_df.parquet"))
    met, seen = corpus._met, []
    monkeypatch.setattr(corpus, "_met", lambda toks, window: (seen.append(toks.count()), met(toks.limit(100), window))[1])
    got = rows(kg.pair_totals(spark, str(tmp_path)))
    assert seen == [8]  # two walks a, p or q, b
    a, b, p, q = range(4)
    half = [(a, b, 18_000_000), (a, p, 12_000_000), (a, q, 6_000_000), (b, p, 12_000_000), (b, q, 6_000_000)]
    assert got == sorted([*half, *[(x, c, n) for c, x, n in half]])


def test_counted_hops_are_those_fanned_out(spark):
    e = spark.createDataFrame([(0, 9, 1), (0, 9, 1), (0, 8, 1), (1, 9, 0), (1, 7, 2)], "subject int, predicate int, object int")
    for walk in (lambda how: walks.random_walks(e, None, 3, 5, multi_edge=how), lambda how: walks.bfs_walks(e, None, 3, multi_edge=how)):
        every = walk("fanout")
        counts = walk("counted")
        assert rows(counts.selectExpr("walk_id", "step", "src", "dst", "n")) == rows(every.groupBy("walk_id", "step", "src", "dst").count())
        tokens = corpus.tokens(every)
        assert rows(corpus.counted_tokens(counts)) == rows(tokens.groupBy("walk_id", "pos", "token").count())
        assert rows(corpus.pair_totals(corpus.counted_tokens(counts), 2)) == rows(corpus.pair_totals(tokens, 2))
        assert rows(corpus.token_counts(corpus.counted_tokens(counts))) == rows(corpus.token_counts(tokens))


def test_walks_are_the_same_whoever_looks_vertices_up(spark, monkeypatch):
    e = spark.createDataFrame([(i % 40, i % 3, (i * i) % 41, 1.0 + i % 2) for i in range(600)], "subject int, predicate int, object int, weights double")
    seen, make = [], graph.walk_table
    for how, weighted in (("counted", False), ("sample", True)):
        got = []
        for steps in (None, 0):
            monkeypatch.setattr(graph, "walk_table", lambda e, w, _, steps=steps: (seen.append((t := make(e, w, steps))[1].columns), t)[1])
            w = walks.random_walks(e, None, 3, 2, weighted=weighted, multi_edge=how)
            got.append(rows(w.withColumn("predicates", F.array_sort("predicates")) if how == "counted" else w))
        assert got[0] == got[1]
        assert got[0]
    assert ["next_first" in c for c in seen] == [True, False] * 2


def test_only_parallel_edges_are_met_again(spark, monkeypatch):
    """Edges that are surely the only ones between their vertices; before, all edges were joined with the hops again."""
    met, join = [], walks._all_edges
    monkeypatch.setattr(walks, "_all_edges", lambda hops, edges, how: (met.append(rows(edges, "subject", "predicate", "object")), join(hops, edges, how))[1])
    e = spark.createDataFrame([(0, 9, i) for i in range(1, 2000)] + [(0, 8, 700)] * 2, "subject int, predicate int, object int").coalesce(1)
    w = walks.random_walks(e, spark.createDataFrame([(0,)], "v int"), 1, 500, multi_edge="counted")
    assert len(met[0]) < 20
    assert {(0, 8, 700), (0, 9, 700)} <= set(met[0])
    n = {r.dst: r.n for r in w.collect()}
    assert len(n) > 300
    assert {t: k for t, k in n.items() if k != 1} == ({700: 3} if 700 in n else {})


def test_contexts_are_sorted_once_a_walk(spark):
    t = spark.createDataFrame([(1, 2, 5, 1), (1, 0, 7, 2), (1, 1, 9, 3), (1, 1, 4, 1), (1, 3, 7, 1), (2, 0, 3, 1)], "walk_id bigint, pos int, token int, n bigint")
    c = corpus.cbow_contexts(t, 2)
    assert "array_sort" not in c._jdf.queryExecution().optimizedPlan().toString()  # before, for every center
    got = {(r.pos, r.center): (list(r.context), list(r.distance), list(r.n)) for r in c.collect()}
    assert got[1, 9] == got[1, 4] == ([7, 5, 7], [-1, 1, 2], [2, 1, 1])
    assert got[2, 5] == ([7, 4, 9, 7], [-2, -1, -1, 1], [2, 1, 3, 1])
    assert set(got) == {(0, 7), (1, 9), (1, 4), (2, 5), (3, 7)}


def test_only_edges_that_walks_took_are_counted(spark, monkeypatch):
    left = []
    join = skew.join_by_key
    monkeypatch.setattr(skew, "join_by_key", lambda a, *x, **kw: (left.append(a.columns), join(a, *x, **kw))[1])
    e = spark.createDataFrame([(1, 2, 3)] * 4 + [(1, 5, 3), (3, 2, 4), (7, 2, 8)], "subject int, predicate int, object int")
    hops = spark.createDataFrame([(1, 0, 1, 3), (2, 0, 1, 3), (1, 1, 3, 4)], "walk_id bigint, step int, src int, dst int")
    got = {(r.walk_id, r.step): (sorted(tuple(p) for p in r.predicates), r.n) for r in walks.counted(hops, e).collect()}
    assert got == {(1, 0): ([(2, 4), (5, 1)], 5), (2, 0): ([(2, 4), (5, 1)], 5), (1, 1): ([(2, 1)], 1)}
    assert left[0] == ["__s", "__o", "predicate"]  # before, all edges were grouped first


def test_encoding_drops_terms_that_are_looked_up(spark, monkeypatch):
    left = []
    join = skew.join_by_key
    monkeypatch.setattr(skew, "join_by_key", lambda a, *x, **kw: (left.append(set(a.columns) & {"subject", "predicate", "object"}), join(a, *x, **kw))[1])
    t = spark.createDataFrame([("a", "p", "b"), ("b", "q", "a"), ("a", "p", None)], "subject string, predicate string, object string")
    v = vocab.vocabulary(t)
    assert rows(vocab.encoded(t, v)) == [(0, 2, 1), (1, 3, 0)]
    assert [len(x) for x in left] == [2, 1]  # the predicates are broadcast; before, all three strings went through every shuffle
