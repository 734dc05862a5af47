import json
import sys
import types

import numpy as np
import pytest
from conftest import rows

from triloom import generators
from triloom.config import WalkConfig
from triloom.model import KGEmbedder, wide
from triloom.operators import search
from triloom.sources import sinks
from triloom.track import build_tracker, read_runs
from triloom.train import models, trainer

CONTEXT = np.array([[0, 1, -1], [2, -1, -1], [3, 3, 4], [5, 0, 1]])
DIST = np.array([[-2, -1, 9], [1, 9, 9], [-1, 1, 2], [-2, 1, 2]])
CENTER = np.array([1, 1, 3, 5])
CASES = [
    (models.SkipGram(6, 3, 3), (CENTER, np.array([2, 0, 3, 1])), None),
    (models.Cbow(6, 3), (CONTEXT, CENTER), None),
    (models.Cbow(6, 3), (CONTEXT, CENTER), np.array([0, 3, 4])),
    (models.OrderAwareSkipGram(6, 3, 3, 2), (CENTER, np.array([2, 0, 3, 1]), np.array([1, -2, 2, 0])), None),
    (models.OrderAwareCbow(6, 3, 3, 2), (CONTEXT, DIST, CENTER), np.array([2, 5])),
]


@pytest.mark.parametrize(("model", "batch", "pool"), CASES, ids=lambda x: type(x).__name__)
def test_gradients_are_those_of_the_loss(model, batch, pool):
    p = {k: v.astype(np.float64) * 3 for k, v in model.params(2).items()}
    at = {role: ids for role, (_, ids) in model.rows(batch, np.random.default_rng(1), pool).items()}
    _, grads = model.grads(p, at)
    for name, table in p.items():
        dense = np.zeros_like(table)
        ids, g = grads[name]
        assert len(set(ids.tolist())) == len(ids)
        dense[ids] = g
        for i in np.ndindex(*table.shape):
            was = table[i]
            table[i] = was + 1e-5
            up = model.grads(p, at)[0]
            table[i] = was - 1e-5
            down = model.grads(p, at)[0]
            table[i] = was
            assert abs((up - down) / 2e-5 - dense[i]) < 1e-3


def test_cbow_with_the_whole_vocabulary_is_the_full_softmax():
    m = models.Cbow(6, 3)
    p = m.params(2)
    loss = m.grads(p, {r: i for r, (_, i) in m.rows((CONTEXT, CENTER), np.random.default_rng(1)).items()})[0]
    h = np.array([np.mean([p["in"][t] for t in c if t >= 0], 0) for c in CONTEXT])
    z = h @ p["weight"][:, :-1].T + p["weight"][:, -1]
    assert abs(loss + np.log(np.exp(z)[np.arange(4), CENTER] / np.exp(z).sum(1)).mean()) < 1e-5


def test_predict_center():
    m = models.OrderAwareCbow(6, 3, 3, 2)
    p = m.params(2)
    top = m.predict_center(p, CONTEXT, DIST, 6)
    h = p["in"][(DIST[1, 0] + 2) * 6 + CONTEXT[1, 0]] + p["position"][DIST[1, 0] + 2]
    assert top[1].tolist() == np.argsort(-(p["out"] @ h), kind="stable").tolist()
    assert m.context_embeddings(p, -2).shape == (6, 3)


def vectors(f):
    return {(r.t, r.row): np.frombuffer(r.vec, np.float32) for r in f.params.collect()}


def test_one_shard_is_one_process(spark):
    m = models.SkipGram(10, 8, 3)
    data = spark.createDataFrame([(i % 10, (i % 10) ^ 1) for i in range(400)], "center int, context int").repartition(3)
    f = trainer.fit(data, m, epochs=1, rate=0.02, batch_size=64)
    c = np.sort(np.arange(400) % 10)
    p = m.params(42)
    ids = {k: np.arange(10) for k in p}
    loss, _ = trainer.local_epoch(m, ids, p, np.arange(10), (c, c ^ 1), 0.02, 64, np.random.default_rng([42, 0, 0]))
    assert abs(f.losses[0] - loss / 400) < 1e-9
    got = vectors(f)
    assert all(np.allclose(got[i, r], p[n][r], atol=1e-6) for i, n in enumerate(p) for r in range(10))


def test_training_lowers_the_loss_and_repeats_itself(spark):
    data = spark.createDataFrame([(i % 10, (i % 10) ^ 1) for i in range(4000)] + [(3, 2)] * 3000, "center int, context int")
    f = trainer.fit(data, models.SkipGram(10, 8, 3), epochs=4, rate=0.02, rows_a_task=1000)
    assert len(f.losses) == 4
    assert f.losses[-1] < f.losses[0]
    again = trainer.fit(data.repartition(7), models.SkipGram(10, 8, 3), epochs=4, rate=0.02, rows_a_task=1000)
    assert again.losses == f.losses
    a, b = vectors(f), vectors(again)
    assert all(np.array_equal(a[k], b[k]) for k in a)
    none = trainer.fit(data.limit(0), models.SkipGram(10, 8, 3))
    assert none.losses == []
    assert none.params.count() == 20


def test_pool_smaller_than_the_vocabulary(spark):
    data = spark.createDataFrame([(i % 300, (i + 1) % 300) for i in range(3000)], "center int, context int")
    f = trainer.fit(data, models.SkipGram(9000, 4, 3, pool=50), epochs=2, rate=0.05, rows_a_task=1000)
    assert f.losses[-1] < f.losses[0]
    got, first = vectors(f), models.SkipGram(9000, 4).params(42)
    assert len(got) == 18000
    assert np.array_equal(got[0, 8999], first["in"][8999])  # no shard touched it
    changed = sum(not np.array_equal(got[1, r], first["out"][r]) for r in range(300, 9000))
    assert 0 < changed <= 2 * 3 * 50


@pytest.mark.parametrize("model", [models.SkipGram(9000, 4), models.Cbow(9000, 3)], ids=lambda x: type(x).__name__)
def test_first_values_of_rows_are_those_of_their_blocks(model):
    rows_ = np.r_[0, 1, 5, np.arange(4000, 4200), 8190, 8999]
    for name, table in model.params(7).items():
        assert np.array_equal(model.initial_rows(name, rows_, 7), table[rows_])
        assert model.initial_rows(name, rows_[:0], 7).shape == (0, table.shape[1])


def test_first_values_are_not_sent_to_shards(spark, monkeypatch):
    names, write = [], trainer.written
    monkeypatch.setattr(trainer, "written", lambda df, name, *a: (names.append((name, "vec" in df.columns)), write(df, name, *a))[1])
    data = spark.createDataFrame([([i % 5, (i + 1) % 5], (i + 2) % 5) for i in range(500)], "context array<int>, center int")
    f = trainer.fit(data, models.Cbow(5, 4), epochs=2, rate=0.05, batch_size=50, rows_a_task=200)
    assert [n for n, vec in names if vec] == ["changed", "params", "changed", "params"]  # before, the first values were a table too
    assert f.losses[1] < f.losses[0]
    assert f.params.count() == 10


@pytest.mark.parametrize("model", [models.SkipGram(50, 4, 3), models.Cbow(50, 4, pool=20)], ids=lambda x: type(x).__name__)
def test_rows_looked_up_at_once_train_alike(model, monkeypatch):
    rng, n = np.random.default_rng(5), np.full(300, 3)
    ids = {t: np.sort(rng.choice(50, 40, replace=False)) for t in model.shapes()}
    named = [ids[t][rng.integers(0, 40, 900 if c == "context" and isinstance(model, models.Cbow) else 300)] for t, c in zip(model.tables, model.columns, strict=True)]
    data = (trainer.Lists(named[0], n), named[1]) if isinstance(model, models.Cbow) else tuple(named)
    pool, got = ids[model.pooled][3:33], []
    for tables in (model.tables, ()):
        monkeypatch.setattr(type(model), "tables", tables)
        p = {t: model.initial_rows(t, r, 1) for t, r in ids.items()}
        got.append((p, trainer.local_epoch(model, ids, p, pool, data, 0.05, 64, np.random.default_rng(2))))
    (p, (loss, steps)), (q, (loss_, steps_)) = got
    assert loss == loss_
    assert all(np.array_equal(p[t], q[t]) and np.array_equal(steps[t], steps_[t]) for t in p)


def test_rows_are_set_whole():
    rng = np.random.default_rng(3)
    table, ids = rng.random((50, 5), np.float32), np.array([40, 3, 7])
    want, new = table.copy(), rng.random((3, 5), np.float32)
    want[ids] = new
    trainer._put(table, ids, new)
    assert np.array_equal(table, want)
    trainer._put(table, ids[:0], new[:0])
    trainer._put(wide_ := table.astype(np.float64), ids, new * 2)
    assert np.array_equal(wide_[ids], (new * 2).astype(np.float64))


def test_other_models_train(spark):
    cb = spark.createDataFrame([([i % 5, (i + 1) % 5], [-1, 1], (i + 2) % 5, i % 5) for i in range(500)], "context array<int>, distance array<int>, center int, one int")
    for m in (models.Cbow(5, 4), models.Cbow(5, 4, pool=2), models.OrderAwareCbow(5, 4, 2, 2)):
        f = trainer.fit(cb, m, epochs=3, rate=0.05, batch_size=50, rows_a_task=200)
        assert f.losses[-1] < f.losses[0]
    sg = cb.selectExpr("one AS center", "center AS context", "2 AS distance")
    f = trainer.fit(sg, models.OrderAwareSkipGram(5, 4, 2, 2), epochs=3, rate=0.05, batch_size=50)
    assert f.losses[-1] < f.losses[0]
    assert {(r.t, r.row) for r in f.params.collect()} == {(0, i) for i in range(5)} | {(1, i) for i in range(25)} | {(2, i) for i in range(5)}


def test_pipeline(spark, tmp_path):
    g = generators.barabasi(spark, 60, 2, ["p", "q"], seed=3)
    log = tmp_path / "log.jsonl"
    with KGEmbedder(spark, walk_depth=2, walk_number=2, vector_size=8, window_size=2, epochs=1, learning_rate=0.01, tracker="local", tracker_kwargs={"path": str(log)}) as m:
        with pytest.raises(ValueError, match="fitted"):
            m.transform()
        out = m.fit_transform(g)
        assert out.count() == m.word2idx.count()
        assert out.columns == ["token", "word", "embedding"]
        assert {len(r.embedding) for r in out.collect()} == {8}
        assert wide(out, 8).columns[2:] == [f"embedding_{i}" for i in range(8)]
        assert m.transform(entities_only=True).count() < out.count()
        m.save(str(tmp_path / "model"))
    back = KGEmbedder.load(spark, str(tmp_path / "model"))
    assert rows(back.transform()) == rows(out)
    assert back.config == m.config
    events = [json.loads(x) for x in log.read_text().splitlines()]
    assert {e["stage"] for e in events if e["event"] == "stage/end"} >= {"Word2idx_Generation", "Graph_Construction", "Walk_Generation", "Word2Vec_Training", "Embedding_Extraction"}
    assert any("number_nodes" in e.get("metrics", {}) for e in events)
    assert any(e["event"] == "end" for e in events)


@pytest.mark.parametrize("more", [{"embedding_model": "cbow"}, {"walk_strategy": "bfs"}, {"backend": "mllib"}, {"walk_weighted": True}])
def test_variants(spark, tmp_path, more):
    g = generators.growing_random(spark, 15, 2, ["p"], seed=3).selectExpr("*", "1.5D AS weights")
    path = str(tmp_path / "g.parquet")
    g.write.parquet(path)
    m = KGEmbedder(spark, walk_depth=2, walk_number=1, vector_size=4, window_size=2, epochs=1, **more)
    edges = m.load_data(path)
    assert m.fit(edges).transform().count() == m.word2idx.count()


def test_config():
    c = WalkConfig()
    assert (c.learning_rate, c.reproducible, c.vector_size, c.window_size) == (0.0001, False, 256, 5)
    for bad in ({"walk_depth": 0}, {"embedding_model": "x"}, {"learning_rate": -0.01}, {"walk_strategy": "x"}, {"backend": "x"}, {"tracker": "x"}, {"window_size": 1}, {"surprise": 1}):
        with pytest.raises(ValueError):
            WalkConfig(**bad)
    with pytest.raises(ValueError, match="skipgram"):
        WalkConfig(embedding_model="x")


def test_trackers():
    assert not build_tracker(None).enabled()
    assert not build_tracker(" NONE ").enabled()
    with pytest.raises(ValueError, match="unknown"):
        build_tracker("paper")
    for name, kwargs in (("mlflow", {}), ("wandb", {"project": "x"})):
        try:
            __import__(name)
        except ImportError:
            with pytest.raises(ImportError, match=name):
                build_tracker(name, kwargs)


def test_generators(spark):
    e = generators.erdos_renyi(spark, 60, 0.4, ["a", "b"])
    n = e.count()
    assert 1200 < n < 1650
    assert e.where("subject = object").count() == 0
    assert rows(e) == rows(generators.erdos_renyi(spark, 60, 0.4, ["a", "b"]))
    assert generators.growing_random(spark, 20, 10).count() == 190
    assert generators.barabasi(spark, 50, 1).count() == 49


def test_top_k(spark):
    v = np.random.default_rng(0).normal(size=(200, 5)).round(2)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "token int, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 200, 20)], "query_id int, query array<double>")
    got = rows(search.top_k(df, q, 3), "query_id", "rank", "token")
    want = [(i, r + 1, int(t)) for i in range(0, 200, 20) for r, t in enumerate(np.lexsort((np.arange(200), -(v @ v[i])))[:3])]
    assert got == want
    assert search.top_k(df, q.limit(0), 3).count() == 0
    assert rows(search.top_k(df, q, 3, block=3), "query_id", "rank", "token") == want
    ties = spark.createDataFrame([(i, [1.0]) for i in range(9000)], "token int, embedding array<double>").coalesce(1)
    assert rows(search.top_k(ties, spark.createDataFrame([("a", [2.0])], "query_id string, query array<double>"), 3), "token") == [(0,), (1,), (2,)]


def parallel(spark, n):
    """Two walks of one hop over n parallel edges of one predicate, and a path beside them."""
    return spark.createDataFrame([("a", "p", "b")] * n + [("c", "q", "d"), ("d", "q", "e")], "subject string, predicate string, object string")


def trained_on(monkeypatch, spark, **settings):
    """The first rows of data that `fit` trains on, in a graph of 1000 parallel edges, and the model."""
    seen = []
    monkeypatch.setattr(trainer, "fit", lambda data, model, *a, **kw: (seen.append(data.limit(100).collect()), trainer.Fit(trainer.initial(spark, model, 1), model))[1])
    m = KGEmbedder(spark, walk_depth=2, walk_number=1, vector_size=4, window_size=2, **settings).fit(parallel(spark, 1000))
    monkeypatch.undo()
    return seen[0], m


def test_skipgram_trains_on_counts_of_parallel_edges(spark, monkeypatch):
    data, m = trained_on(monkeypatch, spark)
    words = {r.token: r.word for r in m.word2idx.collect()}
    got = [(words[r.center], words[r.context], r.n) for r in data]
    assert len(got) == 6 + 14 + 6  # walks a p b, c q d q e and d q e; before, three million rows
    assert sorted(x for x in got if x[0] in "ab") == [(x, y, 10**6) for x, y in ("ab", "ap", "ba", "bp")]
    assert {n for c, _, n in got if c in "cde"} == {1}


def test_a_counted_pair_weighs_as_its_copies():
    m = models.SkipGram(6, 3, 0)
    p = {k: v * 3 for k, v in m.params(2).items()}
    once = {"center": np.array([1, 2]), "target": np.array([[3], [4]])}
    loss, g = m.grads(p, once | {"n": np.array([3, 1])})
    copies = {"center": np.array([1, 1, 1, 2]), "target": np.array([[3], [3], [3], [4]])}
    loss4, g4 = m.grads(p, copies)
    assert abs(loss * 2 - loss4 * 4) < 1e-5
    assert all(np.allclose(g[k][1] * 2, g4[k][1] * 4, atol=1e-6) for k in g)


def test_counted_training_lowers_the_mean_loss_of_all_pairs(spark):
    data = spark.createDataFrame([(i % 10, (i % 10) ^ 1, 1 + 99999 * (i % 10 < 2)) for i in range(400)], "center int, context int, n bigint")
    f = trainer.fit(data, models.SkipGram(10, 8, 3), epochs=3, rate=0.02, batch_size=40, counted=True)
    assert abs(f.losses[0] - 4 * np.log(2)) < 0.5
    assert f.losses[-1] < f.losses[0]


@pytest.mark.parametrize("order_aware", [False, True])
def test_cbow_trains_on_counts_of_parallel_edges(spark, monkeypatch, order_aware):
    data, m = trained_on(monkeypatch, spark, embedding_model="cbow", order_aware=order_aware)
    words = {r.token: r.word for r in m.word2idx.collect()}
    got = {words[r.center]: (sorted(words[t] for t in r.context), list(r.n)) for r in data if words[r.center] in "abp"}
    assert got == {"a": (["b", "p"], [1000] * 2), "b": (["a", "p"], [1000] * 2), "p": (["a", "b"], [1000] * 2)}  # before, two million contexts in a row


@pytest.mark.parametrize("model", [models.Cbow(6, 3), models.OrderAwareCbow(6, 3, 0, 2)], ids=lambda x: type(x).__name__)
def test_a_counted_context_is_as_its_copies(model):
    p = {k: v * 3 for k, v in model.params(2).items()}
    copies = [np.array([[0, 0, 0, 1], [2, 3, 4, 5]]), np.array([[-2, -2, -2, 1], [-2, -1, 1, 2]]), np.array([1, 3])]
    once = [np.array([[0, 1, -1, -1], [2, 3, 4, 5]]), np.array([[-2, 1, -1, -1], [-2, -1, 1, 2]]), np.array([1, 3]), np.array([[3, 1, -1, -1], [1, 1, 1, 1]])]
    if len(model.columns) == 2:
        del copies[1], once[1]
    a, b = (model.grads(p, {r: i for r, (_, i) in model.rows(tuple(x), np.random.default_rng(1)).items()}) for x in (copies, once))
    assert abs(a[0] - b[0]) < 1e-5
    for k, (ids, g) in a[1].items():
        dense = [np.zeros_like(p[k]), np.zeros_like(p[k])]
        dense[0][ids], dense[1][b[1][k][0]] = g, b[1][k][1]
        assert np.allclose(*dense, atol=1e-6)


def test_one_long_list_does_not_widen_the_others():
    import tracemalloc

    n = np.r_[50_000, np.full(20_000, 2)]
    context = trainer.Lists(np.arange(n.sum()) % 40, n)
    assert context[np.array([2, 1])].tolist() == [[(50_002) % 40, 50_003 % 40], [50_000 % 40, 50_001 % 40]]
    m = models.Cbow(40, 3)
    p = m.params(2)
    tracemalloc.start()
    trainer.local_epoch(m, {k: np.arange(40) for k in p}, p, np.arange(40), (context, np.arange(len(n)) % 40), 0.01, 128, np.random.default_rng(1))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2e8  # padded to the longest, eight billion bytes a column


def test_cbow_pools_change_with_every_batch():
    m = models.Cbow(1000, 3, pool=50)
    rng = np.random.default_rng(1)
    a, b = (m.rows((CONTEXT, CENTER), rng, np.arange(500))["pool"][1] for _ in range(2))
    assert all(len(x) == 50 == len(set(x.tolist())) and np.array_equal(x, np.sort(x)) and x.max() < 500 for x in (a, b))
    assert not np.array_equal(a, b)
    assert m.held() >= 1000


def test_an_epoch_moves_runs_of_rows(spark):
    data = spark.createDataFrame([([i % 5, (i + 1) % 5], i % 5, [1, 2]) for i in range(3000)], "context array<int>, center int, n array<bigint>")
    columns = ["context", "center", "n"]
    sharded, count, shards = trainer._sharded(data, models.Cbow(5, 3), columns, 1000)
    runs = trainer._packed(sharded, columns).orderBy("row").collect()
    assert (count, shards, len({r.shard for r in runs})) == (3000, 3, 3)
    assert len(runs) <= 12  # before, an epoch shuffled and sorted all 3000
    center = np.concatenate([np.frombuffer(r.center, np.int32) for r in runs])
    assert center.tolist() == sorted(i % 5 for i in range(3000))
    n = np.concatenate([np.frombuffer(r.n_n, np.int32) for r in runs])
    context = trainer.Lists(np.concatenate([np.frombuffer(r.context, np.int32) for r in runs]), n)
    assert context[np.arange(3000)].tolist() == [[c, (c + 1) % 5] for c in center.tolist()]


@pytest.mark.parametrize("model", [models.OrderAwareSkipGram(5, 4, 2, 2), models.OrderAwareCbow(5, 4, 2, 2)], ids=lambda x: type(x).__name__)
def test_positions_are_not_named_by_every_row(spark, model):
    assert model.whole == ("position",)
    assert [t for t, _ in model.touched()] == ["in", "out"]  # before, each row of data was repeated for each distance
    data = spark.createDataFrame([([i % 5] if "cbow" in type(model).__name__.lower() else i % 5, [1] if "cbow" in type(model).__name__.lower() else 1, (i + 1) % 5) for i in range(50)], "context array<int>, distance array<int>, center int" if "cbow" in type(model).__name__.lower() else "context int, distance int, center int")
    f = trainer.fit(data, model, epochs=1, rate=0.05)
    first, got = model.params(42)["position"], vectors(f)
    assert not np.array_equal(got[2, 3], first[3])


def test_order_aware_pipeline(spark):
    g = generators.growing_random(spark, 15, 2, ["p"], seed=3)
    for kind in ("skipgram", "cbow"):
        m = KGEmbedder(spark, walk_depth=2, walk_number=1, vector_size=4, window_size=2, epochs=1, order_aware=True, embedding_model=kind).fit(g)
        assert m.transform().count() == m.word2idx.count()
        assert m.context_table("out" if kind == "skipgram" else "in").count() == 5 * m.word2idx.count()
        m.release()


class Stub(types.ModuleType):
    """A module that remembers its calls."""

    def __init__(self, name):
        super().__init__(name)
        self.calls, self.config, self.tags = [], self, ()

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)

        def call(*a, **kw):
            self.calls.append((name, a, kw))
            return self

        return call

    def __enter__(self):
        return self

    def __exit__(self, *kind):
        self.calls.append(("left", kind[:1], {}))

    def names(self):
        return [c[0] for c in self.calls]


@pytest.mark.parametrize("name", ["mlflow", "wandb"])
def test_tracker_services(monkeypatch, tmp_path, name):
    stub = Stub(name)
    monkeypatch.setitem(sys.modules, name, stub)
    settings = {"mlflow": {"experiment": "x", "tracking_uri": "file:///tmp/x"}, "wandb": {"project": "p"}}
    t = build_tracker(name, settings)
    t.start_pipeline("run", {"a": "b"})
    (tmp_path / "model").mkdir()
    (tmp_path / "f.txt").write_text("x")
    with pytest.raises(KeyError), t.stage("data_loading"):
        t.log_params({"a": 1})
        t.log_metrics({"m": 1.0}, step=0)
        raise KeyError
    t.log_data({"a": [1]}, "sample", "data", {"k": "v"})
    t.log_artifact(str(tmp_path / "f.txt"))
    t.log_dict({"a": 1}, "d.json", "data")
    t.log_text("hello", "t.txt")
    t.log_model(tmp_path / "model", "model")
    t.set_tags({"status": "success"})
    t.close()
    called = stub.names()
    if name == "mlflow":
        assert called == ["set_tracking_uri", "set_experiment", "start_run", "start_run", "log_params", "log_metrics", "left", "log_table", "set_tags", "log_artifact", "log_dict", "log_text", "log_artifacts", "set_tags", "end_run"]
        assert stub.calls[5][2] == {"step": 0}
        assert stub.calls[10][1][1] == "data/d.json"
    else:
        assert ("log", ({"stage/end": "data_loading"},), {}) in stub.calls
        assert called.count("Artifact") == 4
        assert called.count("log_artifact") == 4
        assert called[-1] == "finish"
        assert "status=success" in stub.tags
    assert build_tracker(name, settings[name]).enabled()
    assert not build_tracker("none", settings).enabled()


def test_runs_are_read_back(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    for status in ("success", "failed"):
        t = build_tracker("local", {"local": {"path": str(path)}})
        t.start_pipeline(f"run-{status}")
        t.log_params({"package": "p", "n": 3})
        t.log_metrics({"loss": 2.0}, step=0)
        t.log_metrics({"loss": 1.0}, step=1)
        t.set_tags({"status": status})
        t.close()
    build_tracker("local", {"path": str(path)}).start_pipeline("open")
    runs = read_runs(spark, str(path))
    assert rows(runs, "run_name", "status") == [("open", "running"), ("run-failed", "failed"), ("run-success", "success")]
    good = runs.where("status = 'success'").select("params.package", "metrics.loss", "seconds")
    assert rows(good, "package", "loss") == [("p", "1.0")]
    s = sinks.write_summary(good, str(tmp_path / "summary"), ["package"], "seconds").collect()
    assert (len(s), s[0].runs) == (1, 1)
