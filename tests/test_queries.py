import pytest
from conftest import same_as_sql

from triloom.plans import data_quality, kg

MODULES = [kg, data_quality]
WITH_SQL = [(n, m) for m in MODULES for n in m.SQL]


@pytest.mark.parametrize(("name", "module"), WITH_SQL, ids=[n for n, _ in WITH_SQL])
def test_query_agrees_with_sql(spark, duck, name, module):
    same_as_sql(spark, duck, module.QUERIES[name], module.SQL[name])


@pytest.mark.parametrize("name", ["p1_found", "p1_triples", "p1_reject_rates", "p1_multiline"])
def test_lines_are_split_without_rest(spark, duck, name):
    from conftest import TESTDATA

    df = data_quality.QUERIES[name](spark, str(TESTDATA))
    assert df.count() > 0


def test_every_sql_has_a_query():
    for m in MODULES:
        assert set(m.SQL) <= set(m.QUERIES)


def test_valid_and_rejected_lines_and_others_are_all(spark, duck):
    from conftest import TESTDATA

    good, bad = (data_quality.QUERIES[n](spark, str(TESTDATA)).select("line_id") for n in ("p1_triples", "p1_found"))
    total = duck.execute("SELECT count(*) FROM kg_raw_lines").fetchone()[0]
    blank = duck.execute(r"SELECT count(*) FROM kg_raw_lines WHERE regexp_full_match(raw, '\s*') OR (fmt IN ('nt', 'nq') AND regexp_matches(raw, '^\s*#'))").fetchone()[0]
    assert good.count() + bad.count() + blank == total
    assert good.join(bad, "line_id").count() == 0


@pytest.mark.parametrize("name", ["fit_ordered_skipgram_invariants", "fit_cbow", "fit_skipgram_invariants", "transform_wide"])
def test_fits_train_on_counts_of_parallel_edges(spark, tmp_path, monkeypatch, name):
    from triloom.train import trainer

    seen = []
    monkeypatch.setattr(trainer, "fit", lambda data, model, *a, **kw: (seen.append(data.limit(100).count()), trainer.Fit(trainer.initial(spark, model, 1), model, [2.0, 1.0]))[1])
    spark.createDataFrame([("a", "p", "b", 1.0)] * 1000 + [("b", "q", "c", 1.0)], "subject string, predicate string, object string, weights double").write.parquet(str(tmp_path / "edge_df.parquet"))
    assert kg.QUERIES[name](spark, str(tmp_path)).count() > 0
    assert 0 < seen[0] < 100  # before, more than a million pairs, or contexts in a row
