import pytest
from conftest import rows
from pyspark.sql import functions as F

from triloom.sources.grammar import parse_text
from triloom.sources.recovering import parsed_lines, recovered_files, valid_and_rejected

T = "http://x.example/s,http://x.example/p"


def test_lines_keep_their_columns_and_nothing_is_lost(spark):
    data = [(1, f"{T},a", "csv", 3, "mine"), (2, f'{T},"a', "csv", 3, "mine"), (3, None, "csv", 3, None), (4, "x", None, None, "mine"), (5, "", "csv", 3, "mine")]
    df = spark.createDataFrame(data, "line_id int, raw string, fmt string, n_cols int, subject string")
    p = parsed_lines(df)
    assert p.columns == [*df.columns, "parsed"]
    assert rows(p.select("line_id", "subject", "parsed.kind")) == [(1, "mine", "record"), (2, "mine", "error"), (3, None, "none"), (4, "mine", "error"), (5, "mine", "none")]
    valid, bad = valid_and_rejected(p, ["line_id"])
    assert rows(valid, "line_id", "object") == [(1, "a")]
    assert rows(bad, "line_id", "reason") == [(2, "quoting"), (4, "format")]


def test_empty_table(spark):
    p = parsed_lines(spark.createDataFrame([], "raw string, fmt string, n_cols int"))
    assert p.count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'{T},"two\nlines"\n{T},"broken\n{T},good\n')
    got = recovered_files(spark, str(tmp_path), "csv", 3, multiline=True)
    assert rows(got, "line_no", "n_lines", "kind", "object") == [(1, 2, "record", "two\nlines"), (3, 1, "error", None), (4, 1, "record", "good")]
    by_line = recovered_files(spark, str(tmp_path), "csv", 3)
    assert rows(by_line, "line_no", "kind") == [(1, "error"), (2, "error"), (3, "error"), (4, "record")]
    assert got.where("file_name LIKE '%a.csv'").count() == 3


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_splits_give_what_the_whole_file_gives(spark, tmp_path, small_splits):
    parts = [f"{T},plain {{}}", f'{T},"two\nlines {{}}"', f'{T},"open {{}}\nand on', f'{T},"long {{}}\n' + "\n".join(["x, y"] * 30) + '"', "no record {}", "", f'{T},"closed {{}}" x\nrest', f'{T},"a ""b""\nc {{}}"\r']
    text = "\n".join(parts[(i * 5 + i // 7) % len(parts)].format(i) for i in range(60))
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text("y\n" * 200 + f"{T},z")
    want = [("a.csv", *o) for o in parse_text(text, "csv", 3)] + [("b.csv", *o) for o in parse_text("y\n" * 200 + f"{T},z", "csv", 3)]
    df = recovered_files(spark, str(tmp_path), "csv", 3, multiline=True)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = df.select(F.element_at(F.split("file_name", "/"), -1).alias("f"), "line_no", "n_lines", "err_line", "kind", "err_column", "reason", "object")
    assert rows(got) == sorted(((w[0], w[2], w[7], w[8], w[1], w[3], w[4], w[6] and w[6].object) for w in want), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def test_a_line_is_parsed_once(spark):
    df = spark.createDataFrame([(f"{T},a", "csv", 3)], "raw string, fmt string, n_cols int")
    valid, _ = valid_and_rejected(parsed_lines(df), [])
    assert valid._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(f"{T},a".encode() + b"\xff\xfe\n" + f"{T},b\n".encode())
    assert rows(recovered_files(spark, str(tmp_path), "csv", 3), "line_no", "reason", "object") == [(1, "value", None), (2, None, "b")]
