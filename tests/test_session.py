import os

import pytest
from conftest import rows

from triloom import session


def test_tables_of_a_scope_are_removed_at_its_end(spark):
    kept = session.written(spark.range(3), "kept")
    with session.scope():
        inside = session.written(spark.range(5), "inside")
        assert inside.count() == 5
    path = inside._triloom_path
    assert not session.exists(spark, path)
    assert session.exists(spark, kept._triloom_path)
    with pytest.raises(KeyError), session.scope():
        failed = session.written(spark.range(1), "failed")
        raise KeyError
    assert not session.exists(spark, failed._triloom_path)
    session.drop(kept, spark.range(1))
    assert not session.exists(spark, kept._triloom_path)


def test_what_dead_processes_left_is_swept(spark):
    own = session.written(spark.range(1), "own")
    root = own._triloom_path.removeprefix("file:").rpartition("/")[0]
    os.mkdir(f"{root}/left-1")
    os.utime(f"{root}/left-1", (0, 0))
    os.utime(own._triloom_path.removeprefix("file:"), (0, 0))
    assert session.sweep(spark) == 1
    assert own.count() == 1
    assert not os.path.exists(f"{root}/left-1")


def test_documents_are_written_whole_and_once(spark, tmp_path):
    path = str(tmp_path / "folder" / "a.json")
    assert session.names(spark, str(tmp_path / "folder")) == []
    session.put_text(spark, path, '{"a": "é"}')
    assert session.get_text(spark, path) == '{"a": "é"}'
    with pytest.raises(FileExistsError):
        session.put_text(spark, path, "other")
    assert [n for n in session.names(spark, str(tmp_path / "folder")) if not n.startswith(".")] == ["a.json"]


def test_local_table(spark):
    t = session.local_table(spark, [(1, [2, 3], None), (2, [], "x")], "a int, b array<int>, c string")
    assert rows(t, "a", "c") == [(1, None), (2, "x")]
    assert session.local_table(spark, [], "a int, b array<int>").count() == 0
