"""Session helpers: the shared work folder, tables written to cut lineage, and small tables of known size."""

from __future__ import annotations

import atexit
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

_written: list[tuple[SparkSession, str, int]] = []  # session, path, and the thread that wrote it


def build_session(app: str = "triloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; `conf` overrides (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one named in `spark.checkpoint.dir`. Where that is unset, a
    checkpoint folder set on the context is used, and else, on a local master
    only, a new temporary folder: a machine-local folder on a cluster would be
    invisible to the other machines, so there the missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="triloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{work_folder(spark)}/triloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path, threading.get_ident()))
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """`df`, written as a table in the shared folder and read again.

    The table cuts the lineage and outlives a lost executor. It is removed when
    the `scope` it was written in ends, else when the process ends.
    """
    path = fresh_path(df.sparkSession, name)
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    t = df.sparkSession.read.schema(df.schema).parquet(path)
    t._triloom_path = path
    return t


def drop(*tables: DataFrame) -> None:
    """Removes tables that `written` gave and that nothing reads any more."""
    release([t._triloom_path for t in tables if hasattr(t, "_triloom_path")])


def release(tables: Sequence[str]) -> None:
    """Removes tables that nothing reads any more, by path."""
    gone = set(tables)
    for spark, path, _ in [w for w in _written if w[1] in gone]:
        remove(spark, path)
    _written[:] = [w for w in _written if w[1] not in gone]


def mark() -> set[str]:
    """The tables there are now; `release_since` removes what this thread has written after."""
    return {path for _, path, _ in _written}


def release_since(point: set[str], *keep: DataFrame) -> None:
    kept = point | {getattr(t, "_triloom_path", None) for t in keep}
    release([path for _, path, thread in _written if thread == threading.get_ident() and path not in kept])


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are removed at the end: what is wanted of them has to be written elsewhere or collected before."""
    point = mark()
    try:
        yield
    finally:
        release_since(point)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def sweep(spark: SparkSession, older_than_hours: float = 48.0) -> int:
    """Removes tables that processes now dead left in the work folder; how many. Choose an age that no running process has."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{work_folder(spark)}/triloom")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    limit = (time.time() - older_than_hours * 3600) * 1000
    own = {path.rpartition("/")[2] for _, path, _ in _written}
    old = [x.getPath() for x in fs.listStatus(root) if x.getModificationTime() < limit and x.getPath().getName() not in own]
    for path in old:
        fs.delete(path, True)
    return len(old)


def local_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A small table of driver-side rows. Catalyst knows its size, so whether it is broadcast follows from that."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    kinds = [to_arrow_type(f.dataType) for f in schema]
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names), schema)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side document that is there whole or not at all. That there is one already is an error."""
    jvm = spark.sparkContext._jvm
    target, own = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(own, target):
        fs.delete(own, False)
        raise FileExistsError(path)


def get_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path, _ in _written:
        try:
            remove(spark, path)
        except Exception:
            return
