"""Reading lines and files with the error-recovering grammar: valid triples on one side, rejects with their reason on the other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triloom.session import written
from triloom.sources.grammar import MAX_RECORD, SEPARATORS, Outcome, Reader, is_record_start, parse_rows

_TRIPLE = "subject string, predicate string, object string, weights double, graph string"
_OUTCOME = f"kind string, err_column int, reason string, expected string, {_TRIPLE}"
_ARROW = pa.struct([("kind", pa.string()), ("err_column", pa.int32()), ("reason", pa.string()), ("expected", pa.string()), ("subject", pa.string()), ("predicate", pa.string()), ("object", pa.string()), ("weights", pa.float64()), ("graph", pa.string())])


def _columns(outcomes: list[Outcome]) -> pa.StructArray:
    triples = [o.triple for o in outcomes]
    parts = [[o.kind for o in outcomes], [o.column for o in outcomes], [o.reason for o in outcomes], [o.expected for o in outcomes]]
    parts += [[t and t[i] for t in triples] if i != 3 else [t[3] if t else None for t in triples] for i in range(5)]
    return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(parts, _ARROW, strict=True)], fields=list(_ARROW))


def _parse(raw: pa.Array, fmt: pa.Array, n_cols: pa.Array) -> pa.Array:
    """The lines of each format and number of columns as one text, whose record starts are its rows."""
    kinds: dict[tuple, list[int]] = {}
    for i, kind in enumerate(zip(fmt.to_pylist(), n_cols.to_pylist(), strict=True)):
        kinds.setdefault(kind, []).append(i)
    lines, out = raw.to_pylist(), [None] * len(raw)
    for kind, places in kinds.items():
        for i, o in zip(places, parse_rows([lines[i] for i in places], *kind), strict=True):
            out[i] = o
    return _columns(out)


def parsed_lines(lines: DataFrame, raw: str = "raw", fmt: str = "fmt", n_cols: str = "n_cols", into: str = "parsed") -> DataFrame:
    """Adds to each line what the grammar made of it, as the struct column `into`.

    Every row of `lines` is a validated record start, so a broken quote ends
    with its row. `parsed.kind` is record, error or none (null, blank and
    comment lines). A null or unknown format gives the reason `format`. All
    other columns stay as they are, also such as have names of the struct's
    fields. Nothing is shuffled, and each line is parsed once whatever is asked
    of the struct: the function is marked so that no filter repeats it.
    """
    parse = F.arrow_udf(_parse, _OUTCOME).asNondeterministic()
    return lines.withColumn(into, parse(F.col(raw), F.col(fmt), F.col(n_cols).cast("int")))


def valid_and_rejected(parsed: DataFrame, keys: list[str], into: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """The triples and the rejects of `parsed_lines`, each with the columns `keys`.

    Both read the same lines; where both are written, persist `parsed` first.
    """
    p: Column = F.col(into)
    valid = parsed.where(p.kind == "record").select(*keys, *[p[x].alias(x) for x in ("subject", "predicate", "object", "weights", "graph")])
    rejected = parsed.where(p.kind == "error").select(*keys, p.reason.alias("reason"), p.err_column.alias("err_column"), p.expected.alias("expected"))
    return valid, rejected


def recovered_files(spark: SparkSession, path: str | list[str], fmt: str, n_cols: int | None = None, multiline: bool = False, max_record: int = MAX_RECORD) -> DataFrame:
    """Files read with recovery, as rows (file_name, line_no, n_lines, err_line, kind, err_column, reason, expected, subject, predicate, object, weights, graph).

    A record begins at `line_no` and has `n_lines`, more than one only with
    `multiline` in csv and tsv; an error lies in `err_line`. Files are split as
    any text: whether a line begins a record follows from the line alone, so a
    task reads its part from the first record start on. Lines before it, and a
    quote still open at the part's end, go on to a second stage that puts them
    together across parts. Line numbers follow from the lines of the parts
    before. A record of more than `max_record` characters is an error. Bytes
    that are no UTF-8 are read as U+FFFD. Files
    are read once; what the first stage makes of them is a written table.
    """
    text = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("part"), F.make_valid_utf8("value").alias("value"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: _Part | None = None
        for b in batches:
            out: list[tuple] = []
            names = b.column(0).dictionary_encode()
            for name, begin, line in zip(names.to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if part is None or part.key != (name, begin):
                    if part is not None:
                        out.extend(part.end())
                    part = _Part((name, begin), Reader(fmt, n_cols, multiline, max_record))
                out.extend(part.feed(line))
            if out:
                yield _stage_batch(out)
        if part is not None:
            yield _stage_batch(part.end())

    first = written(text.mapInArrow(read, _STAGE), "parts")
    parts = first.where("kind = 'part'").select("file_name", "part", F.col("n_lines").alias("lines"), (F.col("line_no") > 0).cast("int").alias("anchored"))
    before = Window.partitionBy("file_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split of a file
    parts = parts.select("file_name", "part", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("__lines"), F.coalesce(F.sum("anchored").over(before), F.lit(0)).alias("__starts"))
    placed = first.where("kind <> 'part'").join(parts, ["file_name", "part"])
    placed = placed.withColumn("line_no", (F.col("line_no") + F.col("__lines")).cast("int")).withColumn("err_line", (F.col("err_line") + F.col("__lines")).cast("int"))
    whole = placed.where("kind IN ('record', 'error')").select(*_FILE_COLUMNS)
    if not multiline or fmt not in SEPARATORS:
        return whole
    # a tail begins a chain, the heads of the parts after it up to the next record start go on with it
    chain = (F.col("__starts") + (F.col("kind") == "tail").cast("int")).alias("chain")
    rest = placed.where("kind IN ('head', 'tail')").select("file_name", chain, "part", "kind", "line_no", "held")

    def put_together(t: pa.Table) -> pa.Table:
        name = t.column("file_name")[0].as_py()
        reader, out = Reader(fmt, n_cols, multiline, max_record), []
        for r in sorted(t.select(["part", "line_no", "held"]).to_pylist(), key=lambda r: (r["part"], r["line_no"])):
            for i, line in enumerate(r["held"]):
                out.extend(reader.feed(line, r["line_no"] + i))
        out.extend(reader.finish())
        return pa.Table.from_batches([_file_batch(name, [o for o in out if o.kind != "none"])])

    return whole.unionByName(rest.groupBy("file_name", "chain").applyInArrow(put_together, _FILE))


_FILE = f"file_name string, line_no int, n_lines int, err_line int, {_OUTCOME}"
_FILE_COLUMNS = [x.split()[0] for x in _FILE.split(", ")]
_STAGE = f"part bigint, held array<string>, {_FILE}"


class _Part:
    """One split of a file: its lines up to the first record start are its head, those of a quote open at its end its tail."""

    def __init__(self, key: tuple, reader: Reader) -> None:
        self.key, self.reader, self.lines, self.head = key, reader, 0, [] if reader.multiline else None
        self.anchored = self.head is None

    def feed(self, line: str) -> Iterator[tuple]:
        """Rows (name, part, held, outcome); line numbers count from 1 in the part."""
        self.lines += 1
        if not self.anchored:
            if not is_record_start(line.removesuffix("\r"), self.reader.fmt, self.reader.n_cols):
                self.head.append(line)
                return
            self.anchored = True
        for o in self.reader.feed(line, self.lines):
            if o.kind != "none":
                yield (*self.key, None, o)

    def end(self) -> list[tuple]:
        none = (None,) * 4
        out = [(*self.key, None, Outcome("part", int(self.anchored), *none, self.lines))]
        if self.head:
            out.append((*self.key, self.head, Outcome("head", 1, *none, len(self.head))))
        if self.reader.held:
            out.append((*self.key, self.reader.held, Outcome("tail", self.reader.first, *none, len(self.reader.held))))
        return out


def _file_columns(names: list[str], outcomes: list[Outcome]) -> list[pa.Array]:
    ints = [pa.array(x, pa.int32()) for x in ([o.line_no for o in outcomes], [o.n_lines for o in outcomes], [o.err_line for o in outcomes])]
    return [pa.array(names, pa.string()), *ints, *_columns(outcomes).flatten()]


def _file_batch(name: str, outcomes: list[Outcome]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(_file_columns([name] * len(outcomes), outcomes), names=_FILE_COLUMNS)


def _stage_batch(rows: list[tuple]) -> pa.RecordBatch:
    names, parts, held, outcomes = (list(x) for x in zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(held, pa.list_(pa.string())), *_file_columns(names, outcomes)], names=["part", "held", *_FILE_COLUMNS])
