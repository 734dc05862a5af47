"""Triples from files: Parquet, ORC, CSV, N-Triples, N-Quads, Turtle, TriG, RDF/XML and JSON-LD."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.sources.recovering import parsed_lines, valid_and_rejected

CANONICAL = ["subject", "predicate", "object"]
# The fixed pattern of the permissive reader.
NT_PATTERN = r"^<([^>]+)>\s+<([^>]+)>\s+(.*)\s+\.\s*$"
# File suffixes of syntaxes that only a full RDF parser reads.
RDF_SUFFIXES = {".rdf": "xml", ".xml": "xml", ".owl": "xml", ".n3": "n3", ".trig": "trig", ".trix": "trix", ".jsonld": "json-ld", ".json-ld": "json-ld", ".html": "html", ".ttl": "turtle"}


def read_triples(spark: SparkSession, path: str | Sequence[str], col_map: dict[str, str] | None = None, read_kwargs: dict | None = None, weighted: bool = False, mode: str = "strict", syntax: str | None = None) -> DataFrame:
    """(subject, predicate, object[, weights]) of files, by their suffix.

    `col_map` names source columns and what they become; columns that it
    doesn't name keep their names. `read_kwargs` go to the reader (`sep`,
    `header`, `schema`, ...); CSV has a header unless told otherwise, and all
    its columns are text. `mode` is for .nt and .nq: `strict` reads the
    grammar, keeps literals whole, leaves out the graph term and drops broken
    lines (use `recovering` to see them); `compat` is the permissive pattern.
    `weighted` without a weights column is a ValueError; an unknown suffix a
    NotImplementedError. `syntax` overrides the suffix.
    """
    paths = [path] if isinstance(path, str) else list(path)
    suffix = f".{syntax}" if syntax else PurePosixPath(paths[0].rstrip("/")).suffix.lower()
    kw = dict(read_kwargs or {})
    if suffix in (".parquet", ".orc"):
        df = spark.read.options(**kw).format(suffix[1:]).load(paths)
    elif suffix in (".csv", ".tsv"):
        schema = kw.pop("schema", None)
        options = {"header": True, **({"sep": "\t"} if suffix == ".tsv" else {}), "escape": '"'} | kw
        reader = spark.read.options(**options)
        df = (reader.schema(schema) if schema else reader).csv(paths)
    elif suffix in (".nt", ".nq"):
        df = nt_triples(spark.read.text(paths).withColumnRenamed("value", "raw"), "raw", mode, suffix[1:])
    elif suffix in RDF_SUFFIXES:
        df = _rdf(spark, paths, RDF_SUFFIXES[suffix])
    else:
        raise NotImplementedError(f"no reader for {suffix or 'files without suffix'}: parquet, orc, csv, tsv, nt, nq, {', '.join(sorted(RDF_SUFFIXES))}")
    return canonical(df, col_map, weighted)


def canonical(df: DataFrame, col_map: dict[str, str] | None = None, weighted: bool = False) -> DataFrame:
    """The canonical columns after renaming."""
    df = df.withColumnsRenamed({s: t for s, t in (col_map or {}).items() if s != t})
    if weighted and "weights" not in df.columns:
        raise ValueError("weighted walks need a 'weights' column: name it, or add it to col_map")
    missing = [c for c in CANONICAL if c not in df.columns]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}: add it to col_map")
    return df.select(*CANONICAL, *([F.col("weights").cast("double").alias("weights")] if weighted else []))


def nt_triples(lines: DataFrame, raw: str = "raw", mode: str = "strict", fmt: str = "nq", keep: Sequence[str] = ()) -> DataFrame:
    """Triples of lines in bracket notation; see `read_triples` for the modes. Lines that give none are left out."""
    if mode == "strict":
        return valid_and_rejected(parsed_lines(lines.select(*keep, F.col(raw).alias("raw"), F.lit(fmt).alias("fmt"), F.lit(None).cast("int").alias("n_cols"))), list(keep))[0].select(*keep, *CANONICAL)
    if mode != "compat":
        raise ValueError("mode must be strict or compat")
    part = lambda i: F.regexp_extract(raw, NT_PATTERN, i)
    return lines.where(F.col(raw).rlike(NT_PATTERN)).select(*keep, part(1).alias("subject"), part(2).alias("predicate"), F.regexp_replace(part(3), "^<|>$", "").alias("object"))


def _rdf(spark: SparkSession, paths: list[str], syntax: str) -> DataFrame:
    """Whole files, one task each: a part of such a file can't be read without what stands before it."""
    files = spark.read.text(paths, wholetext=True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from triloom.sources.turtle import triples_of

        for b in batches:
            for text in b.column(0).to_pylist():
                rows = list(triples_of(text, syntax))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=CANONICAL)

    if syntax not in ("turtle", "n3", "trig", "xml", "json-ld"):
        try:
            import rdflib  # noqa: F401
        except ImportError:
            raise ImportError(f"reading {syntax} needs the package rdflib") from None
    return files.mapInArrow(read, "subject string, predicate string, object string")


def merge_splits(spark: SparkSession, paths: Sequence[str], sep: str = "\t") -> DataFrame:
    """Header-less three-column files (train, valid, test) as one table."""
    return spark.read.csv(list(paths), sep=sep, schema="subject string, predicate string, object string")
