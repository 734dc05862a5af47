"""Duplicates hidden by formatting: canonical text, 128-bit hashes, copies counted with map-side combining."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.functions.numbers import PLAIN
from triloom.operators import skew
from triloom.session import written

# Fixed classes: what may stand around a number, and what counts in any text.
_AROUND = r"[\s\p{Z}\p{Cf}\"'“”„‟‘’‚‛«»‹›`´()\[\]{}<>]+"
_NOT_COUNTED = r"[^\p{L}\p{N}\p{M}]+"


def _compose(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in text.to_pylist()], pa.string())


def composed(text: Column) -> Column:
    """Text with accents composed (NFC). Only texts that hold combining marks are handed to Python."""
    return F.coalesce(F.arrow_udf(_compose, "string")(F.when(text.rlike(r"\p{M}"), text)), text)


def canonical(text: Column) -> Column:
    """Letters, digits and accents without regard to case; blanks, punctuation, symbols and invisible characters go."""
    return F.upper(F.regexp_replace(text, _NOT_COUNTED, ""))


def canonical_object(text: Column) -> Column:
    """As `canonical`, but a number inside blanks, quotation marks and brackets keeps sign and decimal point."""
    bare = F.regexp_replace(text, f"^{_AROUND}|{_AROUND}$", "")
    return F.when(bare.rlike(f"^{PLAIN}$"), bare).otherwise(canonical(text))


def placed(rows: DataFrame, order: str = "field_order", columns: tuple[str, str, str] = ("subject", "predicate", "object")) -> list[Column]:
    """Subject, predicate and object, each from the column that `order` names; null or unknown means spo."""
    o = F.coalesce(F.col(order), F.lit("spo"))
    at = lambda letter: F.when(F.length(o) == 3, F.instr(o, letter)).otherwise(0)
    out = []
    for i, letter in enumerate("spo"):
        c = F.col(columns[i])
        for j, col in enumerate(columns):
            if j != i:
                c = F.when(at(letter) == j + 1, F.col(col)).otherwise(c)
        out.append(c)
    return out


def hashed(rows: DataFrame, row_id: str = "row_id", order: str = "field_order", compose: bool = True) -> DataFrame:
    """(row id, h1, h2, check, k) of every row without a null among the three fields.

    h1 and h2 are 128 bits of hash over the canonical fields, whose text is k;
    `check` is a third hash of another family together with the fields'
    lengths, by which `records` tells apart rows whose 128 bits collide. A row
    whose id is null is left out. Other columns are ignored.
    """
    s, p, o = placed(rows, order)
    r = rows.select(F.col(row_id), s.alias("s"), p.alias("p"), o.alias("o")).where(F.col(row_id).isNotNull() & F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull())
    if compose:
        r = r.select(row_id, *[composed(F.col(c)).alias(c) for c in "spo"])
    r = r.select(row_id, canonical(F.col("s")).alias("s"), canonical(F.col("p")).alias("p"), canonical_object(F.col("o")).alias("o"))
    key = F.concat_ws("\x1f", "s", "p", "o")
    r = r.select(row_id, key.alias("k"))
    return r.select(row_id, F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(0x5DEECE66D), F.reverse("k")).alias("h2"), (F.hash("k").cast("bigint") * 4294967296 + F.length("k")).alias("check"), "k")


HASH = ["h1", "h2", "check"]


def records(h: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(h1, h2, check, copies, first): one row for each distinct record. Counts combine before they are shuffled."""
    return h.groupBy(*HASH).agg(F.count("*").alias("copies"), F.min(row_id).alias("first"))


def collisions(recs: DataFrame) -> DataFrame:
    """Hashes (h1, h2) that different records share."""
    return recs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")


def copies(h: DataFrame, recs: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(first, copy): every row that isn't its record's smallest, with that smallest.

    Records with several copies meet their rows by h1; the loads of the
    heaviest are known from `recs`, so a record with a third of all rows is
    split over the tasks. Then every copy is compared with the text of its
    record's first row; rows that hash alike with another text are records of
    their own, told apart by their texts.
    """
    rid = F.col(row_id)
    several = recs.where("copies > 1").select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("check").alias("rc"), "copies", "first")
    total = recs.agg(F.sum("copies")).first()[0] or 0
    plan = skew.plan_from_counts(several, "r1", "copies", total)
    alike = (F.col("h2") == F.col("r2")) & (F.col("check") == F.col("rc"))
    met = skew.join_by_key(h, several, F.col("h1"), F.col("r1"), plan=plan, spread=[rid]).where(alike).drop("r1", "r2", "rc", "copies")
    met = written(met, "copies")
    firsts = met.where(rid == F.col("first")).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("check").alias("rc"), F.col("k").alias("text")).distinct()
    compared = skew.join_by_key(met.where(rid > F.col("first")), firsts, F.col("h1"), F.col("r1"), plan=plan, spread=[rid]).where(alike)
    same = compared.where("k = text").select("first", rid.alias("copy"))
    other = compared.where("k <> text").select(rid, "h1", "k")  # hardly ever any
    own = other.groupBy(F.col("h1").alias("o1"), F.col("k").alias("ok")).agg(F.min(row_id).alias("first"))
    more = other.join(own, (F.col("h1") == F.col("o1")) & (F.col("k") == F.col("ok"))).where(rid > F.col("first"))
    return same.unionByName(more.select("first", rid.alias("copy")))
