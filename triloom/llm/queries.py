"""Queries of the training-data problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.functions.numbers import literal_number
from triloom.llm import areas, dedup, digest, frequency, mixing, packing, pairs, tokenizer
from triloom.llm.sql import SQL  # noqa: F401
from triloom.plans.tables import table
from triloom.session import written


def _pair_table(spark: SparkSession, d: str) -> pairs.PairTable:
    """The pair table of all walks, after three loads.

    The first brings ten sixteenths of the walks (by a draw from their id), two
    of them cut short and one by mistake. The second brings the rest, corrects
    the walks that were cut and removes the mistaken ones; the third brings
    these. In the end each walk counts once, with all its rows.
    """
    rows = table(spark, d, "pairs").withColumn("part", load_part(F.col("walk_id")))
    cut = "part IN (1, 2) AND (center + context) % 2 = 0"
    t = pairs.temporary(spark)
    t.apply(rows.where(f"part < 10 AND part NOT IN (1, 2) OR {cut}"))
    t.apply(rows.where("part IN (1, 2) OR part >= 10"), rows.where(f"{cut} OR part = 3"))
    return t.apply(rows.where("part = 3"))


def load_part(record: Column) -> Column:
    """A number from 0 to 15 by which records are dealt to loads: the high bits of a multiplicative hash."""
    return F.floor(F.pmod(F.pmod(record, F.lit(65536)) * 40503, F.lit(65536)) / 4096).cast("int")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of terms that meet in at least 12 walks and at least 20 times as often as by chance."""
    t = _pair_table(spark, d)
    return pairs.far_above_chance(t, 12, 20).select(F.col("a").alias("token_a"), F.col("b").alias("token_b"))


def p2_lift(spark: SparkSession, d: str) -> DataFrame:
    """Walks, marginals and lift of every pair."""
    return _pair_table(spark, d).scores().select(F.col("a").alias("token_a"), F.col("b").alias("token_b"), F.col("n").alias("n_walks"), "n_a", "n_b", "lift")


def p2_affected(spark: SparkSession, d: str) -> DataFrame:
    """Walks, marginals and lift of the pairs that the last load affected."""
    return _pair_table(spark, d).affected().select(F.col("a").alias("token_a"), F.col("b").alias("token_b"), F.col("n").alias("n_walks"), "n_a", "n_b", "lift")


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    """(edge_id, predicate, value) of edges whose object is a number, each edge once, as a written table."""
    e = table(spark, d, "edge_df").where("predicate IS NOT NULL AND object IS NOT NULL")
    v = e.select("edge_id", "predicate", literal_number(F.col("object")).alias("value")).where("value IS NOT NULL")
    return written(v.distinct(), "numbers")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose number lies more than three interquartile ranges outside its predicate's quartiles."""
    v = _numbers(spark, d)
    q = digest.exact_quantiles(v, "predicate", "value", [0.25, 0.75])
    return digest.far_outliers(v, q, "predicate", "value").select("edge_id")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact median and other percentiles of each predicate's numbers."""
    return digest.exact_quantiles(_numbers(spark, d), "predicate", "value", [0.05, 0.25, 0.5, 0.75, 0.95])


def p3_certified(spark: SparkSession, d: str) -> DataFrame:
    """Digest estimates of percentiles with their certified rank error."""
    v = _numbers(spark, d)
    m = digest.merged(digest.digests(v, "predicate", "value"), "predicate")
    return digest.certified(v, "predicate", "value", digest.estimated(m, "predicate", [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]))


def p3_certified_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The same with the values counted, and whether each estimate's true rank is off by at most one hundredth of the rows and one row."""
    return p3_certified(spark, d).select("predicate", "q", "n", (F.col("rank_error") <= 0.01 + 1 / F.col("n")).alias("within"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tokens")
    walks = t.agg(F.countDistinct("walk_id")).first()[0]
    return frequency.marked_terms(frequency.term_counts(t.where("token >= 0")), table(spark, d, "word2idx"), walks)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Tokens too rare or too common to be useful."""
    return _marked(spark, d).where("mark IS NOT NULL").select("token", "mark")


def p4_word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, walks and mark of every word."""
    w = table(spark, d, "word2idx").withColumnRenamed("token", "word_token")
    return w.join(_marked(spark, d), F.col("word_token") == F.col("token")).select("token", "word", "occurrences", "records", "mark")


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = written(dedup.hashed(table(spark, d, "kg_file_reader")), "hashed")
    return h, written(dedup.records(h), "records")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are copies of another row, with the smallest row of their set."""
    h, recs = _records(spark, d)
    return dedup.copies(h, recs).select(F.col("first").alias("first_row_id"), F.col("copy").alias("copy_row_id"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """One row for each distinct record: its first row and number of copies."""
    return dedup.records(dedup.hashed(table(spark, d, "kg_file_reader"))).select(F.col("first").alias("first_row_id"), "copies")


def _sizes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Documents with their tokens, as a written table without the texts."""
    return written(tokenizer.with_tokens(table(spark, d, "documents").select("doc_id", *columns, "text")), "sizes")


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """All documents, packed into each kind of container."""
    return packing.packed(_sizes(spark, d), table(spark, d, "pack_sizes"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each kind are."""
    return packing.fill(p7_pack(spark, d), table(spark, d, "pack_sizes"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """For each kind of container: documents packed, and counts of what must not be.

    Documents not whole (a gap, an overlap, or another size than their own),
    split without need, and containers over their capacity; `full` says whether
    nine tenths of the room of all containers but one for each group is used.
    """
    sizes, kinds = _sizes(spark, d), table(spark, d, "pack_sizes")
    p = written(packing.packed(sizes, kinds), "packed")
    by_doc = p.groupBy("container", "doc_id").agg(F.sum("tokens").alias("n"), F.max("size_to").alias("to"), F.count("*").alias("pieces"), F.countDistinct("size_from").alias("begins"))
    each = by_doc.join(sizes.withColumnRenamed("tokens", "own"), "doc_id").join(kinds, "container")
    wrong = (F.col("n") != F.col("own")) | (F.col("to") != F.col("own")) | (F.col("begins") != F.col("pieces"))
    needless = F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("own") / F.col("capacity_tokens")))
    docs = each.groupBy("container").agg(F.count("*").alias("documents"), F.sum(wrong.cast("int")).alias("not_whole"), F.sum(needless.cast("int")).alias("split_without_need"))
    bins = p.groupBy("container", "bin_id").agg(F.sum("tokens").alias("n")).join(kinds, "container")
    over = bins.groupBy("container").agg(F.sum((F.col("n") > F.col("capacity_tokens")).cast("int")).alias("over_capacity"), F.sum("n").alias("used"), ((F.count("*") - 1 - sizes.count() // packing.GROUP_ITEMS) * F.max("capacity_tokens")).alias("room"))
    return docs.join(over, "container").select("container", "documents", "not_whole", "split_without_need", "over_capacity", (F.col("used") >= 0.9 * F.col("room")).alias("full"))


def _mix(spark: SparkSession, d: str) -> DataFrame:
    sizes = mixing.version_weights(_sizes(spark, d, "source", "docket"), "doc_id", "docket")
    return mixing.mixed(written(sizes, "weighted"), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mix(spark, d)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share that each source reaches."""
    return mixing.shares(written(_mix(spark, d), "mix"), table(spark, d, "mix_targets"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """For each target its share among the sources with documents, and whether the mixture keeps it.

    `near`: the reached share differs from it by no more than the largest
    document of each source weighs; `capped`: no document is used more often
    than allowed; `once`: none has two rows.
    """
    sizes, targets = _sizes(spark, d, "source", "docket"), table(spark, d, "mix_targets")
    m = written(mixing.mixed(written(mixing.version_weights(sizes, "doc_id", "docket"), "weighted"), targets), "mix")
    there = sizes.where("tokens > 0").join(targets.where("target_share > 0 AND max_repeats > 0").select("source", "target_share"), "source").groupBy("source").agg(F.max("target_share").alias("s"), F.max("tokens").alias("largest"))
    whole = there.agg(F.sum("s").alias("s"), F.sum("largest").alias("largest")).first()
    total = m.agg(F.sum(F.col("copies") * F.col("tokens"))).first()[0] or 1
    reached = mixing.shares(m, targets).join(there.select("source", "s"), "source", "left").join(targets.select("source", "max_repeats"), "source")
    wanted = F.coalesce(F.col("s") / F.lit(whole["s"] or 1.0), F.lit(0.0))
    rows = m.groupBy(F.col("source").alias("__s")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"))
    near = F.abs(F.col("reached_share") - wanted) <= (whole["largest"] or 0) / total + 1e-9
    out = reached.join(rows, F.col("source") == F.col("__s"), "left")
    return out.select("source", F.round(wanted, 9).alias("wanted_share"), near.alias("near"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"), F.coalesce(F.col("n") == F.col("d"), F.lit(True)).alias("once"))


def _areas(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    names = sorted(r["area"] for r in table(spark, d, "subject_areas").where("area IS NOT NULL").select("area").distinct().collect())
    in_dispute = areas.Settings(units=areas.numbered_paragraphs, least_units=2)  # the problem's own rule
    return areas.scored(docs, areas.train(docs, table(spark, d, "area_labels"), names, in_dispute))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The areas that the dispute of each document is about."""
    return _areas(spark, d)


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by area."""
    return areas.composition(_areas(spark, d), table(spark, d, "documents"), table(spark, d, "subject_areas"))


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """One row on the areas found: counts of pairs named twice, of unknown documents and areas, and of areas whose composition isn't what the pairs give."""
    docs, areas_ = table(spark, d, "documents"), table(spark, d, "subject_areas")
    found = written(_areas(spark, d), "areas")
    length = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("len"))
    again = areas_.select("area").distinct().join(found.join(length, "doc_id"), "area", "left").groupBy("area").agg(F.count("doc_id").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("chars"))
    c = areas.composition(found, docs, areas_).withColumnRenamed("area", "__a")
    counts = {
        "named_twice": found.groupBy("doc_id", "area").count().where("count > 1"),
        "unknown_documents": found.join(docs, "doc_id", "left_anti"),
        "unknown_areas": found.join(areas_, "area", "left_anti"),
        "differing": again.join(c, F.col("area") == F.col("__a"), "full").where("NOT (n <=> documents AND chars <=> characters)"),
    }
    each = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("fault")) for name, df in counts.items()])
    return each.agg(*[F.count(F.when(F.col("fault") == name, 1)).alias(name) for name in counts])


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_lift, p2_affected, p3_found, p3_percentiles, p3_certified, p3_certified_bounds, p4_found, p4_word_counts, p6_found, p6_records, p7_pack, p7_fill, p7_check, p8_mix, p8_shares, p8_check, p9_found, p9_composition, p9_check)
}
