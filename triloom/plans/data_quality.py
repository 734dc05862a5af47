"""Queries of the general problems: lines that don't parse, and keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.operators import skew
from triloom.plans.tables import table
from triloom.session import fresh_path, written
from triloom.sources.recovering import parsed_lines, recovered_files, valid_and_rejected

SEP = "\x1f"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are records but not valid, with the first reason that holds."""
    lines = table(spark, d, "kg_raw_lines").select("line_id", "fmt", "n_cols", "raw")
    return valid_and_rejected(parsed_lines(lines), ["line_id"])[1].select("line_id", "reason")


def p1_triples(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as triples."""
    lines = table(spark, d, "kg_raw_lines").select("line_id", "fmt", "n_cols", "raw")
    return valid_and_rejected(parsed_lines(lines), ["line_id"])[0]


def p1_reject_rates(spark: SparkSession, d: str) -> DataFrame:
    """For each file its records and how many were rejected for each reason."""
    lines = table(spark, d, "kg_raw_lines").select("file_name", "fmt", "n_cols", "raw")
    p = parsed_lines(lines).select("file_name", "parsed.kind", "parsed.reason").where("kind <> 'none'")
    n = lambda r: F.count(F.when(F.col("reason") == r, 1)).alias(r)
    return p.groupBy("file_name").agg(F.count("*").alias("records"), n("quoting"), n("column_count"), n("value"))


def p1_multiline(spark: SparkSession, d: str) -> DataFrame:
    """The triples of csv and tsv files whose quoted objects span lines, read with recovery.

    The lines of each file are written as files again, the blanks of their
    quoted objects as line breaks; lines that don't parse stay as they are,
    broken quotes among them, and must not take a record with them. One row for
    each record, line breaks as blanks again.
    """
    lines = table(spark, d, "kg_raw_lines").where("fmt IN ('csv', 'tsv') AND raw IS NOT NULL").select("fmt", "n_cols", "file_name", "line_no", "line_id", "raw")
    p = parsed_lines(lines).where("parsed.kind <> 'none'")
    o = F.col("parsed")
    term = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [o.subject, o.predicate, F.replace(term(o.object), F.lit(" "), F.lit("\n")), F.when(F.col("n_cols") == 4, o.weights.cast("string"))]
    spread = F.when(F.col("fmt") == "csv", F.concat_ws(",", *cells)).otherwise(F.concat_ws("\t", *cells))
    text = p.select("fmt", "n_cols", "file_name", "line_no", "line_id", F.when(o.kind == "record", spread).otherwise(F.regexp_replace("raw", r"\r?\n?$", "")).alias("value"))
    order = ["fmt", "n_cols", "file_name", "line_no", "line_id"]
    placed = text.repartitionByRange(skew.tasks_of(spark), *order).sortWithinPartitions(*order)
    root = fresh_path(spark, "texts")
    placed.select("fmt", "n_cols", "value").write.partitionBy("fmt", "n_cols").text(root)
    out = None
    for r in lines.select("fmt", "n_cols").distinct().collect():  # two formats, two widths
        one = recovered_files(spark, f"{root}/fmt={r['fmt']}/n_cols={r['n_cols']}", r["fmt"], r["n_cols"], multiline=True).where("kind = 'record'")
        one = one.select(F.lit(r["fmt"]).alias("fmt"), "subject", "predicate", F.replace("object", F.lit("\n"), F.lit(" ")).alias("object"), "weights")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "fmt string, subject string, predicate string, object string, weights double") if out is None else out


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """(field_name, key_value, rid): the rows of the three skewed fields."""
    e, t = table(spark, d, "edge_df"), table(spark, d, "tokens")
    part = lambda df, name, col, rid: df.where(col.isNotNull()).select(F.lit(name).alias("field_name"), col.cast("string").alias("key_value"), rid.alias("rid"))
    out = [part(e, f"edge_df.{c}", F.col(c), F.col("edge_id")) for c in ("subject", "predicate")]
    out.append(part(t.where("token >= 0"), "tokens.token", F.col("token"), F.xxhash64("walk_id", "pos")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """(entry, token): the vocabulary as the matching side of each field, one row for each value of it."""
    w = table(spark, d, "word2idx").where("token IS NOT NULL AND word IS NOT NULL")
    key = lambda name, c: F.struct(F.concat_ws(SEP, F.lit(name), F.col(c).cast("string")).alias("entry"))
    each = w.select("token", F.explode(F.array(key("edge_df.subject", "word"), key("edge_df.predicate", "word"), key("tokens.token", "token"))).alias("e"))
    return each.groupBy("e.entry").agg(F.min("token").alias("token"))


def _counted_where_met(spark: SparkSession, d: str) -> DataFrame:
    """(field_name, key_value, n_rows, token): each key's rows and the token of its entry in the vocabulary (null if it has none).

    Fragment and replicate: every row meets its key's entry. Heavy keys are
    split into shards, the entry is copied only to those, and the rows of a
    shard are counted where they meet it.
    """
    rows = _fields(spark, d).withColumn("key", F.concat_ws(SEP, "field_name", "key_value"))
    plan = skew.plan_shards(rows, F.col("key"))
    met = skew.join_by_key(rows, _entries(spark, d), F.col("key"), F.col("entry"), "left", plan, [F.col("rid")])
    per_key = skew.aggregate_by_key(met, F.col("key"), [F.count("*").alias("n"), F.min("token").alias("t")], [F.sum("n").alias("n_rows"), F.min("t").alias("token")], plan, [F.col("rid")])
    parts = F.split(skew.KEY, SEP, 2)
    return per_key.select(parts[0].alias("field_name"), parts[1].alias("key_value"), "n_rows", "token")


def p5_key_entries(spark: SparkSession, d: str) -> DataFrame:
    """Each key's rows and its entry in the vocabulary, of the three skewed fields."""
    w = table(spark, d, "word2idx").where("token IS NOT NULL").select(F.col("token").alias("__t"), "word")
    k = _counted_where_met(spark, d)
    return k.join(w, F.col("token") == F.col("__t"), "left").drop("__t")


def p5_key_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each key of the three skewed fields, and the field's rows."""
    rows = _fields(spark, d)
    key = F.concat_ws(SEP, "field_name", "key_value")
    per_key = skew.aggregate_by_key(rows, key, [F.count("*").alias("n")], [F.sum("n").alias("n_rows")], spread=[F.col("rid")])
    parts = F.split(skew.KEY, SEP, 2)
    return per_key.select(parts[0].alias("field_name"), parts[1].alias("key_value"), "n_rows")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that hold at least one fiftieth of their field's rows."""
    per_key = written(_counted_where_met(spark, d), "per-key")
    totals = per_key.groupBy("field_name").agg(F.sum("n_rows").alias("total"))  # three rows
    return per_key.join(F.broadcast(totals), "field_name").where("n_rows * 50 >= total").select("field_name", "key_value")


def p5_token_words(spark: SparkSession, d: str) -> DataFrame:
    """For each word the rows and first position of its token: a join whose left side is skewed."""
    t = table(spark, d, "tokens").where("token >= 0")
    w = table(spark, d, "word2idx").withColumnRenamed("token", "word_token")
    plan = skew.plan_shards(t, F.col("token"))
    joined = skew.join_by_key(t, w, F.col("token"), F.col("word_token"), plan=plan, spread=[F.col("walk_id"), F.col("pos")])
    return skew.aggregate_by_key(joined, F.col("word"), [F.count("*").alias("n"), F.min("pos").alias("p")], [F.sum("n").alias("n_rows"), F.min("p").alias("first_pos")]).withColumnRenamed(skew.KEY, "word")


QUERIES = {f.__name__: f for f in (p1_found, p1_triples, p1_reject_rates, p1_multiline, p5_found, p5_key_rows, p5_key_entries, p5_token_words)}

_FIELDS = """
  SELECT 'edge_df.subject' AS field_name, subject AS key_value FROM edge_df WHERE subject IS NOT NULL
  UNION ALL SELECT 'edge_df.predicate', predicate FROM edge_df WHERE predicate IS NOT NULL
  UNION ALL SELECT 'tokens.token', CAST(token AS VARCHAR) FROM tokens WHERE token >= 0"""
_KEY_ROWS = f"SELECT field_name, key_value, count(*) AS n_rows FROM ({_FIELDS}) f GROUP BY 1, 2"


# --- SQL of the lines: the formats' rules as patterns ---

_BARE_IRI = r'(?:https?://|urn:)[^\s\p{Z}\x00-\x20\x7f-\x9f\x{FFFD}<>"{}|\\^`]+'
_BAD = r"[\x00-\x1f\x7f-\x9f\x{FFFD}]"
_PLAIN = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
_STR = r'"(?:[^"\\]|\\.)*"'
_DT = r"\^\^<[^<>]*>"
_LEXED = rf'(?:[ \t]+|<[^<>]*>|{_STR}@[^ \t"<.]*|{_STR}{_DT}|{_STR}[ \t.]|[^ \t"<])*(?:{_STR})?(?:\.[ \t]*(?:#.*)?)?'
_TOKEN = rf'<[^<>]*>|{_STR}(?:@[^ \t"<.]*|{_DT})?|[^ \t"<]+'
_FORMS = {"integer": r"[+-]?[0-9]+", "decimal": _PLAIN, "double": rf"{_PLAIN}(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN", "boolean": "true|false|1|0", "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}"}


def _delimited_sql(fmt: str, sep: str) -> str:
    """(line_id, file_name, reason, subject, predicate, object, weights, graph) of the records of one delimited format."""
    one = rf'(?:"(?:[^"]|"")*"|[^"{sep}]*)'
    text = "CASE WHEN f[1] = '\"' THEN replace(substr(f, 2, length(f) - 2), '\"\"', '\"') ELSE f END"
    iri = lambda c: f"regexp_full_match({c}, '{_BARE_IRI}')"
    blank = lambda c: f"regexp_full_match({c}, '_:[A-Za-z0-9]+')"
    number = "TRY_CAST(ltrim(f4, '+') AS DOUBLE)"
    return rf"""SELECT line_id, file_name, CASE WHEN NOT ok THEN 'quoting' WHEN n <> n_cols THEN 'column_count'
        WHEN NOT ({iri("f1")} OR {blank("f1")}) OR NOT {iri("f2")} OR NOT ({iri("f3")} OR (regexp_matches(f3, '[^\s\p{{Z}}]') AND NOT regexp_matches(f3, '^(?:https?://|urn:)') AND NOT regexp_matches(f3, '{_BAD}')))
          OR (n_cols = 4 AND NOT coalesce(regexp_full_match(f4, '{_PLAIN}(?:[eE][+-]?[0-9]+)?') AND isfinite({number}) AND {number} >= 0, false)) THEN 'value' END AS reason,
        f1 AS subject, f2 AS predicate, f3 AS object, CASE WHEN n_cols = 4 THEN {number} END AS weights, NULL::VARCHAR AS graph
      FROM (SELECT *, fs[1] AS f1, fs[2] AS f2, fs[3] AS f3, fs[4] AS f4 FROM (SELECT *, len(raw_fs) AS n, list_transform(raw_fs, lambda f: {text}) AS fs FROM (
        SELECT *, regexp_full_match(t, '{one}(?:{sep}{one})*') AS ok, regexp_extract_all('{sep}' || t, '{sep}("(?:[^"]|"")*"|[^"{sep}]*)', 1) AS raw_fs FROM l WHERE fmt = '{fmt}') x) y) z"""


def _bracketed_sql() -> str:
    """The same of the records in bracket notation."""
    end = "x = '.' OR starts_with(x, '.#') OR (x[1] NOT IN ('<', '\"') AND ends_with(x, '.') AND length(x) > 1)"
    iri = lambda c: f"regexp_full_match({c}, '<{_BARE_IRI}>')"
    resource = lambda c: f"({iri(c)} OR regexp_full_match({c}, '_:[A-Za-z0-9]+'))"
    inner = lambda c: f"CASE WHEN {c}[1] = '<' THEN substr({c}, 2, length({c}) - 2) ELSE {c} END"
    body, rest = f"regexp_extract(o, '^\"((?:[^\"\\\\]|\\\\.)*)\"', 1)", f"regexp_extract(o, '^{_STR}(.*)$', 1)"
    name = f"string_split(substr({rest}, 4, length({rest}) - 4), '#')[-1]"
    forms = " ".join(f"WHEN '{k}' THEN regexp_full_match({body}, '{v}')" + (f" AND TRY_CAST({body} AS DATE) IS NOT NULL" if k == "date" else "") for k, v in _FORMS.items())
    literal = rf"""(o[1] = '"' AND NOT regexp_matches({body}, '{_BAD}') AND CASE WHEN {rest} = '' THEN true WHEN {rest}[1] = '@' THEN regexp_full_match({rest}, '@[A-Za-z]{{2,3}}(?:-[A-Za-z0-9]+)*')
        ELSE regexp_full_match({rest}, '\^\^<{_BARE_IRI}>') AND CASE {name} {forms} ELSE true END END)"""
    return rf"""SELECT line_id, file_name, CASE WHEN NOT ok THEN 'quoting' WHEN ci = 0 OR NOT (len(ts) = ci OR starts_with(ts[ci + 1], '#') OR starts_with(ts[ci], '.#')) OR n < 3 OR n > CASE fmt WHEN 'nq' THEN 4 ELSE 3 END THEN 'column_count'
        WHEN NOT {resource("s")} OR NOT {iri("p")} OR NOT ({resource("o")} OR {literal}) OR (n = 4 AND NOT {resource("g")}) THEN 'value' END AS reason,
        {inner("s")} AS subject, {inner("p")} AS predicate, {inner("o")} AS object, NULL::DOUBLE AS weights, CASE WHEN n = 4 THEN {inner("g")} END AS graph
      FROM (SELECT *, us[1] AS s, us[2] AS p, us[3] AS o, us[4] AS g FROM (SELECT *, CASE WHEN ci = 0 THEN 0 WHEN ts[ci] = '.' OR starts_with(ts[ci], '.#') THEN ci - 1 ELSE ci END AS n,
          list_transform(ts, lambda x: CASE WHEN x[1] NOT IN ('<', '"') AND ends_with(x, '.') THEN x[:-2] ELSE x END) AS us FROM (
        SELECT *, coalesce(list_position(list_transform(ts, lambda x: {end}), true), 0) AS ci FROM (
          SELECT *, regexp_full_match(t, '{_LEXED}') AS ok, regexp_extract_all(t, '{_TOKEN}') AS ts FROM l WHERE fmt IN ('nt', 'nq')) w) x) y) z"""


_LINES = rf"""l AS (SELECT line_id, file_name, fmt, n_cols, regexp_replace(regexp_replace(raw, '\n$', ''), '\r$', '') AS t FROM kg_raw_lines
    WHERE regexp_matches(raw, '[^\s\p{{Z}}]') AND NOT (fmt IN ('nt', 'nq') AND regexp_matches(raw, '^[\s\p{{Z}}]*#'))),
  r AS ({_delimited_sql("csv", ",")} UNION ALL {_delimited_sql("tsv", chr(9))} UNION ALL {_bracketed_sql()})"""

SQL = {
    "p1_found": f"WITH {_LINES} SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p1_triples": f"WITH {_LINES} SELECT line_id, subject, predicate, object, weights, graph FROM r WHERE reason IS NULL",
    "p1_reject_rates": f"WITH {_LINES} SELECT file_name, count(*) AS records, " + ", ".join(f"count(*) FILTER (reason = '{x}') AS {x}" for x in ("quoting", "column_count", "value")) + " FROM r GROUP BY 1",
    "p1_multiline": f"WITH {_LINES} SELECT l.fmt AS fmt, subject, predicate, object, weights FROM r JOIN l ON l.line_id = r.line_id WHERE reason IS NULL AND l.fmt IN ('csv', 'tsv')",
    "p5_key_entries": f"WITH k AS ({_KEY_ROWS}) SELECT field_name, key_value, n_rows, token, word FROM k LEFT JOIN word2idx w ON CASE field_name WHEN 'tokens.token' THEN CAST(w.token AS VARCHAR) ELSE w.word END = key_value",
    "p5_key_rows": _KEY_ROWS,
    "p5_found": f"WITH k AS ({_KEY_ROWS}) SELECT field_name, key_value FROM k WHERE n_rows * 50 >= (SELECT sum(n_rows) FROM k x WHERE x.field_name = k.field_name)",
    "p5_token_words": "SELECT w.word AS word, count(*) AS n_rows, min(t.pos) AS first_pos FROM tokens t JOIN word2idx w ON t.token = w.token WHERE t.token >= 0 GROUP BY 1",
}
