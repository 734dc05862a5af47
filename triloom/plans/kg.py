"""Queries over the knowledge graph, and the SQL that checks them.

Two graphs: the triples of `edge_df`, and one made of the relational tables
(regions, nations, customers, suppliers and orders), a deep one whose
breadth-first trees start at the regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.model import KGEmbedder, wide
from triloom.operators import corpus, graph, literals, search, vocab, walks
from triloom.plans.tables import table
from triloom.session import written
from triloom.sources.readers import nt_triples

DEPTH, WALKS, SEED, WINDOW = 4, 2, 42, 2
RELATION = "http://core.lexgraph.example/rel/"
# Fixed names: the predicates whose objects are number literals.
LITERALS = [RELATION + n for n in ("age", "altitude", "area", "beam", "capacity", "crew", "depth", "distance", "draught", "duration", "fare", "fee")]


def _triples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edge_df").select("subject", "predicate", "object", "weights")


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    t = _triples(spark, d)
    return written(vocab.encoded(t, vocab.vocabulary(t)), "encoded")


def kg_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples without a null term, as loaded."""
    return vocab.complete(_triples(spark, d))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return vocab.vocabulary(_triples(spark, d))


def encode_edges(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d)


def decode_edges(spark: SparkSession, d: str) -> DataFrame:
    t = _triples(spark, d)
    v = vocab.vocabulary(t)
    return vocab.decoded(vocab.encoded(t, v), v)


def vertex_set(spark: SparkSession, d: str) -> DataFrame:
    return graph.vertices(_encoded(spark, d))


def degree_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.metrics(_encoded(spark, d)).drop("density")


def degree_table(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_encoded(spark, d))


def degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_distribution(_encoded(spark, d))


def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return graph.metrics(_encoded(spark, d)).select("number_nodes", "number_edges", "density")


def out_degree_index(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_index(_encoded(spark, d))


def weight_index(spark: SparkSession, d: str) -> DataFrame:
    """Out index with running weights; of equal edges the one of smaller weight comes first."""
    return graph.out_index(_encoded(spark, d), weighted=True)


def nt_parse(spark: SparkSession, d: str) -> DataFrame:
    """The lines in bracket notation, read by the permissive pattern."""
    lines = table(spark, d, "kg_raw_lines").where("fmt IN ('nt', 'nq')")
    return nt_triples(lines, "raw", mode="compat", keep=["line_id"])


def literal_drop(spark: SparkSession, d: str) -> DataFrame:
    return literals.dropped(_triples(spark, d), LITERALS)


def literal_bin_uniform(spark: SparkSession, d: str) -> DataFrame:
    return literals.binned(_triples(spark, d), LITERALS, 5, "uniform")


def literal_bin_quantile(spark: SparkSession, d: str) -> DataFrame:
    return literals.binned(_triples(spark, d), LITERALS, 5, "quantile")


def predicate_local_name(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).where("predicate IS NOT NULL").select("predicate", literals.local_name(F.col("predicate")).alias("name")).distinct()


def numeric_coerce(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each predicate: how many objects are numbers, and their extremes."""
    v = _triples(spark, d).select("predicate", literals.numeric(F.col("object")).alias("v"))
    return v.groupBy("predicate").agg(F.count("*").alias("n_rows"), F.count("v").alias("numbers"), F.min("v").alias("least"), F.max("v").alias("most"), F.countDistinct("v").alias("distinct_numbers"))


def start_replication(spark: SparkSession, d: str) -> DataFrame:
    return walks.replicated(graph.vertices(_encoded(spark, d)), WALKS)


def _walk(spark: SparkSession, d: str, **more: object) -> DataFrame:
    return walks.random_walks(_encoded(spark, d), depth=DEPTH, walk_number=WALKS, seed=SEED, hashing="md5", **more)


def walk_uniform(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d, multi_edge="sample")


def walk_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d, weighted=True, multi_edge="sample")


def hop_fanout(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d)


def _relational(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Encoded edges region - nation - customer, supplier - order, and the tokens of regions."""
    t = lambda name: table(spark, d, name)
    name = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c).cast("string"))
    part = lambda df, s, p, o: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    parts = [
        part(t("nation"), name("region", "n_regionkey"), "hasNation", name("nation", "n_nationkey")),
        part(t("nation"), name("nation", "n_nationkey"), "inRegion", name("region", "n_regionkey")),
        part(t("customer"), name("nation", "c_nationkey"), "hasCustomer", name("customer", "c_custkey")),
        part(t("customer"), name("nation", "c_nationkey"), "servesMarket", name("customer", "c_custkey")),
        part(t("supplier"), name("nation", "s_nationkey"), "hasSupplier", name("supplier", "s_suppkey")),
        part(t("orders"), name("customer", "o_custkey"), "placed", name("order", "o_orderkey")),
    ]
    triples = parts[0]
    for p in parts[1:]:
        triples = triples.unionByName(p)
    v = vocab.vocabulary(triples)
    return written(vocab.encoded(triples, v), "encoded"), v.where("word LIKE 'region/%'").select("token")


def walk_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first walks over `edge_df` from the five vertices of highest degree."""
    e = _encoded(spark, d)
    return walks.bfs_walks(e, graph.top_k_by_degree(e, 5).select("vertex"), depth=3)


def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Mean centralities and density of `edge_df`; betweenness from 16 random sources, with its standard error."""
    s = graph.graph_statistics(_encoded(spark, d), sources=16, seed=SEED)
    return s.withColumns({c: F.round(c, 6) for c in ("mean_betweenness", "betweenness_error")})


def walk_bfs_relational(spark: SparkSession, d: str) -> DataFrame:
    e, starts = _relational(spark, d)
    return walks.bfs_walks(e, starts, depth=3)


def bfs_leaves(spark: SparkSession, d: str) -> DataFrame:
    e, starts = _relational(spark, d)
    return walks.bfs_leaves(e, starts, depth=3)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tokens(_walk(spark, d))


def walk_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d)


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.token_counts(_tokens(spark, d))


def min_count_filter(spark: SparkSession, d: str) -> DataFrame:
    return corpus.frequent(written(_tokens(spark, d), "tokens"), 5)


def skipgram_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the pairs of the walks that the table `tokens` holds."""
    return corpus.pair_totals(_given(spark, d), WINDOW)


def pair_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the pairs of new uniform walks, whose parallel edges are counted before tokens meet."""
    return corpus.pair_totals(corpus.counted_tokens(_walk(spark, d, multi_edge="counted")), WINDOW)


def _given(spark: SparkSession, d: str) -> DataFrame:
    return corpus.unpadded(table(spark, d, "tokens"))


def tokens_unpadded(spark: SparkSession, d: str) -> DataFrame:
    """The walks of the table `tokens` without padding and repeated deliveries."""
    return _given(spark, d)


def sequence_hops(spark: SparkSession, d: str) -> DataFrame:
    """Hops between the entities (even positions) of those walks."""
    return walks.from_sequences(_given(spark, d).where("pos % 2 = 0"), vertex="token")


def cbow_contexts(spark: SparkSession, d: str) -> DataFrame:
    c = corpus.cbow_contexts(_given(spark, d), WINDOW)
    return c.select("walk_id", "pos", "center", F.array_join(F.transform("context", lambda x: x.cast("string")), ",").alias("context"))


def predict_center_topk(spark: SparkSession, d: str) -> DataFrame:
    """For each vector whose id is divisible by 20 the five vectors of highest dot product."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.top_k(v, q, 5, item="vec_id").withColumn("score", F.round("score", 4))


def betweenness_small(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness in the graph of regions and nations, both directions."""
    n = table(spark, d, "nation")
    there = n.select((F.col("n_regionkey") + 1000).alias("subject"), F.col("n_nationkey").alias("object"))
    e = there.unionByName(there.select(F.col("object").alias("subject"), F.col("subject").alias("object")))
    return graph.betweenness(e)


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Extremes, mean, deviation and number of event values for each type: the form of a benchmark's run summary."""
    e = table(spark, d, "events").where("value IS NOT NULL")
    return e.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"), F.count("*").alias("runs"))


def _pipeline(spark: SparkSession, d: str, **settings: object) -> KGEmbedder:
    """Fitted on all triples of `edge_df`, its numbers binned, over walks from every vertex."""
    m = KGEmbedder(spark, **{"walk_number": 1, "walk_depth": 2, "vector_size": 16, "window_size": 2, "epochs": 1, "learning_rate": 0.01, "literal_predicates": LITERALS, "literal_strategy": "bin"} | settings)
    return m.fit(_triples(spark, d))


def _fitted(spark: SparkSession, d: str, **settings: object) -> DataFrame:
    return _pipeline(spark, d, **settings).transform()


def _invariants(spark: SparkSession, d: str, **settings: object) -> DataFrame:
    """One row on the vectors after two epochs: words, distinct tokens, lengths, whether all values are finite and the loss falls."""
    m = _pipeline(spark, d, epochs=2, **settings)
    finite = F.forall("embedding", lambda x: F.abs(x) < float("inf"))
    v = m.transform().agg(F.count("*").alias("words"), F.countDistinct("token").alias("tokens"), F.min(F.size("embedding")).alias("shortest"), F.max(F.size("embedding")).alias("longest"), F.min(finite).alias("finite"))
    return v.withColumn("loss_falls", F.lit(m.losses[-1] < m.losses[0]))


def fit_skipgram_invariants(spark: SparkSession, d: str) -> DataFrame:
    return _invariants(spark, d)


def fit_cbow_invariants(spark: SparkSession, d: str) -> DataFrame:
    return _invariants(spark, d, embedding_model="cbow", batch_size=128)


def fit_ordered_skipgram_invariants(spark: SparkSession, d: str) -> DataFrame:
    return _invariants(spark, d, order_aware=True)


def fit_ordered_cbow_invariants(spark: SparkSession, d: str) -> DataFrame:
    return _invariants(spark, d, embedding_model="cbow", order_aware=True)


def fit_skipgram(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d)


def fit_cbow(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, embedding_model="cbow", batch_size=128)


def fit_mllib(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, backend="mllib")


def transform_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide(_fitted(spark, d), 16)


QUERIES = {
    f.__name__: f
    for f in (
        kg_triples, vocabulary, encode_edges, decode_edges, vertex_set, degree_stats, degree_table, degree_distribution, graph_density, out_degree_index, weight_index, nt_parse,
        literal_drop, literal_bin_uniform, literal_bin_quantile, predicate_local_name, numeric_coerce,
        start_replication, walk_uniform, walk_weighted, hop_fanout, walk_bfs, walk_bfs_relational, bfs_leaves, graph_statistics,
        walk_tokens, tokens_unpadded, sequence_hops, token_counts, min_count_filter, skipgram_pairs, pair_totals, cbow_contexts,
        predict_center_topk, betweenness_small, run_summary,
        fit_skipgram, fit_cbow, fit_mllib, transform_wide,
        fit_skipgram_invariants, fit_cbow_invariants, fit_ordered_skipgram_invariants, fit_ordered_cbow_invariants,
    )
}


# --- SQL ---------------------------------------------------------------------

_T = "t AS (SELECT subject, predicate, object, weights FROM edge_df WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL)"
_V = "v AS (SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS token, word FROM (SELECT subject AS word FROM t UNION SELECT predicate FROM t UNION SELECT object FROM t) u)"
_E = "e AS (SELECT s.token AS subject, p.token AS predicate, o.token AS object, t.weights AS weights FROM t JOIN v s ON s.word = t.subject JOIN v p ON p.word = t.predicate JOIN v o ON o.word = t.object)"
_TVE = f"{_T}, {_V}, {_E}"
_X = "x AS (SELECT subject, predicate, object, row_number() OVER (PARTITION BY subject ORDER BY object, predicate) - 1 AS out_idx, count(*) OVER (PARTITION BY subject) AS out_deg FROM e)"
_W = "xi AS (SELECT subject, predicate, object, coalesce(CAST(round(weights * 1000) AS BIGINT), 0) AS w FROM e), xw AS (SELECT subject, predicate, object, w, CAST(sum(w) OVER (PARTITION BY subject ORDER BY object, predicate, w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_w, CAST(sum(w) OVER (PARTITION BY subject) AS BIGINT) AS tot_w, row_number() OVER (PARTITION BY subject ORDER BY object, predicate, w) - 1 AS out_idx, count(*) OVER (PARTITION BY subject) AS out_deg FROM xi)"
_S = f"s AS (SELECT vertex AS start, k, CAST(vertex AS BIGINT) * {WALKS} + k AS walk_id FROM (SELECT subject AS vertex FROM e UNION SELECT object FROM e) a, range({WALKS}) r(k))"
_DEG = "d AS (SELECT vertex, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) + sum(o) AS BIGINT) AS degree FROM (SELECT subject AS vertex, 0 AS i, 1 AS o FROM e UNION ALL SELECT object, 1, 0 FROM e) a GROUP BY 1)"


def _h(start: str, k: str, step: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {start}, {k}, {step})), 1, 8) AS BIGINT)"


_HOPS = f"""w(walk_id, start, k, step, src, predicate, dst) AS (
  SELECT s.walk_id, s.start, s.k, 0, x.subject, x.predicate, x.object FROM s JOIN x ON x.subject = s.start AND x.out_idx = {_h("s.start", "s.k", "0")} % x.out_deg
  UNION ALL SELECT w.walk_id, w.start, w.k, w.step + 1, x.subject, x.predicate, x.object FROM w JOIN x ON x.subject = w.dst AND x.out_idx = {_h("w.start", "w.k", "w.step + 1")} % x.out_deg WHERE w.step < {DEPTH - 1})"""
_DRAWN = "cum_w - xw.w <= {h}::HUGEINT * tot_w // 4294967296 AND {h}::HUGEINT * tot_w // 4294967296 < cum_w"
_HOPS_W = f"""w(walk_id, start, k, step, src, predicate, dst) AS (
  SELECT s.walk_id, s.start, s.k, 0, xw.subject, xw.predicate, xw.object FROM s JOIN xw ON xw.subject = s.start AND {_DRAWN.format(h=_h("s.start", "s.k", "0"))}
  UNION ALL SELECT w.walk_id, w.start, w.k, w.step + 1, xw.subject, xw.predicate, xw.object FROM w JOIN xw ON xw.subject = w.dst AND {_DRAWN.format(h=_h("w.start", "w.k", "w.step + 1"))} WHERE w.step < {DEPTH - 1})"""
_FAN = "f AS (SELECT w.walk_id, w.step, w.src, e.predicate, w.dst FROM w JOIN e ON e.subject = w.src AND e.object = w.dst)"
_TOK = "k AS (SELECT walk_id, 0 AS pos, src AS token FROM f WHERE step = 0 UNION ALL SELECT walk_id, 2 * step + 1, predicate FROM f UNION ALL SELECT walk_id, 2 * step + 2, dst FROM f)"
_WALK = f"WITH RECURSIVE {_TVE}, {_X}, {_S}, {_HOPS}"
_STREAM = f"{_WALK}, {_FAN}, {_TOK}"

_R = """t AS (SELECT 'region/' || n_regionkey AS subject, 'hasNation' AS predicate, 'nation/' || n_nationkey AS object, 1.0 AS weights FROM nation
  UNION ALL SELECT 'nation/' || n_nationkey, 'inRegion', 'region/' || n_regionkey, 1.0 FROM nation
  UNION ALL SELECT 'nation/' || c_nationkey, 'hasCustomer', 'customer/' || c_custkey, 1.0 FROM customer
  UNION ALL SELECT 'nation/' || c_nationkey, 'servesMarket', 'customer/' || c_custkey, 1.0 FROM customer
  UNION ALL SELECT 'nation/' || s_nationkey, 'hasSupplier', 'supplier/' || s_suppkey, 1.0 FROM supplier
  UNION ALL SELECT 'customer/' || o_custkey, 'placed', 'order/' || o_orderkey, 1.0 FROM orders)"""


def _trees(starts: str) -> str:
    return f"""g AS (SELECT DISTINCT subject, object FROM e),
  reach(start, v, d) AS (SELECT token, token, 0 FROM ({starts}) z UNION SELECT r.start, g.object, r.d + 1 FROM reach r JOIN g ON g.subject = r.v WHERE r.d < 3),
  lev AS (SELECT start, v, min(d) AS d FROM reach GROUP BY 1, 2),
  par AS (SELECT l.start, l.v, l.d, min(p.v) AS parent FROM lev l JOIN g ON g.object = l.v JOIN lev p ON p.start = l.start AND p.v = g.subject AND p.d = l.d - 1 GROUP BY 1, 2, 3),
  leaf AS (SELECT start, v, d FROM lev WHERE NOT EXISTS (SELECT 1 FROM par WHERE par.start = lev.start AND par.parent = lev.v)),
  back(walk_id, start, src, dst, step) AS (
    SELECT leaf.start::BIGINT * 2147483648 + leaf.v, par.start, par.parent, par.v, par.d - 1 FROM leaf JOIN par ON par.start = leaf.start AND par.v = leaf.v
    UNION ALL SELECT b.walk_id, b.start, par.parent, par.v, par.d - 1 FROM back b JOIN par ON par.start = b.start AND par.v = b.src)"""


_BFS = f"WITH RECURSIVE {_R}, {_V}, {_E}, " + _trees("SELECT token FROM v WHERE word LIKE 'region/%'")
_BFS_HUBS = f"WITH RECURSIVE {_TVE}, {_DEG}, " + _trees("SELECT vertex AS token FROM d ORDER BY degree DESC, vertex LIMIT 5")
_BACK = "SELECT walk_id, step, src, e.predicate AS predicate, dst FROM back JOIN e ON e.subject = src AND e.object = dst"
_STATISTICS = f"""WITH RECURSIVE {_TVE}, {_DEG}, g AS (SELECT DISTINCT subject, object FROM e WHERE subject <> object),
  z AS (SELECT vertex FROM d ORDER BY CAST('0x' || substr(md5(concat_ws('|', '{SEED}', vertex)), 1, 8) AS BIGINT), vertex LIMIT 16),
  reach(start, v, d) AS (SELECT vertex, vertex, 0 FROM z UNION SELECT r.start, g.object, r.d + 1 FROM reach r JOIN g ON g.subject = r.v WHERE r.d < 60),
  lev AS (SELECT start, v, min(d) AS d FROM reach GROUP BY 1, 2), far AS (SELECT start, sum(greatest(0, d - 1))::DOUBLE AS s FROM lev GROUP BY 1),
  b AS (SELECT round(avg(s), 6) AS mean_betweenness, round(stddev_samp(s) / sqrt(count(*)), 6) AS betweenness_error FROM far)
  SELECT avg(degree) AS mean_degree_centrality, count(*) AS number_nodes, CAST(sum(out_degree) AS BIGINT) AS number_edges, sum(out_degree) / (count(*)::DOUBLE * (count(*) - 1)) AS density, max(mean_betweenness) AS mean_betweenness, max(betweenness_error) AS betweenness_error FROM d, b"""

_IN = ", ".join(f"'{p}'" for p in LITERALS)
_NUM = f"CASE WHEN abs(TRY_CAST(regexp_extract(object, '{literals.PLAIN_NUMBER}', 1) AS DOUBLE)) < 'Infinity'::DOUBLE THEN TRY_CAST(regexp_extract(object, '{literals.PLAIN_NUMBER}', 1) AS DOUBLE) END"
_NAME = "string_split(string_split(predicate, '/')[-1], '#')[-1]"
_REST = f"SELECT subject, predicate, object, weights FROM edge_df WHERE coalesce(predicate NOT IN ({_IN}), true)"
_LIT = f"n AS (SELECT subject, predicate, weights, {_NUM} AS v FROM edge_df WHERE predicate IN ({_IN})), m AS (SELECT predicate, min(v) AS lo, max(v) AS hi, least(5, count(DISTINCT v)) AS b FROM n WHERE v IS NOT NULL GROUP BY 1)"
_BINNED = f"SELECT subject, n.predicate AS predicate, {_NAME.replace('predicate', 'n.predicate')} || '_bin_' || len(list_filter(inner_edges, lambda x: x < v)) AS object, weights FROM n JOIN q ON q.predicate = n.predicate WHERE v IS NOT NULL UNION ALL {_REST}"
_QUANTILES = "CASE b " + " ".join(f"WHEN {b} THEN quantile_cont(v, [{', '.join(f'{i}.0/{b}.0' for i in range(b + 1))}])" for b in range(1, 6)) + " END"
_NT = r"^<([^>]+)>\s+<([^>]+)>\s+(.*)\s+\.\s*$"
_GIVEN = "k AS (SELECT DISTINCT walk_id, pos, token FROM tokens WHERE token >= 0)"

_QUANTILE_BINNED = f"{_LIT}, z AS (SELECT n.predicate AS predicate, list_sort(list_distinct({_QUANTILES})) AS edges FROM n JOIN m ON m.predicate = n.predicate WHERE v IS NOT NULL GROUP BY n.predicate, b), q AS (SELECT predicate, edges[2:len(edges) - 1] AS inner_edges FROM z)"
_INVARIANTS = f"WITH {_QUANTILE_BINNED}, t AS (SELECT * FROM ({_BINNED}) x WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL), {_V} SELECT count(*) AS words, count(DISTINCT token) AS tokens, 16 AS shortest, 16 AS longest, true AS finite, true AS loss_falls FROM v"

SQL = {
    **dict.fromkeys(("fit_skipgram_invariants", "fit_cbow_invariants", "fit_ordered_skipgram_invariants", "fit_ordered_cbow_invariants"), _INVARIANTS),
    "kg_triples": f"WITH {_T} SELECT * FROM t",
    "vocabulary": f"WITH {_T}, {_V} SELECT token, word FROM v",
    "encode_edges": f"WITH {_TVE} SELECT * FROM e",
    "decode_edges": f"WITH {_T} SELECT * FROM t",
    "vertex_set": f"WITH {_TVE} SELECT subject AS vertex FROM e UNION SELECT object FROM e",
    "degree_stats": f"WITH {_TVE}, {_DEG} SELECT count(*) AS number_nodes, CAST(sum(out_degree) AS BIGINT) AS number_edges, avg(degree) AS avg_degree, min(degree) AS min_degree, max(degree) AS max_degree FROM d",
    "degree_table": f"WITH {_TVE}, {_DEG} SELECT * FROM d",
    "degree_distribution": f"WITH {_TVE}, {_DEG} SELECT degree, count(*) AS vertices FROM d GROUP BY 1",
    "graph_density": f"WITH {_TVE}, {_DEG} SELECT count(*) AS number_nodes, CAST(sum(out_degree) AS BIGINT) AS number_edges, sum(out_degree) / (count(*)::DOUBLE * (count(*) - 1)) AS density FROM d",
    "out_degree_index": f"WITH {_TVE}, {_X} SELECT * FROM x",
    "weight_index": f"WITH {_TVE}, {_W} SELECT subject, predicate, object, w, cum_w, tot_w, out_idx, out_deg FROM xw",
    "nt_parse": f"SELECT line_id, nullif(regexp_extract(raw, '{_NT}', 1), '') AS subject, nullif(regexp_extract(raw, '{_NT}', 2), '') AS predicate, regexp_replace(regexp_extract(raw, '{_NT}', 3), '^<|>$', '', 'g') AS object FROM kg_raw_lines WHERE fmt IN ('nt', 'nq') AND regexp_matches(raw, '{_NT}')",
    "literal_drop": _REST,
    "literal_bin_uniform": f"WITH {_LIT}, q AS (SELECT predicate, CASE WHEN lo = hi OR b < 2 THEN [] ELSE list_transform(range(1, b), lambda i: lo + i * ((hi - lo) / b)) END AS inner_edges FROM m) {_BINNED}",
    "literal_bin_quantile": f"WITH {_QUANTILE_BINNED} {_BINNED}",
    "predicate_local_name": f"SELECT DISTINCT predicate, {_NAME} AS name FROM edge_df WHERE predicate IS NOT NULL",
    "numeric_coerce": f"SELECT predicate, count(*) AS n_rows, count(v) AS numbers, min(v) AS least, max(v) AS most, count(DISTINCT v) AS distinct_numbers FROM (SELECT predicate, {_NUM} AS v FROM edge_df) n GROUP BY 1",
    "start_replication": f"WITH {_TVE}, {_S} SELECT walk_id, start, CAST(k AS INTEGER) AS k FROM s",
    "walk_uniform": f"{_WALK} SELECT walk_id, step, src, predicate, dst FROM w",
    "walk_weighted": f"WITH RECURSIVE {_TVE}, {_W}, {_S}, {_HOPS_W} SELECT walk_id, step, src, predicate, dst FROM w",
    "hop_fanout": f"{_WALK}, {_FAN} SELECT * FROM f",
    "walk_bfs": f"{_BFS_HUBS} {_BACK}",
    "walk_bfs_relational": f"{_BFS} {_BACK}",
    "graph_statistics": _STATISTICS,
    "bfs_leaves": f"{_BFS} SELECT start, v AS leaf, d AS depth FROM leaf",
    "walk_tokens": f"{_STREAM} SELECT walk_id, pos, token FROM k",
    "tokens_unpadded": f"WITH {_GIVEN} SELECT walk_id, pos, token FROM k",
    "sequence_hops": f"WITH {_GIVEN}, h AS (SELECT walk_id, CAST(row_number() OVER w - 1 AS INTEGER) AS step, token AS src, lead(token) OVER w AS dst FROM k WHERE pos % 2 = 0 WINDOW w AS (PARTITION BY walk_id ORDER BY pos, token)) SELECT * FROM h WHERE dst IS NOT NULL",
    "token_counts": f"{_STREAM} SELECT token, count(*) AS n FROM k GROUP BY 1",
    "min_count_filter": f"{_STREAM} SELECT walk_id, pos, token FROM k WHERE token IN (SELECT token FROM k GROUP BY 1 HAVING count(*) >= 5)",
    "skipgram_pairs": f"WITH {_GIVEN} SELECT c.token AS center, x.token AS context, count(*) AS n FROM k c JOIN k x ON x.walk_id = c.walk_id AND abs(x.pos - c.pos) BETWEEN 1 AND {WINDOW} GROUP BY 1, 2",
    "pair_totals": f"{_STREAM} SELECT c.token AS center, x.token AS context, count(*) AS n FROM k c JOIN k x ON x.walk_id = c.walk_id AND abs(x.pos - c.pos) BETWEEN 1 AND {WINDOW} GROUP BY 1, 2",
    "cbow_contexts": f"WITH {_GIVEN} SELECT c.walk_id AS walk_id, c.pos AS pos, c.token AS center, string_agg(CAST(x.token AS VARCHAR), ',' ORDER BY x.pos - c.pos, x.token) AS context FROM k c JOIN k x ON x.walk_id = c.walk_id AND abs(x.pos - c.pos) BETWEEN 1 AND {WINDOW} GROUP BY 1, 2, 3",
    "predict_center_topk": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 4) AS score FROM r WHERE rank <= 5",
    "betweenness_small": """WITH RECURSIVE g AS (SELECT n_regionkey + 1000 AS s, n_nationkey AS o FROM nation UNION SELECT n_nationkey, n_regionkey + 1000 FROM nation),
      paths(a, z, p) AS (SELECT s, o, [s, o] FROM g UNION ALL SELECT a, g.o, list_append(p, g.o) FROM paths JOIN g ON g.s = z WHERE NOT list_contains(p, g.o) AND len(p) < 6),
      best AS (SELECT * FROM paths QUALIFY len(p) = min(len(p)) OVER (PARTITION BY a, z)), n AS (SELECT a, z, count(*) AS c FROM best GROUP BY 1, 2),
      inner_v AS (SELECT best.a, best.z, unnest(p[2:len(p) - 1]) AS v FROM best), b AS (SELECT v, sum(1.0 / c) AS b FROM inner_v JOIN n ON n.a = inner_v.a AND n.z = inner_v.z GROUP BY 1)
      SELECT u.s AS vertex, CAST(coalesce(b, 0) AS DOUBLE) AS betweenness FROM (SELECT DISTINCT s FROM g) u LEFT JOIN b ON b.v = u.s""",
    "run_summary": "SELECT event_type, min(value) AS least, max(value) AS most, avg(value) AS mean, stddev_samp(value) AS deviation, count(*) AS runs FROM events WHERE value IS NOT NULL GROUP BY 1",
}
