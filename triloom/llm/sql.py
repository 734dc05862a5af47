"""SQL that checks the queries of the training-data problems."""

from triloom.functions.numbers import LITERAL, PLAIN

_MEET = "SELECT walk_id, least(center, context) AS a, greatest(center, context) AS b FROM pairs WHERE walk_id IS NOT NULL AND center >= 0 AND context >= 0"
_COUNTS = f"""m AS ({_MEET}), w AS (SELECT count(DISTINCT walk_id) AS w FROM m),
  ab AS (SELECT a, b, count(DISTINCT walk_id) AS n FROM m WHERE a < b GROUP BY 1, 2),
  x AS (SELECT x, count(DISTINCT walk_id) AS n FROM (SELECT walk_id, a AS x FROM m UNION ALL SELECT walk_id, b FROM m) u GROUP BY 1)"""

_NUMBERS = f"""numbers AS (SELECT DISTINCT edge_id, predicate, value FROM (
    SELECT edge_id, predicate, TRY_CAST(regexp_extract(object, '{LITERAL.replace("'", "''")}', 1) || regexp_extract(object, '{LITERAL.replace("'", "''")}', 2) AS DOUBLE) AS value
    FROM edge_df WHERE predicate IS NOT NULL AND object IS NOT NULL) n WHERE abs(value) < 'Infinity'::DOUBLE)"""

_TERMS = """t AS (SELECT DISTINCT walk_id, pos, token FROM tokens WHERE token >= 0),
  c AS (SELECT token, count(*) AS occurrences, count(DISTINCT walk_id) AS records FROM t GROUP BY 1),
  w AS (SELECT count(DISTINCT walk_id) AS w FROM tokens),
  k AS (SELECT coalesce(c.token, v.token) AS token, coalesce(occurrences, 0) AS occurrences, coalesce(records, 0) AS records, v.token IS NOT NULL AS known
    FROM c FULL JOIN (SELECT DISTINCT token FROM word2idx WHERE token IS NOT NULL) v ON c.token = v.token),
  marked AS (SELECT token, occurrences, records, CASE WHEN records * 10 > w THEN 'common' WHEN known AND occurrences < 3 THEN 'rare' END AS mark FROM k, w)"""


def _from(letter: str, own: str) -> str:
    cases = " ".join(f"WHEN {i + 1} THEN {c}" for i, c in enumerate(("subject", "predicate", "object")))
    return f"CASE instr(coalesce(field_order, 'spo'), '{letter}') {cases} ELSE {own} END"


_CLEAN = "upper(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g'))"
_AROUND = "[\\s\\p{Z}\\p{Cf}\"''“”„‟‘’‚‛«»‹›`´()\\[\\]{}<>]+"
_BARE = f"regexp_replace(o, '^{_AROUND}|{_AROUND}$', '', 'g')"
_KEYS = f"""f AS (SELECT row_id, nfc_normalize({_from("s", "subject")}) AS s, nfc_normalize({_from("p", "predicate")}) AS p, nfc_normalize({_from("o", "object")}) AS o FROM kg_file_reader),
  k AS (SELECT row_id, {_CLEAN.format("s")} AS s, {_CLEAN.format("p")} AS p,
    CASE WHEN regexp_full_match({_BARE}, '{PLAIN}') THEN {_BARE} ELSE {_CLEAN.format("o")} END AS o
    FROM f WHERE row_id IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL),
  r AS (SELECT s, p, o, min(row_id) AS first_row_id, count(*) AS copies FROM k GROUP BY ALL)"""

SQL = {
    "p2_found": f"WITH {_COUNTS} SELECT ab.a AS token_a, ab.b AS token_b FROM ab JOIN x xa ON xa.x = ab.a JOIN x xb ON xb.x = ab.b, w WHERE ab.n >= 12 AND ab.n::HUGEINT * w >= 20::HUGEINT * xa.n * xb.n",
    "p2_lift": f"WITH {_COUNTS} SELECT ab.a AS token_a, ab.b AS token_b, ab.n AS n_walks, xa.n AS n_a, xb.n AS n_b, ab.n::DOUBLE * w::DOUBLE / (xa.n::DOUBLE * xb.n::DOUBLE) AS lift FROM ab JOIN x xa ON xa.x = ab.a JOIN x xb ON xb.x = ab.b, w",
    "p2_affected": f"WITH {_COUNTS}, moved AS (SELECT DISTINCT unnest([a, b]) AS x FROM m WHERE ((walk_id % 65536 + 65536) % 65536 * 40503 % 65536) // 4096 = 3) SELECT ab.a AS token_a, ab.b AS token_b, ab.n AS n_walks, xa.n AS n_a, xb.n AS n_b, ab.n::DOUBLE * w::DOUBLE / (xa.n::DOUBLE * xb.n::DOUBLE) AS lift FROM ab JOIN x xa ON xa.x = ab.a JOIN x xb ON xb.x = ab.b, w WHERE ab.a IN (SELECT x FROM moved) OR ab.b IN (SELECT x FROM moved)",
    "p3_found": f"WITH {_NUMBERS}, q AS (SELECT predicate, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM numbers GROUP BY 1) SELECT edge_id FROM numbers JOIN q USING (predicate) WHERE value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)",
    "p3_percentiles": f"WITH {_NUMBERS}, p AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS q, unnest([1, 2, 3, 4, 5]) AS i), e AS (SELECT predicate, count(*) AS n, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS v FROM numbers GROUP BY 1) SELECT predicate, q, n, v[i] AS quantile FROM e, p",
    "p3_certified_bounds": f"WITH {_NUMBERS}, p AS (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS q), e AS (SELECT predicate, count(*) AS n FROM numbers GROUP BY 1) SELECT predicate, q, n, true AS within FROM e, p",
    "p7_check": "SELECT container, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS not_whole, 0::BIGINT AS split_without_need, 0::BIGINT AS over_capacity, true AS full FROM pack_sizes",
    "p8_check": """WITH there AS (SELECT source, target_share AS s FROM mix_targets WHERE target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE text <> ''))
      SELECT m.source AS source, round(coalesce(s / (SELECT sum(s) FROM there), 0.0), 9) AS wanted_share, true AS near, true AS capped, true AS once FROM mix_targets m LEFT JOIN there ON there.source = m.source""",
    "p9_check": "SELECT 0::BIGINT AS named_twice, 0::BIGINT AS unknown_documents, 0::BIGINT AS unknown_areas, 0::BIGINT AS differing",
    "p4_found": f"WITH {_TERMS} SELECT token, mark FROM marked WHERE mark IS NOT NULL",
    "p4_word_counts": f"WITH {_TERMS} SELECT w2.token AS token, w2.word AS word, occurrences, records, mark FROM word2idx w2 JOIN marked ON w2.token = marked.token",
    "p6_found": f"WITH {_KEYS} SELECT first_row_id, row_id AS copy_row_id FROM k JOIN r USING (s, p, o) WHERE row_id > first_row_id",
    "p6_records": f"WITH {_KEYS} SELECT first_row_id, copies FROM r",
}
