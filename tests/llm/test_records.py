"""Hidden duplicates."""

from conftest import rows

from triloom.llm import dedup

SCHEMA = "row_id bigint, subject string, predicate string, object string, field_order string, copies string"


def found(spark, data):
    h = dedup.hashed(spark.createDataFrame([(*d, "clash") for d in data], SCHEMA).repartition(3))
    recs = dedup.records(h)
    return rows(dedup.copies(h, recs)), rows(recs, "first", "copies")


def test_spellings_and_orders(spark):
    data = [
        (10, "http://x/Ab-c", "http://p", "Café No 1", "spo"),
        (11, "HTTP://X/AB_C/", "http://p#", "«CAFÉ  no​ 1»", None),
        (12, "Café no.1", "http://x/abc", "http://p", "osp"),
        (13, "http://p", "cafÉ-NO-1", "http://x/abc", "pos"),
        (14, "http://x/abc", "http://p", "Cafe No 1", "spo"),  # no accent
        (15, None, "http://p", "Café No 1", "spo"),
        (16, "http://x/abc", "http://p", None, "spo"),
        (17, "", "", "", "spo"),
        (18, " ", "-", "!", "ops"),
    ]
    pairs, recs = found(spark, data)
    assert pairs == [(10, 11), (10, 12), (10, 13), (17, 18)]
    assert recs == [(10, 4), (14, 1), (17, 2)]


def test_numbers_keep_sign_and_point(spark):
    objects = ["4.2", " '4.2' ", "[4.2]", "42", "-4.2", " “-4.2”", "+4.2", "4,2", "4.2 m", "42m", "(42)"]
    pairs, _ = found(spark, [(i, "s", "p", o, "spo") for i, o in enumerate(objects)])
    assert pairs == [(0, 1), (0, 2), (3, 7), (3, 10), (4, 5), (8, 9)]


def test_case_beyond_ascii(spark):
    pairs, _ = found(spark, [(1, "Straße", "p", "ΣΑΣ", "spo"), (2, "STRASSE", "P", "σας", "spo")])
    assert pairs == [(1, 2)]


def test_one_record_holds_most_rows(spark):
    data = [(i, "S" if i % 2 else "s", "p", "o", "spo") for i in range(2000)] + [(i, f"s{i}", "p", "o", "spo") for i in range(2000, 3000)]
    pairs, recs = found(spark, data)
    assert pairs == [(0, i) for i in range(1, 2000)]
    assert recs[0] == (0, 2000)
    assert len(recs) == 1001


def test_empty_and_very_long(spark):
    assert found(spark, []) == ([], [])
    long = "ab " * 400_000
    pairs, _ = found(spark, [(1, long, "p", "o", "spo"), (2, long.upper(), "p", "o", "spo"), (3, long + "c", "p", "o", "spo")])
    assert pairs == [(1, 2)]


def test_colliding_hashes_are_told_apart(spark):
    h = spark.createDataFrame([(1, 5, 5, 100, "x"), (2, 5, 5, 200, "y"), (3, 5, 5, 100, "x")], "row_id bigint, h1 bigint, h2 bigint, check bigint, k string")
    recs = dedup.records(h)
    assert rows(dedup.collisions(recs)) == [(5, 5, 2)]
    assert rows(dedup.copies(h, recs)) == [(1, 3)]


def test_equal_hashes_of_different_texts_are_told_apart(spark):
    data = [(1, 7, 8, 9, "a"), (2, 7, 8, 9, "b"), (3, 7, 8, 9, "a"), (4, 7, 8, 9, "b"), (5, 7, 8, 9, "c"), (6, 7, 8, 10, "a")]
    h = spark.createDataFrame(data, "row_id bigint, h1 bigint, h2 bigint, check bigint, k string")
    recs = dedup.records(h)
    assert rows(dedup.copies(h, recs)) == [(1, 3), (2, 4)]
    assert rows(dedup.collisions(recs), "n") == [(2,)]
