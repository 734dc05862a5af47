import random

import numpy as np
import pytest
from conftest import rows

from triloom.llm import areas as a

PARAGRAPHS = a.Settings(units=a.numbered_paragraphs, least_units=2)
TERMS = {"sport": ["the league table", "a penalty kick", "the home stadium"], "tax": ["the customs duty", "an income levy", "the audit letter"]}
FILLER = ["Costs follow the event", "Judgment was reserved", "The appeal was lodged within time"]


def document(r, own):
    out = [f"Headnote: {r.choice(TERMS['tax' if own == ['sport'] else 'sport'])} was raised."]
    for i in range(10):
        s = [r.choice(FILLER)]
        if own and i % 2:
            s.append(f"The witness recalled {r.choice(TERMS[own[(i // 2) % len(own)]])} in some detail")
        out.append(f"[{i + 1}] {'. '.join(s)}.")
    return "\n".join(out)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    truth = {i: [["sport"], ["tax"], [], ["sport", "tax"]][i % 4] for i in range(240)}
    docs = spark.createDataFrame([(i, document(r, t), "en") for i, t in truth.items()], "doc_id bigint, text string, area string")
    labels = [(i, x, "c") for i, t in truth.items() if i < 160 for x in (t or [None])]
    labels += labels[:20] + [(3, "unknown area", "c"), (None, "tax", "c")]
    return docs, spark.createDataFrame(labels, "doc_id bigint, area string, annotator string"), truth


def test_areas_of_documents_never_seen(spark, corpus):
    docs, labels, truth = corpus
    m = a.train(docs, labels, ["sport", "tax"], PARAGRAPHS)
    got: dict = {i: [] for i in truth}
    for i, area in rows(a.scored(docs, m)):
        got[i].append(area)
    assert sum(got[i] == truth[i] for i in truth if i >= 160) >= 78  # of 80
    c = {x.area: x for x in a.composition(a.scored(docs, m), docs, spark.createDataFrame([("sport",), ("tax",), ("food",)], "area string")).collect()}
    assert c["food"].documents == 0
    assert c["sport"].documents == sum("sport" in v for v in got.values())


def test_scores_do_not_depend_on_partitions_or_caches(spark, corpus):
    docs, labels, _ = corpus
    m = a.train(docs, labels, ["sport", "tax"], PARAGRAPHS)
    assert rows(a.scored(docs.repartition(7), m)) == rows(a.scored(docs.coalesce(1), m))
    s = a.Scorer(m)
    text = [x.text for x in docs.orderBy("doc_id").collect()]
    once = s.areas_of(text)
    assert s.areas_of(text) == once


def test_odd_texts(spark, corpus):
    docs, labels, _ = corpus
    m = a.train(docs, labels, ["sport", "tax"], PARAGRAPHS)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "no numbers, the league table"), (4, "[1] 12 345"), (5, "[1] the league table was raised\n" * 1), (6, "".join(f"[{i}] The witness recalled a penalty kick in some detail.\n" for i in range(20_000)))], "doc_id bigint, text string")
    assert rows(a.scored(odd, m)) == [(6, "sport")]
    assert a.scored(odd.limit(0), m).count() == 0


def test_texts_as_a_whole(spark):
    r = random.Random(5)
    truth = {i: [["sport"], ["tax"], [], ["sport", "tax"]][i % 4] for i in range(480)}
    text = lambda own: ". ".join([*r.sample(FILLER, 2), *[f"The witness recalled {r.choice(TERMS[x])} in some detail" for x in own]])
    docs = spark.createDataFrame([(i, text(t)) for i, t in truth.items()], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x, "c") for i, t in truth.items() if i < 400 for x in (t or [None])], "doc_id bigint, area string, annotator string")
    got: dict = {i: [] for i in truth}
    for i, area in rows(a.scored(docs, a.train(docs, labels, ["sport", "tax"]))):
        got[i].append(area)
    assert sum(got[i] == truth[i] for i in truth if i >= 400) >= 76  # of 80


def test_without_labels(spark, corpus):
    docs, labels, _ = corpus
    assert a.train(docs, labels.limit(0), ["sport", "tax"], PARAGRAPHS) is None
    assert a.scored(docs, None).count() == 0


def test_paragraphs():
    t = "Court\nHeadnote: x.\n[1] One reve-\nnue.\nPage 1 of 2\n(2) Two\n3) Three\n4.  Four\n§ 5 Five\nOrdered."
    assert [p.strip() for p in a.numbered_paragraphs(t)] == ["One revenue.\nPage 1 of 2", "Two", "Three", "Four", "Five\nOrdered."]
    assert a.normal("Pre-Nuptial,") == "prenuptial"
    assert a.normal("§12.") == ""


def test_gradient_of_a_partition_is_that_of_the_loss():
    import pyarrow as pa

    r = np.random.default_rng(0)
    b = pa.RecordBatch.from_arrays([pa.array([[0, 1], [1, 1, 2], [3]], pa.list_(pa.int32())), pa.array([4, 2, 1], pa.float32()), pa.array([[4, 1], [0, 1], [0, 1]], pa.list_(pa.float32()))], names=["ids", "n", "y"])
    v, o, bias = r.normal(size=(4, 3)).astype(np.float64), r.normal(size=(3, 2)), r.normal(size=2)
    g = a.partition_gradient([b], v, o, bias)
    for table, grad in ((v, g[0]), (o, g[1]), (bias, g[2])):
        for i in np.ndindex(*table.shape):
            was = table[i]
            table[i] = was + 1e-5
            up = a.partition_gradient([b], v, o, bias)[3]
            table[i] = was - 1e-5
            down = a.partition_gradient([b], v, o, bias)[3]
            table[i] = was
            assert abs((up - down) / 2e-5 - grad[i]) < 1e-3
