"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

Training learns which sentences speak of which area. A sentence of a labelled
document carries the document's areas; a sentence that recurs in many
documents thereby gets the share of them that have the area, so sentences that
any document may hold come out low and those that belong to an area high. Equal
sentences are one row with their counts, which leaves the loss as it is. Each
round every partition sends the gradient of its rows, the sums move the
parameters, and the next round reads those.

Scoring gives each document the areas that at least `least_units` of its units
hold a sentence of. What the units of a text are is a setting: the text as a
whole by default; `numbered_paragraphs` is another cut.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.session import written

_NUMBERED = re.compile(r"^[ \t]*(?:\[\d+\]|\(\d+\)|\d+[.)]|§[ \t]*\d+)[ \t]+", re.M)
_DIVIDED = re.compile(r"(?<=\w)-\n(?=[a-zà-ÿ])")
_NO_LETTERS = re.compile(r"[\W\d_]+")
BUCKETS = 1 << 15
GRAMS = (4, 5)
MOST_KEPT = 200_000


def whole(text: str) -> list[str]:
    return [text]


@dataclass(frozen=True)
class Settings:
    """`max_labelled` bounds the labelled documents trained on (those with the smallest hashes of their id).

    Every word that occurs in them at least `min_count` times has an embedding
    of its own; the driver holds these, so the sample bounds them too. `units`
    cuts a text into the parts that `least_units` counts.
    """

    max_labelled: int = 8000
    min_count: int = 3
    size: int = 16
    rounds: int = 40
    rate: float = 0.1
    threshold: float = 0.5  # in logits
    units: Callable[[str], list[str]] = whole
    least_units: int = 1
    seed: int = 42


@dataclass
class Model:
    """Logits by word and by subword bucket: averages over a sentence plus the bias are its scores."""

    areas: list[str]
    words: dict[str, int]
    word_logits: np.ndarray
    gram_logits: np.ndarray
    bias: np.ndarray
    threshold: float
    units: Callable[[str], list[str]]
    least_units: int


def numbered_paragraphs(text: str) -> list[str]:
    """The numbered paragraphs of a decision, each with the lines that continue it; what comes before the first isn't one."""
    if "-\n" in text:
        text = _DIVIDED.sub("", text)
    return _NUMBERED.split(text)[1:]


def sentences(paragraph: str) -> list[str]:
    return paragraph.replace("\n", " ").split(". ")


def normal(token: str) -> str:
    """A token's letters in lower case; empty if it has none."""
    return _NO_LETTERS.sub("", token.lower())


def grams(word: str) -> list[int]:
    """Buckets of the word's character 4- and 5-grams, with marks at its ends."""
    x = f"<{word}>"
    found = [zlib.crc32(x[i : i + n].encode()) % BUCKETS for n in GRAMS for i in range(len(x) - n + 1)]
    return found or [zlib.crc32(x.encode()) % BUCKETS]


class _Words(dict):
    """Normal forms of raw tokens, kept while they are few enough."""

    def __missing__(self, token: str) -> str:
        w = normal(token)
        if len(self) >= 5 * MOST_KEPT:
            self.clear()
        self[token] = w
        return w


def _labelled_sentences(docs: DataFrame, labels: DataFrame, areas: list[str], s: Settings) -> DataFrame:
    """(s, n, y0, y1, ...): each distinct sentence of the labelled documents, how often it occurs, and how often with each area."""
    own = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set(F.when(F.col("area").isin(areas), F.col("area"))).alias("has"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_labelled)
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(own), "doc_id")  # at most max_labelled rows
    names = ["s", "n", *[f"y{j}" for j in range(len(areas))]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            found: dict[str, np.ndarray] = {}
            for text, has in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = np.array([1, *[a in has for a in areas]], dtype=np.int64)
                for p in s.units(text):
                    for sentence in sentences(p):
                        key = " ".join(w for w in map(words.__getitem__, sentence.split()) if w)
                        if key:
                            found[key] = found[key] + row if key in found else row
            if found:
                m = np.stack(list(found.values()))
                yield pa.RecordBatch.from_arrays([pa.array(list(found)), *[pa.array(m[:, j]) for j in range(m.shape[1])]], names=names)

    rows = texts.select("text", "has").mapInArrow(cut, "s string, " + ", ".join(f"{c} bigint" for c in names[1:]))
    return rows.groupBy("s").agg(*[F.sum(c).alias(c) for c in names[1:]])


def train(docs: DataFrame, labels: DataFrame, areas: list[str], s: Settings | None = None) -> Model | None:
    """The model, or null if no labelled document has a unit with words."""
    s = s or Settings()
    spark = docs.sparkSession
    rows = written(_labelled_sentences(docs, labels, areas, s), "sentences")
    count = rows.select(F.explode(F.split("s", " ")).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= s.min_count)
    vocabulary = sorted(r["w"] for r in count.select("w").collect())  # words of at most max_labelled documents
    if not vocabulary:
        return None
    index = {w: i for i, w in enumerate(vocabulary)}
    known = spark.sparkContext.broadcast(index)
    k = len(areas)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = known.value
        for b in batches:
            ids = [[at[w] for w in x.split(" ") if w in at] for x in b.column(0).to_pylist()]
            keep = np.array([bool(i) for i in ids])
            y = np.stack([b.column(2 + j).to_numpy() for j in range(k)], 1)[keep].astype(np.float32)
            n = b.column(1).to_numpy()[keep].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([i for i in ids if i], pa.list_(pa.int32())), pa.array(n), pa.array(list(y), pa.list_(pa.float32()))], names=["ids", "n", "y"])

    parts = max(1, -(-rows.count() // 15_000))
    encoded = written(rows.repartition(parts).mapInArrow(encode, "ids array<int>, n float, y array<float>"), "encoded")
    total = encoded.agg(F.sum("n")).first()[0]
    known.destroy()
    if not total:
        return None
    return _rounds(spark, encoded, float(total), vocabulary, areas, s)


def partition_gradient(batches: Iterator[pa.RecordBatch], vectors: np.ndarray, outputs: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Gradients of word vectors, outputs and bias over the rows, and their loss; sums, not means."""
    g_vec, g_out, g_bias, loss = np.zeros_like(vectors), np.zeros_like(outputs), np.zeros_like(bias), 0.0
    for b in batches:
        if not b.num_rows:
            continue
        ids, offsets = b.column(0).flatten().to_numpy(), b.column(0).offsets.to_numpy()
        offsets = offsets - offsets[0]
        n = b.column(1).to_numpy()[:, None]
        y = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
        lengths = np.diff(offsets)
        mean = np.add.reduceat(vectors[ids], offsets[:-1]) / lengths[:, None]
        z = mean @ outputs + bias
        p = 1 / (1 + np.exp(-z))
        loss += float((n * np.logaddexp(0, z) - y * z).sum())
        d = n * p - y
        g_out += mean.T @ d
        g_bias += d.sum(0)
        back = ((d @ outputs.T) / lengths[:, None]).astype(np.float32)
        order = np.argsort(ids, kind="stable")
        own = ids[order]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        g_vec[own[begin]] += np.add.reduceat(back[np.repeat(np.arange(b.num_rows), lengths)[order]], begin)
    return g_vec, g_out, g_bias, loss


def _rounds(spark: SparkSession, encoded: DataFrame, total: float, vocabulary: list[str], areas: list[str], s: Settings) -> Model:
    f32 = np.float32
    sub = [grams(w) for w in vocabulary]
    n_sub = np.array([len(x) for x in sub])
    flat, begin = np.concatenate([np.array(x) for x in sub]), np.r_[0, np.cumsum(n_sub)[:-1]]
    sub_order = np.argsort(flat, kind="stable")
    sub_own = flat[sub_order]
    sub_begin = np.flatnonzero(np.r_[True, sub_own[1:] != sub_own[:-1]])
    owner = np.repeat(np.arange(len(vocabulary)), n_sub)[sub_order]
    rng = np.random.default_rng(s.seed)
    around = lambda *shape: rng.uniform(-0.5, 0.5, shape).astype(f32)
    word, gram, out = around(len(vocabulary), s.size) / s.size, around(BUCKETS, s.size) / s.size, around(s.size, len(areas))
    bias = np.full(len(areas), -2.5, f32)
    params = [word, gram, out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = (1 / (1 + n_sub)[:, None]).astype(f32)
    vectors = lambda: ((word + np.add.reduceat(gram[flat], begin)) * share).astype(f32)
    shape, k = (len(vocabulary), s.size), len(areas)
    for r in range(1, s.rounds + 1):
        sent = spark.sparkContext.broadcast((vectors(), out, bias))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = partition_gradient(batches, *sent.value)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()]) for x in g[:3]], names=["v", "o", "b"])

        back = encoded.mapInArrow(step, "v binary, o binary, b binary").collect()
        sent.destroy()
        g_vec = sum(np.frombuffer(x["v"], f32).reshape(shape) for x in back) * share / total
        g_out = sum(np.frombuffer(x["o"], f32).reshape(s.size, k) for x in back) / total
        g_bias = sum(np.frombuffer(x["b"], f32) for x in back) / total
        g_gram = np.zeros_like(gram)
        g_gram[sub_own[sub_begin]] = np.add.reduceat(g_vec[owner], sub_begin)
        for p, g, m, v in zip(params, [g_vec, g_gram, g_out, g_bias], first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (s.rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)).astype(f32)
    index = {w: i for i, w in enumerate(vocabulary)}
    return Model(areas, index, vectors() @ out, gram @ out, bias, s.threshold, s.units, s.least_units)


class Scorer:
    """Areas of sentences, as bits; sentences met before are looked up."""

    def __init__(self, m: Model) -> None:
        self.m, self.known = m, {}
        self.rows = [*m.word_logits]
        self.at: dict[str, int] = {}
        self.bits = 1 << np.arange(len(m.areas), dtype=np.int64)

    def token(self, raw: str) -> int:
        """The row of a raw token's logits, -1 for a token without letters. An unknown word has the mean of its subwords."""
        w = normal(raw)
        if not w:
            i = -1
        elif w in self.m.words:
            i = self.m.words[w]
        else:
            i = len(self.rows)
            self.rows.append(self.m.gram_logits[grams(w)].mean(0))
        self.at[raw] = i
        return i

    def learn(self, fresh: list[str]) -> None:
        at, ids, ends = self.at, [], [0]
        for sentence in fresh:
            ids += [i for i in [at[t] if t in at else self.token(t) for t in sentence.split()] if i >= 0]
            ends.append(len(ids))
        begin, end = np.array(ends[:-1]), np.array(ends[1:])
        full = np.flatnonzero(end > begin)
        mask = np.zeros(len(fresh), np.int64)
        if len(full):
            used, where = np.unique(np.array(ids), return_inverse=True)
            table = np.stack([self.rows[i] for i in used])
            z = np.add.reduceat(table[where], begin[full]) / (end - begin)[full][:, None] + self.m.bias
            mask[full] = (z > self.m.threshold) @ self.bits
        self.known.update(zip(fresh, mask.tolist(), strict=True))

    def forget(self) -> None:
        if len(self.known) > MOST_KEPT:
            self.known = {}
        if len(self.at) > 5 * MOST_KEPT:
            self.at, self.rows = {}, self.rows[: len(self.m.words)]

    def areas_of(self, texts: list[str]) -> list[list[str]]:
        self.forget()
        cut = [[sentences(p) for p in self.m.units(t)] for t in texts]
        known = self.known
        self.learn(list({s for d in cut for p in d for s in p if s not in known}))
        out = []
        for d in cut:
            counts: dict[int, int] = {}
            for p in d:
                bits = 0
                for s in p:
                    bits |= known[s]
                if bits:
                    counts[bits] = counts.get(bits, 0) + 1
            out.append([a for j, a in enumerate(self.m.areas) if sum(n for bits, n in counts.items() if bits >> j & 1) >= self.m.least_units])
        return out


def scored(docs: DataFrame, m: Model | None, item: str = "doc_id") -> DataFrame:
    """(item, area): one row for each area of each document, scored whole where it lies.

    A null or empty text, one without units, and any text if there is no model
    have no area. Other columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema[item].dataType.simpleString()
    schema = f"{item} {kind}, area string"
    if m is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(m)  # words of at most max_labelled documents, and the buckets

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            found = scorer.areas_of(b.column(1).to_pylist())
            index = np.repeat(np.arange(b.num_rows), [len(a) for a in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index, pa.int64())), pa.array([a for x in found for a in x], pa.string())], names=[item, "area"])

    return docs.where("text IS NOT NULL").select(item, "text").mapInArrow(score, schema)


def composition(found: DataFrame, docs: DataFrame, areas: DataFrame, item: str = "doc_id") -> DataFrame:
    """(area, documents, characters, share): the corpus by area, share of its characters; a document with several areas counts for each."""
    length = docs.select(item, F.coalesce(F.length("text"), F.lit(0)).alias("__n"))
    total = length.agg(F.sum("__n")).first()[0] or 0
    sums = found.join(length, item).groupBy("area").agg(F.count("*").alias("documents"), F.sum("__n").alias("characters"))
    out = areas.select("area").where("area IS NOT NULL").distinct().join(sums, "area", "left")
    n = F.coalesce("characters", F.lit(0))
    return out.select("area", F.coalesce("documents", F.lit(0)).alias("documents"), n.alias("characters"), (n / F.lit(float(max(1, total)))).alias("share"))
