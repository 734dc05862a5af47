"""The pipeline as an object: load triples, walk, train, and give the vectors back with their words."""

from __future__ import annotations

from types import TracebackType
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom import session
from triloom.config import WalkConfig
from triloom.operators import corpus, graph, literals, vocab, walks
from triloom.session import exists, mark, release_since, written
from triloom.sources import sinks
from triloom.sources.readers import read_triples
from triloom.track import build_tracker
from triloom.train import models, trainer

class KGEmbedder:
    """Embeddings of the terms of a knowledge graph.

    `load_data` (or `fit` with triples as strings) builds vocabulary and graph,
    `fit` walks and trains, `transform` returns (token, word, embedding) of the
    whole vocabulary; words that no walk reached keep their initial vectors.
    Tables written on the way are removed when `fit` ends; those that results
    read (edges, vocabulary, parameters) by `release`, or with the process.
    """

    def __init__(self, spark: SparkSession, config: WalkConfig | None = None, **settings: Any) -> None:
        if config is not None and settings:
            raise ValueError("give a config or single settings, not both")
        self.spark = spark
        self.config = config or WalkConfig(**settings)
        self.tracker = build_tracker(self.config.tracker, self.config.tracker_kwargs)
        self.word2idx: DataFrame | None = None
        self.edges: DataFrame | None = None
        self.params: DataFrame | None = None
        self.vectors: DataFrame | None = None
        self.losses: list[float] = []
        self._started = False

    # --- loading ---

    def read_data(self, path: str, col_map: dict | None = None, read_kwargs: dict | None = None) -> DataFrame:
        self._start()
        with self.tracker.stage("data_loading"):
            df = read_triples(self.spark, path, col_map, read_kwargs, self.config.walk_weighted)
            if self.tracker.enabled():
                self.tracker.log_params({"data_path": path, "number_rows": df.count(), "number_columns": len(df.columns)})
        return df

    def handle_literals(self, triples: DataFrame) -> DataFrame:
        c = self.config
        if not c.literal_predicates:
            return triples
        with self.tracker.stage("Literal_Handling"):
            self.tracker.log_params({"literal_strategy": c.literal_strategy, "literal_predicates": c.literal_predicates, "literal_n_bins": c.literal_n_bins, "literal_bin_strategy": c.literal_bin_strategy})
            if c.literal_strategy == "drop":
                return literals.dropped(triples, c.literal_predicates)
            return literals.binned(triples, c.literal_predicates, c.literal_n_bins, c.literal_bin_strategy)

    def generate_vocab(self, triples: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(encoded edges, vocabulary)."""
        with self.tracker.stage("Word2idx_Generation"):
            self.word2idx = written(vocab.vocabulary(triples), "vocabulary")
            self.edges = written(vocab.encoded(triples, self.word2idx), "edges")
            self.tracker.log_params({"vocab_size": self.word2idx.count()})
        return self.edges, self.word2idx

    def construct_graph(self, edges: DataFrame) -> DataFrame:
        """The edges; with a tracker on, the graph's metrics are logged."""
        with self.tracker.stage("Graph_Construction"):
            if self.tracker.enabled():
                self.tracker.log_metrics({k: float(v) for k, v in graph.metrics(edges).first().asDict().items() if v is not None})
        return edges

    def load_data(self, path: str, col_map: dict | None = None, read_kwargs: dict | None = None) -> DataFrame:
        """Encoded edges of the file."""
        return self._prepare(self.read_data(path, col_map, read_kwargs))

    def _prepare(self, triples: DataFrame) -> DataFrame:
        point = mark()
        edges, _ = self.generate_vocab(written(self.handle_literals(triples), "triples"))  # read several times from here on
        self.construct_graph(edges)
        release_since(point, self.edges, self.word2idx)
        return edges

    # --- walking and training ---

    def walk_tokens(self, edges: DataFrame, starts: DataFrame | None = None, counted: bool = False) -> DataFrame:
        """(walk_id, pos, token); `counted` has each token of a position once, with its number `n`, and needs no row for each parallel edge."""
        c, point = self.config, mark()
        with self.tracker.stage("Walk_Generation"):
            if c.walk_strategy == "bfs":
                hops = walks.bfs_walks(edges, starts, c.walk_depth, c.bfs_order, c.starts_a_block, "counted" if counted else "fanout")
            else:
                how = "counted" if counted and c.multi_edge == "fanout" else c.multi_edge
                hops = walks.random_walks(edges, starts, c.walk_depth, c.walk_number, c.random_state, c.walk_weighted, how)
            toks = corpus.counted_tokens(hops) if "predicates" in hops.columns else corpus.tokens(hops)
            toks = written(toks.withColumn("n", F.lit(1).cast("bigint")) if counted and "n" not in toks.columns else toks, "tokens")
            toks = written(corpus.frequent(toks, c.min_count), "frequent") if c.min_count > 1 else toks
            release_since(point, toks)
            return toks

    def walk_generation(self, edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
        """Training pairs: (center, context[, distance]), or for cbow (context array[, distance array], center); distances if the model is aware of order."""
        return self._pairs(self.walk_tokens(edges, starts))

    def _pairs(self, tokens: DataFrame) -> DataFrame:
        c = self.config
        counts = ["n"] if "n" in tokens.columns else []
        if c.embedding_model == "cbow":
            pairs = corpus.cbow_contexts
        elif counts:
            pairs = corpus.counted_pairs
        else:
            pairs = corpus.skipgram_pairs_with_distance if c.order_aware else corpus.skipgram_pairs
        return pairs(tokens, c.window_size).select(*self._model(0).columns, *counts)

    def _model(self, vocabulary: int) -> models.Model:
        c = self.config
        if c.order_aware:
            kind = models.OrderAwareCbow if c.embedding_model == "cbow" else models.OrderAwareSkipGram
            return kind(vocabulary, c.vector_size, c.negative_samples, c.window_size)
        return models.Cbow(vocabulary, c.vector_size) if c.embedding_model == "cbow" else models.SkipGram(vocabulary, c.vector_size, c.negative_samples)

    def fit(self, edges: DataFrame, starts: DataFrame | None = None) -> KGEmbedder:
        """Walks and trains on encoded edges, or on triples as strings, which are loaded first."""
        with session.shuffles_removed(self.spark):
            return self._fit(edges, starts)

    def _fit(self, edges: DataFrame, starts: DataFrame | None) -> KGEmbedder:
        self._start()
        if dict(edges.dtypes)["subject"] == "string":
            edges = self._prepare(edges if self.config.walk_weighted else edges.drop("weights"))  # as `read_data` reads them
        if self.word2idx is None:
            raise ValueError("encoded edges need the vocabulary that load_data builds")
        c, point = self.config, mark()
        counted = c.backend != "mllib"
        tokens = self.walk_tokens(edges, starts, counted=counted)
        with self.tracker.stage("Word2Vec_Training"):
            if c.backend == "mllib":
                self.vectors = written(trainer.fit_mllib(tokens, c.vector_size, c.window_size, c.min_count, c.epochs, c.learning_rate, c.random_state), "vectors")
                release_since(point, self.vectors)
                return self
            f = trainer.fit(self._pairs(tokens), self._model(self.word2idx.count()), c.epochs, c.learning_rate, c.batch_size, c.random_state, counted=counted)
            self.params, self.losses = f.params, f.losses
            release_since(point, self.params)
            for i, loss in enumerate(f.losses):
                self.tracker.log_metrics({"train_loss": loss}, step=i)
        return self

    def transform(self, entities_only: bool = False) -> DataFrame:
        """(token, word, embedding array<float>) of the vocabulary; `entities_only` leaves out words that are only predicates."""
        if self.word2idx is None or (self.params is None and self.vectors is None):
            raise ValueError("nothing is fitted yet")
        with self.tracker.stage("Embedding_Extraction"):
            v = self.vectors if self.vectors is not None else self.context_table(self._model(0).output)
            out = self.word2idx.join(v, "token", "left" if self.vectors is not None else "inner").select("token", "word", "embedding")
            if entities_only:
                if self.edges is None:
                    raise ValueError("entities are known only where the data was loaded")
                out = out.join(graph.vertices(self.edges).withColumnRenamed("vertex", "token"), "token", "left_semi")
            if self.config.generate_artifact:
                sinks.write_embeddings(out, f"vector/embeddings_{self.config.embedding_model}.parquet")
        return out

    def fit_transform(self, edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
        return self.fit(edges, starts).transform()

    def context_table(self, name: str) -> DataFrame:
        """(token, embedding) of one of the model's tables; of an order-aware context table the row is (distance + window) * words + token."""
        if self.params is None:
            raise ValueError("nothing is fitted yet")
        return trainer.table(self.params, self._model(self.word2idx.count()), name)

    # --- keeping ---

    def save(self, path: str) -> None:
        """config, vocabulary and parameters, the last two as far as they are there."""
        sinks.write_json(self.spark, f"{path}/config", self.config.model_dump())
        if self.word2idx is not None:
            self.word2idx.write.mode("overwrite").parquet(f"{path}/word2idx")
        if self.params is not None:
            self.params.write.mode("overwrite").parquet(f"{path}/model")
        if self.vectors is not None:
            self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KGEmbedder:
        """A saved model. `transform` works; walking needs the data loaded again."""
        m = cls(spark, WalkConfig(**sinks.read_json(spark, f"{path}/config")))
        if exists(spark, f"{path}/word2idx"):
            m.word2idx = spark.read.parquet(f"{path}/word2idx")
        if exists(spark, f"{path}/model"):
            m.params = spark.read.parquet(f"{path}/model")
        if exists(spark, f"{path}/vectors"):
            m.vectors = spark.read.parquet(f"{path}/vectors")
        return m

    def _start(self) -> None:
        if not self._started:
            self.tracker.start_pipeline(self.config.tracker_run_name, {"backend": self.config.backend, "model": self.config.embedding_model})
            self._started = True

    def close(self, failed: bool = False) -> None:
        if self._started:
            self.tracker.set_tags({"status": "failed" if failed else "success"})
            self.tracker.close()

    def release(self) -> None:
        """Removes the tables of edges, vocabulary and parameters from the work folder; nothing can be read from this model afterwards."""
        session.drop(*[t for t in (self.edges, self.word2idx, self.params, self.vectors) if t is not None])
        self.edges = self.word2idx = self.params = self.vectors = None

    def __enter__(self) -> KGEmbedder:
        return self

    def __exit__(self, kind: type[BaseException] | None, value: BaseException | None, trace: TracebackType | None) -> None:
        self.close(failed=kind is not None)


def wide(embeddings: DataFrame, size: int) -> DataFrame:
    """(token, word, embedding_0, embedding_1, ...)."""
    return embeddings.select("token", "word", *[F.col("embedding")[i].alias(f"embedding_{i}") for i in range(size)])
