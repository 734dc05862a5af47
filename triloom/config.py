"""Configuration of the walk and embedding pipeline, checked on construction."""

from __future__ import annotations

from typing import Any, Literal

from pydantic import BaseModel, ConfigDict, Field


class WalkConfig(BaseModel):
    """All settings, with their defaults.

    `multi_gpu`, `num_nodes`, `cpu_count` and `tune_batch_size` are accepted and
    have no effect: Spark decides on parallelism. `reproducible` holds in any
    case: equal seeds give equal vectors. The backends `pytorch`, `gensim` and
    `numpy` are one, in numpy.
    """

    model_config = ConfigDict(extra="forbid")

    # The public names of the settings with their options, bounds and defaults.

    walk_strategy: Literal["random", "bfs"] = "random"
    walk_depth: int = Field(4, gt=0)
    walk_number: int = Field(100, gt=0)
    walk_weighted: bool = False

    embedding_model: Literal["skipgram", "cbow"] = "skipgram"
    epochs: int = Field(5, gt=0)
    batch_size: int | None = Field(None, gt=0)
    vector_size: int = Field(256, gt=0)
    window_size: int = Field(5, gt=1)
    min_count: int = Field(1, ge=0)
    negative_samples: int = Field(5, ge=0)
    learning_rate: float = Field(0.0001, gt=0)
    backend: Literal["pytorch", "gensim", "numpy", "mllib"] = "pytorch"

    random_state: int = Field(42, ge=0)
    reproducible: bool = False
    multi_gpu: bool = False
    generate_artifact: bool = False
    cpu_count: int = Field(4, gt=0)
    tune_batch_size: bool = True
    num_nodes: int = Field(1, gt=0)
    tracker: Literal["mlflow", "wandb", "local", "none"] = "none"
    tracker_kwargs: dict[str, Any] | None = None
    tracker_run_name: str | None = None

    literal_predicates: list[str] | None = None
    literal_strategy: Literal["drop", "bin"] = "drop"
    literal_n_bins: int = Field(5, gt=1)
    literal_bin_strategy: Literal["quantile", "uniform"] = "quantile"

    # Settings of this library's own.
    order_aware: bool = False
    starts_a_block: int | None = Field(None, gt=0)
    multi_edge: Literal["fanout", "sample"] = "fanout"
    bfs_order: Literal["path", "subject"] = "path"
