"""Experiment tracking: no-op, a local JSON-lines file, and optional services."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the pipeline's stages.
STAGES = ("data_loading", "Literal_Handling", "Word2idx_Generation", "Graph_Construction", "Walk_Generation", "Word2Vec_Training", "Embedding_Extraction")


class Tracker:
    """The interface; every method does nothing."""

    def enabled(self) -> bool:
        return False

    def start_pipeline(self, run_name: str | None = None, tags: dict[str, str] | None = None) -> Tracker:
        return self

    @contextmanager
    def stage(self, name: str) -> Iterator[Tracker]:
        yield self

    def log_params(self, params: dict[str, Any]) -> None: ...

    def log_metrics(self, metrics: dict[str, float], step: int | None = None) -> None: ...

    def log_data(self, sample_data: Any, data_name: str, artifact_path: str | None = None, tags: dict[str, str] | None = None) -> None: ...

    def log_artifact(self, path: str, artifact_path: str | None = None) -> None: ...

    def log_figure(self, figure: Any, artifact_file: str, artifact_path: str | None = None) -> None: ...

    def log_dict(self, content: dict, artifact_file: str, artifact_path: str | None = None) -> None: ...

    def log_text(self, text: str, artifact_file: str, artifact_path: str | None = None) -> None: ...

    def log_model(self, model: Any, artifact_path: str) -> None: ...

    def set_tags(self, tags: dict[str, str]) -> None: ...

    def close(self) -> None: ...


class LocalTracker(Tracker):
    """Each event as one JSON line of a file; `read_runs` reads it. Figures go beside the file."""

    def __init__(self, path: str) -> None:
        self.path, self.run = Path(path), uuid.uuid4().hex
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def enabled(self) -> bool:
        return True

    def _say(self, event: str, **content: Any) -> None:
        with self.path.open("a") as f:
            f.write(json.dumps({"run": self.run, "event": event, "time": time.time(), **content}, default=str) + "\n")

    def start_pipeline(self, run_name: str | None = None, tags: dict[str, str] | None = None) -> Tracker:
        self._say("start", run_name=run_name, tags=tags or {})
        return self

    @contextmanager
    def stage(self, name: str) -> Iterator[Tracker]:
        began, status = time.time(), "failed"
        self._say("stage/start", stage=name)
        try:
            yield self
            status = "success"
        finally:
            self._say("stage/end", stage=name, seconds=time.time() - began, status=status)

    def log_params(self, params: dict[str, Any]) -> None:
        self._say("params", params=params)

    def log_metrics(self, metrics: dict[str, float], step: int | None = None) -> None:
        self._say("metrics", metrics=metrics, step=step)

    def log_data(self, sample_data: Any, data_name: str, artifact_path: str | None = None, tags: dict[str, str] | None = None) -> None:
        self._say("data", name=data_name, rows=sample_data.to_dict("records"), artifact_path=artifact_path, tags=tags or {})

    def log_artifact(self, path: str, artifact_path: str | None = None) -> None:
        self._say("artifact", path=path, artifact_path=artifact_path)

    def log_figure(self, figure: Any, artifact_file: str, artifact_path: str | None = None) -> None:
        target = self.path.parent / (artifact_path or ".") / artifact_file
        target.parent.mkdir(parents=True, exist_ok=True)
        figure.savefig(target)
        self.log_artifact(str(target), artifact_path)

    def log_dict(self, content: dict, artifact_file: str, artifact_path: str | None = None) -> None:
        self._say("dict", content=content, file=artifact_file)

    def log_text(self, text: str, artifact_file: str, artifact_path: str | None = None) -> None:
        self._say("text", text=text, file=artifact_file)

    def log_model(self, model: Any, artifact_path: str) -> None:
        self._say("model", path=str(model), artifact_path=artifact_path)

    def set_tags(self, tags: dict[str, str]) -> None:
        self._say("tags", tags=tags)

    def close(self) -> None:
        self._say("end")


def _place(artifact_file: str, artifact_path: str | None) -> str:
    return f"{artifact_path}/{artifact_file}" if artifact_path else artifact_file


class MlflowTracker(Tracker):
    """Nested MLflow runs, one for each stage."""

    def __init__(self, experiment: str | None = None, tracking_uri: str | None = None, registry_uri: str | None = None, experiment_name: str | None = None) -> None:
        import mlflow

        self.api, self.open = mlflow, False
        if tracking_uri:
            mlflow.set_tracking_uri(tracking_uri)
        if registry_uri:
            mlflow.set_registry_uri(registry_uri)
        mlflow.set_experiment(experiment or experiment_name)

    def enabled(self) -> bool:
        return True

    def start_pipeline(self, run_name: str | None = None, tags: dict[str, str] | None = None) -> Tracker:
        self.api.start_run(run_name=run_name, tags=tags)
        self.open = True
        return self

    @contextmanager
    def stage(self, name: str) -> Iterator[Tracker]:
        with self.api.start_run(run_name=name, nested=True):  # ended as failed if the body fails
            yield self

    def log_params(self, params: dict[str, Any]) -> None:
        self.api.log_params(params)

    def log_metrics(self, metrics: dict[str, float], step: int | None = None) -> None:
        self.api.log_metrics(metrics, **({} if step is None else {"step": step}))

    def log_data(self, sample_data: Any, data_name: str, artifact_path: str | None = None, tags: dict[str, str] | None = None) -> None:
        self.api.log_table(data=sample_data, artifact_file=_place(f"{data_name}.json", artifact_path))
        if tags:
            self.api.set_tags(tags)

    def log_artifact(self, path: str, artifact_path: str | None = None) -> None:
        self.api.log_artifact(path, artifact_path)

    def log_figure(self, figure: Any, artifact_file: str, artifact_path: str | None = None) -> None:
        self.api.log_figure(figure, _place(artifact_file, artifact_path))

    def log_dict(self, content: dict, artifact_file: str, artifact_path: str | None = None) -> None:
        self.api.log_dict(content, _place(artifact_file, artifact_path))

    def log_text(self, text: str, artifact_file: str, artifact_path: str | None = None) -> None:
        self.api.log_text(text, _place(artifact_file, artifact_path))

    def log_model(self, model: Any, artifact_path: str) -> None:
        """`model` is the folder of a saved model."""
        self.api.log_artifacts(str(model), artifact_path)

    def set_tags(self, tags: dict[str, str]) -> None:
        self.api.set_tags(tags)

    def close(self) -> None:
        if self.open:
            self.api.end_run()
            self.open = False


class WandbTracker(Tracker):
    """One W&B run with start and end events of stages; documents are artifacts."""

    def __init__(self, project: str, entity: str | None = None, run_name: str | None = None, config: dict | None = None, group: str | None = None) -> None:
        import wandb

        self.api, self.settings, self.run = wandb, {"project": project, "entity": entity, "config": config, "group": group}, None
        self.run_name = run_name

    def enabled(self) -> bool:
        return True

    def start_pipeline(self, run_name: str | None = None, tags: dict[str, str] | None = None) -> Tracker:
        self.run = self.api.init(name=self.run_name or run_name, tags=[f"{k}={v}" for k, v in (tags or {}).items()], **self.settings)
        return self

    @contextmanager
    def stage(self, name: str) -> Iterator[Tracker]:
        self.run.log({"stage/start": name})
        try:
            yield self
        finally:
            self.run.log({"stage/end": name})

    def log_params(self, params: dict[str, Any]) -> None:
        self.run.config.update(params, allow_val_change=True)

    def log_metrics(self, metrics: dict[str, float], step: int | None = None) -> None:
        self.run.log(metrics, **({} if step is None else {"step": step}))

    def log_data(self, sample_data: Any, data_name: str, artifact_path: str | None = None, tags: dict[str, str] | None = None) -> None:
        self.run.log({_place(data_name, artifact_path): self.api.Table(dataframe=sample_data)})
        if tags:
            self.set_tags(tags)

    def _upload(self, path: Path, name: str, kind: str) -> None:
        a = self.api.Artifact(name, type=kind)
        a.add_dir(str(path)) if path.is_dir() else a.add_file(str(path))
        self.run.log_artifact(a)

    def log_artifact(self, path: str, artifact_path: str | None = None) -> None:
        self._upload(Path(path), artifact_path or Path(path).stem, "file")

    def _document(self, artifact_file: str, name: str, write: Callable[[Path], None]) -> None:
        with tempfile.TemporaryDirectory() as folder:
            path = Path(folder) / Path(artifact_file).name
            write(path)
            self._upload(path, name, "file")

    def log_figure(self, figure: Any, artifact_file: str, artifact_path: str | None = None) -> None:
        self._document(artifact_file, artifact_path or "figures", figure.savefig)

    def log_dict(self, content: dict, artifact_file: str, artifact_path: str | None = None) -> None:
        self._document(artifact_file, artifact_path or "data", lambda p: p.write_text(json.dumps(content, indent=2)))

    def log_text(self, text: str, artifact_file: str, artifact_path: str | None = None) -> None:
        self._document(artifact_file, artifact_path or "notes", lambda p: p.write_text(text))

    def log_model(self, model: Any, artifact_path: str) -> None:
        """`model` is the folder of a saved model."""
        self._upload(Path(model), artifact_path, "model")

    def set_tags(self, tags: dict[str, str]) -> None:
        self.run.tags = (*(self.run.tags or ()), *[f"{k}={v}" for k, v in tags.items()])

    def close(self) -> None:
        if self.run:
            self.run.finish()
            self.run = None


def build_tracker(spec: str | None, kwargs: dict | None = None) -> Tracker:
    """The tracker of that name: none, local, mlflow or wandb. A missing package is an ImportError, another name a ValueError.

    `kwargs` are the tracker's settings, or settings by tracker name
    (`{"mlflow": {...}, "wandb": {...}}`), of which its own are taken.
    """
    name = (spec or "none").strip().lower()
    kinds = {"none": Tracker, "local": LocalTracker, "mlflow": MlflowTracker, "wandb": WandbTracker}
    if name not in kinds:
        raise ValueError(f"unknown tracker {spec!r}: {', '.join(kinds)}")
    own = dict(kwargs or {})
    if own and set(own) <= set(kinds) and all(isinstance(v, dict) for v in own.values()):
        own = own.get(name, {})
    if name == "none":
        return Tracker()
    try:
        return kinds[name](**own)
    except ImportError as e:
        raise ImportError(f"the tracker {name} needs the package of that name") from e


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, run_name, status, seconds, params, metrics) of the runs in files of the local tracker.

    `status` is what the tag says, else success for a run that ended and
    running for one that didn't. `params` and `metrics` are maps to text; of a
    name logged several times the last value holds.
    """
    schema = "run string, event string, time double, run_name string, status string, tags map<string,string>, params map<string,string>, metrics map<string,string>"
    e = spark.read.schema(schema).json(path).where("run IS NOT NULL")

    def last(c: str) -> Column:
        entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("time", F.map_entries(c).alias("e"))))), lambda x: x["e"]))
        return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["key"]), F.map_from_entries(F.array(x))))

    g = e.groupBy("run").agg(F.max("run_name").alias("run_name"), (F.max("time") - F.min("time")).alias("seconds"), F.max(F.col("event") == "end").alias("__over"), last("tags").alias("__tags"), last("params").alias("params"), last("metrics").alias("metrics"))
    status = F.coalesce(F.col("__tags")["status"], F.when(F.col("__over"), "success").otherwise("running"))
    return g.select("run", "run_name", status.alias("status"), "seconds", "params", "metrics")
