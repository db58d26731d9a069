"""Scorers from outside the library: code and artefacts of a run folder, shipped to the executors and loaded once a worker.

A run folder says in config.yaml (or run.json) which factory makes its scorer:

    scorer:
      factory: model.py:load            # a file of the run folder, or an importable module:name
      artifacts: {weights: checkpoints/best.npz}
      args: {scale: 2.0}

The factory gets each artefact's local path and the arguments by name, and returns a function from a pandas frame to one
list of logits a row. Files travel through Spark's own file server under a name made of their content, so two runs may
both call theirs best.npz, and equal files travel once.
"""

from __future__ import annotations

import hashlib
import importlib
import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corvane.operators.scoring import SCORERS
from corvane.sources.store import Store

Model = Callable[[pd.DataFrame], list]


@dataclass(frozen=True)
class Scorer:
    """factory: a registered name, module:name, or shipped:name of a shipped file."""

    factory: str
    args: tuple = ()
    named: tuple[tuple[str, object], ...] = ()
    artifacts: tuple[tuple[str, str], ...] = ()  # argument and shipped name
    made_by: Callable | None = field(default=None, compare=False)  # of a registered scorer: it travels with the task

    def load(self) -> Model:
        paths = {k: SparkFiles.get(name) for k, name in self.artifacts}
        return _factory(self)(*self.args, **dict(self.named), **paths)


def _factory(scorer: Scorer) -> Callable:
    if scorer.made_by:
        return scorer.made_by
    where, _, name = scorer.factory.rpartition(":")
    if not where.endswith(".py"):
        return getattr(importlib.import_module(where), name)
    spec = importlib.util.spec_from_file_location(f"_scorer_{Path(where).stem}", SparkFiles.get(where))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return getattr(module, name)


def ship(spark: SparkSession, path: str) -> str:
    """Offers a file of any store to all executors; returns the name that SparkFiles.get() knows it by."""
    data = Store(spark).read_bytes(path)
    name = f"{hashlib.sha256(data).hexdigest()[:20]}-{Path(path).name}"
    staged = Path(SparkFiles.getRootDirectory(), "offered", name)
    if not staged.exists():
        staged.parent.mkdir(exist_ok=True)
        staged.write_bytes(data)
        spark.sparkContext.addFile(str(staged))
    return name


def scorer(spark: SparkSession, spec: dict | str, folder: str = ".", args=()) -> Scorer:
    """From a run folder's settings. A plain name is that of a registered scorer."""
    spec = {"factory": spec} if isinstance(spec, str) else spec
    factory = spec["factory"]
    named = spec.get("args", {})
    args, named = (tuple(args or named), {}) if isinstance(named, (list, tuple)) else (tuple(args), named)
    if factory in SCORERS:
        return Scorer(factory, args, tuple(named.items()), made_by=SCORERS[factory])
    where, _, name = factory.rpartition(":")
    if not where:
        raise ValueError(f"{factory} is neither a registered scorer nor a module or file and a name, as in model.py:load")
    if where.endswith(".py"):
        code = ship(spark, f"{folder}/{where}")
        factory = f"{code}:{name}"
    shipped = tuple((k, ship(spark, f"{folder}/{p}")) for k, p in spec.get("artifacts", {}).items())
    return Scorer(factory, args, tuple(named.items()), shipped)


_LOADED: dict[str, Model] = {}  # of this worker; workers outlive their tasks


def loaded(one: Scorer) -> Model:
    if one.made_by:
        return one.load()
    key = repr((one.factory, one.args, one.named, one.artifacts))  # arguments may be lists
    if key not in _LOADED:
        _LOADED[key] = one.load()
    return _LOADED[key]


def score_all(rows: DataFrame, scorers: list[Scorer], batch_size: int = 64, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds `logits`, an array of logits for each scorer, in one pass of Arrow batches; `drop` names columns that only
    the scorers need."""
    kept = [f for f in rows.schema.fields if f.name not in drop]
    schema = T.StructType([*kept, T.StructField("logits", T.ArrayType(T.ArrayType(T.DoubleType())))])
    names = [f.name for f in kept]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [loaded(s) for s in scorers]
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size].reset_index(drop=True)
                each = [[[float(x) for x in row] for row in model(part)] for model in models]
                yield part[names].assign(logits=[list(z) for z in zip(*each)])

    return rows.mapInPandas(run, schema)
