"""Fitted models saved as tables and loaded again, to generate and score without a refit.

A folder holds one Parquet table with a row a model: its name, its kind and its
numbers as JSON (Python's decimal text of a double reads back as the same double).
Models are bounded (trees x 2^(depth + 1) numbers), rows of the data are never saved.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from cohortflow.operators.boosting import Boosted
from cohortflow.operators.hazard import DiscreteHazard
from cohortflow.operators.models import CoxPH, TimeToEvent
from cohortflow.schema import SurvivalSchema

SCHEMA = "name string, kind string, body string"
KINDS = {c.__name__: c for c in (Boosted, CoxPH, DiscreteHazard, TimeToEvent)}


def _pack(value):
    if isinstance(value, np.ndarray):
        return {"array": value.ravel().tolist(), "shape": value.shape, "dtype": str(value.dtype)}
    if isinstance(value, (np.floating, np.integer)):
        return value.item()
    if isinstance(value, SurvivalSchema):
        return {"schema": [value.time, value.status]}
    if type(value).__name__ in KINDS:
        return {"model": type(value).__name__, "fields": {k: _pack(v) for k, v in vars(value).items()}}
    if isinstance(value, dict):
        return {"dict": {k: _pack(v) for k, v in value.items()}}
    return value


def _unpack(value):
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return np.array(value["array"], value["dtype"]).reshape(value["shape"])
    if "schema" in value:
        return SurvivalSchema(*value["schema"])
    if "model" in value:
        model = object.__new__(KINDS[value["model"]])
        model.__dict__.update({k: _unpack(v) for k, v in value["fields"].items()})
        return model
    return {k: _unpack(v) for k, v in value["dict"].items()}


def save_models(spark: SparkSession, models: dict, path: str) -> str:
    """{name: model, or {key: model}} as one table, replaced as a whole."""
    rows = [(n, type(m).__name__, json.dumps(_pack(m))) for n, m in sorted(models.items())]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind) of the saved models."""
    return spark.read.schema(SCHEMA).parquet(path).select("name", "kind")


def load_models(spark: SparkSession, path: str) -> dict:
    return {r["name"]: _unpack(json.loads(r["body"])) for r in spark.read.schema(SCHEMA).parquet(path).collect()}
