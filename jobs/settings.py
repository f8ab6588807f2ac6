"""Small JSON settings of a job, read through Spark, so that the file may be remote."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def parse(text: str, defaults: dict) -> dict:
    """The defaults with what the text says over them. A name that has no default is an error."""
    said = json.loads(text)
    if unknown := sorted(set(said) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | said


def read(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults, with what the file says over them if there is one."""
    if path is None:
        return dict(defaults)
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one settings file is wanted: {path}")
    return parse(rows[0]["value"], defaults)
