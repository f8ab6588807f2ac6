"""Tables in the folder that all machines share, and graphs saved as Parquet."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from walkweave.schema import BiGraph

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a folder that goes with the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="walkweave-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


#: The tables of the scopes that are open here, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("graph_scopes", default=())


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: With this, an action's shuffle files go when it ends. Without, they stay until the driver collects its garbage, so the disk holds those of all actions.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """Actions inside leave no shuffle files behind. The session's setting comes back."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)


@contextmanager
def scope(spark: SparkSession):
    """What materialise() writes inside is deleted in the end, but for tables that it was told to keep: those belong to the scope around, if there is one. Gives the list of the tables written so far."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        with tidy(spark):
            yield own
    finally:
        _SCOPES.reset(token)
        delete(spark, own)


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; what is written there goes with the scope that is open, or with the one around if it's to be kept."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    return path


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes a table and reads it: its plan ends there, and what is lost with an executor is read again. keep: the table outlives the scope in which it is written, as an operator's result does."""
    path = scratch_path(df.sparkSession, name, keep)
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_graph(graph: BiGraph, path: str) -> None:
    for name in ("nodes", "edges", "walks", "paths"):
        if (table := getattr(graph, name)) is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> BiGraph:
    return BiGraph(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "walks", "paths")))
