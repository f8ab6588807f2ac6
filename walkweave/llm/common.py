"""What the text operators share: words, folds, scratch tables, Arrow helpers."""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
BREAK = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_words(col: Column) -> Column:
    """The words of a text in order, A-Z lower-cased and nothing else. One pass of translate() also makes all blanks spaces, so the split needs no pattern."""
    return F.array_remove(F.split(F.translate(F.coalesce(col, F.lit("")), UPPER + BLANKS[1:], LOWER + " " * 5), " "), "")


def words(col: Column) -> Column:
    """The words of a text in order; none for null, empty and blank texts."""
    text = F.btrim(F.coalesce(col, F.lit("")), F.lit(BLANKS))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, BREAK))


def hashes(words: Column) -> Column:
    """A 64-bit hash for each word, in order."""
    return F.transform(words, lambda w: F.xxhash64(w))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, rows: int, rows_per_part: int) -> int:
    """Partitions for so many rows: as many as the session's, more if they'd be too large."""
    return max(shuffle_partitions(spark), math.ceil(rows / rows_per_part))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts may be long, so Arrow batches get fewer rows than Spark's default; a session's own value stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir). A local session without one gets a folder of its own."""
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


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: The tables of the scopes that are open here, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Shuffle files and broadcasts of finished steps go when the driver's garbage is collected, for which a large heap may wait for hours."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scope(spark: SparkSession):
    """What cut() writes inside is deleted in the end, but for tables that it was told to keep: those belong to the scope around, if there is one."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        delete(spark, own)
        release(spark)


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads it again: nothing is computed twice, and lost executors cost no more than their own tasks.
    keep: the table outlives the scope in which it is written, as an operator's result does."""
    path = table_path(df.sparkSession, name)
    scopes = _SCOPES.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same_row(row: DataFrame, column: str, other: str, value: str | None = None):
    """`value` (the column itself), or an error where the column isn't what the first read had: row numbers tie two reads together, so a table must not change between them."""
    changed = F.raise_error(F.lit("the rows changed between two reads; write the table first")).cast(row.schema[value or column].dataType)
    return F.when(F.col(column).eqNullSafe(F.col(other)), F.col(value or column)).otherwise(changed)


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow list column and where each row's begin; the last number is where they end."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits of x (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1024)
def odd(k: int) -> np.uint64:
    """The k-th of a row of odd 64-bit multipliers."""
    return mix(np.array([(k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] | np.uint64(1)


def scaled(n: int, k: int) -> np.uint64:
    """n times the k-th odd multiplier, modulo 2^64."""
    return np.uint64(n * int(odd(k)) & 0xFFFFFFFFFFFFFFFF)
