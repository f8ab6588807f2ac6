"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each task sends the sorted fingerprints of its rows, as Golomb-Rice coded gaps (Golomb 1966; Rice and Plaunt 1971), to the owners of their ranges.
An owner answers each task with a bitmap of those that it has seen twice. Only rows under a set bit are suspects; only they are compared byte by byte.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_for, scope, text_of

#: A fingerprint has so many bits more than the number of rows needs: about one unique row in 2^SPARE is a suspect for nothing.
SPARE = 12
ROW_BITS = 33  # of Spark's row numbers within a task


def encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct numbers as (parameter, code): unary quotients of the gaps, then their remainders of `parameter` bits."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = float(values[-1]) / len(values) if len(values) else 1.0
    k = max(0, int(math.log2(max(mean * 0.69, 1.0))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    bits = (gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return k, np.packbits(unary).tobytes() + np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def decode(n: int, k: int, code: bytes) -> np.ndarray:
    """The numbers again."""
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    begin = (int(ends[-1]) // 8 + 1) * 8
    rest = bits[begin : begin + n * k].reshape(n, k).astype(np.uint64)
    weight = np.uint64(1) << np.arange(k - 1, -1, -1, dtype=np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(k)) + (rest * weight).sum(1, dtype=np.uint64), dtype=np.uint64)


def _messages(owners: int, bits: int):
    """Sends a task's fingerprints: a row per owner with the coded distinct ones; beside them, not sent, the rows in their order and how many rows each has."""

    def run(batches):
        task, at, prints = None, [], []
        for batch in batches:
            if batch.num_rows:
                task = batch.column(0)[0].as_py()
                at.append(batch.column(1).to_numpy())
                prints.append(batch.column(2).to_numpy().astype(np.uint64))
        if task is None:
            return
        at, prints = np.concatenate(at), np.concatenate(prints)
        order = np.argsort(prints, kind="stable")
        at, prints = at[order], prints[order]
        # The owner of the i-th of `owners` equal ranges.
        limits = np.array([(i << bits) // owners for i in range(owners + 1)], np.uint64)
        ends = np.searchsorted(prints, limits[:-1])
        ends = np.append(ends, len(prints))
        out = []
        for i in range(owners):
            a, b = ends[i], ends[i + 1]
            if a < b:
                found, n = np.unique(prints[a:b] - limits[i], return_counts=True)
                k, code = encode(found)
                out.append((task, i, len(found), k, code, at[a:b].astype(np.int32), n.astype(np.int32)))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        names = ["task", "owner", "n", "k", "code", "at", "rows"]
        for i in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out[i : i + 64]], t) for j, t in enumerate(kinds)], names=names)

    return run


def _answers(group: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: which of a task's fingerprints another task has sent, too."""
    sent = [decode(n, k, code) for n, k, code in zip(group.n, group.k, group.code, strict=True)]
    found, n = np.unique(np.concatenate(sent), return_counts=True)
    double = found[n > 1]
    bitmaps = []
    for own in sent:
        place = np.minimum(np.searchsorted(double, own), max(len(double) - 1, 0))
        bitmaps.append(np.packbits(double[place] == own if len(double) else np.zeros(len(own), bool)).tobytes())
    return pd.DataFrame({"task": group.task, "owner": group.owner, "bitmap": bitmaps})


def _by_row(group: pd.DataFrame) -> pd.DataFrame:
    """A task's suspects in the order of its rows: 64 to a number, the first in the lowest bit."""
    size = int(group["at"].map(max).max()) + 1
    flags = np.zeros(-(-size // 64) * 64, np.uint8)
    for at, rows, n, bitmap in zip(group["at"], group["rows"], group["n"], group["bitmap"], strict=True):
        set_ = np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool) | (np.asarray(rows) > 1)
        flags[np.asarray(at)[np.repeat(set_, rows)]] = 1
    return pd.DataFrame({"task": [group.task.iloc[0]], "bits": [np.packbits(flags, bitorder="little").view(np.int64)]})


def duplicates(docs: DataFrame, keep: list[str] | None = None, column: str = "text", digest: Column | None = None, send_rows: int = 1 << 28, prefix: str = "") -> DataFrame:
    """One row per input row: the columns of `keep` (doc_id), keep_id (largest doc_id of the rows with the same text), group_size, kept, text_sha256.

    Null counts as the empty text, and empty texts are copies of each other. Exactly one row of a group is kept: the one with the largest doc_id, a null id being
    the smallest; among rows of the same id, any. An empty table gives no rows. digest: groups suspects before their bytes are compared; SHA-256 unless given.
    prefix: goes before the names of the four new columns. send_rows: up to so many rows the bitmaps (a bit per row: 32 MB) are sent to all tasks; beyond, suspects join by row number."""
    with scope(docs.sparkSession):
        return _duplicates(docs, keep or ["doc_id"], column, digest, send_rows, prefix)


def _duplicates(docs: DataFrame, keep: list[str], column: str, digest: Column | None, send_rows: int, prefix: str) -> DataFrame:
    spark = docs.sparkSession
    count = docs.count()
    bits = min(60, math.ceil(math.log2(count + 1)) + SPARE)
    owners = parts_for(spark, count, 4_000_000)
    text = text_of(column)
    digest = F.sha2(text, 256) if digest is None else digest
    uid = F.monotonically_increasing_id()
    task, row = F.shiftright("uid", ROW_BITS), F.col("uid").bitwiseAND((1 << ROW_BITS) - 1)
    fingerprint = F.shiftrightunsigned(F.xxhash64(text), 64 - bits)
    sent = docs.select(uid.alias("uid"), fingerprint.alias("print")).select(task.alias("task"), row.alias("at"), "print")
    messages = cut(sent.mapInArrow(_messages(owners, bits), "task long, owner int, n int, k int, code binary, at array<int>, rows array<int>"), "dedup-messages")
    answers = messages.select("task", "owner", "n", "k", "code").groupBy("owner").applyInPandas(_answers, "task long, owner int, bitmap binary")
    flags = messages.select("task", "owner", "n", "at", "rows").join(answers, ["task", "owner"]).groupBy("task").applyInPandas(_by_row, "task long, bits array<long>")
    flags = cut(flags, "dedup-flags")

    rows = docs.select(*[F.col(c).alias(f"in_{c}") for c in keep], F.col("doc_id").alias("own_id"), text.alias("text"), digest.alias("digest"), uid.alias("uid"))
    bit = F.getbit(F.element_at("bits", (row / 64).cast("int") + 1), (row % 64).cast("int")) == 1
    if count <= send_rows:
        flagged = rows.withColumn("task", task).join(F.broadcast(flags), "task").withColumn("suspect", bit)
    else:
        numbers = flags.select("task", F.posexplode("bits").alias("place", "word")).where("word != 0")
        numbers = numbers.select("task", (F.col("place") * 64).alias("first"), "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b")).where(F.getbit("word", F.col("b")) == 1)
        numbers = numbers.select((F.shiftleft("task", ROW_BITS) + F.col("first") + F.col("b")).alias("uid"), F.lit(True).alias("set"))
        flagged = rows.join(numbers, "uid", "left").withColumn("suspect", F.coalesce("set", F.lit(False)))
    sha = F.sha2("text", 256).alias("text_sha256")
    seen = cut(flagged.select(*[f"in_{c}" for c in keep], "own_id", "uid", "digest", "suspect", sha), "dedup-rows", keep=True)
    if seen.count() != count:
        raise RuntimeError("the rows changed between two reads; write the table before looking for duplicates in it")
    # Here bytes are compared: the text itself is a key. Each task sends a text once, however many copies it has read.
    groups = flagged.where("suspect").groupBy("digest", "text").agg(F.max("own_id").alias("keep_id"), F.coalesce(F.max_by("uid", "own_id"), F.max("uid")).alias("keep_uid"), F.count(F.lit(1)).alias("group_size"))
    found = cut(groups.select("digest", "keep_id", "keep_uid", "group_size"), "dedup-groups", keep=True)
    suspects = seen.where("suspect").drop("suspect")
    if found.groupBy("digest").count().where("count > 1").isEmpty():
        suspects = suspects.join(found, "digest")
    else:  # different texts share a digest: the rows join by their bytes
        again = flagged.where("suspect").select("uid", "digest", "text")
        again = cut(again.join(groups, ["digest", "text"]).select("uid", "keep_id", "keep_uid", "group_size"), "dedup-again", keep=True)
        suspects = suspects.join(again, "uid")
    single = seen.where("not suspect").drop("suspect").withColumns({"keep_id": F.col("own_id"), "keep_uid": F.col("uid"), "group_size": F.lit(1).cast("long")})
    out = suspects.select(*single.columns).union(single)
    return out.select(*[F.col(f"in_{c}").alias(c) for c in keep], F.col("keep_id").alias(f"{prefix}keep_id"), F.col("group_size").alias(f"{prefix}group_size"), (F.col("uid") == F.col("keep_uid")).alias(f"{prefix}kept"), F.col("text_sha256").alias(f"{prefix}text_sha256"))
