"""A quality classifier over supervised subword embeddings (Joulin et al. 2017; Bojanowski et al. 2017).

Each word and each character n-gram inside a word, with its marks for start and end, hashes to a learnt vector. A document is the average of
all its vectors, a softmax layer tells its label. Both are trained by stochastic gradient descent in numpy. As the layer is linear, scoring needs only
each bucket's margin between the labels, so a text is read once and no document vector is formed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, lists, mix, odd, scope, text_of


@dataclass(frozen=True)
class Params:
    """sample: most labelled documents used for fitting, picked by a hash of their ids. buckets: rows of the embedding table (a power of two).
    dim: a vector's length. lengths: of the character n-grams. epochs, rate: of the descent, whose rate falls to 0. chunk: code points hashed at once."""

    sample: int = 6_000
    buckets: int = 1 << 17
    dim: int = 12
    lengths: tuple[int, ...] = (2, 3, 4)
    epochs: int = 6
    rate: float = 0.6
    chunk: int = 1 << 17
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """margin: each bucket's vector times the difference of the output layer's rows. bias: that of their biases."""

    margin: np.ndarray
    bias: float
    lengths: tuple[int, ...]
    chunk: int


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def buckets_of(texts: list[str], lengths: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all texts, and the text that each belongs to. Features: every word, every n-gram of a word between its two marks, and one that all words share that repeat the word before."""
    code = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (code < 33) & SPACE[np.minimum(code, 255)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)  # of each place but the first
    doc = np.concatenate([doc[:1], doc]) if len(doc) else np.zeros(len(code), np.int32)
    code = np.where(blank, np.uint32(32), code)
    mask = np.uint64(buckets - 1)
    found, owner = [], []
    wide = code.astype(np.uint64)
    for n in lengths:
        if len(code) < n:
            continue
        h = np.zeros(len(code) - n + 1, np.uint64)
        for k in range(n):
            h += wide[k : len(wide) - n + 1 + k] * odd(16 * n + k)
        inner = np.ones(len(h), bool)
        for k in range(1, n - 1):  # a blank may mark a word's start or end, not lie inside
            inner &= ~blank[k : len(blank) - n + 1 + k]
        inner &= ~(blank[: len(h)] & blank[n - 1 :])
        at = np.flatnonzero(inner)
        found.append((mix(h[at] + odd(n)) & mask).astype(np.int32))
        owner.append(doc[at + (1 if n > 1 else 0)])
    edge = np.flatnonzero(np.diff(blank.astype(np.int8)))
    starts, ends = edge[0::2] + 1, edge[1::2] + 1
    if len(starts):
        power = np.full(len(code), odd(999), np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        # Horner's rule backwards: a word's hash doesn't depend on where it stands
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(wide + odd(5)) * power)])
        inverse = np.uint64(pow(int(odd(999)), -1, 1 << 64))
        back = np.full(len(code), inverse, np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        h = (total[ends] - total[starts]) * back[starts]
        found.append((mix(h + odd(1)) & mask).astype(np.int32))
        owner.append(doc[starts])
        again = doc[starts[1:]][(h[1:] == h[:-1]) & (doc[starts[1:]] == doc[starts[:-1]])]
        found.append(np.full(len(again), int(odd(2) & mask), np.int32))
        owner.append(again)
    return (np.concatenate(found), np.concatenate(owner)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def chunks(texts: list[str], most: int):
    """Slices of the list, each of about `most` code points; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def margins(model: Model, texts: list[str]) -> np.ndarray:
    """Log-odds of label 1; an empty text has the bias alone."""
    out = np.full(len(texts), model.bias)
    for a, b in chunks(texts, model.chunk):
        found, owner = buckets_of(texts[a:b], model.lengths, len(model.margin))
        total = np.bincount(owner, model.margin[found], b - a)
        out[a:b] += total / np.maximum(np.bincount(owner, minlength=b - a), 1)
    return out


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", p: Params = Params()) -> Model:
    """learn: tells from the column of ids which rows may be learnt from. Of several labels of a document or text the largest counts. Whole texts are used.
    The sample's features are a table, which one task reads in batches, once for each epoch; only the margins come to the driver. Without labels of both kinds the model has no margins, and its bias is the log-odds of the share of label 1 (of 1 without labels: nothing is known to be bad)."""
    labelled = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    # A text that is there many times counts once.
    rows = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "h", "text")
    lengths, buckets, chunk = p.lengths, p.buckets, p.chunk

    def features(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts, chunk):
                found, owner = buckets_of(texts[a:b], lengths, buckets)
                pair, n = np.unique(owner.astype(np.int64) * buckets + found, return_counts=True)
                ends = np.searchsorted(pair, np.arange(b - a + 1) * buckets).astype(np.int32)
                as_list = lambda v, e=ends: pa.ListArray.from_arrays(pa.array(e), pa.array(v.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], as_list(pair % buckets), as_list(n)], ["y", "h", "bucket", "n"])

    with scope(docs.sparkSession):
        table = cut(rows.mapInArrow(features, "y int, h long, bucket array<int>, n array<int>"), "quality-features")
        count, ones = table.agg(F.count(F.lit(1)), F.sum("y")).first()
        share = float(ones / count) if count else 1.0
        if not count or not 0 < share < 1:
            return Model(np.zeros(2, np.float32), math.log((share + 1e-6) / (1 - share + 1e-6)), p.lengths, p.chunk)
        # p.sample rows at most, mixed once, in one file: a task reads it again and again in this order.
        table = cut(table.repartition(1).sortWithinPartitions(F.xxhash64("h"), "h"), "quality-mixed")
        margin, bias = _descend(table, share, int(count), p)
    return Model(margin, bias + math.log(share / (1 - share)), p.lengths, p.chunk)


def descend(state, documents, share: float, rate) -> None:
    """In place. documents: (label, buckets, counts) of each. rate: tells the step's rate from its number. The labels weigh alike; the bias is moved back to their true shares in the end."""
    vectors, layer, bias = state
    weight = np.array([0.5 / max(1 - share, 1e-3), 0.5 / max(share, 1e-3)], np.float32)
    for done, (y, at, count) in enumerate(documents):
        part = (count / max(count.sum(), 1)).astype(np.float32)
        hidden = part @ vectors[at] if len(at) else np.zeros(vectors.shape[1], np.float32)
        z = layer @ hidden + bias
        q = np.exp(z - z.max())
        q /= q.sum()
        q[y] -= 1
        q *= weight[y] * np.float32(rate(done))
        back = q @ layer
        layer -= np.outer(q, hidden)
        bias -= q
        if len(at):
            # The average's gradient reaches a bucket by its share; as in the published method it isn't divided by the document's length.
            vectors[at] -= (part / part.max())[:, None] * back


def _descend(table: DataFrame, share: float, count: int, p: Params) -> tuple[np.ndarray, float]:
    """All epochs in one task, batch by batch. Only each bucket's margin and the bias come to the driver."""
    steps = p.epochs * count

    def documents(batches):
        for batch in batches:
            (bucket, ends), (n, _) = lists(batch.column(2)), lists(batch.column(3))
            for i, y in enumerate(batch.column(0).to_pylist()):
                yield y, bucket[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]]

    def run(batches):
        rng = np.random.default_rng(p.seed)
        vectors = ((rng.random((p.buckets, p.dim), np.float32) - 0.5) / p.dim).astype(np.float32)
        layer, bias = np.zeros((2, p.dim), np.float32), np.zeros(2, np.float32)
        descend((vectors, layer, bias), documents(batches), share, lambda done: p.rate * (1 - done / steps))
        margin = (vectors @ (layer[1] - layer[0])).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([margin.tobytes()], pa.binary()), pa.array([float(bias[1] - bias[0])])], ["margin", "bias"])

    again = table
    for _ in range(p.epochs - 1):
        again = again.union(table)
    found = again.coalesce(1).mapInArrow(run, "margin binary, bias double").first()
    return np.frombuffer(found.margin, np.float32).copy(), found.bias


def score(docs: DataFrame, model: Model, extra: list[str] | None = None, column: str = "text", name: str = "score") -> DataFrame:
    """One row per input row: the columns of `extra` and `name`, the chance of label 1. Null counts as empty; an empty text has the share of label 1 that the bias stands for.
    Rows are independent: ties and repeats each get their row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # Params.buckets numbers
    rows = docs.select(*(extra or []), text_of(column).alias("__text"))
    schema = rows.drop("__text").schema.add(name, "double")

    def run(batches):
        m = shared.value
        for batch in batches:
            z = margins(m, batch.column(batch.num_columns - 1).to_pylist())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=schema.names)

    return rows.mapInArrow(run, schema)
