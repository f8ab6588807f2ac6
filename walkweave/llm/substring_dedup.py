"""Passages that repeat across documents, found in FM-indexes per shard.

A shard indexes the texts around its anchors: of the k-grams in a window, the one with the smallest hash is the window's anchor, so equal windows have equal anchors and meet in one shard, wherever they stand.
Anchors that only one text has are dropped before. Each shard then streams its texts through its index: backward search gives, for every place, the suffixes that
the window ending there has in common with the index, and among these the smallest document. Texts that are equal as a whole go through all that once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, lists, mix, odd, parts_for, same_row, scope, text_of, words
from .common import hashes as hash_words
from .fm_index import FMIndex

LAST = np.int64(2**63 - 1)
#: Bytes of a word's hash in a shard's texts.
WIDE = 6


@dataclass(frozen=True)
class Params:
    """window: words of a passage. k: words of an anchor, fewer than the window's. id_bits: of a text's number; texts whose numbers clash are told apart by a second one."""

    window: int = 13
    k: int = 5
    id_bits: int = 64


def packed(w: np.ndarray) -> np.ndarray:
    """The upper WIDE bytes of each word's hash, a row each."""
    return np.ascontiguousarray(np.ascontiguousarray(w).view(np.uint8).reshape(-1, 8)[:, 8 - WIDE :])


def unpacked(text: bytes) -> np.ndarray:
    out = np.zeros((len(text) // WIDE, 8), np.uint8)
    out[:, :WIDE] = np.frombuffer(text, np.uint8).reshape(-1, WIDE)
    return out.view(np.uint64).ravel()


def anchors(w: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of a text's anchors, and each window's anchor as its place among them."""
    if len(w) < p.window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(len(w) - p.k + 1, np.uint64)
    for i in range(p.k):
        h += w[i : len(w) - p.k + 1 + i] * odd(i)
    h = mix(h)
    view = np.lib.stride_tricks.sliding_window_view(h, p.window - p.k + 1)
    place = view.argmin(1) + np.arange(len(view))
    at, own = np.unique(place, return_inverse=True)
    return h[at], at, own


def _blobs(owner: np.ndarray, columns: list[np.ndarray]) -> list[pa.Array]:
    """Rows by owner: the owner, and each column's part as bytes."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    end = np.append(begin[1:], len(owner))
    return [pa.array(owner[begin].astype(np.int32)), *(pa.array([x[order][a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()) for x in columns)]


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (((mix(h) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _send_anchors(p: Params, owners: int):
    """class, words -> owner, anchors, classes."""

    def run(batches):
        for batch in batches:
            flat, offsets = lists(batch.column(1))
            flat, seen, found, classes = flat.view(np.uint64), set(), [], []
            for i, c in enumerate(batch.column(0).to_pylist()):
                if c not in seen:
                    seen.add(c)
                    h = np.unique(anchors(flat[offsets[i] : offsets[i + 1]], p)[0])
                    found.append(h)
                    classes.append(np.full(len(h), c, np.int64))
            if found and sum(map(len, found)):
                h = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(_blobs(_part(h, owners), [h, np.concatenate(classes)]), ["owner", "anchors", "classes"])

    return run


def _shared_anchors(group: pd.DataFrame) -> pd.DataFrame:
    """The anchors that several classes have: class and anchor, as blobs."""
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in group["anchors"]])
    c = np.concatenate([np.frombuffer(x, np.int64) for x in group["classes"]])
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    h, c = h[new], c[new]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    several = np.repeat(np.diff(np.append(begin, len(h))) > 1, np.diff(np.append(begin, len(h))))
    return pd.DataFrame({"classes": [c[several].tobytes()], "anchors": [h[several].tobytes()]})


def _open(names: list[str], kinds: list):
    """Blobs -> rows."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(j)[i].as_py(), t)) for j, t in enumerate(kinds)], names)

    return run


def _send_texts(p: Params, shards: int):
    """class, order, words, shared anchors -> shard, and of the batch's texts around those: words, lengths, smallest order; where each stands: its number here, class, order, place."""

    def run(batches):
        for batch in batches:
            flat, offsets = lists(batch.column(2))
            wanted, limits = lists(batch.column(3))
            flat, wanted = flat.view(np.uint64), wanted.view(np.uint64)
            by_shard: dict[int, tuple[dict, list]] = {}
            for i, (c, order) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                w = flat[offsets[i] : offsets[i + 1]]
                h, _, own = anchors(w, p)
                use = np.isin(h, wanted[limits[i] : limits[i + 1]])
                first = np.searchsorted(own, np.arange(len(h)))  # windows of an anchor follow each other
                last = np.append(first[1:], len(own))
                short = packed(w)
                shard = _part(h, shards)
                for j in np.flatnonzero(use):
                    content = short[first[j] : last[j] - 1 + p.window].tobytes()
                    texts, places = by_shard.setdefault(int(shard[j]), ({}, []))
                    text = texts.setdefault(content, [len(texts), order])
                    text[1] = min(text[1], order)
                    places.append((text[0], c, order, int(first[j])))
            if by_shard:
                out = [[] for _ in range(8)]
                for shard, (texts, places) in by_shard.items():
                    columns = zip(*places, strict=True)
                    row = [shard, b"".join(texts), np.array([len(x) // WIDE for x in texts], np.int32).tobytes(), np.array([x[1] for x in texts.values()], np.int64).tobytes()]
                    row += [np.array(x, t).tobytes() for x, t in zip(columns, (np.int32, np.int64, np.int64, np.int32), strict=True)]
                    for a, b in zip(out, row, strict=True):
                        a.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], TEXTS)

    return run


TEXTS = ["shard", "words", "lengths", "least", "text", "classes", "orders", "places"]


def repeats(texts: list[np.ndarray], least: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Streams each text through an index of all: for each of its windows (text, place), the smallest `least` of the texts that have it; windows of one text alone are left out."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.concatenate([np.append(t, np.uint64(0)) for t in texts])
    inside = np.ones(len(flat), bool)
    inside[begin[1:] - 1] = False
    symbols = np.zeros(len(flat), np.int64)
    symbols[inside] = np.unique(flat[inside], return_inverse=True)[1] + 1
    index = FMIndex(symbols, window + 1)
    text = np.repeat(np.arange(len(texts)), np.maximum(sizes - window + 1, 0))
    place = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(sizes - window + 1, 0)) - np.maximum(sizes - window + 1, 0), np.maximum(sizes - window + 1, 0))
    length, start, end = index.match(symbols, begin[text] + place + window, window, 2)
    hit = length == window
    text, place, start, end = text[hit], place[hit], start[hit], end[hit]
    if not len(start):
        return text, place, np.zeros(0, np.int64)
    # Intervals of equal length are equal or disjoint, so one pass gives the smallest owner of each.
    owner = np.append(least[np.searchsorted(begin, index.suffixes, "right") - 1], LAST)
    lows, back = np.unique(start, return_inverse=True)
    highs = np.zeros(len(lows), np.int64)
    highs[back] = end
    smallest = np.minimum.reduceat(owner, np.stack([lows, highs], 1).ravel())[::2]
    return text, place, smallest[back]


def _search(p: Params):
    """A shard: its texts, distinct, go into an index and are streamed through it -> class, start, end of what a smaller document also has, as blobs."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        numbers: dict[bytes, int] = {}
        least: list[int] = []
        text, classes, orders, places = [], [], [], []
        for row in group.itertuples(index=False):
            own, at = [], 0
            for n, order in zip(np.frombuffer(row.lengths, np.int32).tolist(), np.frombuffer(row.least, np.int64).tolist(), strict=True):
                k = numbers.setdefault(row.words[at : at + WIDE * n], len(numbers))
                at += WIDE * n
                own.append(k)
                if k == len(least):
                    least.append(order)
                else:
                    least[k] = min(least[k], order)
            text.append(np.array(own, np.int64)[np.frombuffer(row.text, np.int32)])
            classes.append(np.frombuffer(row.classes, np.int64))
            orders.append(np.frombuffer(row.orders, np.int64))
            places.append(np.frombuffer(row.places, np.int32).astype(np.int64))
        text, classes, orders, places = map(np.concatenate, (text, classes, orders, places))
        least = np.array(least, np.int64)
        found, place, smallest = repeats([unpacked(t) for t in numbers], least, p.window)
        # A window of one distinct text alone: its smallest document is the text's.
        size = np.array([len(t) // WIDE - p.window + 1 for t in numbers], np.int64)
        base = np.cumsum(size) - size
        owner = np.repeat(least, size)
        owner[base[found] + place] = smallest
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j in range(int(size.max(initial=0))):
            hit = size[text] > j
            hit[hit] = owner[base[text[hit]] + j] < orders[hit]
            out[0].append(classes[hit])
            out[1].append(places[hit] + j)
        c, s = np.concatenate(out[0]), np.concatenate(out[1])
        order = np.lexsort((s, c))
        c, s = c[order], s[order]
        # Windows that overlap or touch become one span.
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (s[1:] > s[:-1] + p.window)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(c)) - 1 if len(c) else first
        return pd.DataFrame({"classes": [c[first].tobytes()], "starts": [s[first].tobytes()], "ends": [(s[last] + p.window).tobytes()]})

    return run


def repeated(docs: DataFrame, p: Params = Params(), column: str = "text", send_ids: int = 2_000_000) -> DataFrame:
    """One row per input row: uid (its number), doc_id, n_words, n_removed, kept_sha256, spans: array of (start, end) of the words removed, end not included.

    A word is removed if a window over it also starts in a document with a smaller doc_id; all windows are judged on the input. Null texts have no words. A null doc_id
    is larger than any other, and rows with the same id (or none) don't remove each other's words. Texts shorter than a window keep all. No rows give none.
    Windows are compared by 48 bits of each of their words, equal texts by 128 bits. The rows are read several times; an error tells if they changed.
    All occurrences of an anchor (24 bytes each, texts that are equal as a whole once) meet in one task. send_ids: up to so many row numbers (8 bytes each) are sent to all tasks that read texts again; more are joined."""
    bounded_batches(docs.sparkSession)
    with scope(docs.sparkSession):
        return _repeated(docs, p, column, send_ids)


def _repeated(docs: DataFrame, p: Params, column: str, send_ids: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), words(text_of(column)).alias("words"))
    joined = F.array_join("words", " ")
    one = F.shiftrightunsigned(F.xxhash64(joined), 64 - p.id_bits)
    hashes = hash_words(F.col("words")).alias("w")
    two = F.xxhash64(F.lit("again"), joined)
    order = F.coalesce("doc_id", F.lit(int(LAST)))
    table = cut(rows.select("uid", "doc_id", F.size("words").cast("long").alias("n_words"), one.alias("class"), two.alias("second"), F.sha2(joined, 256).alias("sha")), "repeats-rows", keep=True)
    number = lambda some: some.groupBy("class").agg(F.min(order).alias("order"), F.min(F.struct(order, "uid", "doc_id")).alias("row"), F.min("second").alias("low"), F.max("second").alias("high"))
    classes = cut(number(table.where(F.col("n_words") >= p.window)), "repeats-classes")
    # Of n texts about n^2 / 2^65 pairs clash: three among 10^10.
    clashes = [r[0] for r in classes.where("low <> high").select("class").collect()]
    class_ = one.alias("class")
    if clashes:
        class_ = F.when(one.isin(clashes), two).otherwise(one).alias("class")
        table = table.withColumn("class", F.when(F.col("class").isin(clashes), F.col("second")).otherwise(F.col("class")))
        classes = cut(number(table.where(F.col("n_words") >= p.window)), "repeats-classes")
    long_ = table.where(F.col("n_words") >= p.window)
    classes = classes.select("class", "order", "row.uid", "row.doc_id")
    total = long_.agg(F.sum("n_words")).first()[0] or 0
    owners = 4 * parts_for(spark, total // 4, 2_000_000)
    sent = rows.where(F.size("words") >= p.window).select(class_, hashes).mapInArrow(_send_anchors(p, owners), "owner int, anchors binary, classes binary")
    shared = sent.groupBy("owner").applyInPandas(_shared_anchors, "classes binary, anchors binary")
    shared = shared.mapInArrow(_open(["class", "anchor"], [np.int64, np.int64]), "class long, anchor long").groupBy("class").agg(F.collect_list("anchor").alias("anchors"))
    wanted = cut(shared.join(classes, "class"), "repeats-anchors")

    def read_again(which: DataFrame, *columns) -> DataFrame:
        ids = which.select("uid")
        some = rows.join(F.broadcast(ids), "uid", "left_semi") if ids.count() <= send_ids else rows
        both = some.select("uid", F.col("doc_id").alias("now"), *columns).join(which, "uid")
        tied = "class" if "class" in which.columns else "uid"
        return both.withColumn(tied, same_row(both, "doc_id", "now", tied)).drop("now")

    texts = read_again(wanted, hashes).select("class", "order", "w", "anchors").mapInArrow(_send_texts(p, owners), ", ".join(f"{n} {'int' if n == 'shard' else 'binary'}" for n in TEXTS))
    spans = texts.groupBy("shard").applyInPandas(_search(p), "classes binary, starts binary, ends binary")
    spans = spans.mapInArrow(_open(["class", "start", "end"], [np.int64] * 3), "class long, start long, end long")
    spans = cut(spans.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "repeats-spans")
    # Of equal texts, those of the smallest id are judged by the spans; the others repeat it as a whole.
    judged = long_.join(classes.select("class", "order"), "class").select("uid", "doc_id", "n_words", "sha", "class", (order > F.col("order")).alias("copy"))
    judged = cut(judged.join(spans, "class", "left"), "repeats-judged", keep=True)
    nothing, span = hashlib.sha256(b"").hexdigest(), "array<struct<start:long,end:long>>"
    output = ["uid", "doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
    zero, none = F.lit(0).cast("long"), F.array().cast(span)
    whole = judged.where("copy").select("uid", "doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(nothing).alias("kept_sha256"), F.array(F.struct(zero.alias("start"), F.col("n_words").alias("end"))).alias("spans"))
    same = judged.where("not copy and spans is null").select("uid", "doc_id", "n_words", zero.alias("n_removed"), F.col("sha").alias("kept_sha256"), none.alias("spans"))
    short = table.where(F.col("n_words") < p.window).select("uid", "doc_id", "n_words", zero.alias("n_removed"), F.col("sha").alias("kept_sha256"), none.alias("spans"))
    partly = read_again(judged.where("not copy and spans is not null").select("uid", "doc_id", "n_words", "spans"), F.col("words"))
    partly = partly.select("uid", "doc_id", "n_words", "words", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends")).mapInArrow(_apply, f"uid long, doc_id long, n_words long, n_removed long, kept_sha256 string, spans {span}")
    return whole.select(output).union(same.select(output)).union(short.select(output)).union(partly.select(output))


def _apply(batches):
    for batch in batches:
        removed, shas, spans = [], [], []
        for own, starts, ends in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
            cover = np.zeros(len(own) + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, ends, -1)
            gone = np.cumsum(cover)[:-1] > 0
            removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(" ".join(np.array(own, object)[~gone]).encode("utf-8", "surrogatepass")).hexdigest())
            edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, kind)], ["uid", "doc_id", "n_words", "n_removed", "kept_sha256", "spans"])
