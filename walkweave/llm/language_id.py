"""Language identification by rank-order profiles (Cavnar and Trenkle 1994): a language's profile is its most frequent n-grams in order; a document goes to the language from whose profile its own most
frequent n-grams are least out of place.

N-grams are of 1 to 3 characters of words, lower-cased, with a blank at either side of each word. Their code points of 21 bits stand in one 64-bit number, so they are counted exactly, by sorting, without strings.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, scope, text_of

BLANK, BITS = 32, 21
UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    size: int = 400  #: n-grams of a profile, of languages and documents; what isn't in a language's profile is so far out of place
    send: int = 1 << 21  #: entries of profiles (languages times size) that are sent to the tasks at once; more go in several passes
    block: int = 1 << 20  #: characters of a text that are counted at once
    flush: int = 1 << 21  #: counted n-grams that a task holds before it hands them on


@dataclass(frozen=True)
class Model:
    """profiles: lang, gram, rank (from 0), size rows per language at most; a table in the shared folder."""

    profiles: DataFrame
    params: Params


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is part of words (letters and marks) and whether it is a letter."""
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    return (kinds == ord("L")) | (kinds == ord("M")), kinds == ord("L")


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums the counts of equal keys; keys ascend."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def grams(text: str, block: int = Params.block) -> tuple[np.ndarray, np.ndarray, bool]:
    """The n-grams of a text in ascending order, how often each occurs, and whether the text has a letter. Texts are taken in blocks, so beside the text itself memory is bounded by a block and the distinct n-grams."""
    word, letter = characters()
    lower = f"{text.lower()} "
    tail, found, letters = np.array([BLANK], np.int64), [], False
    for at in range(0, len(lower), block):
        raw = np.frombuffer(lower[at : at + block].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = letters or bool(letter[raw].any())
        codes = np.concatenate([tail, np.where(word[raw], raw, BLANK).astype(np.int64)])
        once = np.concatenate([[True], (codes[1:] != BLANK) | (codes[:-1] != BLANK)])  # blanks after blanks go
        codes, old = codes[once], len(tail)
        one, two = codes[old:], codes[max(old - 1, 0) : -1] << BITS | codes[max(old, 1) :]
        three = (codes[:-2] << BITS | codes[1:-1]) << BITS | codes[2:]
        found.append(np.unique(np.concatenate([one[one != BLANK], two, three[codes[1:-1] != BLANK]]), return_counts=True))
        tail = codes[-2:]
    if len(found) == 1:
        return *found[0], letters
    return *merged(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])), letters


def top(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys first; equal counts by key."""
    if len(keys) > 2 * size:  # keys below the size-th largest count can't be among them
        enough = counts >= np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[enough], counts[enough]
    return keys[np.argsort(-counts, kind="stable")[:size]]


def _counter(p: Params):
    def count(batches):
        """lang, text -> lang, gram, n: a task sums what it reads and hands it on before it holds more than p.flush n-grams."""
        held: dict[str, list] = {}
        size = 0

        def out():
            for lang, parts in held.items():
                keys, counts = merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                for i in range(0, len(keys), 1 << 16):
                    k = keys[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(counts[i : i + (1 << 16)])], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, counts, _ = grams(text.as_py(), p.block)
                held.setdefault(lang, []).append((keys, counts.astype(np.int64)))
                size += len(keys)
                if size > p.flush:
                    held = {k: [merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))] for k, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > p.flush // 2:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    return count


def fit(docs: DataFrame, learn: Callable[[Column], Column], p: Params = Params(), column: str = "text") -> Model:
    """Learns from every document that has a language and of whose doc_id learn() holds. Null and empty texts give no n-grams; a language without any n-gram has no profile.
    Texts of any length are read whole; rows that repeat count again; equal counts are ranked by the n-gram's number. Without such documents there are no profiles. The profiles stay in the shared folder."""
    bounded_batches(docs.sparkSession)
    with scope(docs.sparkSession):
        rows = docs.where(F.col("lang").isNotNull() & F.coalesce(learn(F.col("doc_id")), F.lit(False))).select("lang", text_of(column).alias("text"))
        counts = rows.mapInArrow(_counter(p), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
        # The bound on the rank lets every task drop n-grams before a language's come together.
        profiles = counts.withColumn("rank", rank).where(F.col("rank") < p.size).select("lang", "gram", F.col("rank").cast("int").alias("rank"))
        return Model(cut(profiles, "language-profiles", keep=True), p)


def document_profiles(docs: DataFrame, keep: list[str], p: Params = Params(), column: str = "text") -> DataFrame:
    """row (a struct of the columns of `keep`), letters (whether the text has a letter), grams (its most frequent n-grams in order). No shuffle."""

    def profile(batches):
        for batch in batches:
            flags, lists, texts = [], [], batch.column(1)
            for text in texts:
                keys, counts, letters = grams(text.as_py(), p.block)
                flags.append(letters)
                lists.append(top(keys, counts, p.size))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags), values], ["row", "letters", "grams"])

    rows = docs.select(F.struct(*keep).alias("row"), text_of(column).alias("text"))
    return rows.mapInArrow(profile, rows.select("row", F.lit(True).alias("letters"), F.array(F.lit(0).cast("long")).alias("grams")).schema)


@dataclass(frozen=True)
class Table:
    """Profiles by n-gram: at[i]:at[i+1] are the places of gram i in lang and rank."""

    names: list[str]
    gram: np.ndarray
    at: np.ndarray
    lang: np.ndarray
    rank: np.ndarray


def table(names: list[str], lang: np.ndarray, gram: np.ndarray, rank: np.ndarray) -> Table:
    order = np.argsort(gram, kind="stable")
    keys, first = np.unique(gram[order], return_index=True)
    return Table(names, keys, np.append(first, len(order)), lang[order], rank[order])


def distances(t: Table, found: np.ndarray, size: int) -> np.ndarray:
    """How far the n-grams are out of place in each language's profile, added up."""
    total = np.full(len(t.names), len(found) * size, np.int64)
    if len(t.gram) == 0 or len(found) == 0:
        return total
    i = np.minimum(np.searchsorted(t.gram, found), len(t.gram) - 1)
    here = np.flatnonzero(t.gram[i] == found)
    first, n = t.at[i[here]], t.at[i[here] + 1] - t.at[i[here]]
    places = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    off = np.abs(t.rank[places] - np.repeat(here, n)) - size
    return total + np.bincount(t.lang[places], off, len(t.names)).astype(np.int64)


def _tables(model: Model) -> list[Table]:
    """The profiles in groups of languages with at most p.send entries, which go to the tasks one group after the other."""
    names = [r["lang"] for r in model.profiles.select("lang").distinct().orderBy("lang").collect()]  # a row per language
    step, out = max(1, model.params.send // model.params.size), []
    for i in range(0, len(names), step):
        part = names[i : i + step]
        rows = model.profiles.where(F.col("lang").between(part[0], part[-1])).toArrow()
        number = {name: j for j, name in enumerate(part)}
        out.append(table(part, np.array([number[x] for x in rows["lang"].to_pylist()], np.int64), rows["gram"].to_numpy(), rows["rank"].to_numpy().astype(np.int64)))
    return out


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, column: str = "text") -> DataFrame:
    """The columns of `keep` (doc_id), lang_pred and score, one row per input row. lang_pred: the language from whose profile the document's is least out of place, of equally near ones the first by code point;
    `und`, with score 0, for null texts, texts without a letter, and where nothing was learnt. score: 1 less the distance as a share of the largest one possible.

    Texts of any length are read whole; equal texts get equal results; an empty table gives no rows. Other columns may have any names."""
    spark, p = docs.sparkSession, model.params
    bounded_batches(spark)
    with scope(spark):
        tables = _tables(model)
        out = document_profiles(docs, keep or ["doc_id"], p, column)
        out = out.select("*", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("long").alias("distance"))
        for i, t in enumerate(tables):
            out = _nearest(out, t, p.size)
            if len(tables) > 1:
                out = cut(out, "language-nearest", keep=i + 1 == len(tables))
    known = F.col("letters") & F.col("lang_pred").isNotNull()
    score = 1 - F.col("distance") / (F.size("grams") * p.size)
    return out.select("row.*", F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, score).otherwise(0.0).alias("score"))


def _nearest(rows: DataFrame, t: Table, size: int) -> DataFrame:
    """Puts the nearest language of the table where it is nearer than the one that is there."""
    sent = rows.sparkSession.sparkContext.broadcast(t)

    def near(batches):
        t = sent.value
        for batch in batches:
            langs, least = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, found in enumerate(batch.column(2)):
                d = distances(t, found.values.to_numpy(), size)
                j = int(d.argmin())
                if least[i] is None or d[j] < least[i]:
                    langs[i], least[i] = t.names[j], int(d[j])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(langs, pa.string()), pa.array(least, pa.int64())], batch.schema.names)

    return rows.mapInArrow(near, rows.schema)
