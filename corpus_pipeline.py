"""From raw documents to packed training sequences: what is bad goes, one of each group of copies and near copies stays, sources are mixed, sequences are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkweave.llm import exact_dedup, mixing, ngram_join, packing, quality
from walkweave.llm.common import cut, delete, documents, fold, same_row, scope
from walkweave.llm.queries import tokenizer_files

#: A document goes if the chance that it is good is below this.
GOOD = 0.3
#: Five words and a similarity of 0.8.
NEAR = ngram_join.Params(5, 80, 100)
WEIGHTS, COPIES = [5, 2, 1], 3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labelled rows of `docs` outside the held-out fold."""
    model = quality.fit(docs, documents(spark, sf_dir, "labels"), lambda doc_id: fold(doc_id, 5) != 0)
    return quality.score(docs, model, docs.columns, name="__chance").where(F.col("__chance") >= GOOD).select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.duplicates(docs, docs.columns, prefix="__").where("__kept").select(docs.columns)


def small(ids: DataFrame) -> DataFrame:
    """A table of row numbers, sent to all tasks while it has two million rows at most; a larger one is joined."""
    return F.broadcast(ids) if ids.count() <= 2_000_000 else ids


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one row with the smallest doc_id stays, of several such rows the first. A row without links is its own group, whatever its id."""
    with scope(spark):
        found = ngram_join.classes(docs, NEAR, with_root=True)
        return docs_of(docs, _stays(found), "pipeline-stays")


def _stays(found: DataFrame) -> DataFrame:
    # Null ids come last: a row with one stays if no other of its group has an id.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "uid"))
    stays = found.where("root is not null").groupBy("root").agg(first.alias("first")).select("first.uid", "first.doc_id")
    return stays.union(found.where("root is null").select("uid", "doc_id"))


def docs_of(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The documents of these rows (uid, doc_id, and maybe copies, which is how often each stays)."""
    columns = ["__copies"] * ("copies" in rows.columns)
    rows = rows.select(F.col("uid").alias("__uid"), F.col("doc_id").alias("__was"), *[F.col("copies").alias(c) for c in columns])
    found = docs.withColumn("__uid", F.monotonically_increasing_id()).join(small(cut(rows, name, keep=True)), "__uid")
    return found.withColumn("doc_id", same_row(found, "doc_id", "__was")).select(*docs.columns, *columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    with scope(spark):
        taken = mixing.draw(sized, WEIGHTS, COPIES, 11).where("copies > 0").select("uid", "doc_id", "copies")
        rows = docs_of(docs, taken, "pipeline-taken")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, **tokenizer_files())


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("near duplicates", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: A learnt classifier can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's input and scratch tables go once its output is written; the last stage's input stays, as the result is read from it."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"), keep=True)
        delete(spark, before)
        before = [docs.inputFiles()[0].rpartition("/")[0]] if docs.inputFiles() else []
    return STAGES[-1][1](spark, docs, sf_dir)
