"""Keeps the sequence graph of a growing table of documents up to date: words are segments, documents walks, languages graphs.

An edge is a pair of neighbouring words. It has its weight (times that walks take it), the number of samples (sources) whose walks take it, and whether it's the main way on from its first word: the heaviest, of equal ones the
first by name. All other edges are variants of a language's wording, as a graph's edges outside its reference tree are.

    python -m jobs.word_graph DOCUMENTS OUT [--checkpoint FOLDER] [--config FILE]

DOCUMENTS is a Parquet table, read as a stream of files up to what is there now; the checkpoint knows which files were taken, so a run takes only new ones. OUT gets two tables, by explicit path:
`counts` (partitioned by batch: what each micro-batch adds, a row per language, sample and edge) and `edges` (partitioned by language). A micro-batch overwrites its own part of `counts` and then the languages that it touches in
`edges`, which it sums from all counts up to its own. So a batch that Spark repeats after a crash leaves what it would have left, and a run without new files changes nothing. OUT and its checkpoint belong together.
"""

from __future__ import annotations

import argparse
import logging
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from walkweave.plans.build import walk_pairs
from walkweave.plans.store import delete, tidy

log = logging.getLogger("jobs.word_graph")
#: language, sample: columns of the documents that name a graph and a walk's sample. files_per_batch: files that a micro-batch takes at most; all are taken in the end.
DEFAULTS = {"language": "lang", "sample": "source", "files_per_batch": 200}
#: What stands between words, beside spaces.
BLANKS = "\t\n\x0b\x0c\r"
#: Bytes of texts and rows of counts that a partition takes at most, on average: partitions grow with the input, so a task's memory doesn't.
TEXT, ROWS = 16 << 20, 1 << 20
COUNTS = "lang string, sample string, u string, v string, weight long, batch long"
EDGES = "u string, v string, weight long, samples long, main boolean, lang string"


@contextmanager
def sized(spark: SparkSession, size: int, each: int):
    """Shuffles inside get a partition for every `each` of the size, at least as many as the session's; Spark joins those that turn out small. Gives their number; the session's settings come back."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))
    changed = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.enabled": "true"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        yield parts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def counted(documents: DataFrame, language: str, sample: str) -> DataFrame:
    """lang, sample, u, v, weight. Nulls count as ''; texts of fewer than two words have no edge. Tasks add up what they read before they shuffle, so a frequent pair is a row per task."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text("text"), BLANKS, " " * len(BLANKS)), " "), "")
    walks = documents.select(text(language).alias("lang"), text(sample).alias("sample"), words.alias("steps"))
    return walk_pairs(walks, "lang", "sample").groupBy("lang", "sample", "u", "v").agg(F.count(F.lit(1)).alias("weight"))


def touched(counts: DataFrame, number: int) -> DataFrame:
    """The counts of the languages that a batch touches. Their names, a row each, go to the tasks: dealt by language, a language would be one task's."""
    return counts.join(F.broadcast(counts.where(F.col("batch") == number).select("lang").distinct()), "lang", "left_semi")


#: The folder of the table that a batch writes on its way.
_WORK: ContextVar[str | None] = ContextVar("word_graph_work", default=None)


@contextmanager
def working(spark: SparkSession, path: str):
    """What held() writes inside goes in the end; what a crash left is overwritten."""
    token = _WORK.set(path)
    try:
        yield
    finally:
        _WORK.reset(token)
        delete(spark, [path])


def held(rows: DataFrame) -> DataFrame:
    """Written and read again within working(), so that the shuffles before it are gone when those after it begin."""
    if (path := _WORK.get()) is None:
        return rows
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def graph(counts: DataFrame) -> DataFrame:
    """The edges of all counts: columns of EDGES."""
    # An edge has a row per sample and batch, so rows are dealt once, by edge, for both sums.
    edges = counts.repartition("lang", "u", "v").groupBy("lang", "sample", "u", "v").agg(F.sum("weight").alias("weight")).groupBy("lang", "u", "v").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("samples"))
    edges = held(edges)
    # A frequent word has many ways on. The best is found by partial maxima, and the comparison is a join with one row per word, which Spark may split.
    best = edges.groupBy("lang", "u").agg(F.min(F.struct((-F.col("weight")).alias("w"), "v"))["v"].alias("best"))
    return edges.join(best, ["lang", "u"]).select("u", "v", "weight", "samples", (F.col("v") == F.col("best")).alias("main"), "lang")


def edges_of(spark: SparkSession, out: str) -> DataFrame:
    """The table as it stands. A language of '' has Spark's name for null as its folder and reads as ''."""
    found = spark.read.schema(EDGES).parquet(f"{out}/edges")
    return found.withColumn("lang", F.coalesce("lang", F.lit(""))).select("lang", "u", "v", "weight", "samples", "main")


def streamed(documents: str, files: list[str]) -> str:
    """The path to stream from. Streams take a folder or a pattern, so a table that is one file is named by a pattern that only it matches."""
    folder, slash, name = documents.rstrip("/").rpartition("/")
    return f"{folder}{slash}{{{name}}}" if len(files) == 1 and files[0].rpartition("/")[2] == name else documents


def run(spark: SparkSession, documents: str, out: str, checkpoint: str | None = None, options: dict | None = None) -> DataFrame:
    """Takes what is new and returns the whole table of edges: lang, u, v, weight, samples, main."""
    o = DEFAULTS | (options or {})
    columns = [o["language"], o["sample"], "text"]
    table = spark.read.parquet(documents).select(*dict.fromkeys(columns))
    spark.createDataFrame([], EDGES).write.mode("append").partitionBy("lang").parquet(f"{out}/edges")  # so that there is a table without documents, too

    read: list[int] = []

    def add(batch: DataFrame, number: int) -> None:
        with tidy(batch.sparkSession):  # the stream's own; a batch's shuffles are several times its size, so they go one by one
            added(batch, number)

    def added(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows, size = batch.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
        read.append(rows)
        with sized(session, size, TEXT) as parts:
            # Files may be large, so texts are dealt before their pairs are counted.
            own = counted(batch.repartition(parts) if size > TEXT else batch, o["language"], o["sample"])
            own.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/counts/batch={number}")
        counts = session.read.schema(COUNTS).parquet(f"{out}/counts").where(F.col("batch") <= number)
        with sized(session, counts.count(), ROWS), working(session, f"{out}/work"):
            graph(touched(counts, number)).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(f"{out}/edges")
        of_batch = counts.where(F.col("batch") == number)
        log.info("batch %d: read %d documents, wrote %d rows of counts, %d languages of edges", number, read[-1], of_batch.count(), of_batch.select("lang").distinct().count())

    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", o["files_per_batch"]).parquet(streamed(documents, table.inputFiles()))
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint or f"{out}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    edges = edges_of(spark, out)
    log.info("read %d new documents of %s in %d batches; %s has %d edges", sum(read), documents, len(read), f"{out}/edges", edges.count())
    return edges


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.word_graph", description="Keeps the word graph of a growing table of documents up to date.")
    parser.add_argument("documents", help="a Parquet table with text and the columns that the settings name")
    parser.add_argument("out", help="the folder of the tables counts and edges")
    parser.add_argument("--checkpoint", help="the folder that knows which files were taken (OUT/checkpoint)")
    parser.add_argument("--config", help="a JSON file of settings, such as jobs/word_graph.json")
    a = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("word-graph").getOrCreate()
    try:
        run(spark, a.documents, a.out, a.checkpoint, settings.read(spark, a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
