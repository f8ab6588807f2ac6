"""Source divergence audit: how each source's use of words differs from the other sources of its language and from the language as a whole. Relational only: terms are exploded, counted, made dense
over the kept vocabulary, joined with themselves by language and term, summed and ranked. Plain DataFrame functions, exact integer arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, scope, shuffle_partitions, text_of

#: Terms are runs of ASCII letters and of all characters from U+0080 on; these stand between them.
BETWEEN = "".join(map(chr, (*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))


@dataclass(frozen=True)
class Params:
    documents: int = 30  #: documents of a language in which a kept term stands
    smoothing: int = 5  #: what each count gets added
    unit: int = 1_000_000_000  #: by how much shares are multiplied before they are rounded down
    top: int = 50  #: ranks of terms that are returned


def term_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with the term). A row's terms are sorted, so that each one's first occurrence shows by its neighbour and one shuffle counts both; it carries a row per term and task."""
    # One pass of translate() lower-cases and makes all that stands between terms spaces, so the split needs no pattern; that had taken about two fifths of the counting. Empty pieces sort first and are left out as rows.
    terms = F.sort_array(F.split(F.translate(text_of(column), UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " "))
    pairs = F.arrays_zip(terms.alias("term"), F.concat(F.array(F.lit("")), terms).alias("before"))
    rows = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), F.inline(pairs).alias("term", "before")).where("term <> ''")
    return rows.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("term") != F.col("before")).alias("docs"))


def share(count: Column, total: Column, kept: Column, p: Params) -> Column:
    """1 + floor(unit * (count + smoothing) / (total + smoothing * kept)). Decimals, since the product leaves 64 bits for counts of some billions."""
    wide = lambda c: c.cast("decimal(20,0)")
    above, below = wide(count + p.smoothing) * F.lit(p.unit).cast("decimal(11,0)"), wide(total + kept * p.smoothing)
    return F.call_function("div", above, below) + 1


def audit(docs: DataFrame, p: Params = Params(), column: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank. `pair`: item is another source of the language and value the absolute differences of both sources' shares, summed over the kept terms (0 without any);
    `term`: item is a kept term that the source uses more than its language does, value the difference of the shares, and only the first p.top ranks are returned.

    Null texts, langs and sources count as ''; a group (lang, source) without terms has the smoothed shares. Texts of any length are read whole. Rows that repeat count again.
    Equal values are ranked by item (UTF-8 order). An empty table gives no rows. Only lang, source and the text are read, so other columns may have any names."""
    with scope(docs.sparkSession):
        return _audit(docs, p, column)


def _audit(docs: DataFrame, p: Params, column: str) -> DataFrame:
    counts = cut(term_counts(docs, column), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= p.documents).drop("docs")
    kept = cut(kept, "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    used = counts.join(kept, ["lang", "term"])
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    none = F.lit(0).cast("long")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = cut(groups, "divergence-groups")
    # A language may hold most terms, so its terms are dealt over salts and its groups, a row each, stand once in every salt.
    salts = shuffle_partitions(docs.sparkSession)
    terms = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    spread = groups.where("v > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dense = terms.join(spread, ["lang", "salt"]).drop("salt").join(counts.drop("docs"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", none))
    dense = dense.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("v"), p).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v"), p).alias("q"))
    dense = cut(dense, "divergence-shares")
    # Differences are the same both ways, so each pair of sources is met once.
    a, b = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    apart = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    names = groups.select("lang", "source")
    pairs = names.join(names.withColumnRenamed("source", "item"), "lang").where("source < item").join(apart, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", none))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    more = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    # The bound stands right above the window, so tasks drop what can't be among the first before terms are shuffled.
    first = more.withColumn("rank", place).where(F.col("rank") <= p.top)
    return cut(pairs.withColumn("rank", place).unionByName(first), "divergence", keep=True)
