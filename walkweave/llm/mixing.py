"""Mixing sources to target weights by Pareto order sampling (Rosén 1997), with DataFrame functions only.

A source is to give so many words. Each of its documents is expected in so many copies e: in proportion to EVEN + floor(log2(size)), so that longer documents are likelier, and in no more
than the most copies allowed; a source's words by e are its target. floor(e) copies are certain, and one more is drawn with inclusion probability e - floor(e). Documents are ranked by the odds of a uniform number over the odds of inclusion, and the draw goes down the ranks
until the source's words are reached, so its size is fixed. Where the draw ends is found from histograms of the ranks' digits: no source is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scope, text_of

#: The draw's number has 48 bits; each pass over a histogram settles so many of them.
BITS, DIGIT = 48, 12
#: What a document of one word weighs; each doubling of the size adds 1.
EVEN = 8


def word_count(col: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: list[int], copies: int) -> DataFrame:
    """sizes: one row per source (source, source_size). Adds target: the sources in order of code point, null last, weigh `weights` over and over and share all words;
    none has more than `copies` times its size, and the excess is shared by weight until none is above. This is target = min(copies * size, level * weight)
    for one level, which is found along the sources in order of cap by weight. One row per source is sorted here."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*map(F.lit, weights))
    s = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * copies)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    # With all sources before this one capped, the others' level:
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # It rises while sources are capped rightly and falls once one is that shouldn't be: the highest is the level sought.
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: list[int] = [5, 2, 1], copies: int = 3, seed: int = 11, column: str = "text", keep: list[str] | None = None) -> DataFrame:  # noqa: B006
    """One row per input row: the columns of `keep` (doc_id), source, size, source_size, target, expected (copies, as the inclusion probabilities have it),
    copies (times that the mix takes the document) and taken (size times copies).

    Null texts and texts without words have size 0 and are never taken; a null source is a source of its own. A draw's number is a hash of doc_id and seed: reruns agree,
    and rows that repeat an id are drawn alike. In each source the draw takes ranks until another one would move the words taken away from the target.
    An empty table gives no rows. What is shuffled: ids, sources and sizes, never texts."""
    keep = keep or ["doc_id"]
    return draw(docs.select(*keep, "source", word_count(text_of(column)).alias("size")), weights, copies, seed)


def levels(classes: DataFrame, copies: int) -> DataFrame:
    """classes: source, target, weight, words (of a source's documents of that weight). Gives source, level, need: a document is expected in min(copies, level * weight) copies, which adds up
    to the target in words; need: the words that certain copies leave to be drawn. A source has at most 64 weights; they are sorted here."""
    heavier = Window.partitionBy("source").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    weighed = F.col("weight") * F.col("words")
    # With all heavier documents in as many copies as may be; the highest is the level sought, as in targets().
    level = (F.col("target") - F.coalesce(F.sum("words").over(heavier), F.lit(0)) * copies) / (F.sum(weighed).over(whole) - F.coalesce(F.sum(weighed).over(heavier), F.lit(0)))
    found = classes.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    certain = F.floor(F.least(F.lit(float(copies)), F.col("level") * F.col("weight")) + 1e-12).cast("long")
    return found.groupBy("source").agg(F.max("level").alias("level"), (F.max("target") - F.sum(certain * F.col("words"))).alias("need"))


def draw(sized: DataFrame, weights: list[int], copies: int, seed: int) -> DataFrame:
    """sized: doc_id, source, size and any other columns."""
    with scope(sized.sparkSession):
        return _draw(sized, weights, copies, seed)


def _draw(sized: DataFrame, weights: list[int], copies: int, seed: int) -> DataFrame:
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    sized = cut(sized, "mixing-sizes")
    weight = lambda size: F.length(F.bin(size)) - 1 + EVEN
    sums = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, copies), "mixing-targets")
    by_weight = sized.where("size > 0").groupBy("source", weight(F.col("size")).alias("weight")).agg(F.sum("size").alias("words"))
    own = levels(by_weight.alias("c").join(sums.alias("s"), same("c", "s")).select("c.*", "s.target"), copies)
    sums = cut(sums.alias("s").join(own.alias("o"), same("s", "o"), "left").select("s.*", "o.level", "o.need"), "mixing-levels")
    # sums has a row per source. It joins as it is; Spark sends it to all tasks only if its size is below the session's limit.
    expected = F.least(F.lit(float(copies)), F.col("level") * weight(F.col("size")))
    certain = F.floor(expected + 1e-12).cast("long")
    chance = F.greatest(expected - certain, F.lit(0.0))
    uniform = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << BITS)
    rows = sized.alias("d").join(sums.alias("s"), same("d", "s")).select("d.*", "s.source_size", "s.target", "s.level")
    rows = rows.withColumn("expected", F.when(F.col("size") > 0, expected).otherwise(0.0)).withColumn("certain", F.when(F.col("size") > 0, certain).otherwise(0))
    rows = rows.withColumn("chance", F.when(F.col("size") > 0, chance).otherwise(0.0)).withColumn("uniform", uniform)
    # Pareto rank: odds of the uniform number by odds of inclusion, brought to 0..1 (x / (1 + x)) and cut into digits.
    drawn = (F.col("chance") > 0) & (F.col("chance") < 1)
    rows = rows.withColumn("odds", F.when(drawn, (F.col("uniform") / (1 - F.col("uniform"))) / (F.col("chance") / (1 - F.col("chance")))))
    rank = F.least(F.floor(F.col("odds") / (1 + F.col("odds")) * float(1 << BITS)).cast("long"), F.lit((1 << BITS) - 1))
    rows = rows.withColumn("rank", F.when(drawn, rank)).drop("level", "uniform", "odds", "chance")
    rows = cut(rows, "mixing-ranks", keep=True)
    # After each pass, prefix: the first digits of the rank at which the draw ends; need: words still to be drawn among the ranks that begin so; there: all their words.
    end = sums.select("source", "need", F.lit(0).cast("long").alias("prefix"))
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        digits = F.shiftright("d.rank", shift)
        here = rows.where("rank is not null").alias("d").join(end.alias("n"), same("d", "n") & (F.shiftright("d.rank", shift + DIGIT) == F.col("n.prefix")))
        bins = here.groupBy(F.col("d.source").alias("source"), digits.alias("bin")).agg(F.sum("d.size").alias("there"), F.max("n.need").alias("need"))
        earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 2^DIGIT bins of a source at most
        bins = bins.withColumn("need", F.col("need") - F.coalesce(F.sum("there").over(earlier), F.lit(0))).where("need >= 0")
        last = bins.groupBy("source").agg(F.max(F.struct("bin", "need", "there")).alias("last"))
        end = cut(last.select("source", "last.need", F.col("last.bin").alias("prefix"), "last.there"), "mixing-end", keep=not shift)
    out = rows.alias("d").join(end.alias("n"), same("d", "n"), "left")
    # Rows of the last rank are taken if that brings the words nearer to the target.
    extra = F.when((F.col("d.rank") < F.col("n.prefix")) | ((F.col("d.rank") == F.col("n.prefix")) & (F.col("n.need") * 2 >= F.col("n.there"))), 1).otherwise(0)
    out = out.withColumn("copies", (F.col("d.certain") + extra).cast("long"))
    return out.select(*[f"d.{c}" for c in sized.columns], "d.source_size", "d.target", "d.expected", "copies", (F.col("copies") * F.col("d.size")).alias("taken"))
