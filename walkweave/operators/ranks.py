"""Places in one order over a whole table, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkweave.plans.store import materialise

#: A row's number within its partition, in the numbers that Spark gives: the partition stands in the bits above.
_WITHIN = 33


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank", within: str | None = None) -> DataFrame:
    """Adds each row's place, from 0, in the order of `order` (of `within` first, and counted anew for each value of it, where that is given).

    Two passes: rows are dealt by ranges of the order and numbered in each range, then a range's numbers begin after the rows of those before it, of which there's a row per range. Rows that are equal in `order` meet in one task, so it should tell
    rows apart. The numbered table is written, since ranges come from a sample. An empty table gives no rows."""
    by = [within, *order] if within else list(order)
    place = F.monotonically_increasing_id()
    rows = materialise(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__place", place), "ranks")
    part = F.shiftright("__place", _WITHIN)
    counts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))  # a row per range
    out = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    out = out.withColumn(name, F.col("__start") + F.col("__place").bitwiseAND((1 << _WITHIN) - 1)).drop("__part", "__start", "__place")
    if not within:
        return out
    first = out.groupBy(within).agg(F.min(name).alias("__first"))
    return out.join(first, within).withColumn(name, F.col(name) - F.col("__first")).drop("__first")
