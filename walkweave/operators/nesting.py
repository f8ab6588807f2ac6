"""How bubbles stand inside each other, and their order along the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkweave.operators.ranks import global_rank
from walkweave.operators.trees import tour
from walkweave.plans.store import materialise, scope

#: Values of a block, and blocks of a block above.
BLOCK = 256


def nesting(bubbles: DataFrame, block: int = BLOCK) -> DataFrame:
    """bubbles: bubble (each once), start, end. Gives bubble, place (from 0: by start, longer ones first, then name), parent and level (0 outermost). parent: of the bubbles that hold both ends, or are as long and come earlier by name, the one that stands
    last before it; null where none does. Bubbles that merely overlap aren't nested.

    In this order, a bubble's parent is the nearest one before it that ends no earlier: found by maxima of blocks and blocks of blocks, so neither the depth of a nest nor the number of bubbles over a place matters. Levels are the depths of the tree that
    the parents make."""
    with scope(bubbles.sparkSession):
        placed = materialise(global_rank(bubbles.select("bubble", "start", "end"), ["start", F.desc("end"), "bubble"], "place"), "nesting")
        over = previous_at_least(placed.select(F.col("place").alias("at"), F.col("end").alias("value")), block)
        names = placed.select(F.col("place").alias("found"), F.col("bubble").alias("parent"))
        nested = placed.join(over, placed["place"] == over["at"], "left").join(names, "found", "left").select("bubble", "place", "parent")
        nested = materialise(nested, "nesting")
        depth = tour(nested.select(F.lit("").alias("graph_id"), F.col("bubble").alias("node"), "parent")).select(F.col("node").alias("bubble"), F.col("depth").alias("level"))
        return materialise(nested.join(depth, "bubble").select("bubble", "place", "parent", "level"), "nested", keep=True)


def previous_at_least(values: DataFrame, block: int = BLOCK) -> DataFrame:
    """values: at (each of 0 to n - 1 once), value. Gives at and found, the nearest place before it with a value no smaller; only where there is one.

    A search first looks through its own block, then through the maxima of the blocks before it, level by level, and comes down again in the block that it finds: two joins a level, with a row per block of values."""
    levels, level, n = [], values.select("at", F.col("value").alias("v")), values.count()
    while True:
        rows = level.groupBy(F.expr(f"at div {block}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("x"))  # a block's values and no more
        rows = materialise(rows.select("b", F.transform("x", lambda x: x["v"]).alias("x")), "nesting-blocks")
        levels.append(rows)
        if n <= block:
            break
        level, n = rows.select(F.col("b").alias("at"), F.array_max("x").alias("v")), -(-n // block)
    # The last place of the first `size` values of the block that is no smaller.
    last = F.array_max(F.transform(F.slice("x", 1, F.col("size")), lambda v, i: F.when(v >= F.col("value"), i)))
    seek, found = values.select("at", "value", F.col("at").alias("here")), None
    for k, rows in enumerate(levels):
        here = seek.withColumns({"b": F.expr(f"here div {block}"), "size": (F.col("here") % block).cast("int")})
        met = here.join(rows, "b").withColumn("last", last)
        met = materialise(met.select("at", "value", "b", (F.col("b") * block + F.col("last")).alias("place")), "nesting-seek")
        hit = met.where("place is not null").select("at", "value", "place", F.lit(k).alias("k"))
        found = hit if found is None else found.union(hit)
        seek = met.where("place is null and b > 0").select("at", "value", F.col("b").alias("here"))
    for k in reversed(range(len(levels) - 1)):
        down = found.where(F.col("k") > k).withColumns({"b": F.col("place"), "size": F.lit(block)}).join(levels[k], "b").withColumn("last", last)
        found = materialise(found.where(F.col("k") <= k).unionByName(down.select("at", "value", (F.col("b") * block + F.col("last")).alias("place"), F.lit(k).alias("k"))), "nesting-found")
    return found.select("at", F.col("place").alias("found"))
