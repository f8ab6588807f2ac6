"""Order MinHash fingerprints (Marçais et al. 2019), with DataFrame functions only.

A text's units are its words, a long word being cut into units of UNIT code points. Each k-mer of units, together with the number of its occurrence in the text, gets a hash. The hash picks one of
`bins` bins (one permutation hashing, Li, Owen and Zhang 2012, so a text is hashed once and not once per signature entry); of each bin the `picks` smallest are selected, put back into
the order in which they stand in the text, and hashed as a tuple: that is the bin's entry. A bin of fewer k-mers takes more from the bins that follow (densification by rotation, Shrivastava and Li 2014),
so that entries of short texts are tuples as well and depend on the order; a bin without any stays empty. Equal entries need the same k-mers in the same order, so likeness follows the edit distance, not only the shared k-mers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, same_row, shuffle_partitions, text_of

UNIT = 16
#: A k-mer is packed into 64 bits: its hash above, its position below. Positions take PLACE bits, or LONG_PLACE in texts of more units (Spark's strings have less than 2^31 bytes, so no text has more).
PLACE, LONG_PLACE = 24, 30
#: Most cells into which ids are dealt in order.
CELLS = 1 << 16


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^\\x20\\x09-\\x0D]{{1,{UNIT}}}"), F.lit(0))


def up(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def down(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def kmers(k: int) -> Column:
    """Per k-mer of the units `__u`: hash (upper bits) and position (the lower `__place` bits). A text of fewer units is one k-mer; one without units has none."""
    bits = F.col("__place")
    whole = F.array(up(F.xxhash64(F.array_join("__u", " ")), bits))
    n = F.size("__u") - k
    each = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: up(F.xxhash64(*[F.get("__u", i + j) for j in range(k)]), bits).bitwiseOR(i.cast("long")))
    return F.when(F.size("__u") == 0, F.array().cast("array<long>")).when(n < 0, whole).otherwise(each)


def with_signature(rows: DataFrame, text: str, name: str, k: int, bins: int, picks: int) -> DataFrame:
    """Adds the column `name`: an array of `bins` entries, null where a bin is empty. All is computed within the row.

    Hashes have 40 bits beside the position, 34 in texts of more than 2^PLACE units; equal texts have equal entries either way."""
    head = lambda x: down(x, F.col("__place"))
    low = up(F.lit(1).cast("long"), F.col("__place")) - 1
    rows = rows.withColumn("__u", units(F.col(text))).withColumn("__place", F.when(F.size("__u") > 1 << PLACE, LONG_PLACE).otherwise(PLACE))
    rows = rows.withColumn("__km", F.sort_array(kmers(k))).drop("__u")
    size = F.size("__km")
    # Runs of equal k-mers stand together once sorted, in the order of their positions: a k-mer's place in its run is the number of its occurrence.
    starts = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: (i == 0) | (head(F.get("__km", i)) != head(F.get("__km", i - 1))))
    rows = rows.withColumn("__runs", F.when(size > 0, starts).otherwise(F.array().cast("array<int>")))
    # The new hash: bin, then the rank within it, then the position. It depends on k-mer and occurrence, not on the position.
    number = lambda x, o: up(F.xxhash64(head(x), o), F.col("__place")).bitwiseOR(x.bitwiseAND(low))
    first = F.transform("__runs", lambda s: number(F.get("__km", s), F.lit(0)))
    # Elements are taken by their places: slice() would copy the whole array for each run.
    after = lambda s, r: F.transform(F.sequence(s + 1, F.coalesce(F.get("__runs", r + 1), size) - 1), lambda i: number(F.get("__km", i), i - s))
    longer = F.filter(F.transform("__runs", lambda s, r: F.when(F.coalesce(F.get("__runs", r + 1), size) - s > 1, F.struct(s.alias("s"), r.alias("r")))), lambda x: x.isNotNull())
    more = F.flatten(F.transform(longer, lambda x: after(x["s"], x["r"])))
    numbered = F.when(F.size("__runs") == size, first).otherwise(F.concat(first, more))
    rows = rows.withColumn("__km", F.sort_array(numbered)).drop("__runs")
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - (bins - 1).bit_length())
    # Sorted as signed numbers, bins come in the order of their signed top bits; each bin's entries stand together, smallest first.
    best = F.filter("__km", lambda x, i: (i < picks) | (bin_of(F.get("__km", i - picks)) != bin_of(x)))
    rows = rows.withColumn("__km", best)
    ends = F.filter(F.transform("__km", lambda x, i: F.when((i == F.size("__km") - 1) | (bin_of(F.get("__km", i + 1)) != bin_of(x)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("__e", ends)

    def entry(i: Column, r: Column) -> Column:
        begin = F.coalesce(F.get("__e", r - 1) + 1, F.lit(0))
        # A bin of fewer k-mers goes on with those of the bins after it, around the end.
        taken = F.transform(F.sequence(F.lit(0), F.least(F.lit(picks), F.size("__km")) - 1), lambda j: F.get("__km", F.pmod(begin + j, F.size("__km"))))
        placed = F.sort_array(F.transform(taken, lambda x: F.struct(x.bitwiseAND(low).alias("p"), head(x).alias("h"))))
        return F.xxhash64(placed["h"])

    rows = rows.withColumns({"__filled": F.transform("__e", lambda i: bin_of(F.get("__km", i))), "__entries": F.transform("__e", entry)})
    spread = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.get("__entries", F.array_position("__filled", b.cast("long")).cast("int") - 1))
    # Where no bin is empty, the upper half, whose signed top bits are negative, stands first.
    turned = F.concat(F.slice("__entries", bins // 2 + 1, bins // 2), F.slice("__entries", 1, bins // 2))
    return rows.withColumn(name, F.when(F.size("__e") == bins, turned).otherwise(spread)).drop("__km", "__e", "__filled", "__entries", "__place")


def likeness(a: str, b: str) -> Column:
    """Equal entries by the bins that either text fills; 1 for two texts without units."""
    both = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    either = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), 1).otherwise(0))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    return F.when(total(either) == 0, F.lit(1.0)).otherwise(total(both) / total(either))


def as_text(signature: str) -> Column:
    """16 hex digits per bin; an empty bin has 16 dashes."""
    return F.array_join(F.transform(signature, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 16, "0"), F.lit("-" * 16))), "")


def neighbours(docs: DataFrame, per_bucket: int = 4000) -> tuple[DataFrame, DataFrame | None]:
    """Deals rows out in buckets of consecutive ids and adds each bucket's next row of the bucket below: columns bucket, ghost (a row that only serves as a neighbour), wrap, __h and __h2 (hashes of the text).

    Buckets lie between quantiles of the ids themselves, so outliers and gaps don't matter; an id (or null) that fills more than one bucket is divided by the hash of the texts. Up to CELLS buckets have
    per_bucket rows, more rows make them larger. Only ids and hashes are read for that, and a number per bucket comes to the driver. Null ids come last; the last document's neighbour is the first.
    Rows that agree in id and text follow each other. Where they would fill a bucket, only one of them is dealt; the others, each of which has its own text as the next, are the second table (None: there are none)."""
    spark = docs.sparkSession
    docs_columns = docs.columns
    docs = docs.withColumns({"__uid": F.monotonically_increasing_id(), "__h": F.xxhash64("text"), "__h2": F.xxhash64(F.lit("again"), "text")})
    ids = cut(docs.select("__uid", "doc_id", "__h", "__h2"), "minhash-ids")
    count, known = ids.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    added = ["__h", "__h2"]
    if not count:
        return docs.select(*docs_columns, *added, F.lit(0).cast("long").alias("bucket"), F.lit(False).alias("ghost"), F.lit(False).alias("wrap")), None
    per_bucket = max(1, min(per_bucket, -(-count // shuffle_partitions(spark))), -(-count // CELLS))
    cells = -(-count // per_bucket)
    # Texts that alone fill a bucket: fewer than there are cells.
    many = ids.groupBy("doc_id", "__h", "__h2").agg(F.count(F.lit(1)).alias("n"), F.max("__uid").alias("stays")).where(F.col("n") > per_bucket)
    many = cut(many.select(F.col("doc_id").alias("many_id"), F.col("__h").alias("many_h"), F.col("__h2").alias("many_h2"), "stays"), "minhash-many")
    same = F.col("doc_id").eqNullSafe(F.col("many_id")) & (F.col("__h") == F.col("many_h")) & (F.col("__h2") == F.col("many_h2"))
    repeated = None
    if not many.isEmpty():
        repeats = lambda rows: rows.join(F.broadcast(many), same & (F.col("__uid") != F.col("stays")), "left_semi")
        others = lambda rows: rows.join(F.broadcast(many), same & (F.col("__uid") != F.col("stays")), "left_anti")
        repeated = repeats(docs).select(*docs_columns, *added)
        docs, ids = others(docs), others(ids)
    cuts: list[int] = []
    if known:
        # An id that is several quantiles gets a cell of its own, from itself to the next number.
        shares = np.arange(1, cells) / cells if cells > 1 else np.array([0.5])
        found = ids.agg(F.percentile_approx("doc_id", F.lit(shares), max(1000, 10 * cells))).first()[0] or []
        cuts = sorted({*found, *(x + 1 for x, y in zip(found, found[1:]) if x == y and x < (1 << 63) - 1)})
    # How many cuts are at or below the id, by halving; 0 is for null.
    limits, steps = F.lit(np.array(cuts or [0], np.int64)), [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(limits, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at)) if cuts else F.lit(0)
    cell = F.when(F.col("doc_id").isNull(), 0).otherwise(below + 1)
    held = ids.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("doc_id") == F.max("doc_id"), F.lit(True)).alias("one")).collect()
    parts = {r.cell: -(-r.n // per_bucket) for r in held if r.one and r.n > 2 * per_bucket}
    part = F.lit(0).cast("long")
    if parts:
        share = (F.shiftright("__h", 33) + (1 << 30)).cast("double") / float(1 << 31)
        wide = F.get(F.lit(np.array([parts.get(c, 1) for c in range(len(cuts) + 2)])), F.col("cell"))
        # Rows of an id go by their hashes downward, so the highest share of them is the lowest bucket.
        part = F.floor(share * wide).cast("long")
    bucket = F.col("cell").cast("long") * CELLS + part
    ids = ids.withColumn("cell", cell).withColumn("bucket", bucket)
    firsts = cut(ids.groupBy("bucket").agg(F.max(F.struct("doc_id", "__h", "__h2", "__uid")).alias("first")).select("bucket", "first.__uid", "first.__h"), "minhash-firsts")
    # The first document of each bucket also stands in the bucket that comes before it (they are counted down), that of the very first bucket in the last one.
    # One row per bucket is ordered in one task.
    order = Window.orderBy(F.desc("bucket"))
    ghosts = firsts.withColumn("to", F.lag("bucket").over(order)).withColumn("last", F.min("bucket").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ghosts = ghosts.select("__uid", F.col("__h").alias("first_h"), F.coalesce("to", "last").alias("to"), F.col("to").isNull().alias("wrap"))
    side = F.broadcast(cut(ghosts, "minhash-ghosts"))  # a row per bucket: at most 2 * CELLS and the parts of ids that fill buckets
    dealt = docs.withColumn("cell", cell).withColumn("bucket", bucket)
    own = F.array(F.struct(F.col("bucket"), F.lit(False).alias("ghost"), F.lit(False).alias("wrap")))
    joined = dealt.join(side, "__uid", "left")
    to = F.when(F.col("to").isNotNull(), same_row(joined, "__h", "first_h", "to"))
    more = F.when(F.col("to").isNull(), own).otherwise(F.concat(own, F.array(F.struct(to.alias("bucket"), F.lit(True).alias("ghost"), F.col("wrap").alias("wrap")))))
    return joined.select(*docs_columns, *added, F.explode(more).alias("m")).select(*docs_columns, *added, "m.*"), repeated


def fingerprints(docs: DataFrame, column: str = "text", k: int = 3, bins: int = 64, picks: int = 2, name: str = "fingerprint") -> DataFrame:
    """Every input row and its fingerprint (text of 16 hex digits per bin). Null counts as empty; texts without words have empty bins only."""
    rows = docs.withColumn("__text", text_of(column))
    return with_signature(rows, "__text", "__sig", k, bins, picks).withColumn(name, as_text("__sig")).drop("__text", "__sig")


def edited(docs: DataFrame, k: int = 3, bins: int = 64, picks: int = 2, column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document's edited text has its last floor(n_chars / 2) code points replaced by as many of the first ones (or all) of the next document by descending doc_id. Rows of the same id follow each
    other by the hash of their texts, downward; null ids come last, and after the last row comes the first. Null texts are empty. A table of one row has itself as the next. No rows give none. Texts of any length are read as a whole, each within a row: one of 16.8 million units took 70 s in a JVM of 20 GB.
    Rows are read twice; where a row that stands in two buckets has another text the second time, it is an error."""
    dealt, repeated = neighbours(docs.select("doc_id", text_of(column).alias("text")))
    # Signatures are made once the texts have met, so that only texts are sent.
    dealt = with_signature(dealt.repartition("bucket"), "text", "sig", k, bins, picks)
    order = Window.partitionBy("bucket").orderBy("wrap", F.col("doc_id").desc_nulls_last(), F.desc("__h"), F.desc("__h2"))
    columns = ["doc_id", "text", "sig", "next_text", "next_sig"]
    dealt = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sig", F.lead("sig").over(order)).where("not ghost").select(columns)
    if repeated:
        repeated = with_signature(repeated, "text", "sig", k, bins, picks)
        dealt = dealt.union(repeated.withColumns({"next_text": F.col("text"), "next_sig": F.col("sig")}).select(columns))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    new = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    out = dealt.select("doc_id", n.cast("long").alias("n_chars"), new.alias("new"), "sig", "next_sig")
    out = with_signature(out, "new", "new_sig", k, bins, picks)
    return out.select("doc_id", "n_chars", F.sha2("new", 256).alias("edited_sha256"), as_text("sig").alias("fingerprint"), as_text("new_sig").alias("edited_fingerprint"), likeness("sig", "new_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
