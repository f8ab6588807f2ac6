"""Judging captured URLs by dated block and allow lists, with DataFrame functions only.

A list's entries carry the date from which they hold. Entries of a key become intervals of validity; each capture takes, from the keys of its host
(the host and its parent domains), the entries that hold at its time, and the most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
FAR = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """The lower-cased host of an absolute URL without a closing dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.$", "")


def month(time: Column) -> Column:
    return F.year(time) * 12 + F.month(time)


def intervals(entries: DataFrame) -> DataFrame:
    """entries: key, since, action ('block', 'allow' or 'remove'). Gives key, action, since, until (not included): an entry holds until the key's next one.
    Entries of the same key and time: block goes before allow, allow before remove. Rows with a null in key, since or action say nothing and are left out; repeated rows count once."""
    entries = entries.where("key is not null and since is not null and action in ('block', 'allow', 'remove')")
    entries = entries.groupBy(F.lower("key").alias("key"), "since").agg(F.min(F.expr("CASE action WHEN 'block' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END")).alias("action"))
    until = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    entries = entries.withColumn("until", F.coalesce(until, F.lit(FAR).cast("timestamp_ntz")))
    return entries.where("action < 2").select("key", F.when(F.col("action") == 0, "block").otherwise("allow").alias("action"), "since", "until")


def judge(captures: DataFrame, entries: DataFrame, keep: list[str], url: str = "url", at: str = "fetched") -> DataFrame:
    """One row per distinct capture: the columns of `keep`, host, n_rows (rows of the input that are this capture), verdict ('block', 'allow' or 'none'),
    list_key and since of the entry that decides.

    Entry and capture meet in a join on key and calendar month: an interval stands once in each month that it touches, so a capture meets the entries of its own
    month only and a host with a third of all captures is spread over months. Of the entries that hold, the longest key decides. URLs without a host
    and captures without a time get 'none'. An empty list gives 'none' to all; no captures, no rows. Extra columns don't matter."""
    keys = F.split(F.col("host"), r"\.")
    c = captures.groupBy(*[F.col(k).alias(f"keep_{k}") for k in keep], host_of(F.col(url)).alias("host"), F.col(at).cast("timestamp_ntz").alias("time")).agg(F.count(F.lit(1)).alias("n_rows"))
    # A parent domain has at least two labels; a host of one label is its own key.
    n = F.greatest(F.size(keys) - 1, F.lit(1))
    c = c.withColumn("key", F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(keys, i, F.size(keys)), ".")))
    named = [x for x in c.columns if x != "key"]
    probes = c.select(*named, F.explode("key").alias("key"), month(F.col("time")).alias("period"))
    spans = intervals(entries)
    # A span ends with the last month that has captures, so open entries don't stand in months to come.
    last = captures.agg(F.max(F.col(at).cast("timestamp_ntz")).alias("last"))
    spans = spans.join(F.broadcast(last), F.col("since") <= F.col("last"))  # one row
    spans = spans.select("key", "action", "since", "until", F.explode(F.sequence(month(F.col("since")), month(F.least("until", "last")))).alias("period"))
    held = probes.join(spans, ["key", "period"], "left").withColumn("holds", F.coalesce((F.col("time") >= F.col("since")) & (F.col("time") < F.col("until")), F.lit(False)))
    best = F.max(F.when(F.col("holds"), F.struct(F.length("key").alias("size"), "key", "action", "since"))).alias("best")
    out = held.groupBy(*named).agg(best)
    return out.select(*[F.col(f"keep_{k}").alias(k) for k in keep], "host", "n_rows", F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.key").alias("list_key"), F.col("best.since").alias("since"))
