"""Both jobs on copies of tables: two runs over growing input, repeats, crashes, odd rows, settings and the command line."""

import json
import logging
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobs import sample_calls, settings, word_graph

DOCS = "doc_id long, text string, lang string, source string, n_chars long, u string, weight string, batch string"


def rows(n, seed):
    rng = random.Random(seed)
    out = [(i, " ".join(rng.choices(["a", "b", "B", "ç", "d."], k=rng.randrange(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), 0, "x", "y", "z") for i in range(n)]
    return out + [(n, None, "en", "s1", 0, "x", "y", "z"), (n, "one", None, None, 0, "x", "y", "z"), (n, " a\tb b \x0b a ", "01", "s/=2", 0, "x", "y", "z")]


def slow(rows):
    weight, samples, out = Counter(), defaultdict(set), []
    for _, text, lang, source, *_ in rows:
        w = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")
        w = [x for x in w if x]
        for e in zip(w, w[1:], strict=False):
            weight[lang or "", *e] += 1
            samples[lang or "", *e].add(source or "")
    best = {}
    for (lang, u, v), n in weight.items():
        best[lang, u] = min(best.get((lang, u), (0, "")), (-n, v)) if (lang, u) in best else (-n, v)
    for (lang, u, v), n in weight.items():
        out.append((lang, u, v, n, len(samples[lang, u, v]), best[lang, u][1] == v))
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "u", "v", "weight", "samples", "main"]
    return sorted(map(tuple, df.collect()))


def test_word_graph_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs.word_graph")
    docs, out = str(tmp_path / "documents.parquet"), str(tmp_path / "out")
    put = lambda r: spark.createDataFrame(r, DOCS).repartition(2).write.mode("append").parquet(docs)
    first, second = rows(40, 1), rows(30, 2)
    put(first)
    assert found(word_graph.run(spark, docs, out)) == slow(first)
    put(second)
    caplog.clear()
    assert found(word_graph.run(spark, docs, out, None, {"files_per_batch": 1})) == slow(first + second)
    assert f"read {len(second)} new documents" in caplog.text
    counts = spark.read.schema(word_graph.COUNTS).parquet(f"{out}/counts")
    assert counts.agg(F.sum("weight")).first()[0] == sum(r[3] for r in slow(first + second))
    caplog.clear()
    assert found(word_graph.run(spark, docs, out)) == slow(first + second)
    assert "read 0 new documents" in caplog.text


def test_word_graph_deals_no_language_to_one_task(spark):
    """the names of a batch's languages met all counts by a join on the language, so a language's whole graph was one task's."""
    counts = spark.createDataFrame([("en", "s", "a", "b", 1, 0), ("fr", "s", "a", "b", 1, 1)], word_graph.COUNTS)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = word_graph.touched(counts, 1)
        assert "SortMergeJoin" not in one._jdf.queryExecution().executedPlan().toString()
        assert [r["lang"] for r in one.collect()] == ["fr"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_word_graph_partitions_grow_with_the_input(spark, tmp_path, monkeypatch):
    """shuffles had the session's partitions whatever the input's size."""
    docs, out, seen = str(tmp_path / "documents.parquet"), str(tmp_path / "out"), []
    spark.createDataFrame(rows(60, 7), DOCS).write.parquet(docs)
    usual, own = word_graph.graph, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(word_graph, "TEXT", 100)
    monkeypatch.setattr(word_graph, "ROWS", 20)
    monkeypatch.setattr(word_graph, "graph", lambda c: seen.append(int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))) or usual(c))
    assert found(word_graph.run(spark, docs, out)) == slow(rows(60, 7))
    assert seen[0] > int(own) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_word_graph_holds_one_step_on_disk(spark, tmp_path, monkeypatch):
    """the shuffles of a batch's counts, of its edges and of the main ways stood on the disk together."""
    docs, out, seen = str(tmp_path / "documents.parquet"), str(tmp_path / "out"), []
    spark.createDataFrame(rows(30, 8), DOCS).write.parquet(docs)
    usual, key = word_graph.held, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)

    def held(edges):
        seen.append(edges.sparkSession.conf.get(key, None))
        back = usual(edges)
        seen.append("Exchange" in back._jdf.queryExecution().executedPlan().toString())
        return back

    monkeypatch.setattr(word_graph, "held", held)
    assert found(word_graph.run(spark, docs, out)) == slow(rows(30, 8))
    assert seen == ["true", False] and spark.conf.get(key, None) == before
    assert not (tmp_path / "out/work").exists()


def test_word_graph_after_a_crash(spark, tmp_path, monkeypatch):
    """The first micro-batch fails after its counts were written; the next run repeats it."""
    docs, out = str(tmp_path / "documents.parquet"), str(tmp_path / "out")
    spark.createDataFrame(rows(20, 3), DOCS).write.parquet(docs)
    with monkeypatch.context() as m:
        m.setattr(word_graph, "graph", lambda counts: counts.select(F.raise_error(F.lit("lost")).alias("u")))
        with pytest.raises(Exception):  # noqa: B017
            word_graph.run(spark, docs, out)
    assert found(word_graph.run(spark, docs, out)) == slow(rows(20, 3))


def test_word_graph_of_an_empty_table(spark, tmp_path):
    docs = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(docs)
    assert found(word_graph.run(spark, docs, str(tmp_path / "out"))) == []


def test_word_graph_of_one_file(spark, tmp_path):
    """Files are often tables of their own; one that isn't named in full is no other's."""
    spark.createDataFrame(rows(20, 5), DOCS).coalesce(1).write.parquet(str(tmp_path / "t"))
    part = next((tmp_path / "t").glob("part*"))
    part.rename(tmp_path / "documents.parquet")
    (tmp_path / "documents.parquet2").write_text("no table")
    for _ in range(2):
        assert found(word_graph.run(spark, str(tmp_path / "documents.parquet"), str(tmp_path / "out"))) == slow(rows(20, 5))


def test_settings(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"least": 3}))
    assert settings.read(spark, str(path), sample_calls.DEFAULTS) == {"by": "sample", "least": 3}
    assert settings.read(spark, None, sample_calls.DEFAULTS) == sample_calls.DEFAULTS
    path.write_text(json.dumps({"most": 3}))
    with pytest.raises(ValueError, match="unknown settings: most"):
        settings.read(spark, str(path), sample_calls.DEFAULTS)
    for module in (word_graph, sample_calls):
        assert settings.read(spark, module.__file__.replace(".py", ".json"), module.DEFAULTS) == module.DEFAULTS
    with pytest.raises(ValueError, match="by is"):
        sample_calls.run(spark, str(tmp_path), str(tmp_path), {"by": "walk"})


def test_sample_calls_rerun_and_grow(spark, tmp_path):
    sf, out = "/root/testdata/sf0.001", str(tmp_path / "out")
    for name in ("part", "customer", "lineitem"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"in/{name}.parquet"))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.where("o_orderkey % 2 = 0").write.parquet(str(tmp_path / "in/orders.parquet"))
    state = lambda df: sorted(map(str, df.collect()))
    once = state(sample_calls.run(spark, str(tmp_path / "in"), out))
    assert once and state(sample_calls.run(spark, str(tmp_path / "in"), out)) == once
    orders.where("o_orderkey % 2 = 1").write.mode("append").parquet(str(tmp_path / "in/orders.parquet"))
    grown = sample_calls.run(spark, str(tmp_path / "in"), out)
    assert state(grown) == state(sample_calls.run(spark, sf, str(tmp_path / "other")))
    assert len(state(grown)) > len(once)
    haps = sample_calls.run(spark, sf, str(tmp_path / "haps"), {"by": "hap", "least": 1})
    by_sample = haps.groupBy("sample", "idx").agg(F.sum("alt_count").alias("alt_count"))
    assert state(by_sample) == state(grown.select("sample", "idx", "alt_count"))
    assert haps.where("hap is null or low > high").isEmpty()
    twice = sample_calls.run(spark, sf, str(tmp_path / "twice"), {"least": 2})
    assert state(twice) == state(grown.where("alt_count >= 2"))


def test_command_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    docs = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows(5, 4), DOCS).write.parquet(docs)
    word_graph.main([docs, str(tmp_path / "a"), "--checkpoint", str(tmp_path / "mark"), "--config", word_graph.__file__.replace(".py", ".json")])
    assert found(word_graph.edges_of(spark, str(tmp_path / "a"))) == slow(rows(5, 4))
    assert (tmp_path / "mark").exists() and not (tmp_path / "a/checkpoint").exists()
    sample_calls.main(["/root/testdata/sf0.001", str(tmp_path / "b"), "--config", sample_calls.__file__.replace(".py", ".json")])
    assert spark.read.schema(sample_calls.CALLS).parquet(str(tmp_path / "b/calls")).count() > 0
