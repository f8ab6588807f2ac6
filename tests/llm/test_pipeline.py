"""The pipeline's stages take effect and keep the columns of documents."""

import re

import duckdb
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from walkweave.llm import exact_dedup, ngram_join
from walkweave.llm.common import cut
from walkweave.llm.queries import OP10_SQL

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = P.documents(spark, SF)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name == "exact dedup":
            assert exact_dedup.duplicates(docs).where("not kept").isEmpty()
        if name == "near duplicates":
            assert ngram_join.classes(docs, P.NEAR).where("doc_id <> component_id").isEmpty()
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_labelled_good_documents_stay(spark):
    docs = P.documents(spark, SF)
    labels = P.documents(spark, SF, "labels")
    kept = P.good_quality(spark, docs, SF)
    good = labels.where("quality = 1").join(docs, "doc_id")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.05 * good.count()


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (None, None, None, "s", 3), (2, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1), (None, "x y z x y z", None, None, None), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("uid", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("copy", F.lit("clash"))
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert P.without_near_copies(spark, P.without_copies(spark, docs, SF), SF).where("text is not null and text <> ''").count() == 2
    assert P.STAGES[-1][1](spark, docs, SF).count() == len(rows)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_copies_go_by_their_group_and_not_by_its_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a), (7, b), (8, b + " end"), (None, c), (None, c + " end"), (9, ""), (9, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept = [tuple(r) for r in P.without_near_copies(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([(7, a), (7, b), (None, c), (9, ""), (9, None), (None, "")], key=str)


def test_run_is_the_same_as_brute_force(spark):
    """The classifier's decisions are given; groups, the kept ids, copies (by the SQL of the mix) and packed ids are worked out anew."""
    good = sorted(P.good_quality(spark, P.documents(spark, SF), SF).collect(), key=lambda r: r.doc_id)
    rows = list({r.text or "": r for r in good}.values())  # of equal texts the largest id
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) * 100 >= 80 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    stays = [min((r for r, h in zip(rows, group, strict=True) if h == g), key=lambda r: r.doc_id) for g in set(group)]
    assert len(stays) < len(rows) < len(good)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in stays])
    copies = dict(con.execute(f"SELECT doc_id, copies FROM ({OP10_SQL}) WHERE copies > 0").fetchall())
    whole = Tokenizer.from_file(P.tokenizer_files()["tokenizer"])
    want = {r.doc_id: (copies[r.doc_id] * (len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1), copies[r.doc_id]) for r in stays if r.doc_id in copies}
    out = P.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum((F.col("start") == 0).cast("int")).alias("copies")).collect()
    assert {r.doc_id: (r.n, r.copies) for r in out} == want
