"""The jobs as queries over whole tables, each run twice into one folder, and SQL for the rows that stand there then."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobs import sample_calls, settings, word_graph
from walkweave.plans.store import shared_folder
from walkweave.queries import CTES, TYPED


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _settings(module) -> dict:
    """The settings file beside a job, which is part of the program and so is read where the program is."""
    return settings.parse(Path(module.__file__).with_suffix(".json").read_text(), module.DEFAULTS)


def job1_word_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "word-graph")
    for _ in range(2):
        edges = word_graph.run(spark, f"{sf_dir}/documents.parquet", f"{out}/tables", f"{out}/checkpoint", _settings(word_graph))
    return edges


JOB1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS sample, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT lang, sample, unnest(list_zip(w[:-2], w[2:])) AS e FROM d WHERE len(w) > 1),
c AS (SELECT lang, e[1] AS u, e[2] AS v, count(*) AS weight, count(DISTINCT sample) AS samples FROM p GROUP BY ALL)
SELECT lang, u, v, weight, samples, row_number() OVER (PARTITION BY lang, u ORDER BY weight DESC, v) = 1 AS main FROM c
"""


def job2_sample_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "sample-calls")
    for _ in range(2):
        rows = sample_calls.run(spark, sf_dir, out, _settings(sample_calls))
    return rows


JOB2_SQL = f"""
WITH {", ".join(CTES[c] for c in TYPED)},
t AS (SELECT nation::VARCHAR AS sample, e.idx, e.in_tree, greatest(e.x, e.y) AS k, count(*) AS n FROM canon c JOIN edge e ON c.u = e.u AND c.v = e.v GROUP BY ALL),
g AS (SELECT nation::VARCHAR AS sample, min(least(a.position, b.position)) AS low, max(greatest(a.position, b.position)) AS high FROM pair c JOIN node a ON a.k = uk JOIN node b ON b.k = vk GROUP BY ALL)
SELECT t.sample, NULL::VARCHAR AS hap, t.idx, vtype, pos, ref_len::BIGINT AS ref_len, alt_len::BIGINT AS alt_len, t.n AS alt_count, coalesce(r.n, 0) AS ref_count, low, high
FROM t JOIN typed ON t.idx = typed.idx JOIN g ON t.sample = g.sample LEFT JOIN t r ON r.in_tree AND r.sample = t.sample AND r.k = typed.pv WHERE NOT t.in_tree
"""

QUERIES = {"job1_word_graph": job1_word_graph, "job2_sample_calls": job2_sample_calls}
SQL = {"job1_word_graph": JOB1_SQL, "job2_sample_calls": JOB2_SQL}
