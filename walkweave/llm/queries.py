"""The queries of the text operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, language_id, mixing, ngram_join, order_minhash, packing, quality, recurrent_lm, substring_dedup, toxicity, url_lists
from .common import documents, fold


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def not_in_fold(n: int, rest: int) -> Callable[[Column], Column]:
    return lambda doc_id: fold(doc_id, n) != rest


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"), not_in_fold(4, 2))
    out = toxicity.score(docs, model)
    passages = F.array_join(F.transform("passages", lambda p: F.concat_ws("-", p["start"].cast("string"), p["end"].cast("string"))), ",")
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_tokens", F.size("passages").alias("n_passages"), passages.alias("passages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), **tokenizer_files())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, documents(spark, sf_dir, "labels"), not_in_fold(5, 0))
    out = quality.score(docs, model, ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited(documents(spark, sf_dir))


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = recurrent_lm.fit(docs, not_in_fold(7, 2))
    return recurrent_lm.score(docs, model, fold(F.col("doc_id"), 7) == 2)


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of `pages`, by rule: a host's checksum tells whether and when it is blocked, let off and blocked again; parent domains and `www` hosts too."""
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("key")).where("key != ''").distinct()
    labels = F.split("key", r"\.")
    parents = hosts.where(F.size(labels) > 2).select(F.array_join(F.slice(labels, 2, F.size(labels)), ".").alias("key"))
    number = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("int")
    keys = hosts.union(parents).distinct().withColumn("number", number).where("number % 5 < 3")
    step = lambda base, i: F.expr(f"timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(number % {base} + {i} * (number % 37 + 20), number % 24, 0, 0)")
    entries = F.array(
        F.struct(step(90, 0).alias("since"), F.when(F.col("number") % 7 == 0, "allow").otherwise("block").alias("action")),
        F.struct(step(90, 1).alias("since"), F.lit("remove").alias("action")),
        F.struct(step(90, 3).alias("since"), F.when(F.col("number") % 3 == 0, "allow").otherwise("block").alias("action")),
    )
    return keys.select("key", F.explode(entries).alias("e")).select("key", "e.since", "e.action")


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` has no time of fetching, so it is set by rule: hour page_id * 7 of the year 2024, over and over."""
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(page_id * 7 % 8784 as int), 0, 0)")
    return url_lists.judge(pages.withColumn("fetched", fetched), list_entries(pages), ["page_id", "url", "fetched"])


OP6_SQL = r"""
WITH p AS (SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_hours((page_id * 7 % 8784)::INT) AS fetched,
                  regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', '') AS host FROM pages),
h AS (SELECT DISTINCT host AS key FROM p WHERE host <> ''),
k AS (SELECT key FROM h UNION SELECT array_to_string(string_split(key, '.')[2:], '.') FROM h WHERE len(string_split(key, '.')) > 2),
m AS (SELECT key, ('0x' || substr(md5(key), 1, 6))::INT AS number FROM k),
e AS (SELECT key, TIMESTAMP '2024-01-01 00:00:00' + to_days(number % 90 + i * (number % 37 + 20)) + to_hours(number % 24) AS since,
             CASE i WHEN 0 THEN CASE WHEN number % 7 = 0 THEN 1 ELSE 0 END WHEN 1 THEN 2 ELSE CASE WHEN number % 3 = 0 THEN 1 ELSE 0 END END AS action
      FROM m, (VALUES (0), (1), (3)) t(i) WHERE number % 5 < 3),
v AS (SELECT key, action, since, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM e),
c AS (SELECT page_id, url, fetched, host, count(*) AS n_rows FROM p GROUP BY ALL),
x AS (SELECT c.*, unnest(CASE WHEN len(string_split(host, '.')) < 2 THEN [host] ELSE list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END) AS key FROM c),
j AS (SELECT x.page_id, x.url, x.fetched, x.host, x.n_rows, v.key AS list_key, v.action, v.since,
             row_number() OVER (PARTITION BY x.page_id, x.url, x.fetched ORDER BY length(v.key) DESC NULLS LAST) AS r
      FROM x LEFT JOIN v ON x.key = v.key AND v.action < 2 AND x.fetched >= v.since AND (v.until IS NULL OR x.fetched < v.until))
SELECT page_id, url, fetched, host, n_rows, CASE action WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS verdict, list_key, since FROM j WHERE r = 1
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, sf_dir))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir), ngram_join.Params(4, 85, 100)).drop("uid")


#: Words of each document, lower-cased in A-Z or as they are.
WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
e AS (SELECT r, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING count(*) * 100 >= 85 * (a.n + b.n - count(*))),
k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(r, t) AS (SELECT r, r FROM s UNION SELECT c.r, k.b FROM c JOIN k ON c.t = k.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(d.doc_id) AS component_id FROM c JOIN s ON s.r = c.r JOIN s d ON d.r = c.t GROUP BY s.r, s.doc_id, len(s.s)
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated(documents(spark, sf_dir)).drop("uid", "spans")


OP9_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
x0 AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w),
x AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM x0),
f AS (SELECT g, min(doc_id) AS m FROM x GROUP BY g),
h AS (SELECT r, i FROM x JOIN f ON x.g = f.g WHERE m < doc_id),
c AS (SELECT DISTINCT r, i + j AS p FROM h, range(13) t(j)),
u AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM w),
k AS (SELECT u.r, string_agg(t, ' ' ORDER BY u.p) AS kept, count(*) AS n FROM u LEFT JOIN c ON u.r = c.r AND u.p = c.p WHERE c.r IS NULL GROUP BY u.r)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.r = k.r
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir), [5, 2, 1], 3)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
       FROM s1 WINDOW w AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(level) OVER () AS top FROM s2),
s AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap::DOUBLE, top * weight) END AS target FROM s3),
k AS (SELECT d.source, length(bin(size)) + 7 AS weight, sum(size)::BIGINT AS words, max(target) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source WHERE size > 0 GROUP BY 1, 2),
k1 AS (SELECT *, (target - coalesce(sum(words) OVER w, 0)::DOUBLE * 3) / (sum(weight * words) OVER (PARTITION BY source) - coalesce(sum(weight * words) OVER w, 0))::DOUBLE AS one
       FROM k WINDOW w AS (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k2 AS (SELECT *, max(one) OVER (PARTITION BY source) AS level FROM k1),
n AS (SELECT source, max(level) AS level, max(target) - sum(floor(least(3.0::DOUBLE, level * weight) + 1e-12::DOUBLE)::BIGINT * words)::DOUBLE AS need FROM k2 GROUP BY source),
e AS (SELECT d.*, source_size, target, CASE WHEN size > 0 THEN least(3.0::DOUBLE, level * (length(bin(size)) + 7)) ELSE 0 END AS expected,
             (('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN n ON d.source IS NOT DISTINCT FROM n.source),
f AS (SELECT *, floor(expected + 1e-12::DOUBLE)::BIGINT AS certain FROM e),
g AS (SELECT *, greatest(expected - certain, 0.0::DOUBLE) AS chance FROM f),
h AS (SELECT *, CASE WHEN chance > 0 AND chance < 1 AND size > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS odds FROM g),
r AS (SELECT *, least(floor(odds / (1 + odds) * 281474976710656.0::DOUBLE)::BIGINT, 281474976710655) AS pareto FROM h),
b AS (SELECT source, pareto, sum(size) AS there FROM r WHERE pareto IS NOT NULL GROUP BY ALL),
c AS (SELECT b.*, coalesce(sum(there) OVER (PARTITION BY source ORDER BY pareto ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
l AS (SELECT c.source, max_by(pareto, pareto) AS pareto, max_by(need - before, pareto) AS need, max_by(there, pareto) AS there
      FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE need - before >= 0 GROUP BY c.source),
t AS (SELECT r.*, CASE WHEN size > 0 THEN r.certain ELSE 0 END + CASE WHEN r.pareto < l.pareto OR (r.pareto = l.pareto AND l.need * 2 >= l.there) THEN 1 ELSE 0 END AS copies
      FROM r LEFT JOIN l ON r.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM t
"""


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs, not_in_fold(4, 2))
    out = language_id.predict(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
x AS (SELECT r, lang, source, unnest(t) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM x GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS n FROM x GROUP BY ALL HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
u AS (SELECT c.lang, c.source, sum(c.n) AS total FROM c JOIN k ON c.lang = k.lang AND c.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT k.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(u.total, 0) + 5 * l.v)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * l.v)::HUGEINT AS q
      FROM k JOIN l ON k.lang = l.lang JOIN g ON k.lang = g.lang LEFT JOIN c ON k.lang = c.lang AND g.source = c.source AND k.term = c.term LEFT JOIN u ON k.lang = u.lang AND g.source = u.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
             LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM s WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT * FROM z WHERE part = 'pair' OR rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_lists": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op8_ngram_join": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op10_mixing": OP10_SQL, "op12_source_divergence": OP12_SQL}
