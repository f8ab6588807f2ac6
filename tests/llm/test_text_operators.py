"""Each operator against brute force, on a small table with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from walkweave.llm import components, exact_dedup, fm_index, mixing, ngram_join, order_minhash, packing, quality, recurrent_lm, substring_dedup, toxicity, url_lists
from walkweave.llm.common import fold
from walkweave.llm.queries import tokenizer_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that operators use inside.
CLASHES = ("uid", "class", "words", "n", "w", "score", "size", "task", "suspect", "digest", "bucket", "rank", "sha", "__text", "order", "root", "set", "copies", "key", "host", "verdict", "predicted", "copy")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def prose(rng, n, words=200):
    return " ".join(f"w{int(rng.random() ** 2 * words)}" for _ in range(n))


def rows():
    rng = random.Random(3)
    base = prose(rng, 120)
    other = prose(rng, 60)
    texts = [base, base, base + " tail", base.replace("w1 ", "x1 ", 1), other, other.upper(), None, None, "", " \t\n", "one", "one two three", "Ünï çödé \U0001f600 字 字", "a b " * 300, prose(rng, 9000), "x" * 30_000]
    texts += [prose(rng, 40 + i) for i in range(12)]
    texts += [other + " " + prose(rng, 30) for _ in range(4)]
    out = [(i, t, "en", ["s0", "s0", "s1", None, "s2"][i % 5]) for i, t in enumerate(texts)]
    out += [(3, texts[3], "en", "s0"), (None, "one two three", None, None), (None, base, None, "s1"), (100, base, None, "s0"), (7, None, None, "s1")]
    return [(*r, len(r[1] or ""), *["clash"] * len(CLASHES)) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(30)] + [(None, 1, 1), (5, None, None), (4, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")


def words(t, lower=False):
    return WORD.findall((t or "").translate(LOWER) if lower else t or "")


def everything(doc_id):
    return F.lit(True)


# --- toxicity and quality


def test_maximal_segments_are_those_of_the_definition():
    """All maximal scoring segments, found by splitting at the best segment again and again (Ruzzo and Tompa's definition)."""

    def slow(s, at=0):
        best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        _, _, a, b = best
        return slow(s[:a], at) + [(at + a, at + b - 1, sum(s[a:b]))] + slow(s[b:], at + b)

    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-0.5, -0.8, -1.1, 0.3, 0.7, 1.9]) for _ in range(rng.randrange(1, 14))]
        got = toxicity.segments(np.array(s))
        assert [(a, b, round(x, 9)) for a, b, x in got] == [(a, b, round(x, 9)) for a, b, x in sorted(slow(s))]


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(5)
    texts, marks = [], []
    for i in range(600):
        w = prose(rng, 80).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "foulmouth", "rottenly"]))
        texts.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, lambda d: fold(d, 4) != 2)
    out = toxicity.score(docs, model).toPandas().sort_values("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id])
    bad = np.arange(600) % 4 == 0
    assert held.any() and ((out.score >= 0.3) == bad)[held].mean() > 0.97
    assert out.passages[bad & held].map(len).gt(0).mean() > 0.5 and any("vilest" in x["text"] for p in out.passages[bad] for x in p)


def test_toxicity_of_odd_tables(docs, empty, labels):
    model = toxicity.fit(docs, labels, everything)
    out = toxicity.score(docs, model, ["source"])
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.score(empty, toxicity.fit(empty, labels, everything)).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0), everything)).count() == docs.count()


def test_quality_features_are_words_and_ngrams():
    found, owner = quality.buckets_of(["ab  c", "", "ab"], (2, 3), 1 << 20)
    # 'ab': word, <a ab b>, <ab ab>; 'c': word, <c c>; a word's features don't depend on its place
    assert Counter(owner.tolist()) == {0: 6 + 3, 2: 6}
    assert set(found[owner == 2]) <= set(found[owner == 0])
    one, _ = quality.buckets_of(["x y ab"], (2, 3), 1 << 20)
    assert set(found[owner == 2]) <= set(one)


def test_quality_learns(spark):
    rng = random.Random(6)
    texts = [(i, prose(rng, 60) if i % 3 else " ".join(f"{w}!!" for w in prose(rng, 60).upper().split())) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    model = quality.fit(docs, labels, lambda d: fold(d, 5) != 0)
    out = quality.score(docs, model, ["doc_id"]).toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id])
    assert (((out.score >= 0.3) == (out.doc_id % 3 > 0))[held]).mean() > 0.97


def test_quality_of_odd_tables(docs, empty, labels):
    model = quality.fit(docs, labels, everything)
    out = quality.score(docs, model, ["doc_id", "source"])
    assert out.count() == docs.count() and out.where("score is null").isEmpty()
    assert quality.score(empty, quality.fit(empty, labels, everything), ["doc_id"]).count() == 0


# --- packing


def test_level_packer_minimises_the_sum_of_squares():
    rng, packer, cap = random.Random(2), packing.LevelPacker(12), 12
    count = [0] * cap  # partial windows by level
    for i in range(500):
        size = rng.randrange(1, cap)
        best = None
        for h in range(cap - size + 1):
            if h and not count[h]:
                continue
            new = list(count)
            if h:
                new[h] -= 1
            if h + size < cap:
                new[h + size] += 1
            best = min(best, sum(x * x for x in new)) if best is not None else sum(x * x for x in new)
        packer.place(size, i)
        count = packer.level.tolist()
        assert sum(x * x for x in count) == best
    assert all(len(w) >= 1 for w in packer.closed)


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    files = tokenizer_files()
    whole = Tokenizer.from_file(files["tokenizer"])
    special = docs.sparkSession.createDataFrame([(500, "a <|endoftext|> b")], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(special).withColumn("row", F.monotonically_increasing_id()).cache()
    out = packing.pack(table, **files, keep=["row", "doc_id"], with_ids=True).toPandas()
    for row in table.collect():
        ids = [*whole.encode(row.text or "", add_special_tokens=False).ids, 1]
        pieces = out[out.row == row.row].sort_values("start")
        assert [x for p in pieces.ids for x in p] == ids and set(pieces.doc_tokens) == {len(ids)}
        for p in pieces.itertuples():
            assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    # one short sequence per task at most, but for windows nearly full
    assert (out.groupby("sequence_id").length.sum() < 2040).sum() <= table.rdd.getNumPartitions()
    assert packing.pack(empty, **files).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_both_libraries_give_the_same_ids(sf):
    """Over all given documents, and over texts made of blanks, controls, marks, many scripts, long words and the special token."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    files = tokenizer_files()
    whole, encode = Tokenizer.from_file(files["tokenizer"]), packing.encoder(**dict(zip(("path", "ranks"), files.values(), strict=True)))
    texts = [x or "" for x in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    rng = random.Random(17)
    alphabet = [*map(chr, range(1, 0x250)), *" \t\n\r\x0b\x0c\x85\u00a0\u2028\u3000", *"\u0301\u200d\ufe0f\U0001f600\U0001f1e9字語한अ๑١Ⅷ½²ſß\uffff", "'s", "'LL", "  ", "\n\n", "12345", "<|endoftext|>", "x" * 300]
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(3000)] + ["y" * 20_000, " " * 5000, "\n" * 3000]
    for t in texts:
        assert list(encode(t)) == whole.encode(t, add_special_tokens=False).ids, t[:80]


def test_the_rule_places_most_tokens_of_small_partitions(spark):
    """Few pieces are cut further at a task's end, however the rows are partitioned."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, int(1500 * rng.random() ** 2) + 1)) for i in range(9000)], "doc_id long, text string").repartition(40)
    out = packing.pack(docs, **tokenizer_files())
    cut = out.where("start % 2048 != 0 or (length < 2048 and start + length < doc_tokens)").count()
    assert cut < 0.2 * out.count()


# --- Order MinHash


@pytest.mark.parametrize("short", [24, 4])
def test_fingerprints_by_definition(spark, monkeypatch, short):
    """Bins, picks and order as written down, with the k-mers' hashes taken from Spark. Texts of more than 2^short units take the packing of the longest ones."""
    monkeypatch.setattr(order_minhash, "PLACE", short)
    texts = ["a b c a b c a b c d e f", "one", "", "w " * 50, " ".join(f"t{i % 7}" for i in range(90))]
    bins, picks, k = 8, 2, 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = order_minhash.with_signature(df, "text", "sig", k, bins, picks).select("doc_id", "sig").collect()

    def hash_of(args, kinds):
        return spark.range(1).select(F.xxhash64(*[F.lit(a).cast(t) for a, t in zip(args, kinds, strict=True)])).first()[0]

    for row in got:
        u = texts[row.doc_id].split()
        grams = [tuple(u[i : i + k]) for i in range(len(u) - k + 1)] if len(u) >= k else [(" ".join(u),)] if u else []
        seen, items = Counter(), []
        cut = 30 if len(u) > 1 << short else short
        head = lambda x: (x << cut & (1 << 64) - 1) >> cut  # noqa: B023, E731
        sign = lambda x: x - ((x >> 63 - cut & 1) << 64 - cut)  # noqa: B023, E731
        for at, g in enumerate(grams):
            h = sign(head(hash_of(g, ["string"] * len(g))))
            o = seen[g]
            seen[g] += 1
            v = head(hash_of((h, o), ["long", "int"]))
            items.append((v >> 61 - cut, sign(v), at))
        want = [None] * bins
        chosen = sorted((s, at, b) for b in range(bins) for s, at in sorted((s, at) for x, s, at in items if x == b)[:picks])
        for b in {b for _, _, b in chosen}:
            begin = min(i for i, x in enumerate(chosen) if x[2] == b)
            best = [chosen[(begin + j) % len(chosen)][:2] for j in range(min(picks, len(chosen)))]
            tuple_ = [s for s, at in sorted(best, key=lambda x: x[1])]
            want[b] = spark.range(1).select(F.xxhash64(F.array(*[F.lit(s).cast("long") for s in tuple_]))).first()[0]
        assert row.sig == want


def test_fingerprints_keep_columns_of_any_name(spark):
    names = ["u", "km", "runs", "e", "filled", "entries", "place", "doc_id"]
    df = spark.createDataFrame([("a b c d", *names)], ["text", *names])
    out = order_minhash.fingerprints(df)
    assert out.columns == [*df.columns, "fingerprint"] and out.select(names).first() == tuple(names)


def test_edited_texts(docs, empty):
    out = order_minhash.edited(docs).toPandas()
    assert len(out) == docs.count() and order_minhash.edited(empty).count() == 0
    table = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    table = sorted(table, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h))
    want = Counter()
    for i, r in enumerate(table):
        nxt, half = table[(i + 1) % len(table)].t, len(r.t) // 2
        want[(r.doc_id, len(r.t), hashlib.sha256((r.t[: len(r.t) - half] + nxt[:half]).encode()).hexdigest())] += 1
    got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.n_chars, r.edited_sha256) for r in out.itertuples())
    assert got == want
    assert out.near_edited.between(0, 1).all() and out.near_next.between(0, 1).all()


@pytest.mark.parametrize("ids", [[*range(3000), 2**40], [i % 2 for i in range(3000)], [None if i % 3 else i for i in range(3000)], [7] * 3000, [-(2**63), *range(200), 2**63 - 1]])
def test_neighbours_share_out_sparse_and_equal_ids(spark, ids):
    rows = spark.createDataFrame([(x, f"text {i}") for i, x in enumerate(ids)], "doc_id long, text string")
    dealt, repeated = order_minhash.neighbours(rows, 50)
    assert repeated is None
    dealt = dealt.withColumn("h", F.xxhash64("text")).collect()
    held = Counter(r.bucket for r in dealt if not r.ghost)
    assert sum(held.values()) == len(ids) and max(held.values()) <= 150
    order = sorted(((r.doc_id, r.h) for r in dealt if not r.ghost), key=lambda x: (x[0] is None, -(x[0] or 0), -x[1]))
    follows = {x: y for x, y in zip(order, order[1:] + order[:1], strict=True)}
    for b in held:
        own = sorted((r for r in dealt if r.bucket == b), key=lambda r: (r.wrap, r.doc_id is None, -(r.doc_id or 0), -r.h))
        for x, y in zip(own, own[1:], strict=False):
            assert x.ghost or follows[(x.doc_id, x.h)] == (y.doc_id, y.h)
        assert own[-1].ghost


@pytest.mark.parametrize("name", [7, None])
def test_equal_rows_are_dealt_once(spark, name):
    """20,000 rows of one id and text among others: no bucket holds them, each has its own text as the next, the last one the text that follows."""
    many = [(name, "same words again and again")] * 20_000
    rows = spark.createDataFrame(many + [(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    dealt, repeated = order_minhash.neighbours(rows, 50)
    assert repeated.count() == 19_999 and dealt.count() <= 100
    got = Counter(r.edited_sha256 for r in order_minhash.edited(rows).where(F.col("n_chars") == len(many[0][1])).collect())
    text, half = many[0][1], len(many[0][1]) // 2
    sha = lambda after: hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    follows = [sha("text 6"), sha("text 7")] if name else [sha("text 19")]  # two texts have the id 7, in the order of their hashes
    assert sum(got.values()) == 20_000 and got.pop(sha(text)) == 19_999 and set(got) <= set(follows)


def test_edits_lower_likeness_and_order_counts(spark):
    rng = random.Random(8)
    a = prose(rng, 400, 5000).split()
    few, many, turned = a[:], a[:], a[200:] + a[:200]
    for i in range(0, 400, 50):
        few[i] = "new"
    for i in range(0, 400, 5):
        many[i] = "new"
    blocks = [a[i : i + 4] for i in range(0, 400, 4)]
    rng.shuffle(blocks)
    texts = [a, few, many, turned, [w for b in blocks for w in b]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    s = order_minhash.with_signature(df, "text", "sig", 3, 64, 2).alias("s")
    own = s.where("doc_id = 0").select(F.col("sig").alias("base"))
    near = {r.doc_id: r.n for r in s.join(own).select("doc_id", order_minhash.likeness("sig", "base").alias("n")).collect()}
    assert near[0] == 1 and near[0] > near[1] > near[2] and near[3] < 1 and near[4] < near[1]


@pytest.mark.parametrize("n", [20, 50, 100])
def test_order_counts_in_short_texts(spark, n):
    """Halves of a text change places: nearly all k-mers stay, but tuples across the halves turn. The likeness is clearly lower than that of the sets of k-mers."""
    rng = random.Random(n)
    texts = [rng.sample(range(10**6), n) for _ in range(60)]
    pairs = [(" ".join(map(str, t)), " ".join(map(str, t[n // 2 :] + t[: n // 2]))) for t in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    both = order_minhash.with_signature(order_minhash.with_signature(df, "a", "x", 3, 64, 2), "b", "y", 3, 64, 2)
    near = both.select(F.avg(order_minhash.likeness("x", "y"))).first()[0]
    assert near < 0.75 * (n - 4) / n


# --- language model


def test_language_model_counts_and_probabilities(docs, empty):
    learn = lambda d: fold(d, 7) != 2
    p = recurrent_lm.Params(vocabulary=64, sample=40, head=50)
    model = recurrent_lm.fit(docs, learn, p)
    out = recurrent_lm.score(docs, model, fold(F.col("doc_id"), 7) == 2).toPandas()
    table = docs.select("doc_id", "text").collect()
    count = Counter()
    for r in table:
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
            count.update([*words(r.text, True), "\n"])
    total, kinds = sum(count.values()), len(count)
    want = Counter()
    for r in table:
        t = [*words(r.text, True), "\n"]
        base = sum(np.log10((count[w] + 1) / (total + kinds + 1)) for w in t)
        want[(r.doc_id, len(t), sum(count[w] > 0 for w in t), round(base, 5))] += 1
    got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in out.itertuples())
    assert got == want and set(out.train_tokens) == {total} and (out.score < 0).all()
    none = recurrent_lm.fit(empty, learn, p)
    assert recurrent_lm.score(empty, none, F.lit(False)).count() == 0
    assert recurrent_lm.score(docs, none, F.lit(False)).count() == docs.count()


def test_network_learns_from_all_documents_and_scores_new_ones_better_than_counts(spark):
    """Words follow each other by a rule that counts don't know."""
    rng = random.Random(1)
    texts = []
    for i in range(600):
        at, line = rng.randrange(8), []
        for _ in range(rng.choice([5, 80, 700])):
            at = (at + (1 if rng.random() < 0.9 else 3)) % 8
            line.append(f"w{at}")
        texts.append((i, " ".join(line)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    p = recurrent_lm.Params(vocabulary=16, per_class=4, hidden=8, window=8, lanes=8, piece=64, sample=1, rate=4e-2)
    held = fold(F.col("doc_id"), 7) == 2
    out = recurrent_lm.score(df, recurrent_lm.fit(df, lambda d: fold(d, 7) != 2, p), held).where("held_out")
    mean, base = out.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert mean > -0.4 and base < -0.85  # the sampled document alone doesn't teach that


def test_symbols_grow_with_the_tokens():
    p = recurrent_lm.Params()
    assert [p.symbols(n) for n in (0, 10**6, 4 * 10**6, 10**9)] == [2048, 2048, 4000, 8192]


def test_held_out_likelihood_stays(spark):
    """The network of 2,048 symbols and 32 units that this operator had at first reached -3.836 a token on this table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = fold(F.col("doc_id"), 7) == 2
    out = recurrent_lm.score(docs, recurrent_lm.fit(docs, lambda d: fold(d, 7) != 2), held).where("held_out")
    mean, base = out.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert mean > -3.836 and base < -4.06


def test_pieces():
    ids, offsets = np.arange(10, 40), np.array([0, 7, 7, 8, 30])
    ends, first = recurrent_lm.pieces_of(ids, offsets, 5)
    assert ends.tolist() == [0, 5, 7, 8, 13, 18, 23, 28, 30] and first.tolist() == [1, 14, 1, 1, 22, 27, 32, 37]


def test_network_is_a_distribution_and_its_gradient_is_right():
    p = recurrent_lm.Params(vocabulary=10, per_class=4, hidden=5, window=6, lanes=2)
    net = recurrent_lm.new_network(np.arange(10.0), p)
    for first in range(10):  # all continuations of one step sum to 1
        lines = [np.array([first, s]) for s in range(10)]
        flat, off = np.concatenate(lines), np.arange(0, 22, 2)
        one = recurrent_lm.log_likelihood(net, np.array([first]), np.array([0, 1]))[0]
        assert abs(np.exp(recurrent_lm.log_likelihood(net, flat, off) - one).sum() - 1) < 1e-4
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.append(np.tile([2, 3, 4, 5], 6), 1) for _ in range(20)]).astype(np.int32)
    off = np.arange(0, len(ids) + 1, 25)
    before = recurrent_lm.log_likelihood(net, ids, off).sum()
    parts = [x.copy() for x in net.parts()]
    learner = recurrent_lm.Learner(net, recurrent_lm.Params(vocabulary=10, per_class=4, hidden=5, window=6, lanes=2))
    for _ in range(60):
        learner.once_over(*recurrent_lm.lanes_of(ids, off, 2), lambda done: 2e-2 / (1 + done / 1000))
    assert recurrent_lm.log_likelihood(net, ids, off).sum() > before / 4  # the cycle is learnt
    assert any((a != b).any() for a, b in zip(parts, net.parts(), strict=True)) and rng is not None


def test_sets_of_classes_are_a_distribution_and_the_gradient_is_that_of_the_likelihood():
    p = recurrent_lm.Params(vocabulary=30, per_class=4, hidden=5, direct=2, per_set=2)  # 8 classes, 6 of them in 3 sets
    net = recurrent_lm.new_network(np.arange(30.0), p)
    assert net.first.shape == (5, 5) and net.sets.shape == (3, 2, 5)
    lines = [np.array([7, s]) for s in range(30)]
    one = recurrent_lm.log_likelihood(net, np.array([7]), np.array([0, 1]))[0]
    assert abs(np.exp(recurrent_lm.log_likelihood(net, np.concatenate(lines), np.arange(0, 62, 2)) - one).sum() - 1) < 1e-4
    rng = np.random.default_rng(2)
    ids = rng.choice([3, 3, 3, 9, 14, 28, 29], 3000).astype(np.int32)  # some classes are large, some small
    off = np.arange(0, 3001, 6)
    inputs, targets, owner, begins = recurrent_lm.lanes_of(ids, off, 500)
    learner = recurrent_lm.Learner(net, p)
    groups = list(recurrent_lm._by_group(inputs.ravel(), len(net.inputs), 1))
    symbols = np.concatenate([np.arange(g.start, g.stop) if isinstance(g, slice) else g for g, *_ in groups])
    assert sorted(symbols) == sorted(set(inputs.ravel()))
    _, grads = learner.gradients(np.zeros((500, 5), np.float32), inputs, targets.ravel(), (owner.ravel() >= 0).astype(np.float32), begins, groups)
    assert len(grads[0]) == len(symbols)  # no work for symbols that the window hasn't
    full = [np.zeros_like(net.inputs), *grads[1:]]
    full[0][symbols] = grads[0]
    for part, g in zip(net.parts(), full, strict=True):
        way = g / np.sqrt((g * g).sum())
        old, loss = part.copy(), []
        for side in (1e-2, -1e-2):
            part[...] = old + np.float32(side) * way
            loss.append(-recurrent_lm.log_likelihood(net, ids, off).sum() / len(ids))
        part[...] = old
        assert abs((loss[0] - loss[1]) / 2e-2 - np.sqrt((g * g).sum())) < 2e-2 * np.sqrt((g * g).sum()) + 1e-5


def test_softmax_of_very_large_or_small_numbers():
    seen, member = np.ones((3, 1), np.float32), np.array([0, 1, 1])
    for bias in ([500.0, 499.0], [-500.0, -501.0], [0.0, -1.0]):
        out = recurrent_lm._log_softmax_at(seen, np.zeros(3, int), member, np.zeros((1, 2, 1), np.float32), np.array([bias], np.float32))
        assert np.allclose(out, [-0.3133, -1.3133, -1.3133], atol=1e-3)


def test_steps_made_up_for_are_those_of_adam():
    """A symbol that comes once in a while moves as if all windows had moved it."""
    p = recurrent_lm.Params(vocabulary=40, hidden=2, per_class=4)
    learner = recurrent_lm.Learner(recurrent_lm.new_network(np.ones(40), p), p)
    start = learner.net.inputs.copy()
    learner.done = learner.moved[:] = 300
    x, m, v = np.zeros((3, 6)), np.zeros((3, 6)), np.zeros((3, 6))
    rng = np.random.default_rng(3)
    for t in range(301, 341):
        own = np.flatnonzero([t in (301, 320), t % 7 == 0, True])
        g = np.zeros((3, 6))
        g[own] = rng.standard_normal((len(own), 6))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 1e-3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        learner.make_up(own)
        learner.done, learner.step = t, 1e-3
        some = [y[0][own] for y in (learner.parts, learner.first, learner.second)]
        learner.move(some[0], g[own].astype(np.float32), some[1], some[2], 1.0, 1e-3)
        for y, z in zip((learner.parts, learner.first, learner.second), some, strict=True):
            y[0][own] = z
        learner.moved[own] = t
    learner.make_up(np.arange(40))
    moved = learner.net.inputs - start
    assert np.abs(moved[:3] - x).max() < 0.02 * np.abs(x).max() and not moved[3:].any()


def test_scores_do_not_depend_on_which_texts_are_held_together(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 3, 40, 900])))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    model = recurrent_lm.fit(df, lambda d: fold(d, 7) != 2, recurrent_lm.Params(vocabulary=16, per_class=4, hidden=8))
    one, other = (dict(recurrent_lm.score(df, model, F.lit(False), chunk=c, long_=n).select("doc_id", "score").collect()) for c, n in ((10**6, 10**6), (1000, 20)))
    assert len(one) == 60 and one.keys() == other.keys() and all(abs(one[d] - other[d]) < 1e-4 * abs(one[d]) + 1e-4 for d in one)


def test_state_is_carried_over_windows():
    p = recurrent_lm.Params(vocabulary=12, per_class=4, hidden=6)
    net = recurrent_lm.new_network(np.arange(12.0), p)
    ids = np.random.default_rng(1).integers(0, 12, 200).astype(np.int32)
    off = np.array([0, 150, 170, 200])
    assert np.allclose(recurrent_lm.log_likelihood(net, ids, off, 7), recurrent_lm.log_likelihood(net, ids, off, 1000), rtol=1e-4)


# --- URL lists


def test_url_lists(spark):
    pages = [(1, "http://a.b.example.com/x", 5), (2, "https://u@A.B.EXAMPLE.com:80/?q", 25), (3, "http://other.org", 5), (4, None, 5), (5, "nonsense", 5), (6, "http://b.example.com./", None), (1, "http://a.b.example.com/x", 5), (7, "http://a.b.example.com", 40), (8, "http://localhost/", 5)]
    entries = [("example.com", 1, "block"), ("a.b.example.com", 10, "allow"), ("a.b.example.com", 30, "remove"), ("example.com", 1, "block"), ("other.org", 5, "block"), ("other.org", 5, "remove"), (None, 1, "block"), ("x", None, "block"), ("localhost", 2, "block")]
    day = "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(d)"
    p = spark.createDataFrame(pages, "page_id long, url string, d int").withColumn("fetched", F.expr(day)).withColumn("key", F.lit("clash")).withColumn("action", F.lit("clash"))
    e = spark.createDataFrame(entries, "key string, d int, action string").select("key", F.expr(day).alias("since"), "action")
    got = {(r.page_id, r.url): (r.verdict, r.list_key, r.n_rows) for r in url_lists.judge(p, e, ["page_id", "url", "key"]).collect()}
    assert got[(1, pages[0][1])] == ("block", "example.com", 2)
    assert got[(2, pages[1][1])] == ("allow", "a.b.example.com", 1)
    assert got[(7, pages[7][1])] == ("block", "example.com", 1)
    assert got[(3, "http://other.org")] == ("block", "other.org", 1)
    assert got[(8, "http://localhost/")][0] == "block"
    assert {got[k][0] for k in got if k[0] in (4, 5, 6)} == {"none"} and len(got) == 8
    assert url_lists.judge(p, e.limit(0), ["page_id"]).where("verdict <> 'none'").isEmpty() and url_lists.judge(p.limit(0), e, ["page_id"]).count() == 0


# --- exact duplicates


def test_golomb_codes():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (1, 2**50), (500, 2**40), (64, 64), (3000, 5000)):
        v = np.unique(rng.integers(0, top, n).astype(np.uint64))
        k, code = exact_dedup.encode(v)
        assert (exact_dedup.decode(len(v), k, code) == v).all()
    v = np.unique(rng.integers(0, 2**32, 4000).astype(np.uint64))
    assert len(exact_dedup.encode(v)[1]) < 0.45 * v.nbytes


@pytest.mark.parametrize("digest, send_rows", [(None, 1 << 28), (None, 0), ("weak", 1 << 28)])
def test_exact_duplicates(docs, empty, digest, send_rows):
    digest = F.length("text").cast("string") if digest else None
    digest = None if digest is None else F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 1)
    out = exact_dedup.duplicates(docs, ["doc_id", "source"], digest=digest, send_rows=send_rows).toPandas()
    groups = defaultdict(list)
    for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect():
        groups[hashlib.sha256(r.t.encode()).hexdigest()].append(r.doc_id)
    assert len(out) == docs.count()
    for sha, g in out.groupby("text_sha256"):
        ids = groups[sha]
        assert set(g.group_size) == {len(ids)} and g.kept.sum() == 1
        best = max((i for i in ids if i is not None), default=None)
        assert all(np.isnan(x) if best is None else x == best for x in g.keep_id)
        assert best is None or g[g.kept].doc_id.iloc[0] == best
    assert exact_dedup.duplicates(empty).count() == 0


# --- n-gram join


def brute_links(table, n, num, den):
    sets = []
    for r in table:
        w = words(r.text, True)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(table)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            t = sets[j]
            if s and t and len(s & t) * den >= len(s | t) * num:
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(table)):
        groups[top(i)].append(table[i].doc_id)
    return [(table[i].doc_id, len(sets[i]), min((x for x in groups[top(i)] if x is not None), default=None)) for i in range(len(table))]


def test_ngram_join(docs, empty):
    for p in (ngram_join.Params(4, 85, 100), ngram_join.Params(5, 80, 100), ngram_join.Params(1, 50, 100)):
        out = ngram_join.classes(docs, p)
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect())
        assert got == Counter(brute_links(docs.select("doc_id", "text").collect(), p.n, p.num, p.den))
    assert ngram_join.classes(empty).count() == 0


def test_ngram_join_of_a_large_family(spark, monkeypatch):
    """Copies of one text, each edited, are far more than a group that gives all pairs; many lie just under the threshold."""
    rng = random.Random(11)
    base = prose(rng, 150, 5000).split()
    texts = []
    for i in range(90):
        w = base[:]
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, " ".join(base[:60]) + " " + prose(rng, 60 + i, 5000)) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = Counter(brute_links(df.collect(), 4, 85, 100))
    # Also with numbers of sets that clash, all common keys dealt to all owners, rounds of stars, joins instead of broadcasts and large groups in tiles.
    monkeypatch.setattr(ngram_join, "TILE", 20)
    for p, more in ((ngram_join.Params(4, 85, 100), {}), (ngram_join.Params(4, 85, 100, id_bits=9, probe=1), {"one_task": 0, "send_ids": 0})):
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(df, p, **more).collect()) == want


def test_ngram_join_of_a_family_under_the_threshold(spark, monkeypatch):
    """Templated texts of which no two link: the pairs compared as whole sets stay few."""
    rng = random.Random(12)
    base = prose(rng, 400, 50_000).split()
    texts = []
    for i in range(120):
        w = base[:]
        for j in rng.sample(range(0, 400, 8), 9):
            w[j] = f"e{rng.randrange(10**9)}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    tried = []
    whole = ngram_join.cut

    def counted(some, name, keep=False):
        out = whole(some, name, keep)
        if name == "join-tried":
            tried.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut", counted)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(df, ngram_join.Params(4, 85, 100)).collect())
    want = Counter(brute_links(df.collect(), 4, 85, 100))
    assert got == want and len({x[2] for x in want}) > 60
    assert sum(tried) < 4 * len(texts)


def test_pigeonhole_never_loses_a_link():
    """Small sets, where blocks are often empty: all pairs at the threshold share a key."""
    rng = np.random.default_rng(4)
    p = ngram_join.Params(1, 85, 100)
    limits = ngram_join.edges(85, 100)
    for _ in range(3000):
        size = int(rng.integers(6, 60))
        s = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        most = next(d for d in range(size, -1, -1) if (size - d) * 100 >= size * 85)
        gone = rng.choice(len(s), rng.integers(0, most + 1), replace=False)
        t = np.delete(s, gone)
        bands = [int(np.searchsorted(limits, len(x), "right")) - 1 for x in (s, t)]
        assert 0 <= bands[0] - bands[1] <= 1
        keys = [set((np.concatenate([ngram_join.blocks(x, b, p) for b in (band, band - 1) if b >= 0]) & ~ngram_join.LOW).tolist()) for x, band in zip((s, t), bands, strict=True)]
        assert len(gone) == 0 or keys[0] & keys[1]
        x, y = (np.frombuffer(ngram_join.sketch(v, b, p), np.uint64) for v, b in zip((s, t), bands, strict=True))
        assert ngram_join.hamming(ngram_join.fold(x, len(y)), y) <= len(gone)


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(-50, 50), rng.randrange(-50, 50)) for _ in range(60)] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {r.node: r.root for r in components.connected_components(df, 0).collect()}
    parent = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: r for x, r in parent.items() if any(a != b and x in (a, b) for a, b in links)}


# --- substring dedup


def test_fm_index():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 4, 300)
    index = fm_index.FMIndex(text, 9)
    pattern = rng.integers(1, 4, 200)
    length, start, end = index.match(pattern, np.arange(8, 200), 6)
    for e, n, a, b in zip(range(8, 200), length, start, end, strict=True):
        spots = lambda k: [i for i in range(len(text) - k + 1) if (text[i : i + k] == pattern[e - k : e]).all()]  # noqa: B023, E731
        assert spots(n) and (n == 6 or not spots(n + 1))
        if n == 6:
            assert sorted(index.suffixes[a:b]) == spots(6)


def test_repeated_passages(docs, empty):
    out = substring_dedup.repeated(docs).toPandas()
    table = docs.select("doc_id", "text").collect()
    owner = {}
    for r in table:
        w, key = words(r.text), float("inf") if r.doc_id is None else r.doc_id
        for i in range(len(w) - 12):
            owner[tuple(w[i : i + 13])] = min(owner.get(tuple(w[i : i + 13]), float("inf")), key)
    want = Counter()
    for r in table:
        w, key = words(r.text), float("inf") if r.doc_id is None else r.doc_id
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if owner[tuple(w[i : i + 13])] < key:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[(r.doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out.itertuples())
    assert got == want and substring_dedup.repeated(empty).count() == 0
    # Also with texts whose numbers clash and with joins instead of broadcasts.
    for p, send in ((substring_dedup.Params(), 0), (substring_dedup.Params(id_bits=3), 1000)):
        assert Counter(x.kept_sha256 for x in substring_dedup.repeated(docs, p, send_ids=send).collect()) == Counter(out.kept_sha256)


# --- mixing


def test_mixing_targets_and_words(docs, empty, spark):
    out = mixing.mix(docs).toPandas()
    assert len(out) == docs.count() and mixing.mix(empty).count() == 0
    assert (out.taken <= 3 * out["size"]).all() and (out.taken == out.copies * out["size"]).all()
    sizes = {k: 0 for k in ("s0", "s1", "s2", None)}
    for r in docs.select("source", "text").collect():
        sizes[r.source] += len(words(r.text))
    order = [*sorted(k for k in sizes if k is not None), None]
    weight = dict(zip(order, [5, 2, 1, 5], strict=True))
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        total = sum(weight[k] for k in open_)
        over = {k for k in open_ if left * weight[k] / total > 3 * sizes[k]}
        if not over:
            target |= {k: left * weight[k] / total for k in open_}
            break
        for k in over:
            target[k] = 3 * sizes[k]
        left -= sum(3 * sizes[k] for k in over)
        open_ -= over
    for k, g in out.groupby("source", dropna=False):
        assert abs(g.target.iloc[0] - target[None if k != k or k is None else k]) < 1e-6
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert Counter(zip(out.doc_id.fillna(-1), out.copies, strict=True)) == Counter(zip(again.doc_id.fillna(-1), again.copies, strict=True))


def test_mix_comes_near_targets(spark):
    rng = random.Random(12)
    rows = [(i, "abcd"[min(int(rng.random() * 8), 3)], rng.randrange(1, 40)) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.draw(sized, [5, 2, 1], 3, 11).toPandas()
    for _, g in out.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 40
    assert out.copies.max() <= 3


def test_mix_draws_by_each_documents_own_probability(spark):
    """Over many draws, documents of every size come as often as they are expected, and longer ones oftener."""
    rng = random.Random(13)
    rows = [(i, "ab"[i % 5 == 0], 2 ** rng.randrange(0, 9)) for i in range(500)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long").cache()
    draws = 30
    out = pd.concat([mixing.draw(sized, [5, 2, 1], 3, seed).toPandas() for seed in range(draws)])
    a = out[out.source == "b"]
    assert a.expected.nunique() > 5 and a.groupby("size").expected.first().is_monotonic_increasing
    by_size = out.groupby(["source", "size"]).agg(copies=("copies", "mean"), expected=("expected", "first"), n=("copies", "size"))
    part = by_size.expected % 1
    # Pareto sampling keeps probabilities nearly; the draw ends within half a document of the target.
    assert (np.abs(by_size.copies - by_size.expected) <= 4 * np.sqrt(part * (1 - part) / by_size.n) + 0.02).all()
    for _, g in out.groupby("source"):
        assert abs((g.expected * g["size"]).sum() / draws - g.target.iloc[0]) < 1e-6 * g.target.iloc[0] + 1e-6
