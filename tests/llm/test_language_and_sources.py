"""Language identification and the audit of sources against brute force, on small tables with odd rows."""

import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkweave.llm import divergence, language_id
from walkweave.llm.queries import not_in_fold, op11_language_id

#: Names that the operators use inside.
CLASHES = ("row", "letters", "grams", "distance", "lang_pred", "score", "gram", "rank", "n", "term", "salt", "p", "q", "item", "value", "v", "total")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
TONGUES = {"aa": "ka ko mi mu tana telo rima", "bb": "schrift wald zorn hutte grun", "ßß": "это мир дом река лес", "cc": "ça été noël où façade"}


def rows(n=160):
    rng = random.Random(8)
    out = []
    for i in range(n):
        lang = list(TONGUES)[i % 4]
        text = " ".join(rng.choices(TONGUES[lang].split(), k=rng.randrange(1, 40)))
        out.append((i, text, lang, f"s{rng.randrange(3)}"))
    out += [(n, None, "aa", None), (n + 1, "", "aa", "s0"), (n + 2, "12 34 -- !", "bb", "s1"), (n + 3, "KA Ko\x00mi\ttana", None, "s1"), (n + 4, "x", "aa", "only"), (n + 5, None, "alone", "s0")]
    out += [(3, out[3][1], "ßß", "s1"), (3, out[3][1], "ßß", "s1"), (None, "tana telo", None, None), (None, "wald", "bb", "s2"), (n + 6, "İstanbul ǅ été 字字", "cc", "s0"), (n + 7, "́́ 7", "cc", "s0")]
    out += [(n + 8, "été wald " * 20_000, "cc", "s2"), (n + 9, "z" * 200_000, None, "s2")]
    return [(*r, *["clash"] * len(CLASHES)) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- language identification


def slow_grams(text):
    text = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    return Counter(g for w in text.split(" ") if w for n in (1, 2, 3) for i in range(len(f" {w} ") - n + 1) if (g := f" {w} "[i : i + n]) != " ")


def slow_top(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:size]


def slow_predictions(rows, learn, size):
    counts = defaultdict(Counter)
    for doc_id, text, lang, *_ in rows:
        if lang is not None and learn(doc_id):
            counts[lang] += slow_grams(text or "")
    profiles = {lang: {g: i for i, g in enumerate(slow_top(c, size))} for lang, c in counts.items() if c}
    out = []
    for doc_id, text, *_ in rows:
        found = slow_top(slow_grams(text or ""), size)
        if not profiles or not any(unicodedata.category(c)[0] == "L" for c in (text or "").lower()):
            out.append((doc_id, "und", 0.0))
            continue
        d = {lang: sum(abs(i - p[g]) if g in p else size for i, g in enumerate(found)) for lang, p in profiles.items()}
        lang = min(sorted(d), key=d.get)
        out.append((doc_id, lang, round(1 - d[lang] / (len(found) * size), 9)))
    return sorted(out, key=str)


def learn(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 4 != 2


def predictions(docs, p):
    model = language_id.fit(docs, not_in_fold(4, 2), p)
    return sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.predict(docs, model).collect()), key=str)


@pytest.mark.parametrize("p", [language_id.Params(), language_id.Params(size=20), language_id.Params(size=30, send=60, block=1 << 12, flush=50)])
def test_predictions_are_those_of_the_definition(docs, p):
    """The third case sends two languages at a time, counts long texts in blocks and hands counts on early."""
    assert predictions(docs, p) == slow_predictions(rows(), learn, p.size)


def test_grams_of_blocks_are_those_of_the_whole():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choices("aB é1 ́\n.字Σ", k=rng.randrange(0, 40)))
        whole = slow_grams(text)
        for block in (1, 2, 3, 7, 1000):
            keys, counts, letters = language_id.grams(text, block)
            name = lambda k: "".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s)
            assert {name(int(k)): int(n) for k, n in zip(keys, counts, strict=True)} == whole
            assert letters == any(unicodedata.category(c)[0] == "L" for c in text)


def test_most_frequent_keys():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 100):
        keys, counts = np.arange(n) * 3, rng.integers(1, 6, n)
        for size in (1, 4, 60):
            assert language_id.top(keys, counts, size).tolist() == sorted(keys.tolist(), key=lambda k: (-counts[k // 3], k))[:size]


def test_without_documents_or_languages(docs, empty):
    model = language_id.fit(empty, not_in_fold(4, 2))
    assert model.profiles.count() == 0
    assert language_id.predict(empty, model).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()} == {("und", 0.0)}


def test_inputs_are_text_only(docs):
    model = language_id.fit(docs, not_in_fold(4, 2))
    other = docs.withColumns({"lang": F.lit("aa"), "source": F.lit("t")})
    a, b = (sorted(map(str, language_id.predict(d, model).collect())) for d in (docs, other))
    assert a == b


def test_held_out_accuracy(spark):
    """The whole query against the language of held-out documents."""
    sf = "/root/testdata/sf0.001"
    out = op11_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 30 and right >= 0.97


# --- audit of sources


def slow_terms(text):
    out, word = [], ""
    for c in text + " ":
        if c >= "\x80" or c.isascii() and c.isalpha():
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif word:
            out.append(word)
            word = ""
    return out


def slow_audit(rows, p):
    rows = [(lang or "", source or "", slow_terms(text or "")) for _, text, lang, source, *_ in rows]
    groups, at, spread = {r[:2] for r in rows}, Counter(), Counter()
    for lang, source, terms in rows:
        at.update((lang, source, t) for t in terms)
        spread.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in spread.items() if x == lang and n >= p.documents]
        sources = sorted(s for x, s in groups if x == lang)
        count = {s: {t: at[lang, s, t] for t in kept} for s in sources}
        share = lambda c: {t: 1 + p.unit * (n + p.smoothing) // (sum(c.values()) + p.smoothing * len(kept)) for t, n in c.items()}
        q = share({t: sum(c[t] for c in count.values()) for t in kept})
        shares = {s: share(count[s]) for s in sources}
        for s in sources:
            pair = [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(shares[s][t] - q[t], t) for t in kept if count[s][t] and shares[s][t] > q[t]]
            for part, found, top in (("pair", pair, None), ("term", term, p.top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("p", [divergence.Params(), divergence.Params(documents=2, top=3), divergence.Params(documents=10**6)])
def test_audit_is_that_of_the_definition(docs, p):
    got = divergence.audit(docs, p)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == slow_audit(rows(), p)


def test_shares_are_exact_for_large_counts(spark):
    p = divergence.Params()
    values = [(0, 0, 1), (10**13 + 7, 10**15 + 3, 12345), (3 * 10**17, 10**18, 10**6), (9_223_372_031, 9_223_372_036, 3)]
    df = spark.createDataFrame(values, "n long, total long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"), p)).collect()]
    assert got == [1 + 10**9 * (n + 5) // (total + 5 * v) for n, total, v in values]


def test_audit_of_an_empty_table(empty):
    assert divergence.audit(empty).count() == 0


def test_terms_are_split_without_a_pattern(spark):
    """op12 over its budget: a pattern took about two fifths of the time of counting terms. Every character below U+0180 and some beyond stand between, before and after letters."""
    ends = [*map(chr, range(0x180)), "İ", "K", " ", "　", "﻿", "\U0001f600"]
    texts = [f"Ab{c}{c}Cd {c}x{c}" for c in ends] + ["", " ", None, "aa a Aa aa"]
    docs = spark.createDataFrame([(i, t, "l", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    counts = divergence.term_counts(docs)
    assert "regexp" not in counts._jdf.queryExecution().optimizedPlan().toString()
    want, rows = {}, {}
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        for w in found:
            want[w] = want.get(w, 0) + 1
        for w in set(found):
            rows[w] = rows.get(w, 0) + 1
    assert {r["term"]: (r["n"], r["docs"]) for r in counts.collect()} == {w: (n, rows[w]) for w, n in want.items()}
