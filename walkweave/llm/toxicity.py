"""Toxic passages as maximal scoring segments.

Tokens get the log-odds of the toxic and the clean labelled documents under an informative Dirichlet prior
(Monroe, Colaresi and Quinn 2008). One pass over a text finds all maximal scoring segments (Ruzzo and Tompa 1999).
Segment scores become p-values by the extreme-value law of Karlin and Altschul (1990); a document's segments are combined by the sum statistic of the same authors (1993).
The law's two parameters and the calibration are fitted to all labelled documents, each scored by the log-odds of the other folds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from .common import bounded_batches, cut, scope, text_of

TOKEN = re.compile(r"\w+")
PASSAGES = ArrayType(StructType().add("start", LongType()).add("end", LongType()).add("text", StringType()).add("p_value", DoubleType()))
FOLDS = 4


@dataclass(frozen=True)
class Params:
    """sample: most labelled documents (distinct texts) that are used for fitting, picked by a hash of their ids.
    prior: the prior's mass as a share of the labelled tokens. z: a token's log-odds are brought nearer to 0 by so many standard deviations.
    density: share of toxic words in the passages sought. p_value: a segment is significant below it."""

    sample: int = 24_000
    prior: float = 0.02
    z: float = 3.0
    density: float = 0.1
    p_value: float = 0.01


@dataclass(frozen=True)
class Model:
    """score: of each token that isn't neutral. rest: of any other. lam, k: of the extreme-value law. a, b: of the calibration."""

    score: dict
    rest: float
    lam: float
    k: float
    a: float
    b: float
    p_value: float


#: A word that the lexicon doesn't have takes the best of its stems of these lengths, so inflected and joined forms of a slur count.
STEMS = (4, 5, 6, 8)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def forms(word: str) -> list[str]:
    """The word and its stems, as the lexicon names them."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


class Scores(dict):
    """Each word's score. Words are looked up once; at `most` words the table starts anew."""

    def __init__(self, lexicon: dict, rest: float, most: int = 100_000):
        super().__init__()
        self.lexicon, self.rest, self.most = lexicon, rest, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        # What speaks for toxicity goes before what speaks against it.
        found = [x for x in map(self.lexicon.get, forms(word)) if x is not None]
        self[word] = best = max(found) if found else self.rest
        return best


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last token, score) of a text with these token scores.
    Linear time: each positive token is put once on the list of candidates and leaves it once."""
    at = np.flatnonzero(s > 0)
    after = np.cumsum(s)
    out: list[list] = []  # first token, last token, sum before it, sum after it, index of the nearest candidate with a smaller sum before
    for i, l, r in zip(at.tolist(), (after[at] - s[at]).tolist(), after[at].tolist(), strict=True):
        new = [i, i, l, r, -1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= new[3]:
                new[4] = j
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3], -1]
            del out[j:]
    return [(a, b, r - l) for a, b, l, r, _ in out]


def _scored(scores: Scores, words: list[str]) -> list[tuple[int, int, float]]:
    return segments(np.fromiter(map(scores.__getitem__, words), float, len(words)))


def statistic(model: Model, found: list[tuple[int, int, float]], n: int) -> float:
    """-ln of the document's p-value: the best over r of the sum statistic of its r best segments, each r paid for by a factor of 2."""
    if not found:
        return 0.0
    best = np.sort([x[2] for x in found])[::-1]
    total = np.cumsum(model.lam * best - math.log(max(model.k * n, 1e-9)))
    one = -math.log(max(-math.expm1(-math.exp(min(50.0, -total[0]))), 1e-300))
    r = np.arange(1, len(best) + 1)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(r))])
    holds = (r > 1) & (total > r * (r + 1))  # where the tail formula holds
    r, total = r[holds], total[holds]
    sums = total - (r - 1) * np.log(total) + log_factorial[r] + log_factorial[r - 1] - r * math.log(2)
    return min(600.0, max(0.0, one, float(sums.max(initial=0.0))))


def _training(docs: DataFrame, labels: DataFrame, label: str, learn, p: Params) -> DataFrame:
    """At most p.sample labelled rows with distinct texts: y, fold (by the text's hash), tokens. Of several labels of a document or text the largest counts."""
    labelled = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    # p.sample ids at most: a proven bound, so they're sent to the tasks that read the texts.
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    h = F.xxhash64("text")
    rows = rows.groupBy(h.alias("h")).agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", F.pmod(F.shiftright("h", 7), F.lit(FOLDS)).cast("int").alias("fold"), "text")

    def split(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 50):
                part = batch.slice(i, 50)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([tokens(x) for x in part.column(2).to_pylist()], pa.list_(pa.string()))], ["y", "fold", "tokens"])

    return cut(rows.mapInArrow(split, "y int, fold int, tokens array<string>"), "toxicity-sample")


def _count(batches):
    """y, fold, tokens -> the documents of each label and fold that have a token or stem. A word that one document repeats tells no more of its label, so it counts once for each document."""
    counts: Counter = Counter()

    def rows():
        names, slots = zip(*counts, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(slots, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["token", "slot", "n"])

    for batch in batches:
        for y, fold, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            slot = 2 * fold + y
            counts.update((f, slot) for f in {f for w in set(words.as_py()) for f in forms(w)})
            if len(counts) > 100_000:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def gains(c0: np.ndarray, c1: np.ndarray, n0: float, n1: float, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Each token's log-odds, brought nearer to 0 by p.z standard deviations, and what it adds to the log-odds of a passage in which a share p.density of words is toxic."""
    prior, mass = p.prior * (c1 + c0), p.prior * (n1 + n0)
    odds = np.log((c1 + prior) / (n1 + mass - c1 - prior)) - np.log((c0 + prior) / (n0 + mass - c0 - prior))
    doubt = p.z * np.sqrt(1 / (c1 + prior) + 1 / (c0 + prior))
    sure = np.sign(odds) * np.maximum(np.abs(odds) - doubt, 0)
    return sure, np.log1p(p.density * np.expm1(np.minimum(sure, 12.0)))


def _lexicons(counts: DataFrame, p: Params) -> list[dict]:
    """Scores of the tokens that aren't neutral: FOLDS times without one of the folds, and of all. They come to the driver: those of at most p.sample documents whose log-odds are sure."""
    total = [float(x or 0) for x in counts.agg(*[F.sum(f"c{i}") for i in range(2 * FOLDS)]).first()]
    slots = [[2 * fold for fold in range(FOLDS) if fold != out] for out in [*range(FOLDS), None]]

    def run(batches):
        for batch in batches:
            c = [batch.column(i + 1).to_numpy() for i in range(2 * FOLDS)]
            stem = np.array([x.endswith("*") for x in batch.column(0).to_pylist()], bool)
            scores = []
            for own in slots:
                n0, n1 = sum(total[i] for i in own), sum(total[i + 1] for i in own)
                c0, c1 = (sum(c[i + y] for i in own) for y in (0, 1))
                score, seen = np.full(len(stem), np.nan), c0 + c1 > 0
                if n0 and n1 and seen.any():
                    sure, gain = gains(c0[seen], c1[seen], n0, n1, p)
                    # A token that speaks against toxicity costs more than a neutral one. Stems only speak for it.
                    score[seen] = np.where(sure > 0.05, gain, np.where((sure < -0.05) & ~stem[seen], gain + math.log1p(-p.density), np.nan))
                scores.append(score)
            some = pa.array(~np.isnan(scores).all(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, scores)], ["token", *(f"g{i}" for i in range(len(slots)))]).filter(some)

    some = counts.mapInArrow(run, "token string, " + ", ".join(f"g{i} double" for i in range(len(slots)))).toArrow()
    names = some.column("token").to_pylist()
    return [{w: x for w, x in zip(names, some.column(f"g{i}").to_pylist(), strict=True) if x == x} for i in range(len(slots))]


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", p: Params = Params()) -> Model:
    """learn: tells from the column of ids which rows may be learnt from. Without labels of both kinds all documents score the share of label 1 (0 without labels)."""
    bounded_batches(docs.sparkSession)
    with scope(docs.sparkSession):
        rows = _training(docs, labels, label, learn, p)
        share = float(rows.agg(F.avg("y")).first()[0] or 0.0)
        flat = Model({}, -1.0, 1.0, 1.0, 0.0, math.log((share + 1e-6) / (1 - share + 1e-6)), p.p_value)
        if not 0 < share < 1:
            return flat
        each = rows.mapInArrow(_count, "token string, slot int, n long")
        counts = cut(each.groupBy("token").agg(*[F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0)).cast("double").alias(f"c{i}") for i in range(2 * FOLDS)]), "toxicity-counts")
        *parts, whole = _lexicons(counts, p)
        if not any(x > 0 for x in whole.values()):
            return flat
        model = Model(whole, math.log1p(-p.density), 1.0, 1.0, 1.0, 0.0, p.p_value)
        # Two passes over the sample, so that a number or two of each document come to the driver, not its segments.
        seen = _held_out(rows, model, parts)
        lam, k = _gumbel(seen[(seen[:, 0] == 0) & (seen[:, 1] > 0)][:, [2, 1]])
        model = replace(model, lam=lam, k=k)
        seen = _held_out(rows, model, parts)
    a, b = _logistic(seen[:, 3], seen[:, 0])
    return replace(model, a=a, b=b)


def _held_out(rows: DataFrame, model: Model, parts: list[dict]) -> np.ndarray:
    """Of each document of the sample, scored without its own fold: label, length, best segment, statistic."""
    shared = rows.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        scores = [Scores(x, model.rest) for x in shared.value]
        for batch in batches:
            out = []
            for y, fold, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = _scored(scores[fold], words := words.as_py())
                out.append((float(y), float(len(words)), max((x[2] for x in found), default=0.0), statistic(model, found, len(words))))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.float64())] * 4, ["y", "n", "best", "x"])

    found = rows.mapInArrow(run, "y double, n double, best double, x double").toArrow()
    shared.destroy()
    return np.stack([found.column(i).to_numpy() for i in range(4)], 1)


def _gumbel(clean: np.ndarray) -> tuple[float, float]:
    """lambda and K by maximum likelihood: P(best segment of n tokens <= x) = exp(-K n exp(-lambda x)). Texts without a positive token are censored at 0.
    The likelihood is searched on a grid of lambda, where K has a closed form; most labels of 0 are right, so the top hundredth isn't used."""
    if len(clean) < 20:
        return 1.0, 0.1
    clean = clean[clean[:, 0] <= np.quantile(clean[:, 0], 0.99)]
    best, n = clean.T
    seen = best > 0
    if not seen.any():  # half a segment seen
        return 1.0, 0.5 / n.sum()
    found = []
    for lam in np.geomspace(0.2, 5, 60):
        k = seen.sum() / (n * np.exp(-lam * best)).sum()
        found.append((seen.sum() * math.log(k * lam) - lam * best[seen].sum() - k * (n * np.exp(-lam * best)).sum(), lam, k))
    return max(found)[1:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Label 1's log-odds as a + line of ln(1 + statistic), by Newton steps with a light ridge; the slope is 0 at least."""
    u = np.log1p(x)
    w = np.zeros(2)
    z = np.stack([u, np.ones_like(u)], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (y - q) - 1e-3 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] >= 0 else (0.0, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))


def score(docs: DataFrame, model: Model, extra: list[str] | None = None, column: str = "text") -> DataFrame:
    """One row per input row: doc_id, the columns of `extra`, score (chance of label 1), p_value_log10 (of the document), n_tokens
    and passages: array of (start, end, text, p_value) of every significant segment, start and end counted in tokens, end not included.
    Null and empty texts have no passage and the lowest score. Rows are independent, so ties and repeats each get their row."""
    bounded_batches(docs.sparkSession)
    extra = extra or []
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tokens that Params.sample documents make sure
    rows = docs.select(F.col("doc_id"), *extra, text_of(column).alias("__text"))
    schema = rows.drop("__text").schema.add("score", "double").add("p_value_log10", "double").add("n_tokens", "long").add("passages", PASSAGES)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("p_value", pa.float64())]))

    def run(batches):
        m = shared.value
        scores = Scores(m.score, m.rest)
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                w = tokens(text)
                found, n = _scored(scores, w), len(w)
                x = statistic(m, found, n)
                significant = []
                for a, b, s in found:
                    pv = -math.expm1(-math.exp(min(50.0, math.log(max(m.k * n, 1e-9)) - m.lam * s)))
                    if pv < m.p_value:
                        significant.append((a, b + 1, pv))
                if significant:
                    significant = [{"start": a, "end": b, "text": " ".join(w[a:b]), "p_value": pv} for a, b, pv in significant]
                out.append((1 / (1 + math.exp(-min(30, max(-30, m.a * math.log1p(x) + m.b)))), -x / math.log(10), n, significant))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.float64(), pa.float64(), pa.int64(), kind))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
