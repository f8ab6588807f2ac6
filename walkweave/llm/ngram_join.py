"""Joining documents whose word n-gram sets are alike, by parity sketches.

A set is sketched by parities: every shingle flips one bit. Bits that differ between two sketches are at most the shingles in which the sets differ, and a Jaccard
similarity of t bounds those by (1 - t) / (1 + t) of both sizes. So a sketch is cut into more blocks than that, and two sets that link have a block in which nothing was flipped apart
(pigeonhole). Blocks are wide and nearly empty, so they are kept as the XOR of a random number per set bit, and joined by it; each size band has its own cut. A short
sketch of plain bits then rules candidates out by Hamming distance, and what is left is verified on the sets themselves.

A block that is empty in both sets tells nothing and isn't joined. A set that fills too few blocks for that to be safe also goes through further cuts of other seeds, where it meets its like.

Sets that link agree in all of their filled blocks but so many as were flipped apart. A key that many sets have (of a passage that many texts share) is therefore needed only by a set whose common keys
are that many themselves, and of these keys the rarest are enough (prefix filter: Chaudhuri, Ganti and Kaushik 2006). What is left in large groups are families of texts that are alike nearly as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, lists, lower_words, mix, odd, parts_for, release, same_row, scaled, scope, text_of
from .common import hashes as hash_words
from .components import connected_components

SEEDS = 32
#: Groups of so many sets at most give all their pairs; of larger ones each set is tried with the group's first one, and only what stays apart then is compared further.
SMALL = 16
#: A larger group is compared by pairs of tiles of so many sets, each pair in a task.
TILE = 2048
#: A key's low bits: a number for the cut (the set's own or the next lower band, the seed), and how many filled blocks two sets that link have in common at least.
SLACK, CUT = 14, 6
LOW = np.uint64((1 << SLACK + CUT) - 1)


@dataclass(frozen=True)
class Params:
    """n: words of a shingle. A pair links if den * intersection >= num * union. id_bits: of a set's number; sets whose numbers clash are told apart by a second one.
    probe: one set in so many tells which keys are too common to go to one owner."""

    n: int = 5
    num: int = 80
    den: int = 100
    id_bits: int = 64
    probe: int = 64


@lru_cache(maxsize=8)
def edges(num: int, den: int, most: int = 1 << 40) -> np.ndarray:
    """First size of each band. A set links with sets of its own and the neighbouring bands only."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * den // num + 1)
    return np.array(out, np.int64)


def apart(band: int, p: Params) -> int:
    """Most shingles by which two sets of this band, or one of it and a larger one, differ if they link."""
    a = int(edges(p.num, p.den)[band + 1]) - 1
    return (p.den - p.num) * (a + a * p.den // p.num) // (p.den + p.num)


def most_apart(m, n, p: Params):
    """The same for two sets of these very sizes."""
    return (p.den - p.num) * (m + n) // (p.den + p.num)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the distinct n-grams, ascending; of fewer words, the whole sequence as one."""
    m = min(n, len(words))
    if not m:
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - m + 1, odd(64 + m), np.uint64)
    for i in range(m):
        h += words[i : len(words) - m + 1 + i] * odd(i)
    return np.unique(mix(h))


def blocks(s: np.ndarray, band: int, p: Params, lower: int = 0) -> np.ndarray:
    """Keys of the set's filled blocks in the cut of a band. lower: 1 if it isn't the set's own band."""
    most = apart(band, p)
    if not most:
        return np.zeros(0, np.uint64)  # only equal sets link
    count = most + 1 + max(2, most // 8)
    out = []
    for seed in range(SEEDS):
        h = mix(s ^ odd(200 + seed))
        place = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        content = np.zeros(count, np.uint64)
        np.bitwise_xor.at(content, place.astype(np.int64), mix(h + odd(3)))
        filled = np.flatnonzero(content)
        key = mix(content[filled] + filled.astype(np.uint64) * odd(7) + scaled(band * SEEDS + seed, 9))
        low = (lower * SEEDS + seed) << SLACK | min(max(len(filled) - most, 0), (1 << SLACK) - 1)
        out.append(key & ~LOW | np.uint64(low))
        if len(filled) > most:
            return np.concatenate(out)
    # Too few blocks under every seed, which no set of this many shingles comes to but by a chance below 1e-20: such sets of a band meet in one group.
    return np.concatenate([*out, mix(np.array([band], np.uint64) * odd(11)) & ~LOW | np.uint64(lower * SEEDS << SLACK)])


def sketch(s: np.ndarray, band: int, p: Params) -> bytes:
    """Plain parity bits for the Hamming distance: a power of two, at least 32 for each shingle that may differ. A longer sketch folds into a shorter one of the same set."""
    bits = max(64, 1 << (32 * apart(band, p) - 1).bit_length())
    bit = mix(s ^ odd(300)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches, one to a row, brought to so many words: the XOR of their parts."""
    return np.bitwise_xor.reduce(x.reshape(*x.shape[:-1], -1, words), axis=-2)


def _sets(batch: pa.RecordBatch, column: int, p: Params):
    flat, offsets = lists(batch.column(column))
    flat = flat.view(np.uint64)
    for i in range(len(offsets) - 1):
        yield shingles(flat[offsets[i] : offsets[i + 1]], p.n)


def band_of(s: np.ndarray, p: Params) -> int:
    return int(np.searchsorted(edges(p.num, p.den), len(s), "right")) - 1


def set_ids(s: np.ndarray, p: Params) -> tuple[np.uint64, np.uint64]:
    """Two numbers of a set: the first names it, the second tells clashes of the first."""
    if not len(s):
        return np.uint64(0), np.uint64(0)
    one, two = (mix(mix(s ^ odd(seed)).sum(dtype=np.uint64, keepdims=True) + scaled(len(s), seed))[0] for seed in (21, 22))
    return one >> np.uint64(64 - p.id_bits), two


def _describe(p: Params):
    """uid, doc_id, words -> uid, doc_id, n, set, check."""

    def run(batches):
        for batch in batches:
            found = [(len(s), *set_ids(s, p)) for s in _sets(batch, 2, p)]
            n, one, two = (np.array([x[i] for x in found], np.uint64).view(np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(one), pa.array(two)], ["uid", "doc_id", "n", "set", "check"])

    return run


def _keys(batches, column: int, p: Params, clashes: frozenset):
    """Per batch, the keys of its sets that are new in the task, and the sets they belong to."""
    seen: set[int] = set()
    for batch in batches:
        keys, ids = [], []
        for s in _sets(batch, column, p):
            if not len(s):
                continue
            one, two = map(int, set_ids(s, p))
            one = two if one in clashes else one
            if one in seen:
                continue
            seen.add(one)
            band = band_of(s, p)
            own = np.concatenate([blocks(s, band - i, p, i) for i in (0, 1) if band >= i])
            keys.append(own)
            ids.append(np.full(len(own), one, np.uint64))
        if sum(map(len, keys)):
            yield np.concatenate(keys), np.concatenate(ids)


def _probe(p: Params, clashes: frozenset):
    """words -> keys."""

    def run(batches):
        for keys, _ in _keys(batches, 0, p, clashes):
            yield pa.RecordBatch.from_arrays([pa.array((keys & ~LOW).view(np.int64))], ["key"])

    return run


def _send(p: Params, owners: int, clashes: frozenset, giants: np.ndarray):
    """words -> for each owner of a range of keys, the keys and sets of this batch, side by side in two blobs. The sets of a giant key go to all owners, each to one."""

    def run(batches):
        for keys, ids in _keys(batches, 0, p, clashes):
            giant = np.isin(keys & ~LOW, giants)
            owner = ((np.where(giant, mix(keys ^ ids), keys) >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
            order = np.argsort(owner, kind="stable")
            keys, ids, owner = keys[order], ids[order], owner[order].astype(np.int32)
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            end = np.append(begin[1:], len(owner))
            yield pa.RecordBatch.from_arrays([pa.array(owner[begin]), *(pa.array([x[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()) for x in (keys, ids))], ["owner", "keys", "sets"])

    return run


def _meet(giants: np.ndarray):
    """An owner's groups of sets with the same key. One row: pairs in small groups and how many keys each shares here, and of large groups the keys, their members and sizes; all as blobs.
    Giant keys, of which an owner has a part, count as larger than all others."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        full = np.concatenate([np.frombuffer(x, np.uint64) for x in group["keys"]])
        ids = np.concatenate([np.frombuffer(x, np.uint64) for x in group["sets"]])
        keys = full & ~LOW
        order = np.lexsort((ids, keys))
        full, keys, ids = full[order], keys[order], ids[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        full, keys, ids = full[new], keys[new], ids[new]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(keys)))
        giant = np.isin(keys[begin], giants)
        left, right = [], []
        for g in range(2, SMALL + 1):
            at = begin[(size == g) & ~giant]
            for i in range(g):
                for j in range(i + 1, g):
                    left.append(ids[at + i])
                    right.append(ids[at + j])
        a = np.concatenate(left) if left else np.zeros(0, np.uint64)
        b = np.concatenate(right) if right else np.zeros(0, np.uint64)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(a)))
        large = np.repeat((size > SMALL) | giant, size)
        sizes = np.repeat(np.where(giant, np.int64(1) << 40, size), size)[large]
        blobs = a[first], b[first], times.astype(np.int32), full[large], ids[large], sizes.astype(np.int64)
        return pd.DataFrame({k: [x.tobytes()] for k, x in zip(("a", "b", "n", "key", "set", "size"), blobs, strict=True)})

    return run


def _open(names: list[str], kinds: list):
    """Blobs -> rows."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(j)[i].as_py(), t)) for j, t in enumerate(kinds)], names)

    return run


def _sketches(p: Params):
    """set, words -> set, n, band, bits."""

    def run(batches):
        for batch in batches:
            found = [(len(s), band_of(s, p), s) for s in _sets(batch, 1, p)]
            bits = [sketch(s, band, p) for _, band, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array(bits, pa.binary())], ["set", "n", "band", "bits"])

    return run


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1)


def _near(p: Params):
    """Candidate pairs with sketches -> those that may link by size and Hamming distance."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            a, b = batch.column(batch.schema.get_field_index("x")).to_pylist(), batch.column(batch.schema.get_field_index("y")).to_pylist()
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                if y["band"] < x["band"]:
                    x, y = y, x
                if y["band"] - x["band"] > 1:
                    continue
                x_bits, y_bits = np.frombuffer(x["bits"], np.uint64), np.frombuffer(y["bits"], np.uint64)
                keep[i] = max(x["n"], y["n"]) * p.num <= min(x["n"], y["n"]) * p.den and hamming(x_bits, fold(y_bits, len(x_bits))) <= most_apart(x["n"], y["n"], p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2)], ["a", "b", "n"]).filter(pa.array(keep))

    return run


def _verify(p: Params):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            (x, ox), (y, oy) = lists(batch.column(2)), lists(batch.column(3))
            for i in range(batch.num_rows):
                s, t = x[ox[i] : ox[i + 1]], y[oy[i] : oy[i + 1]]
                same = len(np.intersect1d(s, t, assume_unique=True))
                keep[i] = same * p.den >= (len(s) + len(t) - same) * p.num
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep)], ["a", "b", "linked"])

    return run


def _stray(p: Params, tries: int):
    """A large group that has sets of several components, or two tiles of one (side 0 and 1: only sets of different sides are compared) -> pairs of different ones that may link: those of a forest over the components, the likeliest first, and others until each of
    their sets has had `tries`. `tested` pairs aren't tried again. A row with left (0, 0, true) tells that the group has more to try."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, left_over = group.reset_index(drop=True), False
        sets, roots, side = group["set"].to_numpy(), group["root"].to_numpy(), group["side"].to_numpy()
        two = side.any()
        tested = [np.array(row, np.int64) for row in group["tested"]]
        near = []
        for low in sorted(group["band"].unique()):
            x = np.flatnonzero(group["band"] == low)
            width = len(group["bits"][x[0]]) // 8
            bits = np.stack([np.frombuffer(v, np.uint64) for v in group["bits"][x]])
            for high in (low, low + 1):
                y = np.flatnonzero(group["band"] == high)
                if not len(y):
                    continue
                other = bits if high == low else fold(np.stack([np.frombuffer(v, np.uint64) for v in group["bits"][y]]), width)
                n = group["n"].to_numpy()[y]
                for i, own in zip(x, bits, strict=True):
                    m = int(group["n"][i])
                    at = np.flatnonzero((roots[y] != roots[i]) & (np.maximum(m, n) * p.num <= np.minimum(m, n) * p.den) & ((y > i) | (high != low)) & ((side[y] != side[i]) | (not two)))
                    if len(tested[i]):
                        at = at[~np.isin(sets[y[at]], tested[i])]
                    left = np.concatenate([np.zeros(0, np.int64), *(most_apart(m, n[part], p) - hamming(other[part], own) for part in np.split(at, range(4096, len(at), 4096)))])
                    at, left = at[left >= 0], left[left >= 0]
                    # A set's likeliest few: all would be too many to hold. What isn't tried now is in the next round.
                    best = np.argsort(-left, kind="stable")[: max(2, tries)]
                    left_over |= len(best) < len(at)
                    near += [(-int(k), int(i), int(y[j])) for k, j in zip(left[best], at[best], strict=True)]
        out, parent, tried = [], {}, [0] * len(group)

        def top(r):
            while parent.get(r, r) != r:
                r = parent[r]
            return r

        for _, i, j in sorted(near):
            pair = (min(int(sets[i]), int(sets[j])), max(int(sets[i]), int(sets[j])))
            a, b = top(roots[i]), top(roots[j])
            if a != b or min(tried[i], tried[j]) < tries:
                parent[max(a, b)] = min(a, b)
                tried[i] += 1
                tried[j] += 1
                out.append((*pair, False))
            else:
                left_over = True
        if left_over:
            out.append((0, 0, True))
        return pd.DataFrame(out, columns=["a", "b", "left"]).astype({"a": "int64", "b": "int64", "left": bool})

    return run


def classes(docs: DataFrame, p: Params = Params(), column: str = "text", send_ids: int = 1_000_000, with_root: bool = False, one_task: int = 1_000_000) -> DataFrame:
    """One row per input row: uid (its number), doc_id, n_shingles, component_id (smallest doc_id reachable by links).
    with_root: also root, a number that the rows of a component share and no others have; null for a row without shingles.

    Texts are lower-cased in A-Z. Null and blank texts have no shingles and link with nothing: their component is themselves. Equal sets are one from the start, so copies cost nothing.
    Repeated rows are documents of their own with the same id. No rows give none. Words and shingles are compared by hashes of 64 bits, so two texts of m and n shingles are misjudged with a chance of m * n / 2^64.
    The rows are read several times; an error tells if they changed. send_ids: up to so many ids of sets to be looked at again (8 bytes each) are sent to all tasks that read texts; more are joined.
    one_task: of connected_components()."""
    with scope(docs.sparkSession):
        out = _classes(docs, p, column, send_ids, one_task)
        return cut(out, "join-classes", keep=True).select("uid", "doc_id", "n_shingles", "component_id", *["root"] * with_root)


def _giants(rows: DataFrame, p: Params, clashes: frozenset, hashes) -> np.ndarray:
    """Keys that more than about a 10,000th of all the probed ones are: at most 10,000, so they're sent to all tasks."""
    probed = rows.where(F.pmod(F.xxhash64("uid"), F.lit(p.probe)) == 0).select(hashes).mapInArrow(_probe(p, clashes), "key long")
    counts = cut(probed.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "join-probe")
    total = counts.agg(F.sum("c")).first()[0] or 0
    found = counts.where(F.col("c") > max(SMALL, total / 10_000)).select("key").toArrow().column("key").to_numpy()
    return np.sort(found.view(np.uint64))


def _classes(docs: DataFrame, p: Params, column: str, send_ids: int, one_task: int) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text_of(column).alias("text"))
    hashes = hash_words(lower_words(F.col("text"))).alias("w")
    table = cut(rows.select("uid", "doc_id", hashes).mapInArrow(_describe(p), "uid long, doc_id long, n long, set long, check long"), "join-rows")
    number = lambda some: some.groupBy("set").agg(F.min(F.struct("uid", "doc_id")).alias("row"), F.first("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
    sets = cut(number(table.where("n > 0")), "join-sets")
    # Of n sets about n^2 / 2^65 pairs clash: three among 10^10.
    clashes = frozenset(r[0] & (1 << 64) - 1 for r in sets.where("low <> high").select("set").collect())
    if clashes:
        table = table.withColumn("set", F.when(F.col("set").isin([x - (1 << 64) if x >> 63 else x for x in clashes]), F.col("check")).otherwise(F.col("set")))
        sets = cut(number(table.where("n > 0")), "join-sets")
    # About a third of a text's shingles become keys.
    total = sets.agg(F.sum("n")).first()[0] or 0
    owners = 4 * parts_for(spark, total // 3, 2_000_000)
    giants = _giants(rows, p, clashes, hashes)
    sent = rows.select(hashes).mapInArrow(_send(p, owners, clashes, giants), "owner int, keys binary, sets binary")
    met = cut(sent.groupBy("owner").applyInPandas(_meet(giants), "a binary, b binary, n binary, key binary, set binary, size binary"), "join-met")
    release(spark)
    pairs = met.select("a", "b", "n").mapInArrow(_open(["a", "b", "n"], [np.int64, np.int64, np.int32]), "a long, b long, n int")
    hot = met.select("key", "set", "size").where(F.length("key") > 0).mapInArrow(_open(["full", "set", "size"], [np.int64] * 3), "full long, set long, size long")
    hot = hot.select("set", "size", F.shiftright("full", SLACK).bitwiseAND((1 << CUT) - 1).alias("cut"), F.col("full").bitwiseAND((1 << SLACK) - 1).cast("int").alias("slack"), F.col("full").bitwiseAND(~int(LOW)).alias("key"))
    # A set's common keys: at most its filled blocks, so a list holds them.
    own = hot.groupBy("set", "cut").agg(F.max("slack").alias("slack"), F.sort_array(F.collect_list(F.struct("size", "key"))).alias("k"))
    few = F.when(F.col("slack") < 2, F.size("k")).otherwise(F.size("k") - F.col("slack") + 1)
    needed = own.withColumn("few", few).where("few > 0").select("set", F.explode(F.slice("k", 1, F.col("few"))["key"]).alias("key")).distinct()
    needed = cut(needed, "join-needed")
    # Groups with the same first set are one: a family of texts has the same members under most of its keys.
    centers = needed.groupBy("key").agg(F.min("set").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "a")
    groups = cut(needed.join(centers, "key").groupBy(F.col("a").alias("key"), "set").agg(F.count(F.lit(1)).alias("n")), "join-groups")
    pairs = pairs.union(groups.where("key <> set").select(F.col("key").alias("a"), F.col("set").alias("b"), "n"))
    groups = cut(groups.select("key", "set").join(groups.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key"), "join-groups")
    pairs = cut(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "join-pairs")

    def texts_of(ids: DataFrame) -> DataFrame:
        """set, words of one row of each of these sets."""
        found = cut(ids.distinct().join(sets.select("set", F.col("row.uid").alias("uid"), F.col("row.doc_id").alias("was")), "set"), "join-wanted")
        found = F.broadcast(found) if found.count() <= send_ids else found
        read = rows.join(found, "uid")
        return read.select(same_row(read, "doc_id", "was", "set").alias("set"), hashes)

    either = lambda some: some.select(F.col("a").alias("set")).union(some.select(F.col("b").alias("set")))
    sketches = cut(texts_of(either(pairs)).mapInArrow(_sketches(p), "set long, n long, band int, bits binary"), "join-sketches")
    side = lambda end, name: sketches.select(F.col("set").alias(end), F.struct("n", "band", "bits").alias(name))
    candidates = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "n", "x", "y").mapInArrow(_near(p), "a long, b long, n long")
    candidates = cut(candidates, "join-candidates")

    def verify(some: DataFrame) -> DataFrame:
        some = cut(some.select("a", "b"), "join-tried")

        def shingle(batches):
            for batch in batches:
                own = list(_sets(batch, 1, p))
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["set", "s"])

        whole = cut(texts_of(either(some)).mapInArrow(shingle, "set long, s array<long>"), "join-shingles")
        both = some.join(whole.select(F.col("set").alias("a"), F.col("s").alias("x")), "a").join(whole.select(F.col("set").alias("b"), F.col("s").alias("y")), "b")
        return cut(both.select("a", "b", "x", "y").mapInArrow(_verify(p), "a long, b long, linked boolean"), "join-verified")

    def with_roots(some: DataFrame, roots: DataFrame) -> DataFrame:
        """Adds ra, rb, the ends' components so far."""
        r = lambda end, name: roots.select(F.col("node").alias(end), F.col("root").alias(name))
        both = some.join(r("a", "ra"), "a", "left").join(r("b", "rb"), "b", "left")
        return both.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})

    def joined_by(roots: DataFrame, links: DataFrame) -> DataFrame:
        """The components once these links are added: only their ends' roots take part."""
        moved = connected_components(with_roots(links, roots).select(F.col("ra").alias("a"), F.col("rb").alias("b")), one_task)
        moved = cut(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "join-moved")
        old = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        return cut(old.union(moved.select(F.col("root").alias("node"), F.col("to").alias("root")).join(roots, "node", "left_anti")), "join-roots")

    release(spark)
    # Each set is first tried with the one with which it shares the most keys; of the other pairs only those that lie in different components then have to be tried.
    best = candidates.groupBy("b").agg(F.max_by("a", F.col("n")).alias("a")).select("a", "b")
    tested = verify(best)
    roots = cut(connected_components(tested.where("linked"), one_task), "join-roots")
    others = with_roots(candidates.select("a", "b"), roots).where("ra <> rb").join(tested.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")
    others = cut(others, "join-others")
    if not others.isEmpty():
        new = verify(others)
        tested = cut(tested.union(new), "join-tested")
        roots = joined_by(roots, new.where("linked").select("a", "b"))
    release(spark)
    tries, known = 8, None
    while True:
        if known is None:
            known = groups.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").select("key", "set", "size", F.coalesce("root", "set").alias("root"))
            split = known.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
            known = cut(known.join(split, "key"), "join-groups")
            if known.isEmpty():
                break
        # A set's failed tries go with it. Only sets of groups that aren't one component are here.
        failed = tested.where("not linked").select("a", "b")
        failed = failed.union(failed.select("b", "a")).groupBy(F.col("a").alias("set")).agg(F.collect_set("b").alias("tested"))
        tiles = F.ceil(F.col("size") / TILE).cast("int")
        own = F.pmod(F.xxhash64("set"), tiles).cast("int")
        pair = F.transform(F.sequence(F.lit(0), tiles - 1), lambda i: F.struct(F.least(i, own).alias("i"), F.greatest(i, own).alias("j"), (own > i).cast("int").alias("side")))
        members = known.select("key", "set", "root", F.explode(pair).alias("t")).select("key", "set", "root", "t.*")
        members = members.join(sketches, "set").join(failed, "set", "left").withColumn("tested", F.coalesce("tested", F.array().cast("array<long>")))
        more = cut(members.groupBy("key", "i", "j").applyInPandas(_stray(p, tries), "a long, b long, left boolean").distinct(), "join-stray")
        pairs, done = more.where("not left").select("a", "b"), more.where("left").isEmpty()
        if pairs.isEmpty():
            break
        new = verify(pairs)
        tested = cut(tested.union(new), "join-tested")
        links = new.where("linked").select("a", "b")
        if not links.isEmpty():
            roots = joined_by(roots, links)
            groups, known = known.select("key", "set", "size"), None
        if done:
            break
        tries *= 4
    linked = table.where("n > 0").select("uid", "doc_id", F.col("n").alias("n_shingles"), "set")
    linked = linked.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    columns = ["uid", "doc_id", "n_shingles", "component_id", "root"]
    out = linked.join(least, "root").select(columns)
    alone = table.where("n = 0").select("uid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return out.union(alone.select(columns))
