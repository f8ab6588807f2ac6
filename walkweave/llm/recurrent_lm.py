"""Scoring texts with a gated recurrent language model (Cho et al. 2014) trained in numpy by truncated backpropagation through time.

The output softmax is factored into word classes by frequency (Goodman 2001; Mikolov et al. 2011), rare classes into sets of classes (Morin and Bengio 2005). Words outside the network's vocabulary are one output symbol; which of them
it is takes the smoothed relative frequency among all such words of the training texts. Those frequencies cover the whole corpus: the frequent ones
are sent to all tasks, the long tail stays a table and is joined. The state is carried over windows, so a score is that of the complete document.
"""

from __future__ import annotations

import copy
import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from .common import bounded_batches, cut, lists, lower_words
from .common import hashes as hash_words

OTHER, END = 0, 1  # the network's symbols for words that it doesn't have and for the end; words follow


@dataclass(frozen=True)
class Params:
    """vocabulary: the fewest symbols of the network; they grow as twice the square root of the training tokens, up to `most` (a network is held by every task).
    per_class: symbols of an output class. direct: classes that the first softmax tells apart, if there are more than two sets; per_set: classes of a set of the others. hidden: units. sample: about so many training documents by which the network begins (picked by a hash
    of their row numbers; then it learns from all, as the counts do). rounds: after each of so many parts of the documents the shards' networks are averaged and sent out again.
    head: most words whose counts are sent to all tasks. window: steps of truncated backpropagation.
    lanes: most texts trained side by side; the network begins with a quarter of them, and few tokens take fewer. rate: Adam's for that many; it goes by the root of the lanes. piece: steps after which training begins a long text's state anew; scoring never does."""

    vocabulary: int = 2048
    most: int = 8192
    per_class: int = 64
    direct: int = 8
    per_set: int = 16
    hidden: int = 32
    sample: int = 4000
    rounds: int = 2
    head: int = 150_000
    window: int = 32
    lanes: int = 400
    piece: int = 512
    rate: float = 4e-2
    seed: int = 5

    def symbols(self, tokens: int) -> int:
        return max(self.vocabulary, min(self.most, 2 * math.isqrt(tokens)))


@dataclass
class Network:
    """inputs: (V, 3h) what a symbol adds to the update gate, the reset gate and the candidate; state: (h, 3h); gate: (3h);
    first, first_bias: (F, h), (F), the frequent classes and then the sets; sets, set_bias: (S, G, h), (S, G), the classes of a set;
    words, word_bias: (C, K, h), (C, K), where symbol s is word s % K of class s // K."""

    inputs: np.ndarray
    state: np.ndarray
    gate: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    sets: np.ndarray
    set_bias: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.state, self.gate, self.first, self.first_bias, self.sets, self.set_bias, self.words, self.word_bias]

    def path(self, symbols: np.ndarray):
        """How the softmaxes reach each symbol: its place in the first; which go through a set, with their sets and places there; its class and place in the class."""
        cls, word = np.divmod(symbols, self.words.shape[1])
        direct = len(self.first) - len(self.sets)
        deep = np.flatnonzero(cls >= direct)
        group, member = np.divmod(cls[deep] - direct, self.sets.shape[1])
        start = cls.copy()
        start[deep] = direct + group
        return start, deep, group, member, cls, word


def new_network(unigram: np.ndarray, p: Params) -> Network:
    """unigram: each symbol's count. The biases start at the corpus's relative frequencies."""
    rng = np.random.default_rng(p.seed)
    h, k = p.hidden, p.per_class
    c = -(-len(unigram) // k)
    mass = np.zeros(c * k)
    mass[: len(unigram)] = unigram + 0.5
    mass = mass.reshape(c, k)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)

    def bias(mass):
        with np.errstate(divide="ignore"):
            out = np.log(mass / mass.sum(-1, keepdims=True))
        out[np.isneginf(out)] = -60.0  # places without a symbol
        return out.astype(np.float32)

    direct = c if c <= 2 * p.per_set else min(p.direct, c)
    sets = -(-(c - direct) // p.per_set)
    of_class = mass.sum(1)
    of_set = np.append(of_class[direct:], np.zeros(sets * p.per_set - c + direct)).reshape(sets, p.per_set)
    first = np.append(of_class[:direct], of_set.sum(1))
    return Network(
        draw(c * k, 3 * h, scale=0.1), draw(h, 3 * h, scale=1 / math.sqrt(h)), np.zeros(3 * h, np.float32), draw(len(first), h, scale=0.02), bias(first),
        draw(sets, p.per_set, h, scale=0.02), bias(of_set), draw(c, k, h, scale=0.02), bias(mass),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _step(net: Network, h: np.ndarray, added: np.ndarray) -> np.ndarray:
    """The next state. added: what the symbols add, with the gates' biases."""
    n = h.shape[1]
    gates = h @ net.state[:, : 2 * n]
    gates += added[:, : 2 * n]
    _sigmoid(gates)
    c = h @ net.state[:, 2 * n :]
    c *= gates[:, n:]
    c += added[:, 2 * n :]
    np.tanh(c, out=c)
    out = h - c
    out *= gates[:, :n]
    out += c
    return out


def _exp(x: np.ndarray, again) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp of each row (last axis) in place, the rows' sums, and what was taken from the row before: nothing, unless numbers would leave the range of floats. again: makes x anew."""
    if x.max() < 60:
        np.exp(x, out=x)
        total = (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], np.float32)).reshape(x.shape[:-1])
        if total.min() > 1e-30:
            return x, total, 0.0
        x = again()
    most = x.max(-1, keepdims=True)
    x -= most
    np.exp(x, out=x)
    return x, x.sum(-1), most[..., 0]


def _by_group(group: np.ndarray, count: int, least: int = 8, large: int = 128):
    """Places by group, several groups at once: (groups, places of each, -1 where there is none, or None if each place is one). A group of more than `large` places comes alone;
    the others are filled up to `least` times a power of two, so that many small groups need few calls."""
    order = np.argsort(group.astype(np.min_scalar_type(count)), kind="stable")
    sizes = np.bincount(group, minlength=count)
    begin = np.cumsum(sizes) - sizes
    for g in np.flatnonzero(sizes > large):
        yield slice(g, g + 1), order[None, begin[g] : begin[g] + sizes[g]], None
    low, width = 0, least
    while low < large:
        some = np.flatnonzero((sizes > low) & (sizes <= min(width, large)))
        if len(some):
            at = np.arange(width)
            real = at < sizes[some][:, None]
            yield some, np.where(real, order[np.minimum(begin[some][:, None] + at, len(order) - 1)], -1), real
        low, width = width, 2 * width


def _log_softmax_at(seen: np.ndarray, group: np.ndarray, member: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The log probability of each row's member in the softmax of its group."""
    out = np.empty(len(seen))
    k = weights.shape[1]
    for groups, places, real in _by_group(group, len(weights)):
        own, w, b = np.take(seen, places, 0, mode="wrap"), weights[groups].transpose(0, 2, 1), bias[groups][:, None]
        logits = own @ w
        logits += b
        chosen = np.take(logits, np.arange(places.size) * k + np.take(member, places.ravel(), mode="wrap"))
        _, total, taken = _exp(logits, lambda: own @ w + b)  # noqa: B023
        value = chosen.reshape(places.shape) - np.log(total) - taken
        if real is None:
            out[places[0]] = value[0]
        else:
            out[places[real]] = value[real]
    return out


def _softmax_gradient(seen, group, member, scale, weights, bias, back) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of weights and biases, for the sum of scale times minus the log probability of each row's member; the rows' own is added to back."""
    to_weights, to_bias = np.zeros_like(weights), np.zeros_like(bias)
    k = weights.shape[1]
    for groups, places, real in _by_group(group, len(weights)):
        own, w, b = np.take(seen, places, 0, mode="wrap"), weights[groups], bias[groups][:, None]
        s = np.take(scale, places, mode="wrap")
        if real is not None:
            s *= real
        q = own @ w.transpose(0, 2, 1)
        q += b
        q, total, _ = _exp(q, lambda: own @ w.transpose(0, 2, 1) + b)  # noqa: B023
        q *= (s / total)[:, :, None]
        q.reshape(-1)[np.arange(places.size) * k + np.take(member, places.ravel(), mode="wrap")] -= s.ravel()
        to_weights[groups] = q.transpose(0, 2, 1) @ own
        to_bias[groups] = (np.ones((len(q), 1, q.shape[1]), np.float32) @ q)[:, 0]
        up = q @ w
        if real is None:
            back[places[0]] += up[0]
        else:
            back[places[real]] += up[real]
    return to_weights, to_bias


def lanes_of(ids: np.ndarray, offsets: np.ndarray, lanes: int, first: np.ndarray | None = None):
    """Texts end to end in lanes of about equal length: inputs, targets, text of each place (-1: none), whether a text begins there; each (steps, lanes).
    first: the symbol before each text, END unless given."""
    sizes = np.diff(offsets)
    heap = [(0, i) for i in range(lanes)]
    place = np.zeros((len(sizes), 2), np.int64)
    for d in np.argsort(-sizes, kind="stable"):
        used, lane = heapq.heappop(heap)
        place[d] = lane, used
        heapq.heappush(heap, (used + int(sizes[d]), lane))
    steps = max(x for x, _ in heap)
    inputs, targets = np.full((steps, lanes), END, np.int32), np.full((steps, lanes), END, np.int32)
    owner, begins = np.full((steps, lanes), -1, np.int32), np.zeros((steps, lanes), bool)
    for d, (lane, at) in enumerate(place):
        own = ids[offsets[d] : offsets[d + 1]]
        targets[at : at + len(own), lane] = own
        inputs[at + 1 : at + len(own), lane] = own[:-1]
        owner[at : at + len(own), lane] = d
        begins[at, lane] = True
        if first is not None:
            inputs[at, lane] = first[d]
    return inputs, targets, owner, begins


def pieces_of(ids: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut into pieces of `most` symbols: their offsets, and the symbol before each."""
    count = -(-np.diff(offsets) // most)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(offsets[:-1], count) + number * most
    first = np.where(number > 0, ids[np.maximum(begin - 1, 0)], END)
    return np.append(begin, offsets[-1]), first


def log_likelihood(net: Network, ids: np.ndarray, offsets: np.ndarray, window: int = 32) -> np.ndarray:
    """Natural log probability of each text, given as its symbols with the end."""
    count = len(offsets) - 1
    out = np.zeros(count)
    if not count:
        return out
    sizes = np.diff(offsets)
    long_ = sizes > max(len(ids) // 16, 1024)
    if long_.any() and not long_.all():  # beside so long a text all would go in few lanes
        for some in (long_, ~long_):
            own = np.concatenate([ids[a:b] for a, b in zip(offsets[:-1][some], offsets[1:][some], strict=True)])
            out[some] = log_likelihood(net, own, np.concatenate([[0], np.cumsum(sizes[some])]), window)
        return out
    inputs, targets, owner, begins = lanes_of(ids, offsets, int(np.clip(len(ids) // max(int(sizes.max()), 1), 1, 512)))
    h = np.zeros((inputs.shape[1], net.state.shape[0]), np.float32)
    table = net.inputs + net.gate
    for a in range(0, len(inputs), window):
        b = min(a + window, len(inputs))
        kept = np.empty((b - a, *h.shape), np.float32)
        for t in range(a, b):
            h[begins[t]] = 0
            h = kept[t - a] = _step(net, h, np.take(table, inputs[t], 0))
        live = owner[a:b].ravel() >= 0
        seen, target, text = kept.reshape(-1, h.shape[1])[live], targets[a:b].ravel()[live], owner[a:b].ravel()[live]
        start, deep, group, member, cls, word = net.path(target)
        score = _log_softmax_at(seen, np.zeros_like(start), start, net.first[None], net.first_bias[None])
        if len(deep):
            score[deep] += _log_softmax_at(seen[deep], group, member, net.sets, net.set_bias)
        score += _log_softmax_at(seen, cls, word, net.words, net.word_bias)
        out += np.bincount(text, score, count)
    return out


class Learner:
    """Adam over windows of p.window steps; the state goes on from window to window, its gradient doesn't.
    Of the inputs only those of a window's symbols have a gradient, so the others' steps, along their fading moments, are made up for when they are next needed."""

    def __init__(self, net: Network, p: Params):
        self.net, self.p, self.done, self.step = net, p, 0, 0.0
        self.moved = np.zeros(len(net.inputs), np.int64)
        self.parts = net.parts()
        self.rooms: dict = {}
        self.first, self.second = [np.zeros_like(x) for x in self.parts], [np.zeros_like(x) for x in self.parts]

    def once_over(self, inputs, targets, owner, begins, rate) -> None:
        """Lanes as of lanes_of. rate: tells the learning rate from the number of the window."""
        h = np.zeros((inputs.shape[1], self.p.hidden), np.float32)
        for a in range(0, len(inputs), self.p.window):
            w = slice(a, min(a + self.p.window, len(inputs)))
            groups = list(_by_group(inputs[w].ravel(), len(self.net.inputs), 1))
            symbols = np.concatenate([np.arange(x.start, x.stop) if isinstance(x, slice) else x for x, *_ in groups])
            self.make_up(symbols)
            h, grads = self.gradients(h, inputs[w], targets[w].ravel(), (owner[w].ravel() >= 0).astype(np.float32), begins[w], groups)
            norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads))
            self.done += 1
            clip, step = min(1.0, 1 / max(norm, 1e-9)), rate(self.done)
            self.step, self.moved[symbols] = step, self.done
            own = [x[0][symbols] for x in (self.parts, self.first, self.second)]
            self.move(own[0], grads[0], own[1], own[2], clip, step)
            for x, y in zip((self.parts, self.first, self.second), own, strict=True):
                x[0][symbols] = y
            for x, g, m, v in zip(self.parts[1:], grads[1:], self.first[1:], self.second[1:], strict=True):
                self.move(x, g, m, v, clip, step)
        self.make_up(np.arange(len(self.moved)))

    def make_up(self, symbols: np.ndarray) -> None:
        """The steps of these inputs since they were last moved, together, at the present rate."""
        late = self.done - self.moved[symbols]
        symbols, late = symbols[late > 0], late[late > 0][:, None].astype(np.float32)
        if not len(symbols):
            return
        x, m, v = (y[0] for y in (self.parts, self.first, self.second))
        own, spread = m[symbols], v[symbols]
        fading = np.float32(0.9 / math.sqrt(0.99))
        far = self.step / (1 - 0.9**self.done) * fading * (1 - fading**late) / (1 - fading)
        x[symbols] -= far * own / (np.sqrt(spread / np.float32(1 - 0.99**self.done)) + np.float32(1e-7))
        m[symbols] = own * np.float32(0.9) ** late
        v[symbols] = spread * np.float32(0.99) ** late
        self.moved[symbols] = self.done

    def move(self, x, g, m, v, clip: float, step: float, block: int = 1 << 14) -> None:
        """A step of Adam, block by block, so that all of it happens in the cache."""
        x, g, m, v = (y.reshape(-1) for y in (x, g, m, v))
        to_m, to_v = step / (1 - 0.9**self.done), 1 / math.sqrt(1 - 0.99**self.done)
        room = self.room("move", block)
        for a in range(0, len(x), block):
            x_, g_, m_, v_ = (y[a : a + block] for y in (x, g, m, v))
            t = room[: len(x_)]
            if clip < 1:
                g_ *= clip
            np.subtract(g_, m_, out=t)
            t *= 0.1
            m_ += t
            np.multiply(g_, g_, out=t)
            t -= v_
            t *= 0.01
            v_ += t
            np.sqrt(v_, out=t)
            t *= to_v
            t += 1e-7
            np.divide(m_, t, out=t)
            t *= to_m
            x_ -= t

    def room(self, name: str, *shape: int) -> np.ndarray:
        """Memory that all windows of a shape share."""
        if (name, shape) not in self.rooms:
            self.rooms = {k: v for k, v in self.rooms.items() if k[0] != name} | {(name, shape): np.empty(shape, np.float32)}
        return self.rooms[name, shape]

    def gradients(self, h, inputs, target, live, begins, groups):
        """The state after the window, and the gradients in the order of the network's parts; for the inputs only those of the window's symbols, as groups has them."""
        net, n = self.net, self.p.hidden
        steps, (lanes, _) = len(inputs), h.shape
        added = np.take(net.inputs, inputs, 0, out=self.room("added", steps, lanes, 3 * n), mode="clip")
        added += net.gate
        before, c, u, kept = (self.room(x, steps, lanes, n) for x in ("before", "c", "u", "kept"))
        gates = self.room("gates", steps, lanes, 2 * n)
        to_gates, to_u = net.state[:, : 2 * n], net.state[:, 2 * n :]
        anew = [np.flatnonzero(x) for x in begins]
        for t in range(steps):
            b, g, k = before[t], gates[t], kept[t]
            b[:] = h
            if len(anew[t]):
                b[anew[t]] = 0
            np.matmul(b, to_gates, out=g)
            g += added[t, :, : 2 * n]
            _sigmoid(g)
            np.matmul(b, to_u, out=u[t])
            np.multiply(g[:, n:], u[t], out=c[t])
            c[t] += added[t, :, 2 * n :]
            np.tanh(c[t], out=c[t])
            np.subtract(b, c[t], out=k)
            k *= g[:, :n]
            k += c[t]
            h = k
        h = h.copy()
        seen = kept.reshape(-1, n)
        scale = live / np.float32(max(live.sum(), 1))
        start, deep, group, member, cls, word = net.path(target)
        back = np.zeros_like(seen)
        grads = [None] * len(self.parts)
        of_first = _softmax_gradient(seen, np.zeros_like(start), start, scale, net.first[None], net.first_bias[None], back)
        grads[3], grads[4] = (x[0] for x in of_first)
        deeper = np.zeros((len(deep), n), np.float32)
        grads[5], grads[6] = _softmax_gradient(seen[deep], group, member, scale[deep], net.sets, net.set_bias, deeper)
        back[deep] += deeper
        grads[7], grads[8] = _softmax_gradient(seen, cls, word, scale, net.words, net.word_bias, back)
        back = back.reshape(steps, lanes, n)
        # What a step's dh is multiplied by, for all steps at once.
        z, r = np.ascontiguousarray(gates[:, :, :n]), np.ascontiguousarray(gates[:, :, n:])
        rest = 1 - z
        to_c, to_z, to_r = rest * (1 - c * c), (before - c) * z * rest, u * r * (1 - r)
        da, dh = self.room("da", steps, lanes, 3 * n), np.zeros((lanes, n), np.float32)
        du_c = self.room("du_c", steps, lanes, n)
        from_gates, from_u = to_gates.T, to_u.T
        for t in range(steps - 1, -1, -1):
            dh += back[t]
            d = da[t]
            dc = to_c[t]
            dc *= dh
            d[:, 2 * n :] = dc
            np.multiply(dh, to_z[t], out=d[:, :n])
            np.multiply(dc, to_r[t], out=d[:, n : 2 * n])
            dc *= r[t]
            du_c[t] = dc
            dh *= z[t]
            dh += d[:, : 2 * n] @ from_gates
            dh += dc @ from_u
            if len(anew[t]):
                dh[anew[t]] = 0
        da, flat = da.reshape(-1, 3 * n), before.reshape(-1, n)
        grads[1] = np.concatenate([flat.T @ da[:, : 2 * n], flat.T @ du_c.reshape(-1, n)], 1)
        grads[2] = np.ones(len(da), np.float32) @ da
        of_symbols = []
        for _, places, real in groups:
            weight = np.ones(places.shape, np.float32) if real is None else real.astype(np.float32)
            of_symbols.append((weight[:, None] @ np.take(da, places, 0, mode="wrap"))[:, 0])
        grads[0] = np.concatenate(of_symbols)
        return h, grads


@dataclass
class Model:
    """head: hashes of the most frequent words, ascending; head_count: their counts; symbol: the network's symbol of each. tokens, types: of all training tokens,
    with the end. other: normaliser of the words that the network doesn't have. ends: training documents. tail: DataFrame (word, c) of all counts."""

    network: Network
    head: np.ndarray
    head_count: np.ndarray
    symbol: np.ndarray
    tokens: int
    types: int
    other: int
    ends: int
    tail: DataFrame | None = None


def fit(docs: DataFrame, learn, p: Params = Params(), column: str = "text") -> Model:
    """learn: tells from the column of ids which rows to learn from. Counts cover all of them; without any, every word is unknown."""
    bounded_batches(docs.sparkSession)
    hashes = hash_words(lower_words(F.col(column)))
    training = docs.where(learn(F.col("doc_id")))
    counts = cut(training.select(F.explode(hashes).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c")), "lm-counts")
    ends = training.count()
    words, types = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    head = counts.orderBy(F.desc("c"), "word").limit(p.head).toArrow()
    word, count = head.column("word").to_numpy(), head.column("c").to_numpy()
    order = np.lexsort((word, -count))
    own = order[: p.symbols(words + ends) - 2]
    symbol = np.zeros(len(word), np.int32)
    symbol[own] = np.arange(len(own)) + 2
    rest = words - int(count[own].sum())
    unigram = np.concatenate([[rest, ends], count[own]]).astype(float)
    by_hash = np.argsort(word)
    model = Model(new_network(unigram, p), word[by_hash], count[by_hash], symbol[by_hash], words + ends, types + (ends > 0), rest + types - len(own) + 1, ends, counts)
    if ends:
        # A network that one task has taught by a few documents is where all shards begin; then every training document is learnt from.
        dealt = training.select(F.col(column), F.xxhash64(F.monotonically_increasing_id()).alias("part"))
        some = dealt.where(F.pmod("part", F.lit(1 << 20)) < min(1.0, p.sample / ends) * (1 << 20))
        model.network = learn_all(some.select(hashes.alias("w")).repartition(1), model, p, p.lanes // 4)
        for i in range(p.rounds):
            mine = dealt.where(F.pmod(F.shiftright("part", 20), F.lit(p.rounds)) == i)
            model.network = learn_all(mine.select(hashes.alias("w")), model, p, p.lanes)
    return model


def learn_all(rows: DataFrame, model: Model, p: Params, lanes: int, chunk: int = 400_000, block: int = 4096) -> Network:
    """Each task learns from all of its rows (hashed words), beginning with the model's network; the networks are averaged by the tokens that each has seen.
    The number of shards grows with the input. chunk: tokens that a task holds at once, whole documents. block: numbers of a network in a row of the result. Without rows the network stays."""
    spark = rows.sparkSession
    symbols = _symbols(model)
    shared = spark.sparkContext.broadcast(model.network)

    def shard(batches):
        net = copy.deepcopy(shared.value)
        learner, seen = Learner(net, p), 0
        for ids, offsets in chunks(symbols(pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(0)], ["doc_id", "w"]) for b in batches)):
            offsets, first = pieces_of(ids, offsets, p.piece)
            own = max(1, min(lanes, len(ids) // (2 * p.piece), len(first)))
            scale = math.sqrt(own / p.lanes)
            learner.once_over(*lanes_of(ids, offsets, own, first), lambda done: p.rate * scale * min(1.0, done / 20) / (1 + done * scale / 100))  # noqa: B023
            seen += len(ids)
        if seen:
            flat = np.concatenate([x.ravel() for x in net.parts()])
            cells = [flat[i : i + block].tobytes() for i in range(0, len(flat), block)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int64()), pa.array([seen] * len(cells), pa.int64()), pa.array(cells, pa.binary())], ["block", "seen", "x"])

    def chunks(batches):
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch.column(1))
            size += len(batch.column(1).values)
            if size >= chunk:
                yield lists(pa.chunked_array(waiting))
                waiting, size = [], 0
        if size:
            yield lists(pa.chunked_array(waiting))

    def add(batches):
        """Sums of a task's blocks; only the sums are held."""
        total = {}
        for batch in batches:
            for b, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = n * np.frombuffer(x, np.float32).astype(np.float64)
                weight, sums = total.get(b, (0, 0.0))
                total[b] = weight + n, sums + own
        for b, (n, x) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([(x / n).astype(np.float32).tobytes()], pa.binary())], ["block", "x"])

    cells = rows.mapInArrow(shard, "block long, seen long, x binary").repartition("block").sortWithinPartitions("block", "seen", "x")
    found = cells.mapInArrow(add, "block long, x binary").toArrow().sort_by("block")
    shared.destroy()
    if not found.num_rows:
        return model.network
    flat = np.concatenate([np.frombuffer(x, np.float32) for x in found.column("x").to_pylist()])
    parts = model.network.parts()
    ends = np.cumsum([x.size for x in parts])
    return Network(*(flat[e - x.size : e].reshape(x.shape).copy() for e, x in zip(ends, parts, strict=True)))


def _look_up(head: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Each word's place in the head, or -1."""
    if not len(head):
        return np.full(len(flat), -1)
    at = np.minimum(np.searchsorted(head, flat), len(head) - 1)
    return np.where(head[at] == flat, at, -1)


def _with_ends(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(symbols, offsets[1:], END), offsets + np.arange(len(offsets))


def _symbols(model: Model):
    own = model.symbol != OTHER
    head, symbol = model.head[own], model.symbol[own]

    def run(batches):
        for batch in batches:
            flat, offsets = lists(batch.column(1))
            at = _look_up(head, flat)
            ids, offsets = _with_ends(np.where(at >= 0, symbol[at] if len(symbol) else 0, OTHER).astype(np.int32), offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["doc_id", "s"])

    return run


LINES = StructType().add("uid", LongType()).add("doc_id", LongType()).add("held_out", BooleanType()).add("mark", LongType()).add("word", LongType()).add("n", LongType())
for _name, _kind in (("n_tokens", LongType()), ("n_known", LongType()), ("base", DoubleType()), ("score", DoubleType())):
    LINES.add(_name, _kind)


def score(docs: DataFrame, model: Model, held_out: Column, column: str = "text", chunk: int = 800_000, long_: int = 1500) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Null counts as the empty text, whose only token is the end.
    Repeated rows are scored each on their own. chunk: tokens that a task holds at once, whole documents. long_: words of a text from which it is held with other long ones, so at most two chunks wait."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tail, model.tail = model.tail, None
    shared = spark.sparkContext.broadcast(model)  # Params bounds the head and the network
    model.tail = tail
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), hash_words(lower_words(F.col(column))).alias("w"))

    def lines(keys, flat, offsets, m: Model):
        """Of each document a line with what is known here (mark 1), and a line for each of its words outside the head."""
        count = len(offsets) - 1
        doc = np.repeat(np.arange(count), np.diff(offsets))
        at = _look_up(m.head, flat)
        inside = at >= 0
        symbols = np.where(inside, m.symbol[at] if len(m.symbol) else 0, OTHER).astype(np.int32)
        ids, starts = _with_ends(symbols, offsets)
        likely = log_likelihood(m.network, ids, starts) / math.log(10)
        log_c = np.zeros(len(flat))
        if len(m.head):
            log_c[inside] = np.log10(m.head_count[at[inside]] + 1.0)
        n_tokens = np.diff(offsets) + 1
        base = np.bincount(doc, log_c, count) + math.log10(m.ends + 1) - n_tokens * math.log10(m.tokens + m.types + 1)
        others = symbols == OTHER
        mine = others & inside  # the rest of them is added where the tail's counts are known
        likely += np.bincount(doc[mine], log_c[mine] - math.log10(max(m.other, 1)), count)
        known = np.bincount(doc[inside], minlength=count) + (m.ends > 0)
        out = ~inside
        pairs = np.stack([doc[out], flat[out]], 1)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(1)
        begin = np.flatnonzero(new)
        times, pairs = np.diff(np.append(begin, len(pairs))), pairs[begin]
        uid, doc_id, held = keys
        nulls = pa.nulls(len(pairs), pa.int64())
        join = lambda a, b: pa.concat_arrays([a, b])
        ints = lambda a: pa.array(np.asarray(a, np.int64))
        columns = [
            join(uid, uid.take(ints(pairs[:, 0]))), join(doc_id, nulls), join(held, pa.nulls(len(pairs), pa.bool_())),
            ints(np.concatenate([np.ones(count), np.zeros(len(pairs))])), join(uid, ints(pairs[:, 1])), ints(np.concatenate([np.zeros(count), times])),
            join(ints(n_tokens), nulls), join(ints(known), nulls), join(pa.array(base), pa.nulls(len(pairs), pa.float64())), join(pa.array(likely), pa.nulls(len(pairs), pa.float64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=LINES.names)

    def run(batches):
        m, waiting, size = shared.value, ([], []), [0, 0]
        for batch in batches:
            # Long texts go side by side with long ones: beside short ones most lanes would stand empty.
            far = pc.greater(pc.list_value_length(batch.column(3)), long_)
            for i, some in enumerate((batch.filter(pc.invert(far)), batch.filter(far))):
                waiting[i].append(some)
                size[i] += len(some.column(3).flatten())
                if size[i] >= chunk:
                    yield from flush(waiting[i], m)
                    waiting[i].clear()
                    size[i] = 0
        for some in waiting:
            yield from flush(some, m)

    def flush(waiting, m):
        if waiting:
            table = pa.Table.from_batches(waiting).combine_chunks()
            if table.num_rows:
                flat, offsets = lists(table.column(3))
                yield lines([table.column(i).combine_chunks() for i in range(3)], flat, offsets, m)

    found = rows.mapInArrow(run, LINES)
    least = int(model.head_count.min()) if len(model.head) else 0
    outside = model.tail.where(F.col("c") <= least).select("word", "c", F.lit(0).cast("long").alias("mark"))
    # A document's own line has its row number for a word, so such lines spread over all tasks and meet nothing.
    joined = found.join(outside, ["word", "mark"], "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 1)
    out = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(F.col("n") * log_c)).alias("base_score"), (F.max("score") + F.sum(F.col("n") * (log_c - math.log10(max(model.other, 1))))).alias("score"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
