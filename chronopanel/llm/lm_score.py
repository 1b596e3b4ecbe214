"""Language-model scores: a gated recurrent model with a class-factored softmax, over whole documents."""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: Words of the softmax, its classes, and classes of all other words by their last three bytes.
SHORT, CLASSES, TAILS = 2000, 40, 32
#: Words whose counts every task holds; longer words are looked up by a join. Different words that a task counts at once.
HEAD, HEAD_BYTES, COUNTED = 1 << 18, 64, 400_000
#: Bytes of texts whose words are counted together, and of texts that are split and looked up together.
TOGETHER, LOOKUP = 1 << 24, 1 << 22
EMBED, HIDDEN = 16, 16
#: Lanes and steps of a training window; most lanes and steps of a scoring window; tokens packed into lanes at a time.
TRAIN_LANES, STEPS, LANES, SCORE_STEPS, PACK = 128, 32, 512, 64, 4_000_000
#: Rounds of training: each reads one of ROUNDS parts of the training documents, chosen by a hash. Step size of the first
#: round, and what it is multiplied with from round to round.
ROUNDS, RATE, COOLING = 3, 0.025, 0.8
#: Copies of the model that a round trains apart: the root of the training tokens over this number, rounded up. Tokens that
#: are cut into lanes together.
APART, LESSON = 1_000_000, 500_000
PIECE = 1 << 22
COLUMNS = 512
ONES, PLACES = np.ones(SHORT, np.float32), np.arange(COLUMNS)
SPACE = re.compile(rb"[ \t-\r]")
BLOCK = 1024
#: First word of each class and the end: classes grow with the square of their number, so that frequent words share
#: theirs with few others.
EDGES = np.unique(np.round(SHORT * (np.arange(CLASSES + 1) / CLASSES) ** 2).astype(int))
WIDTH = len(EDGES) - 1
CLASS_OF = np.repeat(np.arange(WIDTH), np.diff(EDGES))
#: What the gates' inputs are multiplied with, as the two logistic gates take exp of the negative.
SIGNS = np.repeat(np.array([-1, -1, 1], np.float32), HIDDEN)[:, None]
CLASS_OF_ID = np.r_[CLASS_OF, WIDTH + np.arange(TAILS)].astype(np.int16)


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def pieces(data: bytes):
    """Lower-cased words of a text, about PIECE bytes at a time."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE and (m := SPACE.search(data, at + PIECE)):
            end = m.start()
        yield data[at:end].lower().split()
        at = end


def words_of(texts):
    """Lower-cased words of an Arrow array of texts (binary, no nulls), one after the other, and where each text's begin."""
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view("string")))
    words, at = split.flatten().cast("binary"), split.value_lengths().to_numpy(zero_copy_only=False)
    some = pc.not_equal(words, b"")  # white space at either end leaves empty words
    held = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))]
    return words.filter(some), held[np.r_[0, np.cumsum(at)]]


def portions(texts, most: int):
    """Slices of an Arrow array of texts with about ``most`` bytes, each text of over PIECE bytes in one of its own."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    lo = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and (size > PIECE or sizes[lo] > PIECE or held + size > most):
            yield texts[lo:i]
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield texts[lo:]


class Vocabulary:
    """Counts of frequent words, and what every token becomes: a softmax word, or a tail class and its share of it."""

    def __init__(self, head: list[tuple[bytes, int]], ends: int, total: int, distinct: int, tails: dict[int, tuple[int, int]]):
        """head: words by falling count; ends: training documents; tails: class -> (count, words) of all words that are not in the softmax."""
        self.short = min(SHORT - 1, len(head))
        self.total, self.distinct = total, distinct
        self.at = {w: i + 1 for i, (w, _) in enumerate(head)}  # 0: the end of a text
        counts = np.array([ends, *(c for _, c in head)], float)
        self.counts = counts
        self.log_count = np.log10(counts + 0.1)
        self.known = counts > 0
        self.input = np.array([*range(self.short + 1), *(SHORT + tail_class(w) for w, _ in head[self.short :])], np.int16)
        mass = np.array([tails.get(k, (0, 0)) for k in range(TAILS)], float)
        self.tail_mass = mass[:, 0]
        self.tail_base = -np.log10(mass[:, 0] + 0.1 * (mass[:, 1] + 1))
        self.base = -np.log10(total + 0.1 * (distinct + 1))

    def codes(self, data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of a text's tokens: places in head (-1: not there), input ids, and the words that are not there."""
        parts, rare, rare_class = [], [], []
        for words in pieces(data):
            got = np.fromiter(map(self.at.get, words, repeat(-1)), np.int32, len(words))
            missing = [words[i] for i in np.flatnonzero(got < 0).tolist()]
            rare += missing
            rare_class += [SHORT + tail_class(w) for w in missing]
            parts.append(got)
        place = np.concatenate([*parts, np.zeros(1, np.int32)])
        ids = self.input[place]
        ids[place < 0] = rare_class
        return place, ids, rare

    def codes_of(self, texts, head) -> tuple[np.ndarray, np.ndarray, np.ndarray, object, np.ndarray]:
        """The same of an Arrow array of texts: places, input ids and the bounds of texts in both, the words that are not
        there and their bounds. head: Arrow array of the words of ``at``."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(texts) == 1 and len(texts[0].as_py()) > PIECE:
            place, ids, rare = self.codes(texts[0].as_py())
            return place, ids, np.array([0, len(ids)]), pa.array(rare, pa.binary()), np.array([0, len(rare)])
        words, at = words_of(texts)
        place = pc.fill_null(pc.index_in(words, value_set=head), -2).to_numpy(zero_copy_only=False) + np.int32(1)
        missing = place < 0
        rare, rare_at = words.filter(pa.array(missing)), np.r_[0, np.cumsum(missing)][at]
        ids = self.input[place]
        ends = pc.binary_slice(rare, -3).dictionary_encode()
        ids[missing] = SHORT + np.array([tail_class(w) for w in ends.dictionary.to_pylist()], np.int16)[ends.indices.to_numpy(zero_copy_only=False)]
        return np.insert(place, at[1:], 0), np.insert(ids, at[1:], 0), at + np.arange(len(at)), rare, rare_at


class Model:
    """A GRU over token ids that predicts a class and, within classes of frequent words, a word.

    The gates' arrays hold features in rows and lanes in columns; the softmax takes a token's state in a row, so that the
    tokens of a class lie together. The last column of the output weights is their bias.
    """

    START = SHORT + TAILS

    def __init__(self, vocabulary: Vocabulary | None = None, flat: np.ndarray | None = None):
        r = np.random.default_rng(7)
        self.p = {
            "emb": r.normal(0, 0.3, (SHORT + TAILS + 1, EMBED)),
            "wx": r.normal(0, EMBED**-0.5, (3 * HIDDEN, EMBED)),
            "wh": r.normal(0, HIDDEN**-0.5, (3 * HIDDEN, HIDDEN)),
            "b": np.zeros(3 * HIDDEN),
            "wc": np.zeros((WIDTH + TAILS, HIDDEN + 1)),
            "wo": np.zeros((SHORT, HIDDEN + 1)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        if vocabulary is not None:  # at first the model is the unigram distribution
            n = vocabulary.short + 1
            counts = np.zeros(SHORT)
            counts[:n] = vocabulary.counts[:n] + 0.1
            by_class = np.add.reduceat(counts, EDGES[:-1])
            mass = np.r_[by_class + 1e-9, vocabulary.tail_mass + 0.1]
            self.p["wc"][:, -1] = np.log(mass / mass.sum())
            share = counts / np.maximum(by_class[CLASS_OF], 1e-9)
            self.p["wo"][:, -1] = np.where(counts > 0, np.log(np.maximum(share, 1e-30)), -1e4)
        if flat is not None:
            at = 0
            for k, v in self.p.items():
                self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def table(self) -> np.ndarray:
        """What each input id adds to the gates, times SIGNS (ids, 3 * HIDDEN)."""
        table = self.p["emb"] @ (self.p["wx"] * SIGNS).T
        table += self.p["b"] * SIGNS[:, 0]
        return table

    def states(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, table: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hidden states and ones (HIDDEN + 1, steps, lanes; a token's lie together) for inputs x (steps, lanes), and the last state;
        fresh marks where a text begins. keep: gets what backward needs, (steps, features, lanes), as a step's numbers
        must lie together: rows that are a power of two apart push each other out of the cache."""
        steps, lanes = x.shape
        x = x.astype(np.intp)
        out = np.empty((steps, lanes, HIDDEN + 1), np.float32)
        out[:, :, HIDDEN] = 1
        added = np.empty((lanes, 3 * HIDDEN), table.dtype)
        wh, held = self.p["wh"] * SIGNS, 1 if keep is None else steps
        gates, by_state = (np.empty((held, 3 * HIDDEN, lanes), table.dtype) for _ in "gs")
        before = np.empty((held + 1, HIDDEN, lanes), table.dtype)
        before[0] = h
        begins = fresh.any(axis=1)
        for t in range(steps):
            k = t % held
            h, after = before[t % len(before)], before[(t + 1) % len(before)]
            if begins[t]:
                h *= ~fresh[t]
            a = np.matmul(wh, h, out=by_state[k])
            g = gates[k]
            np.copyto(g, np.take(table, x[t], axis=0, out=added, mode="clip").T)
            zr, n = g[: 2 * HIDDEN], g[2 * HIDDEN :]
            zr += a[: 2 * HIDDEN]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(zr[HIDDEN:], a[2 * HIDDEN :], out=after)
            n += after
            np.tanh(n, out=n)
            np.subtract(h, n, out=after)
            after *= zr[:HIDDEN]
            after += n
            out[t, :, :HIDDEN] = after.T
        if keep is not None:
            keep |= {"h0": before[:-1], "an": by_state[:, 2 * HIDDEN :], "z": gates[:, :HIDDEN], "r": gates[:, HIDDEN : 2 * HIDDEN], "n": gates[:, 2 * HIDDEN :]}
        return out.transpose(2, 0, 1), before[steps % len(before)]

    def log_probs(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of targets y (class and, if short, word) from columns of h. grad: also adds the
        gradients of the negative sum and returns that with respect to h."""
        # states lie in (-1, 1) and biases are log shares, so exp stays finite below this bound
        clip = max(float((np.abs(w[:, :HIDDEN]).sum(axis=1) + np.maximum(w[:, HIDDEN], 0)).max()) for w in (self.p["wc"], self.p["wo"])) > 60
        order = np.argsort(CLASS_OF_ID[y], kind="stable")  # short words first, by class
        rows, y = np.take(h.T, order, axis=0), y[order]
        cls = CLASS_OF_ID[y]
        bounds = np.searchsorted(cls, np.arange(WIDTH + 1)).tolist()
        n, short = len(y), bounds[-1]
        out = np.empty(n + short, np.float32)  # logits of the classes, then of the words in theirs
        total, dh = np.empty_like(out), np.empty((n + short, HIDDEN), np.float32) if grad is not None else None

        def softmax(name: str, span: slice, k: np.ndarray, lo: int, hi: int, to: int) -> None:
            """Logits and their sums for row k[i] of the span of weights and tokens lo to hi, and gradients, from ``to`` on."""
            w, at = self.p[name][span], slice(to + lo, to + hi)
            v = w @ rows[lo:hi].T
            if clip:
                np.minimum(v, 60, out=v)
            flat, own = v.ravel(), k * np.intp(hi - lo)
            own += PLACES[: hi - lo]
            out[at] = flat[own]
            np.exp(v, out=v)
            np.matmul(ONES[: len(v)], v, out=total[at])
            if grad is not None:
                v /= total[at]
                flat[own] -= 1
                grad[name][span] += v @ rows[lo:hi]
                np.matmul(v.T, w[:, :HIDDEN], out=dh[at])

        for lo in range(0, n, COLUMNS):  # a block of logits stays in the cache
            hi = min(lo + COLUMNS, n)
            softmax("wc", slice(None), cls[lo:hi], lo, hi, 0)
        for c in range(WIDTH):
            for lo in range(bounds[c], bounds[c + 1], COLUMNS):
                hi = min(lo + COLUMNS, bounds[c + 1])
                softmax("wo", slice(EDGES[c], EDGES[c + 1]), y[lo:hi] - EDGES[c], lo, hi, n)
        out -= np.log(np.maximum(total, np.float32(1e-38)))  # a class without counted words has no mass
        out[:short] += out[n:]
        logp = np.empty(n, np.float32)
        logp[order] = out[:n]
        if dh is None:
            return logp, None
        dh[:short] += dh[n:]
        back = np.empty((n, HIDDEN), np.float32)
        back[order] = dh[:n]
        return logp, back.T

    def gradients(self, x: np.ndarray, fresh: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[dict, float, np.ndarray]:
        """Of the mean negative log-probability of one window (steps, lanes), by backpropagation through its steps; the
        state before it is taken as given (truncation)."""
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        keep: dict = {}
        hs, last = self.states(x, fresh, h, self.table(), keep)
        hs, y = hs.reshape(HIDDEN + 1, -1), y.ravel()
        if live.all():
            logp, dh = self.log_probs(hs, y, grad)
        else:
            at = np.flatnonzero(live.ravel())
            dh = np.zeros((x.size, HIDDEN), np.float32).T
            logp, dh[:, at] = self.log_probs(hs.T[at].T, y[at], grad)
        dh = np.ascontiguousarray(dh.T.reshape(*x.shape, HIDDEN).transpose(0, 2, 1))
        h0, an, z, r, n = (keep[k] for k in ("h0", "an", "z", "r", "n"))
        # of a step, with respect to: the candidate's, both gates' inputs and r times the state's part of the candidate; at
        # first without the factor that comes back from later steps
        by = np.empty((len(x), 4, HIDDEN, x.shape[1]), np.float32)
        rest, by_n, by_z, by_r, by_a = (1 - z, *by.transpose(1, 0, 2, 3))
        np.multiply(n, n, out=by_n)
        np.subtract(1, by_n, out=by_n)
        by_n *= rest
        np.subtract(h0, n, out=by_z)
        by_z *= z
        by_z *= rest
        np.multiply(by_n, r, out=by_a)
        np.subtract(1, r, out=by_r)
        by_r *= by_a
        by_r *= an
        flat = by.reshape(len(x), 4 * HIDDEN, -1)
        back, carry, begins = np.ascontiguousarray(self.p["wh"].T), np.zeros_like(last), fresh.any(axis=1)
        for t in range(len(x) - 1, -1, -1):
            d = carry
            d += dh[t]
            by[t] *= d
            carry = back @ flat[t, HIDDEN:]
            d *= z[t]
            carry += d
            if begins[t]:
                carry *= ~fresh[t]
        grad["wh"] = (flat[:, HIDDEN:] @ h0.transpose(0, 2, 1)).sum(axis=0)
        dg, ids = flat[:, : 3 * HIDDEN].transpose(1, 0, 2).reshape(3 * HIDDEN, -1), x.ravel().astype(np.intp)
        sums = np.roll(dg @ np.c_[self.p["emb"], np.ones(len(self.p["emb"]), np.float32)][ids], -HIDDEN, axis=0)
        grad["wx"], grad["b"] = np.ascontiguousarray(sums[:, :EMBED]), sums[:, EMBED].copy()
        by_id = np.roll(self.p["wx"], HIDDEN, axis=0).T @ dg
        grad["emb"] = np.stack([np.bincount(ids, v, len(self.p["emb"])) for v in by_id], axis=1).astype(np.float32)
        for g in grad.values():
            g /= max(len(logp), 1)
        return grad, float(-logp.mean()), last


def lanes(ids: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Texts ids[at[i]:at[i + 1]] packed into at most n lanes: inputs, beginnings, targets, live marks and text numbers
    (steps, lanes), lanes by falling length. There are as many lanes as the longest text leaves room for."""
    sizes = np.diff(at)
    n = max(1, min(n, len(sizes), max(int(at[-1] - at[0]) // int(sizes.max()), n // 8)))
    put, load = [[] for _ in range(n)], [(0, k) for k in range(n)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, k = heapq.heappop(load)
        put[k].append(i)
        heapq.heappush(load, (size + int(sizes[i]), k))
    put.sort(key=lambda own: -int(sizes[own].sum()))
    steps = int(sizes[put[0]].sum())
    x, y = np.full((n, steps), Model.START, np.int16), np.zeros((n, steps), np.int16)
    fresh, live, owner = np.zeros((n, steps), bool), np.zeros((n, steps), bool), np.zeros((n, steps), np.int32)
    for k, own in enumerate(put):
        to = 0
        for i in own:
            text = ids[at[i] : at[i + 1]]
            end = to + len(text)
            y[k, to:end], owner[k, to:end] = text, i
            x[k, to + 1 : end] = text[:-1]
            fresh[k, to] = True
            to = end
        live[k, :to] = True
    return tuple(np.ascontiguousarray(v.T) for v in (x, fresh, y, live, owner))


def score_texts(model: Model, ids: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log10 probability of the classes and softmax words of each text; the state runs through the whole text."""
    parts = lanes(ids, at, LANES)
    h = np.zeros((HIDDEN, parts[0].shape[1]), np.float32)
    out = np.zeros(len(at) - 1)
    for t in range(0, len(parts[0]), SCORE_STEPS):
        k = int(parts[3][t].sum())  # lanes that still hold text: ended ones drop off
        x, fresh, y, live, owner = (p[t : t + SCORE_STEPS, :k] for p in parts)
        hs, h = model.states(x, fresh, h[:, :k], table)
        hs, y, owner = hs.reshape(HIDDEN + 1, -1), y.ravel(), owner.ravel()
        if not live.all():
            some = np.flatnonzero(live.ravel())
            hs, y, owner = hs.T[some].T, y[some], owner[some]
        logp, _ = model.log_probs(hs, y)
        out += np.bincount(owner, logp.astype(float), len(out))
    return out / np.log(10)


class Adam:
    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate, self.t = model, rate, 0
        self.m, self.v = ({k: np.zeros_like(p) for k, p in model.p.items()} for _ in "mv")

    def step(self, grad: dict) -> None:
        """One step along grad, which is scaled in place."""
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grad.items():
            m, v = self.m[k], self.v[k]
            g *= np.float32(scale)
            d = g - m
            d *= np.float32(0.1)
            m += d
            np.multiply(g, g, out=d)
            d -= v
            d *= np.float32(0.001)
            v += d
            np.sqrt(v, out=d)
            d += np.float32(1e-8)
            np.divide(m, d, out=d)
            d *= np.float32(rate)
            self.model.p[k] -= d


def train_texts(model: Model, adam: Adam, ids: np.ndarray, at: np.ndarray) -> int:
    """One pass over texts ids[at[i]:at[i + 1]], which stand one after the other in lanes of equal length; the state runs
    on from window to window and begins anew with each text and lane."""
    at = at - at[0]
    n = max(1, min(TRAIN_LANES, len(ids) // STEPS))
    steps = -(-len(ids) // n)
    fresh = np.zeros(n * steps, bool)
    fresh[at[:-1]] = True
    x = np.r_[Model.START, ids[:-1]]
    x[at[:-1]] = Model.START
    spread = lambda v: np.r_[v, np.zeros(n * steps - len(v), v.dtype)].reshape(n, steps).T
    parts = [np.ascontiguousarray(v) for v in (spread(x.astype(np.int16)), fresh.reshape(n, steps).T, spread(ids), spread(np.ones(len(ids), bool)))]
    parts[1][0] = True
    h = np.zeros((HIDDEN, n), np.float32)
    for t in range(0, steps, STEPS):
        grad, _, h = model.gradients(*(v[t : t + STEPS] for v in parts), h)
        adam.step(grad)
    return len(ids)


def _packs(column):
    """Ids and bounds of texts of an Arrow list column, about PACK tokens at a time, with the number of the first text."""
    ids, at = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PACK)) - 1)
        yield lo, ids, at[lo : hi + 1]
        lo = hi


def word_counts(train: DataFrame, text: str) -> DataFrame:
    """(word binary, c) of all words of the texts. Tasks count by themselves, about TOGETHER bytes of text at
    a time; of longer texts COUNTED different words."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def out(words, counts):
            for lo in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([words[lo : lo + 50_000], counts[lo : lo + 50_000]], names=["word", "c"])

        held, size = [], 0
        for batch in batches:
            for texts in portions(batch.column(0), LOOKUP):
                if len(texts) == 1 and len(texts[0].as_py()) > PIECE:
                    counts = Counter()
                    for words in pieces(texts[0].as_py()):
                        counts.update(words)
                        if len(counts) > COUNTED:
                            yield from out(pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64()))
                            counts = Counter()
                    yield from out(pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64()))
                    continue
                held.append(words_of(texts)[0])
                size += texts.nbytes
                if size > TOGETHER:
                    counts = pc.value_counts(pa.chunked_array(held, pa.binary()))
                    held, size = [], 0
                    yield from out(*counts.flatten())
        if held:
            yield from out(*pc.value_counts(pa.chunked_array(held, pa.binary())).flatten())

    return train.select(text_of(text).cast("binary").alias("t")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_vocabulary(train: DataFrame, text: str) -> tuple[Vocabulary, DataFrame]:
    """Vocabulary and the table of (word, c) of all words of the training texts."""
    counts = stored(word_counts(train, text), "word-counts")
    ends = train.count()
    tail = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(TAILS)).alias("k")
    mass = {r["k"]: [r["c"], r["n"]] for r in counts.groupBy(tail).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    total, distinct = (sum(v[i] for v in mass.values()) for i in (0, 1))
    # the count from which words go to the head: by bins of counts, so that at most HEAD words are gathered
    fit, bin_of = F.octet_length("word") <= HEAD_BYTES, F.floor(F.log2("c") * 16)
    bins = counts.where(fit).groupBy(bin_of.alias("bin")).count().orderBy(F.desc("bin")).collect()
    room, low = HEAD, None
    for b in bins:
        room -= b["count"]
        if room < 0:
            break
        low = b["bin"]
    head = [] if low is None else counts.where(fit & (bin_of >= low)).collect()
    head = sorted(((bytes(r["word"]), r["c"]) for r in head), key=lambda x: (-x[1], x[0]))
    for w, c in head[: SHORT - 1]:
        mass[tail_class(w)][0] -= c
        mass[tail_class(w)][1] -= 1
    return Vocabulary(head, ends, total + ends, distinct + (1 if ends else 0), {k: tuple(v) for k, v in mass.items()}), counts


def tokens(rows: DataFrame, vocabulary) -> DataFrame:
    """rows (id, out, t) with their token ids, counts of tokens and known ones, the sums of log counts of known
    words and of shares of tail classes, the words outside the head, and a number of the row."""
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        v, row = vocabulary.value, TaskContext.get().partitionId() << 33
        head = pa.array(v.at, pa.binary())
        known, log_count = np.r_[v.known, False], np.r_[v.log_count, 0.0]  # the last is of words that are not there
        for batch in batches:
            lo = 0
            for texts in portions(batch.column(2), LOOKUP):
                place, ids, at, rare, rare_at = v.codes_of(texts, head)
                logs, tail = log_count[place], ids >= SHORT
                inside = np.zeros(len(ids))
                inside[tail] = logs[tail] + v.tail_base[ids[tail] - SHORT]
                total = lambda x: pa.array(np.add.reduceat(x, at[:-1]))  # noqa: B023, E731
                numbers = pa.array(np.arange(row, row + len(texts)))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values) for bounds, values in ((rare_at, rare), (at, pa.array(ids, pa.int16())))]
                own = [c[lo : lo + len(texts)] for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, numbers, pa.array(np.diff(at)), total(known[place].astype(np.int64)), total(logs), total(inside), *lists], names=["id", "out", "row", "n", "known", "logs", "inside", "rare", "ids"])
                lo += len(texts)
                row += len(texts)

    return rows.mapInArrow(run, f"id {kind}, out boolean, row long, n long, known long, logs double, inside double, rare array<binary>, ids array<smallint>")


def lessons(texts, size: int):
    """Texts (arrays of ids), one after the other, in lists of about ``size`` tokens."""
    held, n = [], 0
    for ids in texts:
        held.append(ids)
        n += len(ids)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def train(rows: DataFrame, flat: np.ndarray, shards: int, rate: float = RATE) -> np.ndarray:
    """One round on rows (h, ids): texts are dealt by their hash to ``shards`` copies of the model, each learns from its own
    in the order of the hash, and the weights are averaged by tokens seen, block by block. Which text comes when to which
    copy depends on the texts alone, not on how many tasks or executors there are."""
    spark = rows.sparkSession
    start = spark.sparkContext.broadcast(flat)

    def run(batches):
        from itertools import groupby

        import pyarrow as pa

        def texts():
            for batch in batches:
                shard, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                ids, at = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
                for i, k in enumerate(shard):
                    yield k, ids[at[i] : at[i + 1]]

        for shard, own in groupby(texts(), key=lambda x: x[0]):
            model = Model(flat=start.value)
            adam, seen = Adam(model, rate), 0
            for part in lessons((x[1] for x in own), LESSON):
                seen += train_texts(model, adam, np.concatenate(part), np.r_[0, np.cumsum([len(x) for x in part])])
            out = model.flat()
            blocks = [out[i : i + BLOCK] * np.float32(seen) for i in range(0, len(out), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([int(shard)] * len(blocks), pa.int32()), pa.array([float(seen)] * len(blocks)), pa.array(blocks, pa.list_(pa.float32()))], names=["block", "salt", "seen", "w"])

    kind = "block int, salt int, seen double, w array<float>"

    def summed(pdf):
        import pandas as pd

        pdf = pdf.sort_values("part" if "part" in pdf else "salt")  # so that sums come out alike
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "salt": [pdf["salt"].iloc[0]], "seen": [pdf["seen"].sum()], "w": [np.sum(np.stack(pdf["w"].tolist()), axis=0, dtype=np.float64).astype(np.float32)]})

    shard = F.pmod(F.shiftright("h", 16), F.lit(shards)).cast("int")
    dealt = rows.select(shard.alias("shard"), "ids", "h").repartitionById(shards, "shard").sortWithinPartitions("shard", "h").select("shard", "ids")
    copies = stored(dealt.mapInArrow(run, kind), "lm-copies")
    part = copies.select("block", (F.col("salt") % 32).alias("salt"), "seen", "w", F.col("salt").alias("part"))
    out = part.groupBy("block", "salt").applyInPandas(summed, kind).withColumn("part", F.col("salt")).withColumn("salt", F.lit(0)).groupBy("block", "salt").applyInPandas(summed, kind).collect()
    return np.concatenate([np.array(r["w"], np.float32) / np.float32(r["seen"]) for r in sorted(out, key=lambda r: r["block"])]) if out else flat


def scores(coded: DataFrame, flat: np.ndarray) -> DataFrame:
    """coded with the column ids replaced by score: log10 probability of the classes and softmax words."""
    final = coded.sparkSession.sparkContext.broadcast(flat)
    kept = [x for x in coded.dtypes if x[0] != "ids"]

    def run(batches):
        import pyarrow as pa

        model = Model(flat=final.value)
        table = model.table()
        for batch in batches:
            for lo, ids, at in _packs(batch.column("ids")):
                part = batch.slice(lo, len(at) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score_texts(model, ids, at, table))], names=[*part.schema.names[:-1], "score"])

    return coded.select(*(k for k, _ in kept), "ids").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kept) + ", score double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 10) -> DataFrame:
    """Scores of all texts by a unigram base and by the recurrent model, both learnt from the training documents.

    A document is held out if crc32 of its id as text (null: of nothing) is divisible by ``held_out``. Words are counted
    over all others. Model: GRU over softmax words and tail classes; a word of the softmax has the probability of its
    class times that within its class, any other word that of its tail class times its smoothed share of the class, so
    unknown words have some as well. Training: ROUNDS rounds of truncated backpropagation that together read every training
    document once. A round trains copies side by side, one more for each fourfold of the corpus' root, and averages their
    weights; texts are dealt to rounds and copies by a hash of id and text, so scores do not depend on partitions or tasks.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score and score. Null and empty text are one end
    token. Every row is scored, repeated ones and null ids included; a table without rows gives none; other columns are
    ignored. The head of at most HEAD words goes to all tasks; counts of other words are joined to the texts' rare words.
    Token ids of all texts are written once to the shared folder and read by each round and for the scores. Texts never
    move between tasks; token ids of training documents are dealt to their copy once.
    """
    spark = docs.sparkSession
    sum_of = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), (sum_of % held_out == 0).alias("out"), text_of(text_col).cast("binary").alias("t"))
    vocabulary, counts = fit_vocabulary(rows.where(~F.col("out")).select(F.col("t").cast("string")), "t")
    coded = stored(tokens(rows, spark.sparkContext.broadcast(vocabulary)).withColumn("h", F.xxhash64("id", "ids")), "lm-tokens")
    flat = Model(vocabulary).flat()
    shards = max(1, math.ceil(math.sqrt(vocabulary.total / APART)))
    lesson = coded.where(~F.col("out")).select("h", "ids")
    for k in range(ROUNDS):
        flat = train(lesson.where(F.pmod("h", F.lit(ROUNDS)) == k), flat, shards, RATE * COOLING**k)
    rare = coded.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_logs"), F.count("c").alias("rare_known"))
    scored = stored(scores(coded.drop("rare", "h"), flat), "lm-scores")
    zero = F.lit(0.0)
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col), F.col("out").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", zero) + F.col("n") * F.lit(float(vocabulary.base))).alias("base_score"), (F.col("score") + F.col("inside") + F.coalesce("rare_logs", zero)).alias("score"),
    )
