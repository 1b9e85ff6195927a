"""Operator 9: scoring by a gated recurrent language model.

1. Texts are read and split once, into chunks of documents with words numbered
   in each; from these the words of all training documents are counted.
2. The most frequent words that make up ``SHARE`` of all training tokens, so
   more of them in a larger corpus, are the model's own; all others are one
   more outcome, within which a word's share follows its count. Every document
   is kept as the places of its words.
3. Training documents are dealt by a hash of id and words to rounds and, within
   a round, to copies of the model; how many there are follows from the number
   of training tokens alone, not from how the table is stored. A copy learns
   from all of its documents by truncated backpropagation: documents run side
   by side in lanes, and the state is carried from window to window and reset
   only where a document starts. Copies of a round start alike and are averaged
   by their token counts; the next round goes on from the average.
4. Every document is scored as a whole, the state carried across windows.
   Counts of the model's and of at least the ``COUNTED`` most frequent words are
   at hand as a broadcast; rarer words are sent to a join with the table of all counts.

The unit is a GRU: h' = z h + (1 - z) tanh(x + r (U h)), with the update gate z
and the reset gate r sigmoids of x + U h, each with an x and U of its own; r acts
behind the product with the state, so all three are products with the same state. Outputs are
factored into classes in order of frequency: a softmax over classes, one within
the class, and for all but the most frequent words a third one, over the words
of a part of it. Starting biases follow the counts.

Words are told apart by 64-bit hashes. Retried tasks give the same copies: the
only randomness is the fixed start, and a copy reads its documents in a fixed
order, the longest first, so that no lane is left to run alone at the end.

Defined results: a null or empty text is the end token alone; repeated rows
are scored, and learned from, each on its own; a null id counts as the empty
text in the split; very long texts are learned and scored whole, in one lane;
with no training document N and V are 0 and the model is uniform over what it
knows; an empty table gives an empty result. Only the id and the text are
read, so other columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frequent import most_frequent
from .storage import discard, materialise

#: Share of the training tokens whose words are the model's own, and the least number of such words.
SHARE = 0.8
HEAD = 2048
#: Least number of outcomes in a softmax below the first; it grows with the cube root of the model's words.
SIDE = 8
COUNTED = 1 << 18
HIDDEN = 24
LANES = 1024
STEPS = 24
#: How many times as many steps a window may have when few lanes are left.
LONGER = 16
#: Rows at a time of the first softmax and of those below it, so that tables stay in a core's cache and products are small ones.
FIRST, BLOCK = 256, 1024
#: Rows of one token whose inputs' gradients are added up rank by rank, all tokens at once; what is beyond, token by token.
RANKS = 32
RATE = 0.15
#: Where sums of squares start.
SQUARES = 1e-7
#: Rounds of learning, training tokens to a copy and round, and the largest number of copies.
ROUNDS = 2
COPY_TOKENS = 1 << 22
COPIES = 1024
#: Documents of more tokens come first in a copy, by length.
LONG = 256
#: Tokens after which a chunk of documents ends, and bytes of texts that are split at a time.
CHUNK = 1 << 20
SLICE = 1 << 22
#: Different words of chunks to a file, at least: a small table in many files would mean as many child processes of Hadoop's local writer.
WORDS = 1 << 18
#: Hash of the end token: it holds a line break, which no word does.
END = xxhash.xxh3_64_intdigest(b"\nend")
#: Numbers in a piece of a copy.
_PIECE = 1 << 18
#: Logits are held below this, so that their exponentials stay finite.
_LIMIT = np.float32(80)


def is_held_out(doc: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")) % 10 == 0


_CHUNK = "docs array<long>, held array<boolean>, sizes binary, ids binary, words binary, counts binary, distinct long"


def _split(texts):
    """Words of texts, one after another, and how many each text has. Arrow's white space is ``[\\x20\\x09-\\x0D]``, and only A-Z are lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # at the ends of a text
    if empty.any():
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        words = words.filter(pa.array(~empty))
    return words, sizes


def _slices(batches):
    """Parts of batches with about SLICE bytes of text, or a single one that is larger."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")) - at)
            yield batch.slice(at, n)
            at += n


def _chunks(batches):
    """Documents put together: their ids, numbers of tokens and word numbers, and each word's hash and count in training documents.

    Words are numbered from 1 in order of their first occurrence; 0 is the end token.
    """
    types = (pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4, pa.int64())
    parts: list = []

    def flush():
        docs, held = (pa.concat_arrays([p[k] for p in parts]) for k in (0, 1))
        found, sizes = pa.concat_arrays([p[2] for p in parts]).dictionary_encode(), np.concatenate([p[3] for p in parts]) + 1
        parts.clear()
        ids = np.zeros(int(sizes.sum()), np.uint32)
        word = np.ones(len(ids), bool)
        word[np.cumsum(sizes) - 1] = False
        ids[word] = found.indices.to_numpy(zero_copy_only=False) + np.uint32(1)
        words = found.dictionary.cast(pa.large_binary() if pa.types.is_large_string(found.dictionary.type) else pa.binary()).to_numpy(zero_copy_only=False)
        hashes = np.fromiter((END, *map(xxhash.xxh3_64_intdigest, words)), np.uint64, len(words) + 1)
        learned = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), sizes)
        counts = np.bincount(ids[learned], minlength=len(hashes)).astype(np.int64)
        row = (docs, held, sizes.tobytes(), ids.tobytes(), hashes.tobytes(), counts.tobytes(), len(hashes))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in _CHUNK.split(", ")])

    for part in _slices(batches):
        parts.append((part.column("doc"), part.column("held_out"), *_split(part.column("text"))))
        if sum(int(p[3].sum()) + len(p[3]) for p in parts) >= CHUNK:
            yield flush()
    if parts:
        yield flush()


def _count(batches):
    for batch in batches:
        for words, counts in zip(batch.column("words"), batch.column("counts"), strict=True):
            h, n = np.frombuffer(words.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 0]), pa.array(n[n > 0])], names=["h", "n"])


def _order(tokens: np.ndarray) -> np.ndarray:
    """Places in order of their tokens, and of themselves where these are equal; numbers that differ sort faster than places do."""
    return np.sort((tokens.astype(np.int64) << 32) | np.arange(len(tokens))) & 0xFFFFFFFF


def _sums(rows: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` over the runs of ``order`` that begin at ``starts``, longest first."""
    out = rows.take(order[starts], 0)
    for k in range(1, RANKS):
        m = int(np.searchsorted(-sizes, -k))  # runs of more than k rows
        if not m:
            return out
        out[:m] += rows.take(order[starts[:m] + k], 0)
    for i in range(int(np.searchsorted(-sizes, -RANKS))):
        out[i] += rows.take(order[starts[i] + RANKS : starts[i] + sizes[i]], 0).sum(0)
    return out


class Model:
    """Gated unit with an input row per token and a softmax factored into classes. Token ``head`` stands for all rarer words.

    A table of the output is (nodes, hidden + 1, outcomes); the last row of a node is its bias.
    """

    NAMES = ("g", "u", "top", "mid", "low")

    def __init__(self, counts: np.ndarray, rest: float, hidden: int = HIDDEN, weights: dict | None = None):
        head = len(counts)
        self.head, self.hidden = head, hidden
        self.side = side = max(SIDE, -(-math.ceil(head ** (1 / 3)) // 8) * 8)
        self.flat = min(head, side * side)  # words that are outcomes of a class itself
        self.parts = -(-(head - self.flat) // side)
        self.deep = -(-self.parts // side)  # classes of parts
        if weights:
            self.__dict__.update({k: v.copy() for k, v in weights.items()})
            return
        rng = np.random.default_rng(11)
        normal = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)

        def table(mass: np.ndarray) -> np.ndarray:
            w = normal(len(mass), hidden + 1, mass.shape[1])
            with np.errstate(divide="ignore"):
                w[:, hidden] = np.maximum(np.log(mass) - np.log(np.maximum(mass.max(1, keepdims=True), 1e-30)), -_LIMIT)
            return w

        mass = np.asarray(counts, np.float64) + 0.1
        few = np.zeros((-(-self.flat // side), side))
        few.reshape(-1)[: self.flat] = mass[: self.flat]
        many = np.zeros((self.deep * side, side))
        many.reshape(-1)[: head - self.flat] = mass[self.flat :]
        mid = np.concatenate((few, many.sum(1).reshape(-1, side)))
        self.low, self.mid = table(many), table(mid)
        self.top = table(np.append(mid.sum(1), rest + 0.1)[None])
        self.g, self.u = normal(head + 2, 3 * hidden), normal(hidden, 3 * hidden) * np.float32(10 / np.sqrt(hidden))
        self.g[:, : 2 * hidden] += 1  # begin by remembering, and without resets

    def weights(self) -> dict:
        return {k: getattr(self, k) for k in self.NAMES}

    def forward(self, tokens: np.ndarray, first: np.ndarray, h: np.ndarray, before: np.ndarray, keep: bool = False):
        """Steps of a window: tokens and first (a document starts) are (steps, lanes).

        Returns the inputs, the states with a one behind each, what backpropagation needs (``keep``) and the last state.
        """
        n, hid = tokens.shape, self.hidden
        inputs = np.empty(n, np.int64)
        inputs[0], inputs[1:] = before, tokens[:-1]
        inputs[first] = self.head + 1
        states, starts = np.ones((*n, hid + 1), np.float32), [np.flatnonzero(x) for x in first]
        # Each step's state before and product with it; where nothing is kept, two places and one serve in turn.
        befores, proposed = (np.empty((k, n[1], hid), np.float32) for k in ((n[0] + 1, n[0]) if keep else (2, 1)))
        befores[0] = h
        # Gates and candidates lie apart, so that each step works on whole rows.
        update, reset, fresh = (self.g.reshape(-1, hid).take(3 * inputs + k, 0) for k in range(3))
        to_update, to_reset, to_fresh = (np.ascontiguousarray(self.u[:, k : k + hid]) for k in (0, hid, 2 * hid))
        past = np.empty((n[1], hid), np.float32)

        def squash(a):  # a sigmoid, in place: half of one more than the tanh of a half
            a *= np.float32(0.5)
            np.tanh(a, out=a)
            a += 1
            a *= np.float32(0.5)

        for t in range(n[0]):
            h, after, product = befores[t % len(befores)], befores[(t + 1) % len(befores)], proposed[t % len(proposed)]
            h[starts[t]] = 0
            z, r, c = update[t], reset[t], fresh[t]
            z += np.matmul(h, to_update, out=past)
            squash(z)
            r += np.matmul(h, to_reset, out=past)
            squash(r)
            np.matmul(h, to_fresh, out=product)
            c += np.multiply(product, r, out=past)
            c *= np.float32(0.5)
            np.tanh(c, out=c)
            np.subtract(h, c, out=after)
            after *= z
            after += c
            states[t, :, :hid] = after
        return inputs, states, (befores[:-1], proposed, update, reset, fresh), befores[n[0] % len(befores)]

    @staticmethod
    def _first(weights, target, states, grads):
        """Logs of the targets' probabilities under the one softmax that all rows share, and the gradient by state."""
        w, one = weights[0], np.ones(weights.shape[2], np.float32)
        log, slope, d_w = np.empty(len(target), np.float32), None, np.zeros_like(w)
        if grads is not None:
            slope, back = np.empty_like(states), np.ascontiguousarray(w.T)
        aim = np.arange(len(target)) % FIRST * len(one) + target
        for i in range(0, len(target), FIRST):
            s, at = states[i : i + FIRST], aim[i : i + FIRST]
            e = s @ w
            np.clip(e, -np.inf, _LIMIT, out=e)
            line = e.reshape(-1)
            own = line.take(at)
            np.exp(e, out=e)
            total = e @ one
            log[i : i + FIRST] = own - np.log(total)
            if grads is not None:
                e *= np.reciprocal(total)[:, None]
                line[at] -= 1
                d_w += s.T @ e
                np.matmul(e, back, out=slope[i : i + FIRST])
        if grads is not None:
            grads.append((np.zeros(1, np.int64), d_w[None]))
        return log, slope

    @staticmethod
    def _below(weights, node, target, rows, states, log, slope, grads):
        """Adds the same to ``log`` and ``slope`` for the ``rows`` of ``states``, in order of their nodes, each node with a softmax of its own.

        A node's rows are one block; nodes whose blocks are of one length are multiplied together.
        """
        if not len(node):
            return
        n, one = len(node), np.ones(weights.shape[2], np.float32)
        edge = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        touched, sizes = node[edge], np.diff(np.append(edge, n))
        # Lengths are in steps of a quarter of a power of two, of 4 at least.
        unit = np.maximum(4, 1 << np.maximum(0, np.log2(sizes).astype(np.int64) - 2))
        length = -(-sizes // unit) * unit
        by = np.argsort(length, kind="stable")
        touched, sizes, edge, length = touched[by], sizes[by], edge[by], length[by]
        ends = np.cumsum(length)
        # A block's places beyond its rows hold the node's last row, and count for nothing.
        within = np.arange(ends[-1]) - np.repeat(ends - length, length)
        spare = within >= np.repeat(sizes, length)
        source = np.repeat(edge, length) + np.minimum(within, np.repeat(sizes, length) - 1)
        row, hit = rows[source], (~spare).astype(np.float32)
        aim = np.arange(ends[-1]) * len(one) + target[source]
        logs = np.empty(ends[-1], np.float32)
        if grads is not None:
            slopes = np.empty((ends[-1] + 1, states.shape[1]), slope.dtype)
            slopes[-1] = 0
            d_w = np.empty((len(touched), *weights.shape[1:]), weights.dtype)
        a = 0
        while a < len(touched):
            size = int(length[a])
            b = min(a + max(1, BLOCK // size), int(np.searchsorted(length, size, "right")))
            i, j = int(ends[a]) - size, int(ends[b - 1])
            s = states.take(row[i:j], 0).reshape(b - a, size, -1)
            w = weights.take(touched[a:b], 0)
            e = np.matmul(s, w)
            by_row = e.reshape(j - i, -1)
            np.clip(by_row, -np.inf, _LIMIT, out=by_row)
            at, line = aim[i:j] - i * len(one), e.reshape(-1)
            own = line.take(at)
            np.exp(by_row, out=by_row)
            total = by_row @ one
            logs[i:j] = own - np.log(total)
            if grads is not None:
                by_row *= (hit[i:j] / total)[:, None]
                line[at] -= hit[i:j]
                np.matmul(s.transpose(0, 2, 1), e, out=d_w[a:b])
                np.matmul(e, w.transpose(0, 2, 1), out=slopes[i:j].reshape(s.shape))
            a = b
        place = np.full(len(states), ends[-1])
        real = np.flatnonzero(~spare)
        place[row[real]] = real
        log[row[real]] += logs[real]
        if grads is not None:
            slope += slopes.take(place, 0)
            grads.append((touched, d_w))

    def output(self, states: np.ndarray, tokens: np.ndarray, grads: dict | None = None):
        """Natural log of each token's probability (a rarer word's: of its class), and the gradient by state (with or without its one)."""
        if states.shape[1] == self.hidden:
            states = np.concatenate((states, np.ones((len(states), 1), states.dtype)), 1)
        order = _order(tokens)
        tok = tokens[order]
        f, k = np.searchsorted(tok, (self.flat, self.head))  # tokens of classes, of parts, then the rarer ones
        few, side = -(-self.flat // self.side), self.side
        part = (tok[f:k] - self.flat) // side
        node = np.concatenate((tok[:f] // side, few + part // side))
        within = np.concatenate((tok[:f] % side, part % side))
        found = {name: [] if grads is not None else None for name in ("top", "mid", "low")}
        target = np.full(len(tok), few + self.deep)
        target[order[:k]] = node
        log, slope = self._first(self.top, target, states, found["top"])
        self._below(self.mid, node, within, order[:k], states, log, slope, found["mid"])
        self._below(self.low, part, (tok[f:k] - self.flat) % side, order[f:k], states, log, slope, found["low"])
        if grads is None:
            return log, None
        grads.update({name: g[0] for name, g in found.items() if g})
        return log, slope[:, : self.hidden]


class Trainer:
    """Truncated backpropagation over one window, with Adagrad steps; outputs of a node and inputs of a token share a sum of squares."""

    def __init__(self, model: Model, sums: dict | None = None):
        self.m = model
        self.sums = {k: v.copy() for k, v in sums.items()} if sums else self.start(model)

    @staticmethod
    def start(model: Model) -> dict:
        shape = {"g": lambda s: s[:1], "u": lambda s: s}
        return {k: np.full(shape.get(k, lambda s: (s[0], s[2]))(v.shape), SQUARES, np.float32) for k, v in model.weights().items()}

    def window(self, tokens, first, real, h, before):
        m, hid = self.m, self.m.hidden
        inputs, states, (befores, proposed, update, reset, fresh), last = m.forward(tokens, first, h, before, keep=True)
        at = np.flatnonzero(real.ravel())
        if not len(at):
            return last
        grads: dict = {}
        if len(at) == tokens.size:
            d_states = np.ascontiguousarray(m.output(states.reshape(-1, hid + 1), tokens.ravel(), grads)[1])
        else:
            d_states = np.zeros((tokens.size, hid), np.float32)
            _, d_states[at] = m.output(states.reshape(-1, hid + 1).take(at, 0), tokens.ravel()[at], grads)
        d_states = d_states.reshape(*tokens.shape, hid)
        d_h, starts = np.zeros_like(last), [np.flatnonzero(x) for x in first]
        to_update, to_reset, to_fresh = (np.ascontiguousarray(m.u[:, k : k + hid].T) for k in (0, hid, 2 * hid))
        forget, more = np.empty_like(last), np.empty_like(last)
        for t in range(len(tokens) - 1, -1, -1):
            # Arrays become gradients in place: update and fresh by their own sums, proposed by the reset gate's, reset by the product with the state.
            d, past, c, z, r = d_states[t], proposed[t], fresh[t], update[t], reset[t]
            d += d_h
            np.subtract(1, z, out=forget)
            forget *= d
            d *= z
            np.subtract(befores[t], c, out=more)
            z *= forget
            z *= more
            np.multiply(c, c, out=c)
            np.subtract(1, c, out=c)
            c *= np.float32(0.5)
            c *= forget
            np.subtract(1, r, out=more)
            r *= c
            past *= r
            past *= more
            np.matmul(z, to_update, out=d_h)
            d_h += np.matmul(past, to_reset, out=more)
            d_h += np.matmul(r, to_fresh, out=more)
            d_h += d
            d_h[starts[t]] = 0
        # Step by step, as small products are the faster ones.
        by_state = befores.transpose(0, 2, 1)
        d_u = np.concatenate([np.matmul(by_state, x).sum(0) for x in (update, proposed, reset)], 1)
        d_x = tuple(x.reshape(-1, hid) for x in (update, proposed, fresh))
        self._step(grads, d_u, inputs.ravel(), d_x, len(at))
        return last

    def _step(self, grads, d_u, inputs, d_x, n):
        scale = np.float32(32 / n)
        for k, (touched, whole) in grads.items():
            w, sums = getattr(self.m, k), self.sums[k]
            # Some nodes at a time, so that they stay in a core's cache.
            for i in range(0, len(touched), 32):
                at, g = touched[i : i + 32], whole[i : i + 32]
                g *= scale
                np.clip(g, -1, 1, out=g)
                sums[at] = s = sums[at] + np.einsum("nhs,nhs->ns", g, g) * np.float32(1 / g.shape[1])
                g *= (RATE / np.sqrt(s))[:, None, :]
                w[at] -= g
        g = np.clip(d_u * scale, -1, 1)
        self.sums["u"] += g * g
        self.m.u -= RATE * g / np.sqrt(self.sums["u"])
        order = _order(inputs)
        inputs = inputs[order]
        starts = np.flatnonzero(np.concatenate(([True], inputs[1:] != inputs[:-1])))
        sizes = np.diff(np.append(starts, len(inputs)))
        by = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[by], sizes[by]
        g, rows = np.concatenate([_sums(part, order, starts, sizes) for part in d_x], 1), inputs[starts]
        g *= scale
        np.clip(g, -1, 1, out=g)
        self.sums["g"][rows] = s = self.sums["g"][rows] + np.einsum("nh,nh->n", g, g) * np.float32(1 / g.shape[1])
        g *= (RATE / np.sqrt(s))[:, None]
        self.m.g[rows] -= g


def windows(docs, lanes: int = LANES, steps: int = STEPS):
    """Windows over documents that run side by side: yields (owners, tokens, first, real, lanes that go on).

    ``docs``: iterable of (owner, tokens). A lane takes the next document when its own ends; lanes left idle are dropped.
    With few lanes left, windows are longer, so that a window still holds a fair number of tokens.
    """
    docs = iter(docs)
    running: list = []  # [owner, tokens, place]
    ended = False
    while True:
        while not ended and len(running) < lanes:
            doc = next(docs, None)
            if doc is None:
                ended = True
            else:
                running.append([*doc, 0])
        if not running:
            return
        long = steps * max(1, min(LONGER, lanes // (8 * len(running))))
        tokens = np.zeros((long, len(running)), np.int64)
        owner = np.full(tokens.shape, -1, np.int64)
        first = np.zeros(tokens.shape, bool)
        for lane, run in enumerate(running):
            t = 0
            while t < long and run is not None:
                own, seq, at = run
                n = min(long - t, len(seq) - at)
                tokens[t : t + n, lane], owner[t : t + n, lane] = seq[at : at + n], own
                first[t, lane] = at == 0
                run[2], t = at + n, t + n
                if run[2] == len(seq):
                    doc = None if ended else next(docs, None)
                    ended = ended or doc is None
                    run = running[lane] = [*doc, 0] if doc is not None else None
        stay = [i for i, run in enumerate(running) if run is not None]
        yield owner, tokens, first, owner >= 0, stay
        running = [running[i] for i in stay]


def _run(docs, step, hidden: int, head: int, lanes: int = LANES):
    """Carry states over the windows of ``docs``; step(owner, tokens, first, real, h, before) returns the new states."""
    h, before = np.zeros((0, hidden), np.float32), np.zeros(0, np.int64)
    for owner, tokens, first, real, stay in windows(docs, lanes):
        more = tokens.shape[1] - len(h)
        if more > 0:
            h = np.concatenate((h, np.zeros((more, hidden), np.float32)))
            before = np.concatenate((before, np.full(more, head + 1)))
        h = step(owner, tokens, first, real, h, before)[stay]
        before = tokens[-1, stay]


def head_size(by_count: list, total: int) -> int:
    """Number of most frequent words that make up SHARE of ``total`` tokens; by_count: (count, words with it)."""
    size, left = 0, SHARE * total
    for c, n in sorted(by_count, reverse=True):
        size += min(n, max(0, math.ceil(left / c)))
        left -= c * n
    return max(HEAD, size)


def vocabulary(chunks: DataFrame) -> dict:
    """Counts of all words (a table), the words at hand, most frequent first, and what scores need of them."""
    files = max(1, math.ceil((chunks.agg(F.sum("distinct")).first()[0] or 0) / WORDS))
    counts = chunks.select("words", "counts").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))
    counts = materialise(counts.coalesce(files), "lm-counts")
    by_count = [tuple(r) for r in counts.groupBy("c").count().collect()]  # as many rows as there are different counts
    total, distinct = sum(c * n for c, n in by_count), sum(n for _, n in by_count)
    size = head_size(by_count, total)
    top = most_frequent(counts, by_count, max(COUNTED, size))
    h, c = top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    head = c[:size]
    rest, below = total - int(head.sum()), total + 0.1 * (distinct + 1)
    rest_below = rest + 0.1 * (distinct - len(head) + 1)
    return {
        "table": counts, "hashes": h, "counts": head, "rest": float(rest), "total": total, "below": below, "rest_below": rest_below,
        "base": np.log10((c + 0.1) / below), "share": np.log10((c + 0.1) / rest_below), "files": files,
    }


_TOKENS = "uid long, doc long, held_out boolean, n_tokens long, n_known long, base double, share double, ids binary, rare binary"
#: A word of a document that is not at hand: its hash, and how often it occurs there.
_RARE = np.dtype([("h", "<i8"), ("n", "<i4")])


def _width(head: int) -> str:
    return "<u2" if head < 1 << 16 else "<u4"


def _look_up(shared):
    """A row per document with its tokens, and its words that are not at hand."""
    names = [x.split()[0] for x in _TOKENS.split(", ")]

    def run(batches):
        s = shared.value
        order = np.argsort(s["hashes"], kind="stable")
        known, head = s["hashes"][order], s["head"]  # the model's tokens come first
        base_of, share_of, width = np.append(s["base"], 0), np.append(np.where(np.arange(len(known)) < head, 0, s["share"]), 0), _width(head)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = {k: batch.column(k)[i] for k in ("docs", "held", "sizes", "ids", "words")}
                words, sizes = np.frombuffer(chunk["words"].as_buffer(), np.int64), np.frombuffer(chunk["sizes"].as_buffer(), np.int64)
                near = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
                place = np.where(known[near] == words, order[near], -1) if len(known) else np.full(len(words), -1)
                ids = np.frombuffer(chunk["ids"].as_buffer(), np.uint32)
                starts, size = np.cumsum(sizes) - sizes, len(sizes)
                at = place[ids]
                sums = [np.add.reduceat(x, starts) for x in ((at >= 0).astype(np.int64), base_of[at], share_of[at])]
                own = uid + np.arange(size)
                uid += size
                tokens, step = np.where((at < 0) | (at >= head), head, at).astype(width).tobytes(), np.dtype(width).itemsize
                each = [tokens[step * a : step * (a + n)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                rare = np.flatnonzero(at < 0)
                key, n = np.unique((np.searchsorted(starts, rare, "right") - 1) * len(words) + ids[rare], return_counts=True)
                pairs = np.empty(len(key), _RARE)
                pairs["h"], pairs["n"] = words[key % len(words)], n
                edge, pairs = (np.searchsorted(key, np.arange(size + 1) * len(words)) * _RARE.itemsize).tolist(), pairs.tobytes()
                more = [pairs[a:b] for a, b in zip(edge, edge[1:], strict=False)]
                cols = [own, chunk["docs"].values, chunk["held"].values, sizes, *sums, pa.array(each, pa.binary()), pa.array(more, pa.binary())]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=names)

    return run


def chunks(rows: DataFrame) -> DataFrame:
    """Documents (doc, held_out, text) as word numbers, in the shared folder: texts are read and split once."""
    return materialise(rows.mapInArrow(_chunks, _CHUNK), "lm-chunks")


def look_up(held: DataFrame, vocab: dict) -> DataFrame:
    """The documents of ``held`` (chunks) as the places of their words, in the shared folder."""
    send = held.sparkSession.sparkContext.broadcast({k: vocab[k] for k in ("hashes", "base", "share")} | {"head": len(vocab["counts"])})
    return materialise(held.mapInArrow(_look_up(send), _TOKENS), "lm-tokens")


_COPY = "piece int, part int, tokens double, flat binary"


def _train(shared):
    """A trained copy of the model in pieces, weighted by the tokens it has seen."""

    def run(batches):
        start = shared.value
        model = Model(start["counts"], start["rest"], weights=start["weights"])
        trainer, width, seen = Trainer(model, start["sums"]), _width(model.head), 0

        def docs():
            nonlocal seen
            for batch in batches:
                for ids in batch.column("ids").to_pylist():
                    at = np.frombuffer(ids, width)
                    seen += len(at)
                    yield 0, at

        _run(docs(), lambda owner, tokens, first, real, h, before: trainer.window(tokens, first, real, h, before), model.hidden, model.head)
        if seen:
            flat = np.concatenate([v.ravel() for v in (*model.weights().values(), *trainer.sums.values())])
            part = TaskContext.get().partitionId()
            for k, piece in enumerate(np.array_split(flat, -(-flat.size // _PIECE))):
                yield pa.RecordBatch.from_pydict(
                    {"piece": [k], "part": [part], "tokens": [float(seen)], "flat": [piece.tobytes()]},
                    schema=pa.schema([("piece", pa.int32()), ("part", pa.int32()), ("tokens", pa.float64()), ("flat", pa.binary())]),
                )

    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    total, tokens = 0, 0.0
    for flat, n in zip(pdf["flat"], pdf["tokens"], strict=True):
        total, tokens = total + np.frombuffer(flat, np.float32).astype(np.float64) * n, tokens + n
    return pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "part": [int(pdf["part"].min())], "tokens": [tokens], "flat": [(total / tokens).astype(np.float32).tobytes()]})


def _unpack(flat: np.ndarray, *like: dict) -> list[dict]:
    out, at = [], 0
    for part in like:
        out.append({})
        for k, v in part.items():
            out[-1][k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
    return out


def learn(tokens: DataFrame, vocab: dict, rounds: int = ROUNDS, copy_tokens: int = COPY_TOKENS) -> dict:
    """Weights learned from the training documents of ``tokens``."""
    context = tokens.sparkSession.sparkContext
    start = {k: vocab[k] for k in ("counts", "rest")}
    model = Model(start["counts"], start["rest"])
    weights, sums = model.weights(), Trainer.start(model)
    copies = max(1, min(COPIES, round(vocab["total"] / (rounds * copy_tokens))))
    key = F.xxhash64("doc", "ids")
    docs = tokens.where(~F.col("held_out")).select("ids", "n_tokens", key.alias("key"))
    docs = docs.withColumn("round", F.pmod("key", F.lit(rounds))).withColumn("copy", F.pmod(F.floor(F.col("key") / rounds), F.lit(copies)).cast("int"))
    for r in range(rounds):
        send = context.broadcast(start | {"weights": weights, "sums": sums})
        dealt = docs.where(F.col("round") == r).repartitionById(copies, "copy")
        ordered = dealt.sortWithinPartitions(F.desc(F.when(F.col("n_tokens") > LONG, F.col("n_tokens")).otherwise(0)), "key").select("ids")
        trained = materialise(ordered.mapInArrow(_train(send), _COPY), "lm-copies")
        halfway = trained.groupBy("piece", F.floor(F.col("part") / 64).alias("g")).applyInPandas(_average, _COPY)
        flat = sorted(halfway.groupBy("piece").applyInPandas(_average, _COPY).collect(), key=lambda x: x["piece"])  # one model
        discard(trained)
        if flat:
            weights, sums = _unpack(np.concatenate([np.frombuffer(x["flat"], np.float32) for x in flat]), weights, sums)
    return weights


_SCORED = "uid long, doc long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _score(shared):
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def run(batches):
        s = shared.value
        model = Model(s["counts"], s["rest"], weights=s["weights"])
        width = _width(model.head)
        for batch in batches:
            score, docs = batch.column("share").to_numpy(zero_copy_only=False).copy(), [np.frombuffer(x, width) for x in batch.column("ids").to_pylist()]
            waiting: list = []

            def output(waiting=waiting, score=score):
                if waiting:
                    states, tokens, owner = (np.concatenate(x) for x in zip(*waiting, strict=True))
                    waiting.clear()
                    got, _ = model.output(states, tokens)
                    score += np.bincount(owner, got.astype(np.float64) / np.log(10), minlength=len(score))

            def step(owner, tokens, first, real, h, before, waiting=waiting, output=output):
                _, states, _, last = model.forward(tokens, first, h, before)
                at = np.flatnonzero(real.ravel())
                waiting.append((states.reshape(-1, model.hidden + 1).take(at, 0), tokens.ravel()[at], owner.ravel()[at]))
                if sum(len(x) for _, x, _ in waiting) >= 2 * LANES * STEPS:
                    output()
                return last

            # The longest first, so that all lanes stay busy to the end.
            _run(((i, docs[i]) for i in sorted(range(len(docs)), key=lambda k: -len(docs[k]))), step, model.hidden, model.head)
            output()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(score)], names=names)

    return run


def _rare(batches):
    """A row per document and word that is not at hand."""
    for batch in batches:
        rare = batch.column("rare").to_pylist()
        pairs, sizes = np.frombuffer(b"".join(rare), _RARE), [len(x) // _RARE.itemsize for x in rare]
        cols = (np.repeat(batch.column("uid").to_numpy(), sizes), pairs["h"], pairs["n"].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["uid", "h", "n"])


def score(tokens: DataFrame, vocab: dict, weights: dict, doc: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    send = tokens.sparkSession.sparkContext.broadcast({k: vocab[k] for k in ("counts", "rest")} | {"weights": weights})
    own = tokens.select("uid", "doc", "held_out", "n_tokens", "n_known", "base", "share", "ids")
    scored = own.mapInArrow(_score(send), _SCORED)
    rare = tokens.select("uid", "rare").where(F.octet_length("rare") > 0).mapInArrow(_rare, "uid long, h long, n long").join(vocab["table"], "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / F.lit(float(vocab["below"])))).alias("more_base"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / F.lit(float(vocab["rest_below"])))).alias("more_score"),
    )
    zero = F.lit(0)
    return scored.join(rare, "uid", "left").coalesce(vocab["files"]).select(
        F.col("doc").alias(doc),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", zero)).cast("long").alias("n_known"),
        F.lit(vocab["total"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )


def score_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Count, look up, learn and score: a row for every row of ``docs``."""
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).withColumn("held_out", is_held_out("doc"))
    held = chunks(rows)
    vocab = vocabulary(held)
    tokens = look_up(held, vocab)
    discard(held)
    return score(tokens, vocab, learn(tokens, vocab), doc)
