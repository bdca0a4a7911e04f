"""A bidirectional gated recurrent network with attention pooling, in numpy: training and scoring of windows of words.

A word's inputs are two learned vectors: its own, if LEAST training texts or more have it, and the scaled sum of those of its character grams. Both are
parameters of the network and fitted with the rest of it by the gradient of the loss; nothing is counted from the labels. While training, words' own vectors
are dropped at random, so that grams must do without them. Both directions run side by side as the first axis of every array.
"""

from __future__ import annotations

import numpy as np

from quarry.llm import textkit
from quarry.llm.hashtable import HashTable

U = textkit.U
WINDOW, STRIDE = 48, 38
GRAMS, BUCKETS = (3, 4, 5, 6), 1 << 15
#: Sizes of the words' own vectors, of the grams' vectors and of the layers.
WORD, GRAM, HIDDEN, ATTENTION = 6, 10, 12, 8
INPUTS = WORD + GRAM
#: Training texts that a word with a vector of its own stands in at least.
LEAST = 4
#: Bytes between words: all of ASCII but letters and digits.
APART = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character grams, each word in marks, and where each word's begin (every word has one at least)."""
    flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(U)
    n = np.array([len(w) + 2 for w in words])
    begin = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    found = []
    for g in GRAMS:
        if len(flat) < g:
            continue
        with np.errstate(over="ignore"):
            h = np.zeros(len(flat) - g + 1, U)
            for j in range(g):
                h = h * U(1099511628211) + flat[j : len(flat) - g + 1 + j] + U(1)
        at = np.flatnonzero(of[: len(h)] == of[g - 1 :])
        found.append((of[at], (textkit.mix(h[at] + U(g)) & U(BUCKETS - 1)).astype(np.int64)))
    found.append((np.arange(len(n)), (textkit.mix(flat[begin + 1]) & U(BUCKETS - 1)).astype(np.int64)))
    of, bucket = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(of, kind="stable")
    return bucket[order], np.searchsorted(of[order], np.arange(len(n)))


def windows(n: int, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Starts of overlapping windows that cover n words."""
    return np.arange(0, max(n - window, 0) + stride, stride)[: 1 + -(-max(n - window, 0) // stride)] if n else np.zeros(0, np.int64)


def _sig(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def gathered(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(n, width): the sums of the rows of each number."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        cut = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order[cut]]] = np.add.reduceat(rows[order], cut, axis=0)
    return out


class Lookup:
    """Some words by their row in the table of own vectors (0: none) and their grams (flat, with each word's begin)."""

    def __init__(self, rows: np.ndarray, words: list[bytes]):
        self.rows = rows
        self.flat, self.begin = grams(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.size = np.diff(np.append(self.begin, len(self.flat)))

    def some(self, at: np.ndarray) -> Lookup:
        out, size = Lookup(self.rows[at], []), self.size[at]
        out.begin, out.size = np.cumsum(size) - size, size
        out.flat = self.flat[np.arange(size.sum()) + np.repeat(self.begin[at] - out.begin, size)]
        return out


class Net:
    """Parameters: vectors of words and grams, input and recurrent weights of both directions, attention, output."""

    def __init__(self, known: np.ndarray = np.zeros(0, np.uint64), seed: int = 1):
        """known: hashes of the words with vectors of their own; row 0 is of all others and stays 0."""
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.known = HashTable(max(8, int(2 * len(known) + 2).bit_length()))
        self.known.add(known, np.arange(1, len(known) + 1))
        draw = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        self.p = {
            "word": draw(len(known) + 1, WORD, by=0.1), "gram": draw(BUCKETS, GRAM, by=0.1),
            "wx": draw(2, INPUTS, 3 * h, by=INPUTS**-0.5), "bx": np.zeros((2, 1, 3 * h), np.float32), "uh": draw(2, h, 3 * h, by=h**-0.5),
            "att": draw(2 * h, ATTENTION, by=(2 * h) ** -0.5), "v": draw(ATTENTION, by=ATTENTION**-0.5), "out": draw(2 * h, by=(2 * h) ** -0.5), "b": np.zeros(1, np.float32),
        }

    def lookup(self, keys: np.ndarray, words: list[bytes]) -> Lookup:
        return Lookup(np.maximum(self.known.find(keys), 0).astype(np.int64), words)

    def inputs(self, w: Lookup, drop: np.ndarray | None = None) -> np.ndarray:
        """(words, INPUTS). drop: words whose own vector counts as 0."""
        own = self.p["word"][w.rows] * (w.rows > 0 if drop is None else (w.rows > 0) & ~drop)[:, None]
        return np.concatenate([own, np.add.reduceat(self.p["gram"][w.flat], w.begin) / np.sqrt(w.size)[:, None].astype(np.float32)], 1)

    def inputs_back(self, w: Lookup, dx: np.ndarray, drop: np.ndarray | None = None) -> dict:
        """Gradients of the two tables for those of the inputs."""
        on = w.rows > 0 if drop is None else (w.rows > 0) & ~drop
        each = np.repeat(dx[:, WORD:] / np.sqrt(w.size)[:, None].astype(np.float32), w.size, axis=0)
        return {"word": gathered(len(self.p["word"]), w.rows[on], dx[on, :WORD]), "gram": gathered(BUCKETS, w.flat, each)}

    def gates(self, x: np.ndarray) -> np.ndarray:
        """(rows, 2, 3 * HIDDEN): what an input adds to the gates of either direction."""
        return np.matmul(x[None], self.p["wx"]).transpose(1, 0, 2) + self.p["bx"].transpose(1, 0, 2)

    def run(self, gates: np.ndarray, rows: np.ndarray, keep: bool = False):
        """Logits of windows; rows: (windows, steps) numbers of words, -1 after the end. keep: all that backward() needs, too."""
        b, steps = rows.shape
        h, p = HIDDEN, self.p
        mask = rows >= 0
        whole = bool(mask.all())
        rows = np.where(mask, rows, 0)
        state, states, kept = np.zeros((2, b, h), np.float32), np.zeros((2, steps, b, h), np.float32), []
        for t in range(steps):
            a = steps - 1 - t
            x = np.stack([gates[rows[:, t], 0], gates[rows[:, a], 1]])
            u = np.matmul(state, p["uh"])
            zr = _sig(x[..., : 2 * h] + u[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(x[..., 2 * h :] + r * u[..., 2 * h :])
            new = n + z * (state - n)
            if not whole:
                m = np.stack([mask[:, t], mask[:, a]])[..., None]
                new = np.where(m, new, state)
            if keep:
                kept.append((state, z, r, n, u[..., 2 * h :]))
            state = new
            states[0, t], states[1, a] = new[0], new[1]
        both = np.concatenate([states[0], states[1]], 2)
        tight = np.tanh(both @ p["att"])
        score = np.where(mask.T, tight @ p["v"], np.float32(-1e9))
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = (weight[..., None] * both).sum(0)
        logit = pooled @ p["out"] + p["b"]
        return (logit, (mask, rows, kept, both, tight, weight, pooled)) if keep else logit

    def backward(self, error: np.ndarray, memory, count: int) -> tuple[dict, np.ndarray]:
        """Gradients for d loss / d logit, and for the gates of the words (count of them)."""
        mask, rows, kept, both, tight, weight, pooled = memory
        h, p, g = HIDDEN, self.p, {}
        steps = len(both)
        g["out"], g["b"] = pooled.T @ error, np.array([error.sum()])
        dp = error[:, None] * p["out"]
        dw = (both * dp).sum(2)
        ds = weight * (dw - (weight * dw).sum(0))
        g["v"] = ds.reshape(-1) @ tight.reshape(-1, ATTENTION)
        da = ds[..., None] * p["v"] * (1 - tight * tight)
        g["att"] = both.reshape(-1, 2 * h).T @ da.reshape(-1, ATTENTION)
        dh = weight[..., None] * dp + da @ p["att"].T
        g["uh"], carry, each = np.zeros_like(p["uh"]), np.zeros((2, len(error), h), np.float32), np.zeros((2, steps, len(error), 3 * h), np.float32)
        for t in reversed(range(steps)):
            a = steps - 1 - t
            state, z, r, n, un = kept[t]
            m = np.stack([mask[:, t], mask[:, a]])[..., None]
            total = carry + np.stack([dh[t, :, :h], dh[a, :, h:]])
            d = np.where(m, total, 0)
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (state - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], 2)
            g["uh"] += np.matmul(state.transpose(0, 2, 1), du)
            carry = np.where(m, d * z, total) + np.matmul(du, p["uh"].transpose(0, 2, 1))
            each[:, t, :, : 2 * h], each[:, t, :, 2 * h :] = du[..., : 2 * h], dn
        at = rows.T.ravel()
        forth, back = (gathered(count, a, x.reshape(-1, 3 * h)) for a, x in ((at, each[0]), (rows.T[::-1].ravel(), each[1])))
        return g, np.stack([forth, back], 1)


class Scorer:
    """Scores whole texts: the largest logit of their windows. Remembers the gate inputs of words, up to half of 2**bits."""

    def __init__(self, net: Net, bits: int = 18):
        self.net = net
        self.table = HashTable(bits)
        self.gates = np.zeros((0, 2, 3 * HIDDEN), np.float32)
        self.size = 0

    def _rows(self, w: textkit.Words) -> np.ndarray:
        keys, at, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        found = self.table.find(keys)
        if not self.table.room(int((found < 0).sum())):
            self.table.clear()
            self.size = 0
            while not self.table.room(len(keys)):
                self.table = HashTable(self.table.bits + 1)
            found[:] = -1
        new = np.flatnonzero(found < 0)
        for a in range(0, len(new), 1 << 13):
            some = new[a : a + (1 << 13)]
            words = [w.buf[s:e] for s, e in zip(w.starts[at[some]].tolist(), w.ends[at[some]].tolist(), strict=True)]
            made = self.net.gates(self.net.inputs(self.net.lookup(keys[some], words)))
            if self.size + len(some) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros((max(len(self.gates), len(some), 1 << 13), 2, 3 * HIDDEN), np.float32)])
            self.gates[self.size : self.size + len(some)] = made
            self.table.add(keys[some], np.arange(self.size, self.size + len(some)))
            found[some] = np.arange(self.size, self.size + len(some))
            self.size += len(some)
        return found[back].astype(np.int64)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """-inf for a text without words."""
        out = np.full(len(texts), -np.inf)
        for a, b in textkit.groups([len(t) for t in texts], 1 << 20):
            w = textkit.Words([t.lower() for t in texts[a:b]], APART)
            if not len(w.starts):
                continue
            rows = self._rows(w)
            doc, start, left = [], [], []
            for d in np.flatnonzero(w.counts).tolist():
                s = windows(int(w.counts[d]))
                doc.append(np.full(len(s), d)), start.append(s + w.first[d]), left.append(w.counts[d] - s)
            doc, start, left = map(np.concatenate, (doc, start, left))
            left = np.minimum(left, WINDOW)
            order = np.argsort(-left, kind="stable")
            for c in range(0, len(order), 1024):
                some = order[c : c + 1024]
                place = np.arange(left[some[0]])
                inside = place < left[some][:, None]
                r = np.where(inside, rows[np.minimum(start[some][:, None] + place, len(rows) - 1)], -1)
                np.maximum.at(out, a + doc[some], self.net.run(self.gates, r))
        return out


def distinct_texts(texts: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Numbers of texts with words that are no near copies of one earlier text of their label: copies agree in 5 or more of 8 smallest shingle hashes by different orders."""
    kept, seen = [], [{} for _ in range(8)]
    salts = textkit.series(8, 23)
    for i, s in enumerate(x for a, b in textkit.groups([len(t) for t in texts]) for x in textkit.shingle_sets(texts[a:b])):
        if not len(s):
            continue
        low = [(int(labels[i]), int(textkit.mix(s ^ k).min())) for k in salts]
        like = [x[m] for m, x in zip(low, seen, strict=True) if m in x]
        if not like or max(map(like.count, like)) < 5:
            kept.append(i)
            for m, x in zip(low, seen, strict=True):
                x.setdefault(m, i)
    return np.array(kept, np.int64)


def train(texts: list[bytes], labels: np.ndarray, rounds: int = 8, batch: int = 96, per_text: int = 24, least_steps: int = 480, seed: int = 2) -> Net:
    """The network. A text's label is that of its highest-scoring window: each round takes that window of a labelled
    text (at first a random one; of texts with label 0, not always). per_text: windows of a text of label 0 that may be taken; of label 1, all may."""
    rng = np.random.default_rng(seed)
    at = distinct_texts(texts, labels)
    texts, labels = [texts[i] for i in at.tolist()], labels[at]
    w = textkit.Words([t.lower() for t in texts], APART)
    keys, at, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(len(texts)), w.counts)
    held = np.bincount(np.unique(np.stack([doc, back]), axis=1)[1], minlength=len(keys))  # texts of each word, whatever their label
    net = Net(keys[held >= LEAST])
    usable = np.flatnonzero(w.counts)
    yes, no = usable[labels[usable] == 1], usable[labels[usable] == 0]
    if not len(yes) or not len(no):
        return net
    every = net.lookup(keys, [w.buf[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
    starts = [s if len(s) <= per_text or labels[i] else np.sort(rng.choice(s, per_text, False)) for i, s in enumerate(windows(int(n)) for n in w.counts)]

    def rows_of(d: np.ndarray, s: np.ndarray) -> np.ndarray:
        place = s[:, None] + np.arange(WINDOW)
        return np.where(place < w.counts[d][:, None], back[np.minimum(w.first[d][:, None] + place, len(back) - 1)], -1)

    moment, square, steps = {}, {}, 0
    chosen = {d: int(rng.choice(starts[d])) for d in usable.tolist()}
    half = batch // 2
    per_round = max(least_steps // rounds, min(2 * max(len(yes), len(no)) // batch, 60))
    for r in range(rounds):
        if r:
            gates = net.gates(net.inputs(every))
            d = np.repeat(usable, [len(starts[i]) for i in usable.tolist()])
            s = np.concatenate([starts[i] for i in usable.tolist()])
            logit = np.concatenate([net.run(gates, rows_of(d[a : a + 1024], s[a : a + 1024])) for a in range(0, len(d), 1024)])
            best = np.lexsort((logit, d))[np.append(np.flatnonzero(np.diff(d)), len(d) - 1)]
            for i in best.tolist():
                chosen[int(d[i])] = int(s[i]) if labels[d[i]] == 1 or rng.random() < 0.7 else int(rng.choice(starts[d[i]]))
        for _ in range(per_round):
            d = np.concatenate([rng.choice(yes, half), rng.choice(no, half)])
            rows = rows_of(d, np.array([chosen[i] for i in d.tolist()]))
            local, where = np.unique(rows, return_inverse=True)
            where = where.reshape(rows.shape) - (local[0] < 0)
            met = every.some(local[local >= 0])
            drop = rng.random(len(met.rows)) < 0.6
            x = net.inputs(met, drop)
            logit, memory = net.run(net.gates(x), where, keep=True)
            g, dg = net.backward(((_sig(logit) - labels[d]) / batch).astype(np.float32), memory, len(x))
            dg = dg.transpose(1, 0, 2)
            g["wx"], g["bx"] = np.matmul(np.broadcast_to(x.T, (2, *x.T.shape)), dg), dg.sum(1, keepdims=True)
            g |= net.inputs_back(met, np.matmul(dg, net.p["wx"].transpose(0, 2, 1)).sum(0), drop)
            steps += 1
            for k, v in g.items():
                v = v + 1e-4 * net.p[k]
                moment[k] = 0.9 * moment.get(k, 0) + 0.1 * v
                square[k] = 0.999 * square.get(k, 0) + 0.001 * v * v
                net.p[k] -= (0.01 * min(1, steps / 20) * (moment[k] / (1 - 0.9**steps)) / (np.sqrt(square[k] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    return net
