"""A gated recurrent language model in numpy with a class-factored softmax.

The vocabulary's words lie in LEAVES leaves: the most frequent half of the leaves hold one word each, the other words
share leaves with their neighbours in byte order, about as many tokens in each. Leaves lie in FAN groups of FAN groups
of FAN leaves. P(word) = P(group | state) * P(subgroup | group, state) * P(leaf | subgroup, state) * P(word | leaf): the
state decides over the whole vocabulary down to the leaf, and counts decide inside leaves of several words.
"""

from __future__ import annotations

import heapq

import numpy as np

FAN = 16
LEAVES = FAN**3
HIDDEN = 16
#: Lanes and steps of a scoring window.
LANES, STEPS = 256, 64
#: Truncated backpropagation: steps of a training window, the most lanes, and windows aimed at where there are fewer.
TRAIN_STEPS, TRAIN_LANES, TRAIN_WINDOWS = 32, 256, 64
F32 = np.float32


class Vocabulary:
    """Leaves of words from their smoothed counts, sorted from the most frequent down; the rest's total is ``rare``.

    ``words`` gives the byte order of the words that share leaves; without it they share them by count.
    """

    def __init__(self, counts: np.ndarray, rare: float, words: list[bytes] | None = None):
        n = self.n = len(counts)
        single = n if n < LEAVES else LEAVES // 2
        self.leaf = np.full(n + 1, LEAVES - 1, np.int32)
        self.leaf[:single] = np.arange(single)
        if n > single:
            order = np.arange(single, n) if words is None else np.array(sorted(range(single, n), key=words.__getitem__))
            up_to = np.cumsum(counts[order])
            self.leaf[order] = single + np.minimum((up_to - counts[order]) * (LEAVES - 1 - single) // up_to[-1], LEAVES - 2 - single).astype(np.int32)
        mass = np.bincount(self.leaf[:n], counts, LEAVES)
        mass[-1] += rare
        #: log10 P(word | leaf); 0 for the rest, whose words are told apart outside
        self.inside = np.append(np.log10(counts / mass[self.leaf[:n]]) if n else np.zeros(0), 0.0)
        mass = np.maximum(mass, 1e-9).reshape(FAN, FAN, FAN)
        self.bias = [np.log(m / m.sum(axis=-1, keepdims=True)) for m in (mass.sum(axis=(1, 2)), mass.sum(axis=2), mass.reshape(-1, FAN))]


def _softmax(logits: np.ndarray, target: np.ndarray, grad: bool) -> np.ndarray:
    """log P(target) of each row; with ``grad`` the logits become the loss's gradients."""
    rows = np.arange(len(target))
    np.clip(logits, -40, 40, out=logits)
    got = logits[rows, target]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    got -= np.log(total)
    if grad:
        logits *= (1 / total)[:, None]
        logits[rows, target] -= 1
    return got


class Net:
    """Parameters in one float32 vector, so that shards can be averaged; at first it is the unigram model.

    ``E`` holds what a word read adds to the gates (update, reset) and to the candidate state.
    """

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        self.v = vocabulary
        d = HIDDEN
        self.shapes = {"E": (LEAVES, 3 * d), "Wh": (d, 3 * d), "W1": (d, FAN), "b1": (FAN,), "W2": (FAN, d, FAN), "b2": (FAN, FAN), "W3": (FAN * FAN, d, FAN), "b3": (FAN * FAN, FAN)}
        total = sum(int(np.prod(s)) for s in self.shapes.values())
        self.flat = np.zeros(total, F32) if flat is None else flat.astype(F32)
        self.p = self.views(self.flat)
        if flat is None:
            rng = np.random.default_rng(4)
            self.p["E"][:] = rng.normal(0, 0.4, self.shapes["E"])
            self.p["E"][:, :d] += 0.5
            self.p["Wh"][:] = rng.normal(0, d**-0.5, self.shapes["Wh"])
            for k, b in zip(("b1", "b2", "b3"), vocabulary.bias):
                self.p[k][:] = b

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return out

    def run(self, x: np.ndarray, start: np.ndarray, h: np.ndarray):
        """States (steps x HIDDEN x lanes) of a window x (steps x lanes of leaves) from the states h; start: a document begins.

        Also, per step, what backpropagation needs: the states before, gates and candidates, and the recurrent parts. A
        gate is (1 + tanh) / 2, so that one tanh serves both gates.
        """
        wh, d = np.ascontiguousarray(self.p["Wh"].T), HIDDEN
        a = np.ascontiguousarray(self.p["E"][x].transpose(0, 2, 1))
        before, out = (np.empty((len(x), d, x.shape[1]), F32) for _ in range(2))
        g = np.empty_like(a)
        fresh = start.any(axis=1).tolist()
        for t in range(len(x)):
            if fresh[t]:
                h = np.where(start[t], F32(0), h)
            before[t] = h
            now, s = a[t], g[t]
            np.matmul(wh, h, out=s)
            gates, n, new = now[: 2 * d], now[2 * d :], out[t]
            gates += s[: 2 * d]
            np.tanh(gates, out=gates)
            gates *= F32(0.5)
            gates += F32(0.5)
            np.multiply(gates[d:], s[2 * d :], out=new)
            n += new
            np.tanh(n, out=n)
            np.subtract(h, n, out=new)
            new *= gates[:d]
            new += n
            h = new
        return out, h, (before, a, g)

    def output(self, states: np.ndarray, words: np.ndarray, grad: dict | None = None):
        """Natural log P(leaf) of each word from its state (rows alike).

        With ``grad`` the gradients of the summed loss are put into it, and those of the states are given too.
        """
        p, leaf = self.p, self.v.leaf[words]
        order = np.argsort(leaf.astype(np.uint16), kind="stable")
        s, leaf = states[order], leaf[order]
        c, g = leaf // (FAN * FAN), leaf // FAN
        logits = s @ p["W1"]
        logits += p["b1"]
        got = _softmax(logits, c, grad is not None)
        if grad is not None:
            grad["W1"][:], grad["b1"][:] = s.T @ logits, logits.sum(axis=0)
            back = logits @ p["W1"].T
        for of, target, w, b in ((c, g % FAN, "W2", "b2"), (g, leaf % FAN, "W3", "b3")):
            held, first = np.unique(of, return_index=True)
            ends = [*first[1:].tolist(), len(of)]
            parts = list(zip(held.tolist(), first.tolist(), ends))
            logits = p[b][of]
            for k, i, j in parts:
                logits[i:j] += s[i:j] @ p[w][k]
            got += _softmax(logits, target, grad is not None)
            if grad is not None:
                gw = grad[w]
                gw[:] = 0
                for k, i, j in parts:
                    np.matmul(s[i:j].T, logits[i:j], out=gw[k])
                    back[i:j] += logits[i:j] @ p[w][k].T
                grad[b][:] = 0
                if len(held):
                    grad[b][held] = np.add.reduceat(logits, first, axis=0)
        put = np.empty_like(got)
        put[order] = got
        if grad is None:
            return put, None
        unsorted = np.empty_like(back)
        unsorted[order] = back
        return put, unsorted

    def score(self, docs: list[np.ndarray], end: int, lanes: int = LANES) -> np.ndarray:
        """log10 P of each document (word numbers, its end included), less the rare words' shares within their leaf.

        Documents go through lanes, one after the other, window by window; a lane's state is carried from window to
        window and reset where a document begins.
        """
        out = np.zeros(len(docs))
        if not docs:
            return out
        held = deal([len(x) for x in docs], lanes)
        ids = [np.concatenate([docs[i] for i in mine]) for mine in held]
        owner = [np.repeat(np.array(mine, np.int32), [len(docs[i]) for i in mine]) for mine in held]
        alive = np.array([len(x) for x in ids])
        h = np.zeros((HIDDEN, len(ids)), F32)
        last = np.full(len(ids), end, np.int32)
        for t in range(0, int(alive[0]), STEPS):
            n, steps = int((alive > t).sum()), min(STEPS, int(alive[0]) - t)
            w, o = np.zeros((n, steps), np.int32), np.full((n, steps), -1, np.int32)
            for k in range(n):
                part = ids[k][t : t + steps]
                w[k, : len(part)] = part
                o[k, : len(part)] = owner[k][t : t + steps]
            words, of = np.ascontiguousarray(w.T), np.ascontiguousarray(o.T)
            feed, start = np.empty_like(words), np.empty(words.shape, bool)
            feed[0], feed[1:] = last[:n], words[:-1]
            start[0], start[1:] = feed[0] == end, of[1:] != of[:-1]
            feed[start] = end
            last = words[-1]
            states, h, _ = self.run(self.v.leaf[feed], start, h[:, :n])
            real = of >= 0
            words, of = words[real], of[real]
            got, _ = self.output(states.transpose(0, 2, 1)[real], words)
            out += np.bincount(of, got / np.log(10) + self.v.inside[words], len(docs))
        return out

    def train(self, docs: list[np.ndarray], end: int, rate: float = 2e-2) -> None:
        """One pass of truncated backpropagation through the documents in their order, with Adam.

        The documents follow one another in a stream that is cut into equally long lanes.
        """
        ids, real, start = stream(docs)
        if not ids.size:
            return
        feed = feed_of(ids, start, end)
        h = np.zeros((HIDDEN, ids.shape[1]), F32)
        g = np.zeros_like(self.flat)
        grad = self.views(g)
        n_embed = int(np.prod(self.shapes["E"]))
        rest, rest_g = self.flat[n_embed:], g[n_embed:]
        m1, m2 = np.zeros_like(g), np.zeros_like(g)
        e1, e2, r1, r2 = self.views(m1)["E"], self.views(m2)["E"], m1[n_embed:], m2[n_embed:]
        for step, t in enumerate(range(0, len(ids), TRAIN_STEPS), 1):
            cut = slice(t, t + TRAIN_STEPS)
            n, h, rows, sums = self.gradient(grad, ids[cut], feed[cut], real[cut], start[cut], h)
            if not n:
                continue
            norm = float(np.sqrt(rest_g @ rest_g + np.vdot(sums, sums))) / n
            scale = F32(1 / (n * max(1.0, norm)))
            rest_g *= scale
            sums *= scale
            on1, on2 = F32(1 / (1 - 0.9**step)), F32(1 / (1 - 0.995**step))
            r1 += F32(0.1) * (rest_g - r1)
            r2 += F32(0.005) * (rest_g * rest_g - r2)
            rest -= F32(rate) * (r1 * on1) / (np.sqrt(r2 * on2) + F32(1e-7))
            a, b = e1[rows], e2[rows]
            a += F32(0.1) * (sums - a)
            b += F32(0.005) * (sums * sums - b)
            e1[rows], e2[rows] = a, b
            self.p["E"][rows] -= F32(rate) * (a * on1) / (np.sqrt(b * on2) + F32(1e-7))

    def gradient(self, grad: dict, words: np.ndarray, feed: np.ndarray, real: np.ndarray, start: np.ndarray, h: np.ndarray):
        """Gradients of a window's summed loss, put into ``grad`` (all but E): words counted, states at the end, and E's rows with theirs."""
        p, d, x = self.p, HIDDEN, self.v.leaf[feed]
        states, last, (before, a, g) = self.run(x, start, h)
        _, back = self.output(states.transpose(0, 2, 1)[real], words[real], grad)
        ds = np.zeros((*x.shape, d), back.dtype)
        ds[real] = back
        ds = np.ascontiguousarray(ds.transpose(0, 2, 1))
        z, r, n, gn = a[:, :d], a[:, d : 2 * d], a[:, 2 * d :], g[:, 2 * d :]
        to_n = (1 - z) * (1 - n * n)
        to_z = (before - n) * z * (2 - 2 * z)
        to_r = gn * r * (2 - 2 * r)
        dg, dn, dh, wh = g, np.empty_like(states), np.zeros_like(last), p["Wh"]
        fresh = start.any(axis=1).tolist()
        for t in range(len(x) - 1, -1, -1):
            dh += ds[t]
            one, now = dn[t], dg[t]
            np.multiply(dh, to_n[t], out=one)
            np.multiply(dh, to_z[t], out=now[:d])
            np.multiply(one, to_r[t], out=now[d : 2 * d])
            np.multiply(one, r[t], out=now[2 * d :])
            dh *= z[t]
            dh += wh @ now
            if fresh[t]:
                dh[:, start[t]] = 0
        grad["Wh"][:] = np.matmul(before, dg.transpose(0, 2, 1)).sum(axis=0)
        dg[:, 2 * d :] = dn
        flat = x.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        rows, first = np.unique(flat[order], return_index=True)
        return int(real.sum()), last, rows, np.add.reduceat(dg.transpose(0, 2, 1).reshape(-1, 3 * d)[order], first, axis=0)


def stream(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, whether there is one, and document starts, as steps x lanes; each lane is a run of the documents' words."""
    n = sum(map(len, docs))
    lanes = int(min(TRAIN_LANES, max(1, n // (TRAIN_STEPS * TRAIN_WINDOWS)), max(1, n)))
    steps = -(-n // lanes) if n else 0
    ids, real, start = np.zeros(steps * lanes, np.int32), np.zeros(steps * lanes, bool), np.zeros(steps * lanes, bool)
    if n:
        ids[:n] = np.concatenate(docs)
        real[:n] = True
        sizes = np.array([len(x) for x in docs])
        start[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        start[::steps] = True
    return tuple(np.ascontiguousarray(x.reshape(lanes, steps).T) for x in (ids, real, start))


def deal(sizes: list[int], lanes: int) -> list[list[int]]:
    """Which documents go through each lane, one after the other; longest lanes first."""
    lanes = max(1, min(lanes, len(sizes), sum(sizes) // STEPS + 1))
    held: list[list[int]] = [[] for _ in range(lanes)]
    heap = [(0, k) for k in range(lanes)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (n + sizes[i], k))
    return sorted((x for x in held if x), key=lambda x: -sum(sizes[i] for i in x))


def feed_of(ids: np.ndarray, start: np.ndarray, end: int) -> np.ndarray:
    """The word before each, ``end`` where a document begins."""
    feed = np.empty_like(ids)
    feed[1:] = ids[:-1]
    feed[0] = end
    feed[start] = end
    return feed
