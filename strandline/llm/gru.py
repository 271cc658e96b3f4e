"""A gated recurrent language model in numpy: training by truncated backpropagation, class-factored softmax.

Token ids run from 0 (end of text) over 1 (any word out of vocabulary) to classes * size - 1, in order of falling
frequency; id // size is a token's class. P(token | state) = P(class | state) * P(token | class, state).
"""

from __future__ import annotations

import heapq

import numpy as np

END, UNKNOWN = 0, 1
LN10 = float(np.log(10.0))
#: Texts that are learned side by side.
LANES = 384
#: Rows whose softmaxes are taken at a time: few enough to stay in a processor's cache.
ROWS = 1024


class Gru:
    """Parameters by name, all float32."""

    def __init__(self, classes: int, size: int, hidden: int, embed: int):
        self.classes, self.size, self.hidden, self.embed = classes, size, hidden, embed
        self.shapes = {
            "emb": (classes * size, embed),
            "wx": (embed, 3 * hidden),
            "u": (hidden, 3 * hidden),
            "b": (3 * hidden,),
            "wc": (hidden, classes),
            "bc": (classes,),
            "ww": (classes, hidden, size),
            "bw": (classes, size),
        }
        self.p: dict[str, np.ndarray] = {}

    def start(self, counts: np.ndarray, seed: int = 0) -> Gru:
        """Random weights; output biases at the log frequencies, so that the model starts from the unigram."""
        rng = np.random.default_rng(seed)
        for name, shape in self.shapes.items():
            scale = {"emb": 0.5, "wx": self.embed**-0.5, "u": self.hidden**-0.5, "wc": 0.05, "ww": 0.05}.get(name, 0.0)
            self.p[name] = (rng.standard_normal(shape) * scale).astype(np.float32)
        share = (np.resize(counts.astype(np.float64), self.classes * self.size) + 0.5).reshape(self.classes, self.size)
        self.p["bc"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
        self.p["bw"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
        self.p["b"][: self.hidden] = 1.0  # keep the state at first
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.shapes])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            self.p[name] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n
        return self

    def same(self) -> Gru:
        return Gru(self.classes, self.size, self.hidden, self.embed).load(self.flat())

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """The input part of each gate per token, (3, tokens, hidden), and each gate's recurrent weights, (3, hidden, hidden).

        A gate's numbers lie together, so that no step works on columns of wider rows. Those of the two sigmoid gates are
        halved: sigmoid(a) is (1 + tanh(a / 2)) / 2.
        """
        n = self.hidden
        x = self.p["emb"] @ self.p["wx"] + self.p["b"]
        both = [np.ascontiguousarray(y.reshape(-1, 3, n).transpose(1, 0, 2)) for y in (x, self.p["u"])]
        for y in both:
            y[:2] *= 0.5
        return tuple(both)

    @staticmethod
    def step(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
        """(state, z, r, c, recurrent part of c) after inputs x, (3, batch, hidden), from state h; uses x up."""
        a = h @ u
        zr, c = x[:2], x[2]
        zr += a[:2]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r = zr
        c += r * a[2]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new, z, r, c, a[2]

    def log_probs(self, h: np.ndarray, targets: np.ndarray, grad: bool = False):
        """ln P(target | state) per row; with grad also the gradient of its negative sum."""
        classes, size, n = self.classes, self.size, self.hidden
        cls = (targets // size).astype(np.uint16)
        order = np.argsort(cls, kind="stable")
        cls = cls[order]
        word = targets[order] - cls * size + classes
        edges = np.searchsorted(cls, np.arange(classes + 1)).tolist()
        # Beside the columns of all classes, those of the words of one: a row's two softmaxes are one product. Below the
        # weights, the biases, which meet a column of ones.
        both = np.empty((classes, n + 1, classes + size), np.result_type(h, self.p["ww"]))
        both[:, :n, :classes], both[:, n, :classes] = self.p["wc"], self.p["bc"]
        both[:, :n, classes:], both[:, n, classes:] = self.p["ww"], self.p["bw"]
        sides = np.zeros((classes + size, 2), both.dtype)
        sides[:classes, 0] = sides[classes:, 1] = 1
        x = np.ones((len(h), n + 1), both.dtype)
        x[:, :n] = np.take(h, order, axis=0)
        out = np.empty(len(h), both.dtype)
        if grad:
            dh, g = np.empty((len(h), n), both.dtype), np.zeros_like(both)
        some, room = np.arange(ROWS), np.empty((ROWS, classes + size), both.dtype)
        # Rows of a class lie together now.
        for c in range(classes):
            for a in range(edges[c], edges[c + 1], ROWS):
                b = min(a + ROWS, edges[c + 1])
                part, at = x[a:b], (some[: b - a], word[a:b])
                e = np.matmul(part, both[c], out=room[: b - a])
                out[a:b] = e[:, c] + e[at]
                np.exp(e, out=e)
                total = e @ sides
                out[a:b] -= np.log(total[:, 0] * total[:, 1])
                if grad:
                    e *= (1 / total) @ sides.T
                    e[:, c] -= 1
                    e[at] -= 1
                    g[c] += part.T @ e
                    np.matmul(e, both[c, :n].T, out=dh[a:b])
        back = np.empty_like(out)
        back[order] = out
        if not grad:
            return back
        dback = np.empty_like(dh)
        dback[order] = dh
        shared = g[:, :, :classes].sum(0)
        return back, {"wc": shared[:n], "bc": shared[n], "ww": g[:, :n, classes:], "bw": g[:, n, classes:]}, dback

    def window(self, before: np.ndarray, targets: np.ndarray, h0: np.ndarray, fresh: np.ndarray | None = None) -> tuple[float, int, dict[str, np.ndarray], np.ndarray]:
        """Truncated backpropagation through one window (time, batch); targets of -1 count for nothing.

        before: the token ahead of each target; fresh: where a text starts, from the state of nought (after an END, if
        not given). Returns (negative log likelihood, targets, gradient, last state).
        """
        time, batch = targets.shape
        n = self.hidden
        table, u = self.gates()
        starts = [np.flatnonzero(x) for x in (before == END if fresh is None else fresh)]
        states, steps, h = [], [], h0
        for t in range(time):
            if len(starts[t]):
                h = h.copy()
                h[starts[t]] = 0
            new, *rest = self.step(np.take(table, before[t], axis=1), h, u)
            steps.append((h, *rest))
            states.append(new)
            h = new
        live = np.flatnonzero(targets.ravel() >= 0)
        flat = np.concatenate(states)
        out, g, dlive = self.log_probs(np.take(flat, live, axis=0), targets.ravel()[live], grad=True)
        dout = np.zeros_like(flat)
        dout[live] = dlive
        dout = dout.reshape(time, batch, n)
        # Of each gate's sum, of its input part; the recurrent part of c has a factor r more.
        dx, da = np.empty((3, time, batch, n), flat.dtype), np.empty((time, batch, n), flat.dtype)
        back = np.ascontiguousarray(self.p["u"].reshape(n, 3, n).transpose(1, 2, 0))
        dh = np.zeros_like(h0)
        for t in range(time - 1, -1, -1):
            prev, z, r, c, a = steps[t]
            dz, dr, dc = dx[:, t]
            dh += dout[t]
            dh_z = dh * z
            np.subtract(dh, dh_z, out=dc)
            np.subtract(prev, c, out=dz)
            dz *= z
            dz *= dc
            slope = c * c
            np.subtract(1, slope, out=slope)
            dc *= slope
            np.multiply(dc, r, out=da[t])
            np.multiply(da[t], a, out=dr)
            np.subtract(1, r, out=slope)
            dr *= slope
            dh = dh_z
            dh += dz @ back[0]
            dh += dr @ back[1]
            dh += da[t] @ back[2]
            if len(starts[t]):
                dh[starts[t]] = 0
        before_all = np.concatenate([s[0] for s in steps]).T
        dx = dx.reshape(3, -1, n)
        tokens = before.ravel()
        emb = np.take(self.p["emb"], tokens, axis=0)
        g["u"] = np.concatenate([before_all @ d for d in (dx[0], dx[1], da.reshape(-1, n))], axis=1)
        g["wx"], g["b"] = np.concatenate(emb.T @ dx, axis=1), (np.ones((1, dx.shape[1]), dx.dtype) @ dx).ravel()
        demb = sum(d @ w.T for d, w in zip(dx, np.split(self.p["wx"], 3, axis=1)))
        order = np.argsort(tokens.astype(np.min_scalar_type(len(self.p["emb"]))), kind="stable")  # few bytes sort by radix
        used, first = np.unique(tokens[order], return_index=True)
        g["emb"] = np.zeros_like(self.p["emb"])
        g["emb"][used] = np.add.reduceat(np.take(demb, order, axis=0), first)
        return -float(out.sum()), len(live), g, h


class Adam:
    def __init__(self, model: Gru, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def update(self, grad: dict[str, np.ndarray], weight: float) -> None:
        self.t += 1
        for k, g in grad.items():
            g = np.clip(g / weight, -1, 1)
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            self.model.p[k] -= self.rate * m / (np.sqrt(v) + 1e-6)


def stream(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, targets, fresh) of pieces of texts, one behind another; a piece is the token ahead of it and its tokens."""
    before = np.concatenate([p[:-1] for p in pieces])
    targets = np.concatenate([p[1:] for p in pieces])
    fresh = np.zeros(len(targets), bool)
    fresh[np.cumsum([0, *[len(p) - 1 for p in pieces[:-1]]])] = True
    return before, targets, fresh


def train(model: Gru, pieces: list[np.ndarray], rate: float, epochs: int = 1, lanes: int = LANES, steps: int = 32, adam: Adam | None = None) -> tuple[float, int]:
    """Train on every token of the pieces, laid out one behind another and cut into lanes of equal length.

    The state is carried from window to window along a lane and set back where a piece starts, so a text that does not
    straddle two lanes is learned as scoring reads it. Returns the last epoch's (negative log likelihood in nats, targets).
    """
    adam = adam or Adam(model, rate)
    before, targets, fresh = stream(pieces)
    lanes = max(1, min(lanes, len(targets) // steps))
    height = -(-len(targets) // lanes)

    def laid(x: np.ndarray, filler: int) -> np.ndarray:
        out = np.full(lanes * height, filler, x.dtype)
        out[: len(x)] = x
        return np.ascontiguousarray(out.reshape(lanes, height).T)

    before, targets, fresh = laid(before, END), laid(targets, -1), laid(fresh, True)
    loss, total = 0.0, 0
    for _ in range(epochs):
        loss, total = 0.0, 0
        h = np.zeros((lanes, model.hidden), np.float32)
        for at in range(0, height, steps):
            nll, n, grad, h = model.window(before[at : at + steps], targets[at : at + steps], h, fresh[at : at + steps])
            loss, total = loss + nll, total + n
            adam.update(grad, n)
    return loss, total


def packed(lengths: list[int], lanes: int) -> list[list[int]]:
    """Texts by number, dealt to lanes of about equal length, longest first.

    Beside a text that is long for the whole, fewer lanes do: all lanes together, each as long as the longest, hold a
    few times the texts' tokens at most.
    """
    lanes = min(lanes, len(lengths), max(1, 2 * sum(lengths) // max(lengths)))
    heap = [(0, k) for k in range(lanes)]
    lane: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        load, k = heapq.heappop(heap)
        lane[k].append(i)
        heapq.heappush(heap, (load + lengths[i], k))
    return lane


def score(model: Gru, texts: list[np.ndarray], lanes: int = 512, steps: int = 64) -> np.ndarray:
    """ln P of each whole text, whose tokens end with END. Texts are packed one behind another into lanes; the state
    is carried across windows and set back where a text starts, so that every text is read as if alone."""
    total = np.zeros(len(texts))
    if not texts:
        return total
    lane = packed([len(x) for x in texts], lanes)
    loads = [sum(len(texts[i]) for i in one) for one in lane]
    order = sorted(range(len(lane)), key=lambda k: -loads[k])  # lanes that end first come last
    height = loads[order[0]]
    tokens = np.full((height, len(lane)), -1, np.int32)
    owner = np.zeros((height, len(lane)), np.int32)
    for col, k in enumerate(order):
        at = 0
        for i in lane[k]:
            tokens[at : at + len(texts[i]), col] = texts[i]
            owner[at : at + len(texts[i]), col] = i
            at += len(texts[i])
    lengths = np.array([loads[k] for k in order])
    alive = np.searchsorted(-lengths, -np.arange(height), side="left")  # lanes longer than t
    table, u = model.gates()
    before = np.zeros(len(lane), np.int64)
    h = np.zeros((len(lane), model.hidden), np.float32)
    for start in range(0, height, steps):
        states, targets, owners = [], [], []
        for t in range(start, min(start + steps, height)):
            live = alive[t]
            h, before = h[:live], before[:live]
            fresh = np.flatnonzero(before == END)
            if len(fresh):
                h = h.copy()
                h[fresh] = 0
            h = model.step(np.take(table, before, axis=1), h, u)[0]
            before = tokens[t, :live].astype(np.int64)
            states.append(h)
            targets.append(before)
            owners.append(owner[t, :live])
        out = model.log_probs(np.concatenate(states), np.concatenate(targets))
        total += np.bincount(np.concatenate(owners), weights=out, minlength=len(texts))
    return total
