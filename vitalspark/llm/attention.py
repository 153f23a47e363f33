"""A small causal self-attention model over classes of subword ids, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CLASSES = 48
WIDTH = 16
CONTEXT = 16
#: New positions a window scores; the ones before them are context from the window before.
STEP = 12
#: Windows of a training step, its first rate, and the steps by which rates fall (halved after three times as many).
BATCH, RATE, HALVING = 64, 0.02, 20
#: Counts of neighbours an id is classed by, on each side; the last is the end of a text.
SLOTS = 97
#: Pseudo neighbours, dealt as for all ids of a kind, that rare ids' features are smoothed by.
PRIOR = 20
#: Classes below this one hold ids that start a word or end the text, the others ids within words.
INNER = CLASSES // 2


def slots(counts: np.ndarray) -> np.ndarray:
    """The slot of each id as a neighbour: common ids are spread first, the end id has the last."""
    out = np.empty(len(counts), np.int64)
    order = np.argsort(-counts[:-1], kind="stable")
    out[order] = np.arange(len(order)) % (SLOTS - 1)
    out[-1] = SLOTS - 1
    return out


def neighbours(total: np.ndarray, ids: np.ndarray, slot: np.ndarray) -> None:
    """Add to the rows of ids the counts of the slots behind them, then before them, in ids laid end to end."""
    for side, (one, other) in enumerate(((ids[:-1], ids[1:]), (ids[1:], ids[:-1]))):
        np.add.at(total.reshape(-1), one * 2 * SLOTS + side * SLOTS + slot[other], 1)


def token_classes(counts: np.ndarray, feature: np.ndarray, starts: np.ndarray, seed: int = 5) -> np.ndarray:
    """A class for each id by weighted k-means over its ``neighbours`` in all training texts.

    ``starts`` tells which ids start a word. Each kind has classes of its own, and ids that never
    occur share one per kind. The id behind the last ends a text and is class 0 alone.
    """
    out = np.append(np.where(starts, 1, INNER), 0)
    rng = np.random.default_rng(seed)
    for kind, low, high in ((starts, 2, INNER), (~starts, INNER + 1, CLASSES)):
        known = np.flatnonzero(np.append(kind, False) & (counts > 0))
        k = min(high - low, len(known))
        if k < 2:
            continue
        own = feature[known].astype(np.float64)
        own += PRIOR * own.sum(0) / max(own.sum(), 1)
        own = np.sqrt(own / own.sum(1, keepdims=True))
        weight = counts[known].astype(float)
        centers = own[rng.choice(len(known), k, replace=False, p=weight / weight.sum())]
        for _ in range(12):
            nearest = (own @ centers.T - (centers ** 2).sum(1) / 2).argmax(1)
            for c in range(k):
                at = nearest == c
                if at.any():
                    centers[c] = np.average(own[at], axis=0, weights=weight[at])
        out[known] = nearest + low
    return out


def windows_of(classes: np.ndarray, offsets: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts laid end to end: inputs, targets, and which targets count.

    Input t is the token before target t; at a text's start and before it stands the end class,
    so no text sees another. Windows overlap unless ``step`` is as long as they are, and every target
    counts in exactly one.
    """
    n = np.diff(offsets)
    count = -(-n // step)
    text = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = (number * step - (CONTEXT - step))[:, None] + np.arange(CONTEXT)
    scored = (at >= 0) & (at < n[text][:, None]) & (np.arange(CONTEXT) >= CONTEXT - step)
    place = np.clip(at, 0, np.maximum(n[text] - 1, 0)[:, None]) + offsets[text][:, None]
    inputs = np.where(at > 0, classes[np.maximum(place - (at < n[text][:, None]), 0)], 0)
    return inputs, classes[place], scored


def below(x: np.ndarray, most: float = 60.0) -> np.ndarray:
    """Rows of values whose exponentials are finite; they are moved only if some are not."""
    if x.size and x.max() > most:
        x -= x.max(-1, keepdims=True)
    return x


@dataclass
class Attention:
    """One head, a residual and a linear output; every position sees itself and those before."""

    parts: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 11) -> Attention:
        rng = np.random.default_rng(seed)
        shapes = {"token": (CLASSES, WIDTH), "place": (CONTEXT, WIDTH), "q": (WIDTH, WIDTH),
                  "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "out": (WIDTH, CLASSES)}
        parts = {k: rng.normal(0, 0.3, v).astype(np.float32) for k, v in shapes.items()}
        return Attention(parts | {"bias": np.zeros(CLASSES, np.float32)})

    def forward(self, inputs: np.ndarray):
        p, rows = self.parts, inputs.shape
        x = (p["token"][inputs] + p["place"]).reshape(-1, WIDTH)
        q, k, v = (y.reshape(*rows, WIDTH) for y in np.split(x @ self.projections(), 3, axis=-1))
        a = q @ k.transpose(0, 2, 1)
        np.exp(below(a), out=a)
        a *= SEEN
        a /= (a @ np.ones((CONTEXT, 1), a.dtype))
        h = x + (a @ v).reshape(-1, WIDTH)
        z = h @ p["out"]
        z += p["bias"]
        return x, q, k, v, a, h, z.reshape(*rows, CLASSES)

    def projections(self) -> np.ndarray:
        """Weights of queries, already divided by the root of their width, keys and values side by side."""
        p = self.parts
        return np.concatenate([p["q"] / np.float32(np.sqrt(WIDTH)), p["k"], p["v"]], axis=1)

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray, last: int = CONTEXT):
        """Natural logs, for the last positions of windows: of each target's probability, and of any word start's."""
        p, first = self.parts, CONTEXT - last
        # a class at a place is always the same vector, so its query, key and value come from a table
        each = (p["token"] + p["place"][:, None]).reshape(-1, WIDTH)
        table = np.concatenate([each @ self.projections(), each], axis=1)
        found = table.take(inputs + np.arange(CONTEXT) * CLASSES, 0)
        a = found[:, first:, :WIDTH] @ found[..., WIDTH:2 * WIDTH].transpose(0, 2, 1)
        np.exp(below(a), out=a)
        a *= SEEN[first:]
        h = a @ found[..., 2 * WIDTH:3 * WIDTH]
        h /= a @ np.ones((CONTEXT, 1), a.dtype)
        h += found[:, first:, 3 * WIDTH:]
        z = h.reshape(-1, WIDTH) @ p["out"]
        z += p["bias"]
        below(z)
        picked = z[np.arange(len(z)), targets[:, first:].reshape(-1)]
        np.exp(z, out=z)
        outer, total = np.log(z @ OUTER.astype(z.dtype)).T
        shape = len(inputs), last
        return (picked - total).reshape(shape), (outer - total).reshape(shape)

    def gradients(self, inputs, targets, scored):
        p, n = self.parts, np.float32(max(scored.sum(), 1))
        x, q, k, v, a, h, z = self.forward(inputs)
        d = z.reshape(-1, CLASSES)
        np.exp(below(d), out=d)
        share = (scored.reshape(-1) / n).astype(d.dtype)
        d *= (share / (d @ np.ones(CLASSES, d.dtype)))[:, None]
        d[np.arange(len(d)), targets.reshape(-1)] -= share
        g = {"out": h.T @ d, "bias": np.ones(len(d), d.dtype) @ d}
        dx = d @ p["out"].T
        dh = dx.reshape(v.shape)
        da = dh @ v.transpose(0, 2, 1)
        da *= a
        ds = a * (da @ np.ones((CONTEXT, 1), a.dtype))
        np.subtract(da, ds, out=ds)
        part = np.empty((*v.shape[:2], 4 * WIDTH), d.dtype)
        np.matmul(ds, k, out=part[..., :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), q, out=part[..., WIDTH:2 * WIDTH])
        np.matmul(a.transpose(0, 2, 1), dh, out=part[..., 2 * WIDTH:3 * WIDTH])
        flat = part.reshape(-1, 4 * WIDTH)
        np.add(dx, flat[:, :3 * WIDTH] @ self.projections().T, out=flat[:, 3 * WIDTH:])
        # x is a token and a place, so sums by token and by place give all products with x
        by_token = ONE_HOT.astype(d.dtype)[inputs.reshape(-1)].T @ flat
        by_place = (np.ones(len(inputs), d.dtype) @ part.reshape(len(inputs), -1)).reshape(CONTEXT, -1)
        g["token"], g["place"] = by_token[:, 3 * WIDTH:], by_place[:, 3 * WIDTH:]
        both = p["token"].T @ by_token[:, :3 * WIDTH] + p["place"].T @ by_place[:, :3 * WIDTH]
        g["q"], g["k"], g["v"] = both[:, :WIDTH] / np.float32(np.sqrt(WIDTH)), both[:, WIDTH:2 * WIDTH], both[:, 2 * WIDTH:]
        return g

    def train(self, adam: Adam, inputs, targets, scored, seed: int = 3) -> None:
        """One step for each random batch of about ``BATCH`` windows; the rate falls with the steps."""
        order = np.random.default_rng(seed).permutation(len(inputs))
        for at in np.array_split(order, max(1, len(order) // BATCH)):
            adam.step(self.gradients(inputs[at], targets[at], scored[at]), RATE / np.sqrt(1 + adam.t / HALVING))

    def flat(self) -> np.ndarray:
        """All weights in one array, in order of names."""
        return np.concatenate([self.parts[n].ravel() for n in sorted(self.parts)]).astype(float)

    def shaped(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """A flat array in order of names as arrays of the shapes of the weights."""
        names = sorted(self.parts)
        cuts = np.cumsum([self.parts[n].size for n in names])[:-1]
        return {n: x.reshape(self.parts[n].shape) for n, x in zip(names, np.split(flat, cuts), strict=True)}


class Adam:
    """Adam's running means of a model's gradients, all weights in one array in order of names."""

    def __init__(self, model: Attention, m: np.ndarray | None = None, s: np.ndarray | None = None, t: float = 0):
        self.model, self.t = model, t
        size = sum(v.size for v in model.parts.values())
        self.m, self.s = (np.zeros(size, np.float32) if x is None else x.copy() for x in (m, s))

    def step(self, gradients: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        m, s, model = self.m, self.s, self.model
        g = np.concatenate([gradients[k].ravel() for k in sorted(model.parts)])
        m += np.float32(0.1) * (g - m)
        s += np.float32(0.01) * (g * g - s)
        move = np.float32(rate / (1 - 0.9 ** self.t)) * m / (np.sqrt(s / np.float32(1 - 0.99 ** self.t)) + np.float32(1e-6))
        start = 0
        for k in sorted(model.parts):
            v = model.parts[k]
            model.parts[k] = v - move[start:start + v.size].reshape(v.shape)
            start += v.size


SEEN = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))
ONE_HOT = np.eye(CLASSES, dtype=np.float32)
#: Adds the classes that start words, and all classes.
OUTER = np.stack([np.arange(CLASSES) < INNER, np.ones(CLASSES, bool)], 1).astype(np.float32)
