"""A character tagger in numpy: a bidirectional LSTM whose outputs feed a CRF over span tags."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Outside, then beginning and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Printable ASCII has a symbol each; then other letters, blanks, digits, anything else, padding.
SYMBOLS = 95 + 5
PADDING = SYMBOLS - 1
EMBEDDED = 12
HIDDEN = 16
TRAIN_WIDTH = 64


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((points >= 32) & (points < 127), points - 32, 98).astype(np.int64)
    out[(points >= 0xC0) & (points < 0x2000)] = 95
    out[((points >= 9) & (points <= 13)) | (points == 0xA0)] = 96
    return out


@dataclass
class Tagger:
    """``step`` adds the letter's and the last state's parts for four gates, per direction."""

    embed: np.ndarray  # symbol, EMBEDDED
    enter: np.ndarray  # direction, EMBEDDED, 4 gates * HIDDEN
    bias: np.ndarray  # direction, 4 gates * HIDDEN
    again: np.ndarray  # direction, HIDDEN, 4 gates * HIDDEN
    out: np.ndarray  # 2 * HIDDEN, TAGS
    out_bias: np.ndarray  # TAGS
    move: np.ndarray  # tag, next tag

    def arrays(self) -> list[np.ndarray]:
        return list(vars(self).values())


def allowed() -> np.ndarray:
    """An inside tag follows only the beginning or inside of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for inside in range(2, TAGS, 2):
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


FORBIDDEN = np.where(allowed(), 0.0, -1e4)
#: A window cannot begin within a span.
START = np.array([0.0] + [0.0, -1e4] * len(KINDS))


def fresh(seed: int) -> Tagger:
    rng = np.random.default_rng(seed)
    bias = np.zeros((2, 4 * HIDDEN))
    bias[:, HIDDEN : 2 * HIDDEN] = 1.0
    return Tagger(
        rng.normal(0, 0.3, (SYMBOLS, EMBEDDED)),
        rng.normal(0, 1 / np.sqrt(EMBEDDED), (2, EMBEDDED, 4 * HIDDEN)),
        bias,
        rng.normal(0, 1 / np.sqrt(HIDDEN), (2, HIDDEN, 4 * HIDDEN)),
        rng.normal(0, 0.2, (2 * HIDDEN, TAGS)),
        np.zeros(TAGS),
        np.zeros((TAGS, TAGS)),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _states(model: Tagger, x: np.ndarray, way: int, keep: list | None) -> np.ndarray:
    """Hidden states, time first; ``keep`` gets per step what going back needs."""
    steps = x.shape[1]
    letters = (model.embed @ model.enter[way] + model.bias[way]).astype(model.embed.dtype)
    again, h = model.again[way], np.zeros((len(x), HIDDEN), model.embed.dtype)
    c, states = np.zeros_like(h), np.empty((steps, len(x), HIDDEN), model.embed.dtype)
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        gates = letters[x[:, t]]
        gates += h @ again
        three = _sigmoid(gates[:, : 3 * HIDDEN])  # in, forget, out
        new = np.tanh(gates[:, 3 * HIDDEN :])
        before = (h, c)
        c = three[:, HIDDEN : 2 * HIDDEN] * c + three[:, :HIDDEN] * new
        curved = np.tanh(c)
        h = three[:, 2 * HIDDEN :] * curved
        states[t] = h
        if keep is not None:
            keep.append((t, three, new, curved, before))
    return states


def emissions(model: Tagger, x: np.ndarray) -> np.ndarray:
    """Scores of tags, ``(window, position, tag)``, for windows of symbols."""
    h = np.concatenate([_states(model, x, 0, None), _states(model, x, 1, None)], axis=2)
    return (h @ model.out + model.out_bias).transpose(1, 0, 2)


def decode(model: Tagger, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best path of tags of each window, and how far each position's tag beats *outside* there."""
    score = emissions(model, x)
    move = (model.move + FORBIDDEN).astype(score.dtype)
    best, back = score[:, 0] + START.astype(score.dtype), []
    for t in range(1, x.shape[1]):
        reach = best[:, :, None] + move
        back.append(reach.argmax(1))
        best = np.take_along_axis(reach, back[-1][:, None], 1)[:, 0] + score[:, t]
    path = np.empty(x.shape, np.int64)
    path[:, -1] = best.argmax(1)
    for t in range(x.shape[1] - 2, -1, -1):
        path[:, t] = np.take_along_axis(back[t], path[:, t + 1, None], 1)[:, 0]
    return path, np.take_along_axis(score, path[:, :, None], 2)[:, :, 0] - score[:, :, 0]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def _gradients(model: Tagger, x: np.ndarray, gold: np.ndarray) -> list[np.ndarray]:
    """Of the mean negative log-likelihood of the gold paths, in the order of ``arrays``."""
    count, steps = x.shape
    kept: tuple[list, list] = ([], [])
    states = [_states(model, x, way, kept[way]) for way in (0, 1)]
    h = np.concatenate(states, axis=2)
    score = h @ model.out + model.out_bias
    move = model.move + FORBIDDEN
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[0] = score[0] + START
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + move, 1) + score[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(move + (score[t + 1] + beta[t + 1])[:, None], 2)
    total = _lse(alpha[-1], 1)
    d_score = np.exp(alpha + beta - total[:, None])
    d_move = np.zeros_like(model.move)
    for t in range(1, steps):
        joint = alpha[t - 1][:, :, None] + move + (score[t] + beta[t])[:, None] - total[:, None, None]
        d_move += np.exp(joint).sum(0)
    rows = np.arange(count)
    for t in range(steps):
        d_score[t, rows, gold[:, t]] -= 1
    np.subtract.at(d_move, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    d_score /= count
    d_h = d_score @ model.out.T
    grads = [np.zeros_like(a) for a in model.arrays()]
    grads[4] = np.einsum("tbh,tbk->hk", h, d_score)
    grads[5], grads[6] = d_score.sum((0, 1)), d_move / count
    for way in (0, 1):
        later_h = np.zeros((count, HIDDEN))
        later_c = np.zeros((count, HIDDEN))
        for t, three, new, curved, (h_before, c_before) in reversed(kept[way]):
            i, f, o = (three[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
            dh = d_h[t][:, way * HIDDEN : (way + 1) * HIDDEN] + later_h
            dc = later_c + dh * o * (1 - curved**2)
            d_gates = np.concatenate(
                [dc * new * i * (1 - i), dc * c_before * f * (1 - f), dh * curved * o * (1 - o), dc * i * (1 - new**2)], 1
            )
            later_c, later_h = dc * f, d_gates @ model.again[way].T
            grads[3][way] += h_before.T @ d_gates
            grads[2][way] += d_gates.sum(0)
            seen = model.embed[x[:, t]]
            grads[1][way] += seen.T @ d_gates
            np.add.at(grads[0], x[:, t], d_gates @ model.enter[way].T)
    return grads


def _digits(rng: np.random.Generator, count: int) -> str:
    return "".join(map(str, rng.integers(0, 10, count)))


def passes_luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _word(rng: np.random.Generator) -> str:
    letters = list("etaoinshrdlucmwfgypbvkéèñöüß")
    word = "".join(rng.choice(letters, rng.integers(1, 9)))
    shape = rng.integers(0, 8)
    return word.upper() if shape == 0 else word.capitalize() if shape == 1 else word + rng.choice(list(".,;:!?*|")) if shape == 2 else word


def _span(rng: np.random.Generator) -> tuple[str, int]:
    """A piece of text and its kind; kind -1 for look-alikes that are no personal data."""
    n = lambda low, high: int(rng.integers(low, high))
    kind = n(-3, len(KINDS))
    name = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789._-"), n(2, 10))).strip("._-") or "a"
    if kind == 0:
        return f"{name}@{rng.choice(['mail', 'post', 'web'])}{n(0, 30)}.{rng.choice(['example', 'host', 'uni'])}.{rng.choice(['com', 'org', 'net', 'de'])}"[n(0, 1) :], 0
    if kind == 1:
        return ".".join(str(n(0, 256)) for _ in range(4)), 1
    if kind == 2:
        number = "4" + _digits(rng, 14)
        number += next(d for d in "0123456789" if passes_luhn(number + d))
        sign = rng.choice(["", " ", "-", ".", "/"])
        return sign.join(number[i : i + 4] for i in range(0, 16, 4)), 2
    if kind == 3:
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        forms = [f"+{n(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{n(1, 99)} {a} {b} {c}", f"{a}-{b}-{c}", f"+{n(1, 99)}{a}{b}{c}"]
        return forms[n(0, len(forms))], 3
    others = ["".join(rng.choice(list("0123456789abcdef"), 40)), str(n(1000, 2100)), _digits(rng, n(1, 9)), f"{n(0, 99)}.{n(0, 99)}", f"v{n(0, 9)}.{n(0, 9)}.{n(0, 9)}", f"@{name}", f"{n(1, 28)}.{n(1, 12)}.{n(1990, 2030)}", f"{name}-{n(100, 99999)}", f"{n(1990, 2030)}-{n(10, 12)}-{n(10, 28)}"]
    return others[n(0, len(others))], -1


def labelled_windows(count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made-up prose with labelled spans and look-alikes, cut at any place."""
    x, gold = np.empty((count, TRAIN_WIDTH), np.int64), np.zeros((count, TRAIN_WIDTH), np.int64)
    for row in range(count):
        text, tags = "", []
        while len(text) < TRAIN_WIDTH + 40:
            piece, kind = _span(rng) if rng.random() < 0.25 else (_word(rng), -1)
            glue = rng.choice([" ", " ", " ", " ", "\n", ", ", " | "])
            if kind == 0 and rng.random() < 0.3 and text:  # mail addresses may follow a full stop
                text, tags = text[:-1], tags[:-1]
            text += piece + glue
            own = [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1) if kind >= 0 else [0] * len(piece)
            tags += own + [0] * len(glue)
        at = int(rng.integers(0, 40))
        while at and tags[at] and tags[at] % 2 == 0:  # a window does not begin within a span
            at -= 1
        x[row] = symbols(text)[at : at + TRAIN_WIDTH]
        gold[row] = tags[at : at + TRAIN_WIDTH]
    return x, gold


@lru_cache(maxsize=2)
def trained(seed: int = 11, windows: int = 2048, batch: int = 64, rounds: int = 7, rate: float = 0.02) -> Tagger:
    """A tagger fitted by Adam on ``windows`` labelled windows made from ``seed``; always the same.

    The number of windows bounds the training, whatever the size of the table it is used on.
    """
    rng = np.random.default_rng(seed)
    x, gold = labelled_windows(windows, rng)
    model = fresh(seed)
    first = [np.zeros_like(a) for a in model.arrays()]
    second = [np.zeros_like(a) for a in model.arrays()]
    step, steps = 0, rounds * (windows // batch)
    for _ in range(rounds):
        order = rng.permutation(windows)
        for at in range(0, windows - batch + 1, batch):
            step += 1
            own = order[at : at + batch]
            pace = rate * (1 - step / (steps + 1)) + 5e-4
            for a, g, m, v in zip(model.arrays(), _gradients(model, x[own], gold[own]), first, second, strict=True):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Tagger(*(a.astype(np.float32) for a in model.arrays()))
