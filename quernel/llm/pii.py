"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns (email, ip, card, phone) give the base spans.  The model adds what they miss:
addresses written "name (at) host dot com" or "10[.]0[.]0[.]1", cards with other separators,
telephone numbers without a plus.  It is trained in numpy, by back-propagation through the LSTM
and the CRF's forward-backward recursion, from EXAMPLES labelled windows that a seeded generator
writes; so it is the same for every corpus.  ``python -m quernel.llm.pii`` trains it and keeps the
parameters in a file beside this one; where that is missing or another recipe's, the driver trains.

Where it looks: ``fits`` accepts no span without a digit, an "@", an "at" in brackets or before a
host, or a "dot", so places without these are read and found empty by a pattern, and only the
rest of a text is scored.  Windows of WINDOW characters, overlapping by half, cover a region
around such places; where they overlap their scores are averaged, each weighted by the distance
from the window's edge, and one Viterbi pass decodes the whole region, so no span breaks at a
window's end.  A region whose decoding has a span close to its edge is widened to double its
margin and decoded again, until no span touches an edge but that of the text: spans of any
length come out whole.  A span is added if it touches no base span, its least marginal
probability is SURE or more, and its characters suit its kind.

Null texts are empty; repeated rows are scanned alike; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, slices, table

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, and a first and further character of each kind
WINDOW, MARGIN = 128, 24
HIDDEN = 24
EXAMPLES, BATCH, SEED = 32_000, 32, 3
SURE = 0.5
#: The part of training windows that the text does not fill.
PADDED = 0.25
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Longer regions are decoded in pieces of LONG characters that overlap by LAP on both sides.
LONG, LAP = 1 << 15, 1 << 10
#: Characters that are decoded at once, unless one piece is longer.
AT_ONCE = 1 << 18
#: Characters at a region's edge that no span may come to.
CLEAR = 8
#: How "at" and "dot" are written out in addresses.
_AT = r"[\[({<]\s?at\s?[\])}>]|(?<![^\W_])at\s+[\w-]+(?:\.\w|\s+dot(?![^\W_])|\s?[\[({<]\s?dot)"
_WRITTEN = re.compile("@|" + _AT, re.I)
#: What every span holds.
TRIGGER = re.compile(r"[0-9@]|" + _AT + r"|(?<![^\W_])dot(?![^\W_])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- the model


@functools.cache
def _classes():
    """The input class of each of 65,536 code points (higher ones share those of the low bits)."""
    import numpy as np

    own = " \n@.-_+()[]:/,%#=\"'*"
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        s = chr(c)
        if s in own:
            out[c] = own.index(s)
        elif "0" <= s <= "9":
            out[c] = len(own)
        elif s in "atdoATDO":
            out[c] = len(own) + 1 + "atdo".index(s.lower())
        elif "a" <= s <= "z":
            out[c] = len(own) + 5
        elif "A" <= s <= "Z":
            out[c] = len(own) + 6
        else:
            out[c] = len(own) + (7 if s.isalpha() else 8)
    return out, len(own) + 10  # the last class pads


def encode(text: str):
    import numpy as np

    return _classes()[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") & 0xFFFF]


def _sigmoid(x):
    import numpy as np

    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _lstm(x, wx, wh, b):
    """Hidden states of (batch, time) input classes, and what back-propagation needs."""
    import numpy as np

    n, t = x.shape
    size = wh.shape[0]
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    states, kept = np.empty((t, n, size), np.float32), []
    for k in range(t):
        z = wx[x[:, k]] + h @ wh + b
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o, g = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(z[:, 3 * size :])
        before, last = c, h
        c = f * c + i * g
        th = np.tanh(c)
        h = o * th
        states[k] = h
        kept.append((i, f, o, g, before, th, last))
    return states, kept


def _lstm_back(x, wx, wh, kept, grad):
    """Gradients of wx, wh and b from those of the hidden states."""
    import numpy as np

    t, n, size = grad.shape
    dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    every, wht = np.empty((t, n, 4 * size), np.float32), wh.T.copy()
    for k in range(t - 1, -1, -1):
        i, f, o, g, before, th, _ = kept[k]
        dz = every[k]
        dh = dh + grad[k]
        dc = dc + dh * o * (1 - th * th)
        dz[:, :size] = dc * g * i * (1 - i)
        dz[:, size : 2 * size] = dc * before * f * (1 - f)
        dz[:, 2 * size : 3 * size] = dh * th * o * (1 - o)
        dz[:, 3 * size :] = dc * i * (1 - g * g)
        dh = dz @ wht
        dc = dc * f
    flat = every.reshape(-1, 4 * size)
    hot = np.zeros((t * n, wx.shape[0]), np.float32)
    hot[np.arange(t * n), x.T.ravel()] = 1
    last = np.concatenate([k[6] for k in kept])
    return hot.T @ flat, last.T @ flat, flat.sum(axis=0)


def emissions(p: dict, x):
    """(time, batch, TAGS) scores of (batch, time) classes."""
    import numpy as np

    forth, _ = _lstm(x, p["wx0"], p["wh0"], p["b0"])
    back, _ = _lstm(x[:, ::-1], p["wx1"], p["wh1"], p["b1"])
    return np.concatenate([forth, back[::-1]], axis=2) @ p["out"] + p["bias"]


def _allowed():
    """Score added to each transition: a further character follows one of its own kind only."""
    import numpy as np

    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[1 + 2 * k, 2 + 2 * k] = out[2 + 2 * k, 2 + 2 * k] = 0
    return out


def _total(a, axis):
    import numpy as np

    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def marginals(p: dict, e, size=None):
    """Marginal tag probabilities (time, batch, TAGS), pair sums (TAGS, TAGS), log partition.

    ``size``: how many of the times of each row count.
    """
    import numpy as np

    t, n, _ = e.shape
    step = p["trans"] + _allowed()
    inside = np.ones((t, n), bool) if size is None else np.arange(t)[:, None] < size
    first = np.zeros(TAGS, np.float32)
    first[2::2] = -1e4
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + first
    for k in range(1, t):
        new = _total(alpha[k - 1][:, :, None] + step, 1) + e[k]
        alpha[k] = np.where(inside[k][:, None], new, alpha[k - 1])
    for k in range(t - 2, -1, -1):
        new = _total(step + (e[k + 1] + beta[k + 1])[:, None, :], 2)
        beta[k] = np.where(inside[k + 1][:, None], new, 0)
    z = _total(alpha[-1], 1)
    gamma = np.exp(alpha + beta - z[None, :, None])
    pairs = None
    if size is None:
        pairs = np.zeros((TAGS, TAGS), np.float32)
        for k in range(1, t):
            pairs += np.exp(alpha[k - 1][:, :, None] + step + (e[k] + beta[k])[:, None, :] - z[:, None, None]).sum(axis=0)
    return gamma, pairs, z


def viterbi(p: dict, e, size):
    """The best tags (time, batch) of rows with ``size`` times each."""
    import numpy as np

    t, n, _ = e.shape
    step = p["trans"] + _allowed()
    score = e[0].copy()
    score[:, 2::2] -= 1e4
    came = np.zeros((t, n, TAGS), np.int8)
    stay = np.arange(TAGS, dtype=np.int8)
    for k in range(1, t):
        every = score[:, :, None] + step
        best = every.argmax(axis=1)
        live = (k < size)[:, None]
        came[k] = np.where(live, best, stay)
        score = np.where(live, np.take_along_axis(every, best[:, None, :], 1)[:, 0] + e[k], score)
    out = np.empty((t, n), np.int8)
    out[-1] = score.argmax(axis=1)
    for k in range(t - 1, 0, -1):
        out[k - 1] = came[k][np.arange(n), out[k]]
    return out


# --- labelled examples


def examples(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts of at least WINDOW characters with their spans (kind, start, end)."""
    import random

    rnd = random.Random(seed)
    syl = "an be ch de el en er es ge he in is ka la le ma me ne no on or ou ra re ri sch st ta te th ti to tion un ver wa wi zu é ó ñ ü".split()
    word = lambda a=1, b=4: "".join(rnd.choice(syl) for _ in range(rnd.randint(a, b)))
    plain = lambda a=1, b=3: re.sub("[^a-z]", "x", word(a, b))
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def email():
        long_ = rnd.random() < 0.2
        name = plain(1, 9 if long_ else 3) + rnd.choice(["", ".", "_", "-"]) + rnd.choice([plain(1, 8 if long_ else 3), d(2), ""])
        name, host, end = name.strip("._-"), plain(1, 8 if long_ else 3) + rnd.choice(["", d(1), "." + plain(), "-" + plain()]), rnd.choice(["com", "org", "net", "de", "io", "edu", "example.com", "co.uk"])
        if rnd.random() < 0.15:
            name = name.capitalize()
        left, right = rnd.choice(["()", "[]", "{}", "<>"])
        forms = [("@", ".")] * 4 + [(f" {left}at{right} ", " dot "), (f"{left}at{right}", "."), (f" {left}at{right} ", f" {left}dot{right} "), (" @ ", "."), (f" {left}at{right} ", "."), (f"{left}at{right}", f"{left}dot{right}"), (" at ", " dot "), (" at ", " dot ")]
        at, dot = rnd.choice(forms)
        if rnd.random() < 0.3:
            at, dot = at.upper(), dot.upper()
        return name + at + host.replace(".", dot) + dot + end.replace(".", dot)

    def ip():
        dot = rnd.choice([".", ".", ".", "[.]", "(.)", " . "])
        return dot.join(str(rnd.randint(0, 255)) for _ in range(4))

    def card():
        n = d(rnd.choice([15, 15, 15, 14, 12]))
        n += next(c for c in "0123456789" if luhn(n + c))
        sep = rnd.choice(["", "", " ", "-", ".", "_", "/"])
        return sep.join(n[k : k + 4] for k in range(0, len(n), 4))

    def phone():
        a, b, c = d(3), d(3), d(4)
        return rnd.choice([f"+1 ({a}) {b}-{c}", f"+{d(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{d(2)} {a} {c}", f"0{d(3)}/{d(7)}", f"+{d(2)}-{a}-{d(7)}"])

    def other():
        return rnd.choice([
            d(rnd.randint(1, 6)), f"{rnd.randint(1900, 2099)}", f"{d(4)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}", f"{rnd.randint(0, 23):02}:{d(2)}", f"${d(2)}.{d(2)}",
            f"{d(1)}.{d(1)}", f"v{d(1)}.{d(2)}.{d(1)}", f"{d(1)},{d(3)},{d(3)}", f"{d(2)}%", f"#{d(5)}", f"id={d(8)}", "@" + plain(), f"{rnd.randint(1, 28)}.{rnd.randint(1, 12)}.{rnd.randint(1900, 2099)}",
            f"{word()} at {word()}", "at the " + word(), "(at " + word() + ")", "dot " + word(), word() + " at " + d(2) + ":" + d(2), "look at " + word() + ". " + word(), f"version {d(1)}.0.", f"{d(3)} x {d(3)}", f"{d(2)}-{d(2)}", f"{d(9)}", f"{d(11)}", f"{d(20)}", f"({rnd.randint(1900, 2099)})", f"{plain()}{d(3)}", f"{d(4)}{plain()}{d(5)}{plain()}{d(3)}", f"{d(3)}.{d(3)}.{d(3)}", f"AK{d(2)}Q{d(3)}XZ{d(2)}",
            f"{plain()}={d(2)}{plain(1, 1)}{d(4)}{plain(1, 1)}{d(5)}", f"({plain()}) {plain()}", f"p. {d(2)}-{d(3)}", f"§ {d(2)}.{d(1)}", f"ISBN {d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}",
        ])

    out = []
    while len(out) < count:
        text, spans = "", []
        for _ in range(rnd.randint(4, 9)):
            roll = rnd.random()
            if roll < 0.22:
                kind = rnd.randrange(4)
                made = (email, ip, card, phone)[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
                text += made
            elif roll < 0.45:
                text += other()
            else:
                part = " ".join(word() for _ in range(rnd.randint(1, 5)))
                text += part.capitalize() if rnd.random() < 0.2 else part
            text += rnd.choice([" ", " ", " ", " ", ", ", ". ", "\n", ".\n", ": ", " - ", "; "])
        if len(text) > WINDOW:
            out.append((text, spans))
    return out


def labelled(count: int, seed: int):
    """(classes, tags), each (count, WINDOW): one random window of each example."""
    import numpy as np

    rnd = np.random.default_rng(seed)
    xs, ys = np.empty((count, WINDOW), np.int64), np.empty((count, WINDOW), np.int64)
    for n, (text, spans) in enumerate(examples(count, seed)):
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
        at = int(rnd.integers(0, len(text) - WINDOW + 1))
        for a, b in ((s, e) for _, s, e in spans):  # whole spans only
            if a < at < b:
                at = min(b, len(text) - WINDOW)
        if rnd.random() < PADDED:  # the end of a text, or a short one
            at = len(text) - int(rnd.integers(8, WINDOW))
            at = min([b for _, a, b in spans if a < at < b], default=at)
        own, x = tags[at : at + WINDOW].copy(), encode(text)[at : at + WINDOW]
        if len(own) and own[0] and own[0] % 2 == 0:
            own[0] -= 1
        xs[n], ys[n] = _classes()[1] - 1, 0
        xs[n, : len(x)], ys[n, : len(x)] = x, own
    return xs, ys


def _loss(p: dict, e, y, z) -> float:
    """Mean negative log probability of the tags ``y``."""
    import numpy as np

    own = np.take_along_axis(e, y[:, :, None], 2)[:, :, 0].sum(axis=0) + (p["trans"] + _allowed())[y[:-1], y[1:]].sum(axis=0)
    return float((z - own).mean())


#: The trained parameters, some 60 kB, beside the number that says what they were trained with.
WEIGHTS = Path(__file__).with_name("pii_weights.npz")


def recipe() -> str:
    """What training depends on: its numbers, and the examples themselves."""
    import hashlib

    seen = hashlib.sha256(repr(((EXAMPLES, BATCH, HIDDEN, SEED, WINDOW, PADDED, TAGS), examples(50, SEED))).encode())
    return seen.hexdigest()


@functools.cache
def trained() -> dict:
    """The parameters that ``fit`` finds, read from WEIGHTS if these come from the same recipe, else fitted now."""
    import numpy as np

    if WEIGHTS.exists():
        with np.load(WEIGHTS) as held:
            if str(held["recipe"]) == recipe():
                return {k: held[k] for k in held.files if k != "recipe"}
    return fit(EXAMPLES, HIDDEN, SEED)


def fit(count: int, hidden: int, seed: int, trace: list | None = None) -> dict:
    """The parameters, by Adam over one pass of the labelled windows; ``trace`` gets the losses."""
    import numpy as np

    rnd = np.random.default_rng(seed)
    kinds = _classes()[1]
    draw = lambda *s: (rnd.standard_normal(s) * 0.2).astype(np.float32)
    p = {}
    for k in "01":
        p |= {"wx" + k: draw(kinds, 4 * hidden), "wh" + k: draw(hidden, 4 * hidden), "b" + k: np.zeros(4 * hidden, np.float32)}
        p["b" + k][hidden : 2 * hidden] = 1
    p |= {"out": draw(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    xs, ys = labelled(count, seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    steps = count // BATCH
    for step in range(1, steps + 1):
        rows = slice((step - 1) * BATCH, step * BATCH)
        x, y = xs[rows], ys[rows].T
        forth, kept0 = _lstm(x, p["wx0"], p["wh0"], p["b0"])
        back, kept1 = _lstm(x[:, ::-1], p["wx1"], p["wh1"], p["b1"])
        h = np.concatenate([forth, back[::-1]], axis=2)
        e = (h @ p["out"] + p["bias"]).astype(np.float32)
        gamma, pairs, z = marginals(p, e)
        if trace is not None:
            trace.append(_loss(p, e, y, z))
        np.put_along_axis(gamma, y[:, :, None], np.take_along_axis(gamma, y[:, :, None], 2) - 1, 2)
        de = gamma / BATCH
        np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
        dh = de @ p["out"].T
        grads = {"out": np.einsum("tbh,tbk->hk", h, de, optimize=True), "bias": de.sum(axis=(0, 1)), "trans": pairs / BATCH}
        for k, kept, d, own in (("0", kept0, dh[:, :, :hidden], x), ("1", kept1, dh[::-1, :, hidden:], x[:, ::-1])):
            grads["wx" + k], grads["wh" + k], grads["b" + k] = _lstm_back(own, p["wx" + k], p["wh" + k], kept, d)
        rate = 0.012 * min(1, step / 20) * (1 - 0.95 * step / steps)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


# --- decoding


def regions(text: str, margin: int = MARGIN) -> list[tuple[int, int]]:
    """Where spans may lie: ``margin`` characters around each trigger, joined where they meet."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - margin), min(len(text), m.end() + margin)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def _scores(p: dict, pieces: list, at_once: int = 2048):
    """For each region's class array its emissions, overlapping windows averaged by weight."""
    import numpy as np

    half, pad = WINDOW // 2, _classes()[1] - 1
    starts = [(k, a) for k, x in enumerate(pieces) for a in range(0, max(1, len(x) - half), half)]
    sums = [np.zeros((len(x), TAGS), np.float32) for x in pieces]
    weights = [np.zeros((len(x), 1), np.float32) for x in pieces]
    weight = (np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW)) + 1).astype(np.float32)[:, None]
    for lo in range(0, len(starts), at_once):
        part = starts[lo : lo + at_once]
        x = np.full((len(part), WINDOW), pad, np.int64)
        for n, (k, a) in enumerate(part):
            own = pieces[k][a : a + WINDOW]
            x[n, : len(own)] = own
        e = emissions(p, x).transpose(1, 0, 2)
        for n, (k, a) in enumerate(part):
            size = min(WINDOW, len(pieces[k]) - a)
            sums[k][a : a + size] += weight[:size] * e[n, :size]
            weights[k][a : a + size] += weight[:size]
    return [s / w for s, w in zip(sums, weights, strict=True)]


def decode(p: dict, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans (kind, start, end) that the model finds in each text."""
    out: list[list] = [[] for _ in texts]
    todo, margin = [(n, a, b) for n, t in enumerate(texts) for a, b in regions(t)], MARGIN
    while todo:
        margin *= 2
        wider: dict[int, list[list[int]]] = {}
        for (n, a, b), spans, tight in _decoded(p, texts, todo):
            if tight:
                a, b = max(0, a - margin), min(len(texts[n]), b + margin)
                wider.setdefault(n, []).append([a, b])
            else:
                out[n] += spans
        todo = []
        for n, own in wider.items():
            own.sort()
            joined = [own[0]]
            for a, b in own[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            todo += [(n, a, b) for a, b in joined]
    return [_apart(x) for x in out]


def _apart(spans: list) -> list:
    """Without what overlaps an earlier span: a widened region may have grown over a neighbour."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= done:
            out.append((kind, a, b))
            done = b
    return out


def _cuts(a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
    """A region in pieces of bounded size: (start, end) of each, and of the part whose spans count."""
    for at in range(a, b, LONG):
        yield max(a, at - LAP), min(b, at + LONG + LAP), at, min(b, at + LONG)


def _decoded(p: dict, texts: list[str], where: list[tuple[int, int, int]]) -> Iterator:
    """Each region with its sure spans, and whether any span, sure or not, comes close to an edge inside the text."""
    import numpy as np

    cuts = [(k, *cut) for k, (_, a, b) in enumerate(where) for cut in _cuts(a, b)]
    found: list[list] = [[] for _ in where]
    tight = [False] * len(where)
    cuts.sort(key=lambda c: c[2] - c[1])
    at = 0
    while at < len(cuts):
        upto, longest = at, cuts[at][2] - cuts[at][1]
        most = max(longest + 16, longest * 5 // 4)
        while upto < len(cuts) and (upto == at or (upto - at) * most < AT_ONCE) and cuts[upto][2] - cuts[upto][1] <= most:
            upto += 1
        own = cuts[at:upto]
        scores = _scores(p, [encode(texts[where[k][0]][a:b]) for k, a, b, *_ in own])
        size = np.array([len(s) for s in scores])
        e = np.zeros((size.max(), len(own), TAGS), np.float32)
        for n, s in enumerate(scores):
            e[: len(s), n] = s
        tags, gamma = viterbi(p, e, size), marginals(p, e, size)[0]
        sure = np.take_along_axis(gamma, tags[:, :, None].astype(np.int64), 2)[:, :, 0]
        for n, (k, start, end, core, core_end) in enumerate(own):
            text, first, last = where[k]
            row = tags[: size[n], n]
            for a in np.flatnonzero(row % 2 == 1).tolist():
                b = a + 1
                while b < len(row) and row[b] == row[a] + 1:
                    b += 1
                if core <= start + a < core_end and sure[a:b, n].min() >= SURE:
                    found[k].append(((int(row[a]) - 1) // 2, start + a, start + b))
            tight[k] |= start == first > 0 and bool(row[:CLEAR].any())
            tight[k] |= end == last < len(texts[text]) and bool(row[-CLEAR:].any())
        at = upto
    yield from zip(where, found, tight, strict=True)


def fits(kind: int, s: str) -> bool:
    """Whether a span's characters suit its kind."""
    d = _digits(s)
    if kind == 0:
        return bool(_WRITTEN.search(s)) and len(re.findall("[A-Za-z]+", s)) >= 3
    if kind == 1:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(int(x) <= 255 for x in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and not re.fullmatch("[0-9]+", s)


def spans_of(p: dict, texts: list[str | None]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    out = [([], []) for _ in texts]
    hit = [k for k, t in enumerate(texts) if t and TRIGGER.search(t)]
    for k in hit:
        out[k] = base_spans(texts[k]), []
    for k, found in zip(hit, decode(p, [texts[k] for k in hit]), strict=True):
        base, added = out[k]
        taken = sorted((a, b) for _, a, b in base)
        for kind, a, b in found:
            at = _first_after(taken, a)
            clear = (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b)
            if clear and fits(kind, texts[k][a:b]):
                added.append((kind, a, b))
    return out


def _first_after(spans: list[tuple[int, int]], a: int) -> int:
    import bisect

    return bisect.bisect_left(spans, (a, -1))


def _scan(batches: Iterator, p) -> Iterator:
    import hashlib

    import pyarrow as pa

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    joined = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        cols: list[list] = [[] for _ in names[1:]]
        for base, added in (x for _, texts in slices(batch, 1, 2000) for x in spans_of(p.value, texts)):
            row = [sum(k == kind for k, _, _ in base) for kind in range(4)]
            row += [hashlib.sha256(joined(base).encode()).hexdigest() if base else empty, joined(base + added), len(added)]
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, counts of base spans, base_sha256, all spans, n_added; no shuffle."""
    p = docs.sparkSession.sparkContext.broadcast(trained())  # some 60 kB
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: freeing(_scan(it, p)), schema)


def query(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))


if __name__ == "__main__":  # python -m quernel.llm.pii trains anew and writes the parameters
    import numpy as np

    np.savez_compressed(WEIGHTS, recipe=recipe(), **fit(EXAMPLES, HIDDEN, SEED))
