"""Personal data: exact rules for four kinds, and a character-level bidirectional LSTM with CRF transitions for the rest.

The network reads character classes, is trained here in numpy on labelled spans that a seeded generator writes into
varied filler text, and tags every character as plain, personal (identity numbers, spelled-out addresses, and the kinds of
the rules) or secret (keys, tokens, passwords). Every text is cut into overlapping windows of its own, padded with a class of
their own at its ends; windows of many texts advance together, side by side and always as many of them, so that a text's
result is the same in whatever company. Emissions of overlapping windows are blended by distance from the window's edge and
the whole text is decoded as one sequence: only stretches whose running score could pay for leaving and re-entering "plain"
need the Viterbi recursion, the best path is plain elsewhere. Very long texts are decoded up to places where it surely is.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone", "personal", "secret")
BASE = KINDS[:4]
TAGS = ("plain", "personal", "secret")
HIDDEN = 8
#: Characters of a window, and how many at each end overlap the neighbour's.
WINDOW, MARGIN = 288, 16
CORE = WINDOW - 2 * MARGIN
#: Windows that advance through the network together, and windows of a text that are decoded at once.
TOGETHER, LONG = 1024, 4096

# --- exact rules ------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the leftmost non-overlapping matches of each kind; linear in the text's length."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done, "email"))
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        place = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((place, place + size, "ip"))
            place += size + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# --- the network ------------------------------------------------------------------------------------------------------

_GROUPS = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", " \t", "\n\r", ".", ",", "@", "-", "+", "(", ")", "=", "\"'", ":;", "_", "/\\", "[]{}<>", "!?", "#*$%&|"]
CLASSES = len(_GROUPS) + 2  # then letters and signs beyond ASCII, and the filler between texts
_CLASS = np.full(0x110000, len(_GROUPS), np.uint8)
for _k, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _k


def classes_of(text: str) -> np.ndarray:
    return _CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def initial(seed: int = 7, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in ("f", "b"):
        p[f"in_{d}"] = rng.normal(0, 0.4, (CLASSES, 4 * hidden))
        p[f"in_{d}"][:, hidden : 2 * hidden] += 0.7  # remember at first
        p[f"rec_{d}"] = rng.normal(0, 0.3, (hidden, 4 * hidden))
    p["out"] = rng.normal(0, 0.3, (2 * hidden, len(TAGS)))
    p["bias"] = np.array([2.0] + [0.0] * (len(TAGS) - 1))
    p["trans"] = 1.5 * np.eye(len(TAGS))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(x: np.ndarray, table_: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, list]:
    """LSTM over x (time x batch); gate order input, forget, output, candidate; sigmoids as tanh of half arguments."""
    n = rec.shape[0]
    h = c = np.zeros((x.shape[1], n), np.float32)
    out, kept = np.empty((len(x), x.shape[1], n), np.float32), []
    for t in range(len(x)):
        a = np.tanh(table_[x[t]] + h @ rec)
        s = 0.5 * a[:, : 3 * n] + 0.5
        new = s[:, n : 2 * n] * c + s[:, :n] * a[:, 3 * n :]
        tc = np.tanh(new)
        kept.append((h, c, a, s, tc))
        c, h = new, s[:, 2 * n :] * tc
        out[t] = h
    return out, kept


def _back(x: np.ndarray, rec: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = rec.shape[0]
    drec, dz_all = np.zeros_like(rec), np.empty((len(x), x.shape[1], 4 * n), np.float32)
    dh = dc = np.zeros((x.shape[1], n), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, c, a, s, tc = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * s[:, 2 * n :] * (1 - tc * tc)
        ds = np.concatenate([dc * a[:, 3 * n :], dc * c, dh * tc], 1)
        dz = dz_all[t]
        dz[:, : 3 * n] = ds * 0.5 * (1 - a[:, : 3 * n] ** 2)
        dz[:, 3 * n :] = dc * s[:, :n] * (1 - a[:, 3 * n :] ** 2)
        drec += h.T @ dz
        dh, dc = dz @ rec.T, dc * s[:, n : 2 * n]
    seen = np.zeros((x.size, CLASSES), np.float32)
    seen[np.arange(x.size), x.reshape(-1)] = 1
    return seen.T @ dz_all.reshape(-1, 4 * n), drec


def _crf(e: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of tags y (time x batch), and its gradients by emissions and transitions."""
    steps, batch, k = e.shape

    def total(v, axis):
        top = v.max(axis, keepdims=True)
        return (top + np.log(np.exp(v - top).sum(axis, keepdims=True))).squeeze(axis)

    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = e[t] + total(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = total(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = total(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None])
    pair = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None])
    dtrans = pair.sum((0, 1))
    np.subtract.at(dtrans, (y[:-1].reshape(-1), y[1:].reshape(-1)), 1)
    t, b = np.indices(y.shape)
    gold = e[t, b, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
    de[t, b, y] -= 1
    return float((z - gold).mean()), de / batch, dtrans / batch


def train(windows: list[tuple[np.ndarray, np.ndarray]], steps: int, batch: int = 48, rate: float = 0.02, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over minibatches of labelled windows (classes, tags) of equal length."""
    p, rng = initial(), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    n = HIDDEN
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        x = np.stack([windows[i][0] for i in pick], 1)
        y = np.stack([windows[i][1] for i in pick], 1).astype(np.int64)
        hf, kf = _run(x, p["in_f"], p["rec_f"])
        hb, kb = _run(x[::-1], p["in_b"], p["rec_b"])
        both = np.concatenate([hf, hb[::-1]], 2)
        _, de, dtrans = _crf(both @ p["out"] + p["bias"], p["trans"], y)
        de = de.astype(np.float32)
        g = {"trans": dtrans, "bias": de.sum((0, 1)), "out": np.tensordot(both, de, ([0, 1], [0, 1]))}
        dh = de @ p["out"].T
        g["in_f"], g["rec_f"] = _back(x, p["rec_f"], kf, dh[:, :, :n])
        g["in_b"], g["rec_b"] = _back(x[::-1], p["rec_b"], kb, dh[::-1, :, n:])
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        pace = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 5 / (size + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] = (p[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


# --- labelled spans ---------------------------------------------------------------------------------------------------

_VOWELS, _OTHERS, _ACCENTS = "aeiou", "bcdfghjklmnpqrstvwxyz", "éèêçñäöüßíóúà"


def _word(r: random.Random, accents: float) -> str:
    return "".join(r.choice(_ACCENTS if r.random() < accents else _VOWELS if r.random() < 0.45 else _OTHERS) for _ in range(r.choice((1, 2, 2, 3, 4, 5, 6, 7, 9, 12))))


def _filler(r: random.Random) -> str:
    """A run of words in one of several styles, without personal data."""
    style, accents = r.random(), r.choice((0, 0, 0.15))
    words = [_word(r, accents) for _ in range(r.randint(4, 22))]
    if style < 0.08:
        return " | ".join(words) + ". "
    if style < 0.14:
        return "!! ".join(w.upper() for w in words) + "! "
    if style < 0.2:
        return "".join(w + r.choice(("### ", "$$$ ", "%%% ", "&&& ", "*** ")) for w in words)
    if style < 0.3:
        words[r.randrange(len(words))] = r.choice((str(r.randint(1, 2100)), f"{r.randint(1, 99)}%", f"{r.randint(1, 12)}.", f"{r.randint(0, 23)}:{r.randint(10, 59)}", f"{r.randint(1, 999)},{r.randint(100, 999)}", f"$ {r.randint(1, 900)}.{r.randint(10, 99)}", f"({r.randint(1, 99)})", f"Version {r.randint(1, 9)}.{r.randint(0, 9)}"))
    if style < 0.36:
        words[r.randrange(len(words))] = f"https://{_word(r, 0)}.org/{_word(r, 0)}/{r.randint(1, 9999)}"
    text = " ".join(w + (r.choice(",;:") if r.random() < 0.07 else "") for w in words)
    return text[:1].upper() + text[1:] + r.choice((". ", ".\n", "\n", ", ", " "))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _planted(r: random.Random) -> tuple[str, str, str, str]:
    """(before, span, after, tag) of one labelled span."""
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    free = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n))
    name, host = _word(r, 0) + _word(r, 0), _word(r, 0) + _word(r, 0)
    pick = r.randrange(14)
    if pick < 2:
        quote = r.choice(('"', '"', "'", ""))
        return f"{r.choice(('token', 'secret', 'api_key', 'key', 'auth'))}{r.choice((' = ', '=', ': '))}{quote}", hexes(r.choice((32, 40, 40, 64))), quote + " ", "secret"
    if pick == 2:
        return r.choice(("password=", "passwd: ", "pwd=", "password = ")), r.choice((hexes, free))(r.randint(8, 20)), " ", "secret"
    if pick == 3:
        return "", "AKIA" + mixed(16), " ", "secret"
    if pick == 4:
        return "", r.choice(("sk-", "ghp_", "xoxb-")) + free(r.randint(24, 40)), " ", "secret"
    if pick == 5:
        return "", f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", " ", "personal"
    if pick == 6:
        return "", f"{mixed(2).translate(str.maketrans('0123456789', 'ABCDEFGHIJ'))}{_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)}", " ", "personal"
    if pick == 7:
        return "", f"{name}{r.choice((' [at] ', ' (at) ', '[at]'))}{host}{r.choice((' [dot] ', ' (dot) ', '[dot]'))}{r.choice(('com', 'org', 'net'))}", " ", "personal"
    if pick == 8:
        return "", f"{r.randint(200, 999)}-{_digits(r, 3)}-{_digits(r, 4)}", " ", "personal"
    if pick == 9:
        return "", f"{name}.{_digits(r, 2)}@{host}.{r.choice(('com', 'example.com', 'org'))}", " ", "personal"
    if pick == 10:
        return "", ".".join(str(r.randint(1, 255)) for _ in range(4)), " ", "personal"
    if pick == 11:
        return "", f"+{r.randint(1, 99)} ({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", " ", "personal"
    if pick == 12:
        return "", f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", " ", "personal"
    sep = r.choice(("", " ", "-"))
    return "", sep.join(_digits(r, 4) for _ in range(4)), " ", "personal"


def labelled_text(r: random.Random, size: int, spans: float = 0.55) -> tuple[str, np.ndarray]:
    """A text of exactly ``size`` characters and the tag of each."""
    text, tags = "", []
    while len(text) < size:
        part = _filler(r)
        text, tags = text + part, tags + [0] * len(part)
        if r.random() < spans:
            before, span, after, tag = _planted(r)
            text += before + span + after
            tags += [0] * len(before) + [TAGS.index(tag)] * len(span) + [0] * len(after)
    cut = r.randint(0, len(text) - size)
    return text[cut : cut + size], np.array(tags[cut : cut + size], np.int8)


@functools.lru_cache(maxsize=2)
def trained(texts: int = 3000, steps: int = 700, size: int = 128, seed: int = 3) -> dict[str, np.ndarray]:
    """The model; it depends on these numbers alone, so one process trains it once."""
    r = random.Random(seed)
    windows = []
    for _ in range(texts):
        text, tags = labelled_text(r, size)
        windows.append((classes_of(text), tags))
    return train(windows, steps)


# --- decoding ---------------------------------------------------------------------------------------------------------


#: Hidden states and the weights they meet are multiples of this. A product is then a multiple of its square, and a sum of
#: ``HIDDEN`` of them below 2**8 has fewer than 53 bits: exact in double precision, in whatever order a library adds it up.
GRID = np.float32(2.0**-20)


def _on_grid(weights: np.ndarray) -> np.ndarray:
    """``weights`` rounded to the grid, in double precision."""
    if not np.abs(weights).max() < 32:
        raise ValueError("weights beyond the range in which sums are exact")
    return np.rint(weights.astype(np.float64) / float(GRID)) * float(GRID)


def _forward(x: np.ndarray, table_: np.ndarray, rec: np.ndarray, out: np.ndarray) -> None:
    """The same recursion as ``_run``, features x batch and in place; writes hidden states, on the grid, to out (time x hidden x
    batch). No result depends on the place in the batch."""
    n = rec.shape[0]
    table_, rec = np.ascontiguousarray(table_.T), np.ascontiguousarray(_on_grid(rec).T)
    batch = x.shape[1]
    h, c, tc = (np.zeros((n, batch), np.float32) for _ in range(3))
    wide, exact, near, z = np.zeros((n, batch)), np.empty((4 * n, batch)), np.empty((4 * n, batch), np.float32), np.empty((4 * n, batch), np.float32)
    for t in range(len(x)):
        np.take(table_, x[t], axis=1, out=z, mode="clip")  # classes are in range: unlike others, this mode fills z in place
        if t:
            wide[:] = h
            np.matmul(rec, wide, out=exact)
            near[:] = exact
            z += near
        np.tanh(z, out=z)
        gates = z[: 3 * n]
        gates *= 0.5
        gates += 0.5
        c *= gates[n : 2 * n]
        z[3 * n :] *= gates[:n]
        c += z[3 * n :]
        np.tanh(c, out=tc)
        h = out[t]
        np.multiply(gates[2 * n :], tc, out=h)
        h *= 1 / GRID
        np.rint(h, out=h)
        h *= GRID


def windows_of(size: int) -> int:
    return max(1, -(-size // CORE))


_RAMP = np.minimum(1.0, np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)) / (2.0 * MARGIN)).astype(np.float32)


def emissions(parts: list[tuple[np.ndarray, int, int]], p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Scores (characters x tags) of stretches of texts: (all character classes of a text, first window, end window).

    Each window reads MARGIN characters beyond its core on both sides, and blends there with the windows beside it, which
    are computed too where the stretch leaves them out.
    """
    k, n = len(TAGS), HIDDEN
    codes, begin, places, size = [], [], [], 0
    for text, first, end in parts:
        a, b = max(0, first - 1), min(windows_of(len(text)), end + 1)
        own = np.full((b - a) * CORE + 2 * MARGIN, CLASSES - 1, np.uint8)
        low = max(0, a * CORE - MARGIN)
        inside = text[low : b * CORE + MARGIN]
        own[low - (a * CORE - MARGIN) :][: len(inside)] = inside
        codes.append(own)
        begin.append(size + CORE * np.arange(b - a))
        places.append((size + MARGIN + (first - a) * CORE, min(end * CORE, len(text)) - first * CORE))
        size += len(own)
    padded, begin = np.concatenate([*codes, np.full(WINDOW, CLASSES - 1, np.uint8)]), np.concatenate(begin)
    total, weight = np.zeros((k, size + WINDOW), np.float32), np.zeros(size + WINDOW, np.float32)
    hidden, e = np.empty((WINDOW, n, TOGETHER), np.float32), np.empty((WINDOW, k, TOGETHER), np.float32)
    for at in range(0, len(begin), TOGETHER):
        mine = begin[at : at + TOGETHER]
        # the last group is filled up with windows of padding: results never depend on how many there are
        x = padded[np.append(mine, np.full(TOGETHER - len(mine), size))[None, :] + np.arange(WINDOW)[:, None]]
        for name, seq, w in (("f", x, p["out"][:n]), ("b", x[::-1], p["out"][n:])):
            _forward(seq, p[f"in_{name}"], p[f"rec_{name}"], hidden)
            part = np.matmul(_on_grid(w).T, hidden).astype(np.float32)
            if name == "f":
                e[:] = part
            else:
                e += part[::-1]
        blend = np.ascontiguousarray((e[:, :, : len(mine)] * _RAMP[:, None, None]).transpose(1, 2, 0))
        # a window meets the next one in its last characters only: each part of all windows is without overlaps
        for part in (slice(0, CORE), slice(CORE, WINDOW)):
            to = mine[:, None] + np.arange(part.start, part.stop)
            total[:, to] += blend[:, :, part]
            weight[to] += _RAMP[part]
    return [(total[:, a : a + m] / weight[a : a + m]).T + p["bias"] for a, m in places]


def _stretches(gain: np.ndarray, need: float, slack: float) -> list[list[int]]:
    """The stretches outside of which the best path is plain.

    ``gain`` bounds what a character adds to a run of other tags. A run that pays adds more than ``need`` in all, so it ends
    in an excursion of the running sum over its lowest value so far that rises by more than ``need``. No part of the run
    loses more than ``need + slack``, else the path that is plain there were better, so the run stays near the excursion's
    foot and top. What follows the top is searched in the same way.
    """
    total = np.concatenate([[0.0], np.cumsum(gain, dtype=float)])
    above = total - np.minimum.accumulate(total)
    high = np.flatnonzero(above > need)
    if not len(high):
        return []
    drop, found = need + slack, []
    zero = np.append(np.flatnonzero(above == 0), len(total))
    for k in np.unique(np.searchsorted(zero, high)).tolist():
        foot, stop = int(zero[k - 1]), int(zero[k])
        part = total[foot:stop]
        start = foot
        while start and total[start - 1] <= total[foot] + drop:
            start -= 1
        at = 0
        while len(part) - at > 1:
            rise = part[at:] - np.minimum.accumulate(part[at:])
            if not (rise > need).any():
                break
            # the highest point that a paying run can end at, and how far its run may go beyond
            top = at + int(part[at:].argmax())
            if rise[top - at] <= need:
                top = at + int(rise.argmax())
            low = np.flatnonzero(part[top:] < part[top] - drop)
            end = top + int(low[0]) - 1 if len(low) else len(part) - 1
            found.append([start, foot + end])
            at = end
            start = foot + at
    merged: list[list[int]] = []
    for a, b in found:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return merged


def decode(e: np.ndarray, trans: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, tag) of the best path's runs other than plain, over one sequence with plain text before and after it."""
    k = range(len(trans))
    cost, out = trans.tolist(), []
    for a, b in _stretches(*_gain(e, trans)):
        rows = e[a:b].tolist()
        score, back = [cost[0][j] + rows[0][j] for j in k], []
        for row in rows[1:]:
            from_ = [max(k, key=lambda i, j=j: score[i] + cost[i][j]) for j in k]
            score = [score[i] + cost[i][j] + row[j] for j, i in enumerate(from_)]
            back.append(from_)
        tag = max(k, key=lambda i: score[i] + cost[i][0])
        path = [tag]
        for from_ in reversed(back):
            tag = from_[tag]
            path.append(tag)
        path.reverse()
        start = 0
        for t in range(1, len(path) + 1):
            if t == len(path) or path[t] != path[start]:
                if path[start]:
                    out.append((a + start, a + t, path[start]))
                start = t
    return out


def _gain(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float, float]:
    """What ``_stretches`` needs: a bound of each character's gain, of what a run needs, and of what varies besides."""
    inner = float(trans[1:, 1:].max() - trans[0, 0])
    need = float(2 * trans[0, 0] - trans[0, 1:].max() - trans[1:, 0].max()) + inner
    slack = float(np.ptp(trans[0, 1:]) + np.ptp(trans[1:, 0]) + np.ptp(trans[1:, 1:])) + abs(inner)
    return e[:, 1:].max(1) - e[:, 0] + inner, need, slack


def _quiet(e: np.ndarray, trans: np.ndarray) -> int | None:
    """The last place of the second half that no run of other tags crosses, whatever follows: outside all stretches, and
    between it and the end the sum of gains falls by more than any run that pays can lose."""
    gain, need, slack = _gain(e, trans)
    total = np.cumsum(gain, dtype=float)
    ahead = np.minimum.accumulate(total[::-1])[::-1]
    ok = np.append(total[:-1] - ahead[1:] > need + slack, False)
    ok[: len(ok) // 2] = False
    for a, b in _stretches(gain, need, slack):
        ok[max(0, a - 1) : b + 2] = False
    found = np.flatnonzero(ok)
    return int(found[-1]) + 1 if len(found) else None


def runs_of(codes: np.ndarray, p: dict[str, np.ndarray], long: int = LONG) -> list[tuple[int, int, int]]:
    """The runs of a text of any length, decoded in stretches of about ``long`` windows that meet at quiet places."""
    out, start, step, count = [], 0, long, windows_of(len(codes))
    while start < len(codes):
        first = start // CORE
        end = min(count, first + step)
        e = emissions([(codes, first, end)], p)[0][start - first * CORE :]
        cut = len(e) if end == count else _quiet(e, p["trans"])
        if cut is None:  # nothing but signs of runs: take more at once
            step *= 2
            continue
        out += [(start + a, start + b, tag) for a, b, tag in decode(e[:cut], p["trans"])]
        start, step = start + cut, long
    return out


def decode_plainly(e: np.ndarray, trans: np.ndarray) -> list[int]:
    """The whole Viterbi recursion without shortcuts, for tests."""
    score, back = trans[0] + e[0], []
    for row in e[1:]:
        options = score[:, None] + trans
        back.append(options.argmax(0))
        score = options.max(0) + row
    path = [int((score + trans[:, 0]).argmax())]
    for from_ in reversed(back):
        path.append(int(from_[path[-1]]))
    return path[::-1]


_EDGE = " \t\n\r.,;:!?\"'=()[]{}<>|#*$%&"
_SPELLED_AT = re.compile(r"[\[(]\s*at\s*[\])]|@")


#: A name of a secret with = or :, just before a value or at the head of a run that took it in.
_NAMED = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|key|auth|credentials?)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
_NAMED_BEFORE, _NAMED_INSIDE = re.compile(_NAMED + r"\Z", re.IGNORECASE), re.compile(r"\w{0,16}?" + _NAMED + r"\S", re.IGNORECASE)
#: Heads by which services mark their keys.
_MARKED = ("AKIA", "sk-", "ghp_", "xoxb-")


def plausible(text: str, tag: int, before: str = "") -> bool:
    """The exact check behind the network: personal data has digits or an at-sign; secrets are one long word that has
    digits, a service's mark at its head, or the name of a secret with = or : before it."""
    digits = sum(c.isdigit() and c.isascii() for c in text)
    if tag == 2:
        if len(text) < 8 or any(c.isspace() for c in text):
            return False
        return digits >= 2 or text.startswith(_MARKED) or _NAMED_BEFORE.search(before) is not None or _NAMED_INSIDE.match(text) is not None
    return digits >= 7 or (len(text) >= 8 and _SPELLED_AT.search(text) is not None)


def added_spans(text: str, runs: list[tuple[int, int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The network's runs, trimmed, checked, and without those that touch a span of the rules."""
    out = []
    for a, b, tag in runs:
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a < b and plausible(text[a:b], tag, text[max(0, a - 32) : a]) and not any(a < y and x < b for x, y, _ in base):
            out.append((a, b, KINDS[3 + tag]))
    return out


def find(texts: list[str], p: dict[str, np.ndarray]) -> Iterator[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(spans of the rules, all spans) of each text, in order; a function of that text alone."""
    at = 0
    while at < len(texts):
        end, count = at, 0
        while end < len(texts) and (end == at or count + windows_of(len(texts[end])) <= TOGETHER):
            count += windows_of(len(texts[end]))
            end += 1
        codes = [classes_of(t) for t in texts[at:end]]
        if count > LONG:
            runs = [runs_of(codes[0], p)]
        else:
            runs = [decode(e, p["trans"]) if len(e) else [] for e in emissions([(c, 0, windows_of(len(c))) for c in codes], p)]
        for text, found in zip(texts[at:end], runs, strict=True):
            base = base_spans(text)
            yield base, sorted([*base, *added_spans(text, found, base)], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
        at = end


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_personal, n_secret, n_spans) for every row; offsets are
    code points, ends exclusive. A row's result depends on its text alone, not on other rows or partitions.

    Nulls: a null text is the empty text and has no spans. Repeated rows are read each. Spans of one kind never overlap;
    of the network's spans those that touch a rule's span are dropped, so ties go to the rules. An empty table gives no
    rows; texts of any length are read whole. Only the id and the text are read, so other names cannot clash.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            counts, sums, spans = [], [], []
            for base, all_ in find([t or "" for t in batch.column("text").to_pylist()], p):
                counts.append([*(sum(k == kind for *_, k in all_) for kind in KINDS), len(all_)])
                sums.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                spans.append(spelled(all_))
            cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS) + 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols[:4], pa.array(sums, pa.string()), pa.array(spans, pa.string()), *cols[4:]], names)

    kind = own.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_personal long, n_secret long, n_spans long"
    names = [c.split()[0] for c in out.split(", ")]
    return own.mapInArrow(run, out)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, as the bracketed kind of its first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data of ``text_col`` replaced, and ``size_col``, if there is such a column, counted anew.

    A null text stays null. All other columns, whatever their names, are as they were.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    at = docs.columns.index(text_col)
    sized = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [redacted(t, spans) if t is not None else None for t, (_, spans) in zip(texts, find([t or "" for t in texts], p), strict=True)]
            cols = list(batch.columns)
            cols[at] = pa.array(new, batch.schema.field(at).type)
            if sized is not None:
                cols[sized] = pa.array([None if t is None else len(t) for t in new]).cast(batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op3_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op3_bilstm_crf": op3_bilstm_crf}
ORACLE: dict[str, str] = {}
