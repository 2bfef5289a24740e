"""Personal data: patterns, and a character tagger that finds what they miss.

The tagger is a bidirectional LSTM over letters with CRF transitions, trained
in numpy on labelled spans: those that the patterns find in a bounded sample
of texts, and made-up ones of each kind set into those texts in forms that the
patterns can't read. Every text is cut into overlapping windows; each place
takes its scores from the window in whose middle it lies best, and one path
over the whole text is decoded from them.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidemark.llm.common import hashed_sample, map_text, table

#: Kinds in the order in which the contract lists them; the method adds the last.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
WINDOW, OVERLAP = 320, 64
HIDDEN, EMBEDDED = 8, 12
#: The tagger learns from windows of so many texts at most, drawn by a hash of their id.
TRAIN_ROWS, TRAIN_CHARS = 600, 160
EPOCHS, BATCH, RATE, SEED = 14, 128, 0.03, 20240229
#: Windows run through the network at a time.
ROWS = 1024

# -- patterns -----------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the look-behind changes no match, as a run of digits can only be entered at its start
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SEPARATED = str.maketrans("", "", " -")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each holds one @, reaches left as far as letters allow, and starts after the last."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    digits = text.translate(_SEPARATED)
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 10 <= len(_NOT_DIGIT.sub("", text)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind), sorted: what the patterns find."""
    found = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if is_ip(m[0])]
        found += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if is_card(m[0])]
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if is_phone(m[0])]
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


# -- letters and tags ---------------------------------------------------------

#: Tag 0 is outside; kind k has tag k + 1.
TAGS = len(KINDS) + 1
_CLASSES = 98


def _class_table() -> np.ndarray:
    """The class of each code point below 0x250; what lies beyond counts as a letter or as other."""
    table_ = np.full(0x250, 96, np.uint8)
    for c in range(32, 127):
        table_[c] = c - 32 + 1
    for c in range(ord("A"), ord("Z") + 1):
        table_[c] = ord(chr(c).lower()) - 32 + 1
    for c in (9, 10, 11, 12, 13):
        table_[c] = 97
    return table_


_TABLE = _class_table()


def classes_of(text: str) -> np.ndarray:
    """A class (from 1) for each code point; 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(points, 0x24F)]


# -- network ------------------------------------------------------------------


@dataclass
class Tagger:
    """Weights: embedding, and for each direction input, recurrent and bias; emission, transitions."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator) -> Tagger:
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"emb": g(_CLASSES, EMBEDDED) * 3}
        for d in "fb":
            p |= {f"w{d}": g(EMBEDDED, 4 * HIDDEN), f"u{d}": g(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
            p[f"o{d}"] = g(HIDDEN, TAGS)
        return Tagger(p | {"bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)})

    def emissions(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(rows, places, tags) for rows of classes, padded with 0 at the right.

        Everything is kept feature by feature, so that a gate of all rows is one
        stretch of memory. A letter's share of the gates is a column of a table.
        Sigmoids are taken as halved tanh, for which the gates are halved.
        """
        n, width = x.shape
        half = np.full(4 * HIDDEN, 0.5, np.float32)
        half[3 * HIDDEN :] = 1
        i, f, o, a = (slice(k * HIDDEN, (k + 1) * HIDDEN) for k in range(4))
        uneven = bool((lengths != width).any())
        if uneven:
            place = lengths[:, None] - 1 - np.arange(width)[None, :]
            back = np.where(place >= 0, np.take_along_axis(x, np.maximum(place, 0), axis=1), 0)
        else:
            back = x[:, ::-1]
        made = []
        for d, turned in (("f", x), ("b", back)):
            gates = np.ascontiguousarray(((self.p["emb"] @ self.p[f"w{d}"] + self.p[f"c{d}"]) * half).T)
            u = np.ascontiguousarray((self.p[f"u{d}"] * half).T)
            emit = np.ascontiguousarray(self.p[f"o{d}"].T)
            letters = np.ascontiguousarray(turned.T).astype(np.intp)
            out = np.empty((width, TAGS, n), np.float32)
            h, c = np.zeros((HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
            for t in range(width):
                z = gates.take(letters[t], axis=1)
                z += u @ h
                np.tanh(z, out=z)
                z[: 3 * HIDDEN] += 1
                c *= z[f]
                z[i] *= z[a]
                c += z[i]
                c *= 0.5
                np.tanh(c, out=h)
                h *= z[o]
                h *= 0.5
                np.matmul(emit, h, out=out[t])
            made.append(out)
        both = made[0].transpose(2, 0, 1)
        other = made[1].transpose(2, 0, 1)
        if uneven:
            other = np.take_along_axis(other, np.maximum(place, 0)[:, :, None], axis=1)
        else:
            other = other[:, ::-1]
        return both + other + self.p["bias"]


def decode(emissions: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best path of tags over (places, tags).

    A stay inside earns over being outside at most the sum of its places' gains,
    plus what entering and leaving cost. Where every run of places that ends
    at a place sums to so little that a stay over it could as well begin after
    it, the path is outside, and between such places only stretches that can
    pay for entering and leaving are run through the Viterbi recursion. The
    path is the one that the recursion over all places would give.
    """
    n = len(emissions)
    path = np.zeros(n, np.int64)
    stay = trans[0, 0]
    enter, leave = trans[0, 1:] - stay, trans[1:, 0] - stay
    border, spread = float(enter.max() + leave.max()), float(enter.max() - enter.min())
    if border > 0:
        return _viterbi(emissions, trans, 0, n)
    gain = reduce(np.maximum, (emissions[:, k] for k in range(1, emissions.shape[1]))) - emissions[:, 0]
    gain = gain + max(0.0, float((trans[1:, 1:] - stay).max()))
    total = np.cumsum(gain, dtype=np.float64)
    # the most that any run of places ending here sums to
    run = total - np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
    # a stay from the first place on is not entered, one up to the last not left
    if run.max() <= -border and total.max() <= -leave.max() and run[-1] <= -enter.max():
        return path
    # what goes on from the first place would have to be entered if it began later
    warm = (run > -spread - 1e-6) | (total > enter.min() - 1e-6)
    warm = np.flatnonzero(np.diff(warm.astype(np.int8), prepend=0, append=0))
    for start, end in zip(warm[::2].tolist(), warm[1::2].tolist(), strict=True):
        if not start or end == n or run[start:end].max() > -border:
            path[start:end] = _viterbi(emissions, trans, start, end)
    return path


def _viterbi(emissions: np.ndarray, trans: np.ndarray, start: int, end: int) -> np.ndarray:
    """The best tags from start to end, between places outside where the text goes on."""
    part, n = emissions[start:end], end - start
    score = trans[0] + part[0] if start else part[0].copy()
    came = np.zeros((n, len(trans)), np.int64)
    for t in range(1, n):
        ways = score[:, None] + trans
        came[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + part[t]
    if end < len(emissions):
        score = score + trans[:, 0]
    path = np.zeros(n, np.int64)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t][path[t]]
    return path


# -- training -----------------------------------------------------------------


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss per row and its gradients for rows of classes x and tags y; keep marks places that aren't padding, which is at the right.

    Both directions run at once, the backward one over reversed rows. Only what
    goes from place to place is in loops; all else is taken over all places.
    """
    n, width = x.shape
    lengths = keep.sum(axis=1)
    place = np.maximum(lengths[:, None] - 1 - np.arange(width)[None, :], 0)
    turned = place.T[:, :, None]
    ok = keep.T
    letters = np.stack([x, np.where(keep, np.take_along_axis(x, place, axis=1), 0)]).transpose(2, 0, 1)
    w, u, o_ = (np.stack([p[f"{k}f"], p[f"{k}b"]]) for k in "wuo")
    e = p["emb"][letters]
    gates = e @ w + np.stack([p["cf"], p["cb"]])[:, None, :]
    before, squashed, out = (np.empty((width, 2, n, HIDDEN), gates.dtype) for _ in range(3))
    h = c = np.zeros((2, n, HIDDEN), gates.dtype)
    three = slice(0, 3 * HIDDEN)
    i, f, o, a = (slice(k * HIDDEN, (k + 1) * HIDDEN) for k in range(4))
    for t in range(width):
        z = gates[t]
        z += h @ u
        z[..., three] *= 0.5
        np.tanh(z, out=z)
        z[..., three] *= 0.5
        z[..., three] += 0.5
        before[t] = c
        c = z[..., f] * c + z[..., i] * z[..., a]
        squashed[t] = np.tanh(c)
        h = out[t] = z[..., o] * squashed[t]
    each = out @ o_
    emitted = each[:, 0] + np.take_along_axis(each[:, 1], turned, axis=0) + p["bias"]
    # CRF: forward and backward sums, scaled to one at each place
    trans, top = np.exp(p["trans"]), emitted.max(axis=2)
    weight = np.exp(emitted - top[:, :, None])
    alpha, beta, scale = np.empty_like(weight), np.ones_like(weight), np.ones_like(top)
    for t in range(width):
        now = weight[t] if not t else (alpha[t - 1] @ trans) * weight[t]
        scale[t] = np.where(ok[t], now.sum(axis=1), 1)
        alpha[t] = np.where(ok[t][:, None], now / scale[t][:, None], alpha[t - 1])
    for t in range(width - 1, 0, -1):
        weight[t] *= beta[t] * (ok[t] / scale[t])[:, None]
        beta[t - 1] = np.where(ok[t][:, None], weight[t] @ trans.T, 1)
    log_z = float((np.log(scale) + top)[ok].sum())
    times, rows = np.nonzero(ok)
    tags = y.T
    d_emit = alpha * beta * ok[:, :, None]
    d_emit[times, rows, tags[times, rows]] -= 1
    pairs = trans * (alpha[:-1].reshape(-1, TAGS).T @ weight[1:].reshape(-1, TAGS))
    g = {"bias": d_emit.sum(axis=(0, 1)), "trans": pairs}
    later, row = np.nonzero(ok[1:])
    moves = tags[later, row], tags[later + 1, row]
    np.add.at(g["trans"], moves, -1)
    score = float(emitted[times, rows, tags[times, rows]].sum() + p["trans"][moves].sum())
    # and back through both directions
    d_out = np.stack([d_emit, np.take_along_axis(d_emit, turned, axis=0) * ok[:, :, None]], axis=1)
    dz = np.empty_like(gates)
    dh, dc = d_out @ o_.transpose(0, 2, 1), np.zeros_like(c)
    back = u.transpose(0, 2, 1)
    for t in range(width - 1, -1, -1):
        z, now = gates[t], dh[t]
        if t + 1 < width:
            now += dz[t + 1] @ back
        dc = dc + now * z[..., o] * (1 - squashed[t] ** 2)
        dz[t, ..., i] = dc * z[..., a]
        dz[t, ..., f] = dc * before[t]
        dz[t, ..., o] = now * squashed[t]
        dz[t, ..., three] *= z[..., three] * (1 - z[..., three])
        dz[t, ..., a] = dc * z[..., i] * (1 - z[..., a] ** 2)
        dc = dc * z[..., f]
    flat = lambda v, k: v[:, k].reshape(-1, v.shape[-1])
    last = np.concatenate([np.zeros_like(out[:1]), out[:-1]])
    d_letters = dz @ w.transpose(0, 2, 1)
    for k, d in enumerate("fb"):
        g |= {f"w{d}": flat(e, k).T @ flat(dz, k), f"u{d}": flat(last, k).T @ flat(dz, k), f"c{d}": flat(dz, k).sum(axis=0), f"o{d}": flat(out, k).T @ flat(d_out, k)}
    one = letters.ravel()
    g["emb"] = np.stack([np.bincount(one, d_letters[..., k].ravel(), len(p["emb"])) for k in range(d_letters.shape[-1])], axis=1)
    return (log_z - score) / n, {k: (v / n).astype(p[k].dtype) for k, v in g.items()}


def _with_check(digits: str) -> str:
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def made_up(rng: random.Random) -> tuple[str, int | None]:
    """A span and its kind, in forms that patterns can and can't read; or a harmless look-alike (None)."""
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(3, 9)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    grouped = lambda d, s: s.join(d[i : i + 4] for i in range(0, len(d), 4))
    kind = rng.choice((0, 0, 1, 2, 2, 3, 4, None, None))
    if kind == 0:
        name = word() + rng.choice(("", "." + word(), number(2), "." + number(2), "_" + word()))
        host = rng.choice(("", "mail.", "mail" + number(1) + ".")) + rng.choice(("example", word())) + rng.choice((".com", ".org", ".net", ".de", ".fr"))
        return name + rng.choice(("@", "@", " [at] ", " (at) ", " at ")) + rng.choice((host, host, host.replace(".", " dot "))), 0
    if kind == 1:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice((".", ".", ".", " . ", "[.]")).join(parts), 1
    if kind == 2:
        digits = _with_check(rng.choice("3456") + number(rng.choice((14, 14, 13))))
        return rng.choice((digits, digits, grouped(digits, " "), grouped(digits, "-"), grouped(digits, "."))), 2
    if kind == 3:
        a, b, c = number(3), number(3), number(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.choice(('33', '49', '34'))} {a} {b} {c}", f"00{rng.choice(('33', '49', '34'))} {a} {b} {c}")), 3
    if kind == 4:
        letters = rng.choice(("0123456789abcdef", "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789"))
        return "".join(rng.choice(letters) for _ in range(rng.choice((24, 32, 40, 40)))), 4
    return rng.choice((number(rng.randint(1, 6)), f"{number(1)}.{number(1)}", f"version {number(1)}.{number(1)}.{number(1)}", f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}", f"https://{word()}.example.com/{number(3)}", f"{number(3)},{number(3)}", word() + "###", word().upper() + "!!")), None


def spans_for_training(text: str) -> list[tuple[int, int, int]]:
    found = base_spans(text)
    taken = [(s, e) for s, e, _ in found]
    for m in re.finditer(r"[0-9A-Za-z]{24,}", text):
        if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0], re.I) and not any(s < m.end() and m.start() < e for s, e in taken):
            found.append((m.start(), m.end(), 4))
    return found


def examples(texts: list[str], rng: random.Random) -> list[tuple[np.ndarray, np.ndarray]]:
    """(classes, tags) of windows: each text as it is and with made-up spans set in."""
    out = []
    for text in texts:
        for made in (0, 2, 3):
            whole, spans = text, spans_for_training(text)
            places = sorted({m.start() for m in re.finditer(" ", text)} - {i for s, e, _ in spans for i in range(s, e)})
            if made and not places:
                continue
            for at in sorted((rng.choice(places) for _ in range(made)), reverse=True):
                span, kind = made_up(rng)
                whole = f"{whole[:at]} {span}{whole[at:]}"
                spans = [(s + (len(span) + 1) * (s >= at), e + (len(span) + 1) * (s >= at), k) for s, e, k in spans]
                if kind is not None:
                    spans.append((at + 1, at + 1 + len(span), kind))
            y = np.zeros(len(whole), np.int64)
            for s, e, k in spans:
                y[s:e] = k + 1
            out.append((classes_of(whole)[:WINDOW], y[:WINDOW]))
    return [x for x in out if len(x[0])]


def train(texts: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Tagger:
    """A tagger from labelled spans in these texts, by Adam; the same texts give the same weights."""
    rng, tagger = random.Random(seed), Tagger.fresh(np.random.default_rng(seed))
    # a few made-up texts, so that nothing depends on what a small sample holds
    words = ("the", "and", "of", "for", "on", "this", "line", "call", "card", "mail", "from", "to", "in", "at")
    own = [" ".join(rng.choice(words) for _ in range(30)) + "." for _ in range(120)]
    data = examples([t for t in texts if t] + own, rng)
    p, m, v, step = tagger.p, {}, {}, 0
    for epoch in range(epochs):
        # windows of like length share a batch
        order = sorted(range(len(data)), key=lambda i: (len(data[i][0]) // 32, rng.random()))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        rng.shuffle(batches)
        for batch in batches:
            width = max(len(data[i][0]) for i in batch)
            x, y, keep = np.zeros((len(batch), width), np.int64), np.zeros((len(batch), width), np.int64), np.zeros((len(batch), width), bool)
            for r, i in enumerate(batch):
                k = len(data[i][0])
                x[r, :k], y[r, :k], keep[r, :k] = data[i][0], data[i][1], True
            _, g = gradients(p, x, y, keep)
            norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k, w in g.items():
                w = w * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * w
                v[k] = 0.99 * v.get(k, 0) + 0.01 * w * w
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


# -- finding ------------------------------------------------------------------


def window_starts(n: int) -> list[int]:
    if n <= WINDOW:
        return [0]
    step = WINDOW - OVERLAP
    return [*range(0, n - WINDOW, step), n - WINDOW]


def tag_texts(tagger: Tagger, texts: list[str]) -> list[np.ndarray]:
    """For each text a tag per code point, from scores reconciled over all its windows."""
    letters = [classes_of(t) for t in texts]
    windows = [(d, s, min(WINDOW, len(x) - s)) for d, x in enumerate(letters) if len(x) for s in window_starts(len(x))]
    scores = [np.empty((len(x), TAGS), np.float32) for x in letters]
    by_length = sorted(range(len(windows)), key=lambda i: windows[i][2])
    for i in range(0, len(by_length), ROWS):
        rows = [windows[j] for j in by_length[i : i + ROWS]]
        width = rows[-1][2]
        x = np.zeros((len(rows), width), np.uint8)
        for r, (d, s, k) in enumerate(rows):
            x[r, :k] = letters[d][s : s + k]
        made = tagger.emissions(x, np.array([k for _, _, k in rows]))
        for r, (d, s, k) in enumerate(rows):
            n = len(letters[d])
            # each place belongs to the window in which it is farther from an end
            low = s + (OVERLAP // 2 if s else 0)
            high = s + k - (OVERLAP // 2 if s + k < n else 0)
            scores[d][low:high] = made[r, low - s : high - s]
    return [decode(e, tagger.p["trans"]) if len(e) else np.zeros(0, np.int64) for e in scores]


_TRIM = " \t\r\n\"'.,;:!?#*$%&=()[]<>"
_LOOKS = {
    0: re.compile(r"[\w.%+-]+ ?(?:@|\[at\]|\(at\)|at) ?[\w-]+(?:(?:\.| dot )[\w-]+)+"),
    1: re.compile(r"[0-9]{1,3}(?:(?: ?\. ?|\[\.\])[0-9]{1,3}){3}"),
    4: re.compile(r"[0-9A-Za-z_-]{20,}"),
}


def plausible(text: str, kind: int) -> bool:
    """Whether a tagged span can be what its tag says; the tagger alone would also take a stray number."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == 0:
        return bool(_LOOKS[0].fullmatch(text))
    if kind == 1:
        return bool(_LOOKS[1].fullmatch(text)) and all(int(p) <= 255 for p in re.findall("[0-9]+", text))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .-]", text)
    if kind == 3:
        return 10 <= len(digits) <= 15 and not re.search(r"[^0-9 ().+-]", text)
    return bool(_LOOKS[4].fullmatch(text)) and len(digits) >= 4 and len(digits) < len(text)


def tagged_spans(text: str, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal tags that are plausible, trimmed of marks; a run of two cards side by side is two."""
    found = []
    change = np.flatnonzero(np.diff(tags, prepend=0, append=0))
    for s, e in zip(change, change[1:], strict=False):
        if not tags[s]:
            continue
        kind = int(tags[s]) - 1
        # the tagger may take a letter too few or too many: go by whole words
        s, e = int(s), int(e)
        while s > 0 and text[s - 1].isalnum():
            s -= 1
        while e < len(text) and text[e].isalnum():
            e += 1
        parts = [(s, e)]
        if kind == 2:
            parts = [(s + m.start(), s + m.end()) for m in re.finditer(r"[0-9]{14,19}(?![0-9])|[0-9]{4}(?:[ .-][0-9]{2,6}){2,3}(?![0-9])", text[s:e])] or parts
        for a, b in parts:
            while a < b and text[a] in _TRIM.replace("(", "" if kind == 3 else "("):
                a += 1
            while b > a and text[b - 1] in _TRIM:
                b -= 1
            if a < b and plausible(text[a:b], kind):
                found.append((a, b, kind))
    return found


def all_spans(text: str, tags: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all): every span of the patterns, and those of the tagger that meet none of them nor each other."""
    base = base_spans(text)
    merged, end = list(base), 0
    i, by_end = 0, sorted(base)
    for s, e, k in sorted(tagged_spans(text, tags)):
        while i < len(by_end) and by_end[i][1] <= s:
            i += 1
        # spans of several kinds may nest, so look on while they begin before this one's end
        j, free = i, s >= end
        while free and j < len(by_end) and by_end[j][0] < e:
            free = by_end[j][1] <= s
            j += 1
        if free:
            merged.append((s, e, k))
            end = e
    return base, sorted(merged, key=lambda x: (x[0], x[2], x[1]))


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
RESULT = StructType([StructField("doc_id", LongType()), StructField("base", ArrayType(SPAN)), StructField("spans", ArrayType(SPAN))])
_as_row = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans]


def _find(tagger: Tagger, ids: list, texts: list) -> dict[str, list]:
    texts = [t or "" for t in texts]
    both = [all_spans(t, tags) for t, tags in zip(texts, tag_texts(tagger, texts), strict=True)]
    return {"doc_id": ids, "base": [_as_row(b) for b, _ in both], "spans": [_as_row(a) for _, a in both]}


def sample_texts(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list[str]:
    """Stretches of `chars` letters of at most `rows` texts, drawn and placed by a hash of the id."""
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - chars, F.lit(1)).cast("bigint")).cast("int") + 1
    picked = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.substring(F.col("text"), at, F.lit(chars)).alias("text"))
    return [r.text for r in hashed_sample(picked, "doc_id", rows, docs.select("doc_id").count()).collect()]


def find_personal_data(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, base and spans (kind, start, end in code points) for each row of docs (doc_id, text).

    base holds what the patterns find, spans those and the tagger's, sorted by
    start. A null text counts as empty and has none; a null doc_id stays null;
    repeated rows repeat; other columns are ignored; no rows, none. Bytes that
    aren't UTF-8 are read as U+FFFD, one code point for each part that isn't.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    weights = tagger.p
    return map_text(docs, _find, ["doc_id", "text"], RESULT, make=lambda: Tagger(weights))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind; of spans that meet, what they cover together by the first's."""
    out, end = [], 0
    for s, e, k in sorted(spans):
        if s >= end:
            out += [text[end:s], f"[{KINDS[k].upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


_TEXT = StructType([StructField("text", StringType())])


def _redact(tagger: Tagger, texts: list) -> dict[str, list]:
    tags = tag_texts(tagger, [t or "" for t in texts])
    return {"text": [t if t is None else redact(t, all_spans(t, own)[1]) for t, own in zip(texts, tags, strict=True)]}


def redact_documents(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets, and n_chars, if there is one, to match.

    Null texts stay null. Columns and rows stay as they are otherwise, whatever
    the columns' names, repeated rows and those without doc_id included. In text,
    bytes that aren't UTF-8 become U+FFFD.
    """
    weights = tagger.p
    done = map_text(docs, _redact, ["text"], _TEXT, make=lambda: Tagger(weights), carry=True)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def op8_char_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, train(sample_texts(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
