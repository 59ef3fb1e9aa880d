"""Personal data: fixed formats, and a character BiLSTM with CRF transitions that goes beyond them.

The network is trained in numpy on windows of a bounded sample of documents. Its
labels are the spans of the formats and, in as many more windows, the same data
as people write it where the formats stop: other separators, no country's
sign, signs spelled out (see reworded). At work, overlapping windows cover every
text from end to end; they are decoded (Viterbi) and reconciled: each character
takes its tag from the window in which it stands farthest from an edge. A decoded
span is added where it overlaps no fixed one and by the CRF's sums its
characters are personal data with a mean probability of SURE; cards must pass Luhn's test.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPANS, Shared, Span, map_rows, outside, sample_rows, span_rows, stash

# Kinds in order, and the formats of the contract.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Patterns that begin with a set of characters are searched for fastest. DIGITS takes whole runs of digits, those of no ip too, so that none is entered in its middle.
DIGITS = re.compile(r"[0-9][0-9]*(\.[0-9]+\.[0-9]+\.[0-9]+)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SAMPLE_DOCUMENTS = 20_000
SAMPLE_WINDOWS = 1500
#: One in PLAIN of the sample's windows without a digit or an at sign is a candidate for the training set; POOL: see learn.
PLAIN, POOL = 4, 16
WINDOW, STRIDE, CROP = 256, 224, 64
#: Windows that are decoded at once, and characters of the texts that make them up.
CHUNK, TOGETHER = 1024, 200_000
#: Characters whose scores are compared at once, to stay in a core's cache.
BLOCK = 8
HIDDEN, STEPS, BATCH, LEARN = 10, 800, 64, 0.02
SURE = 0.9
SYMBOLS = 129
TAGS = 1 + 2 * len(KINDS)


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email"
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out = list(_emails(text))
    for m in DIGITS.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def symbols(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), SYMBOLS - 1).astype(np.uint8)


def cut(codes: np.ndarray) -> np.ndarray:
    """Windows at multiples of STRIDE that cover codes, the last one padded with zeros."""
    n = max(1, -(-(len(codes) - WINDOW) // STRIDE) + 1) if len(codes) else 0
    padded = np.zeros(n * STRIDE + WINDOW, codes.dtype)
    padded[: len(codes)] = codes
    return padded[np.arange(n)[:, None] * STRIDE + np.arange(WINDOW)]


def reworded(kind: str, value: str, rng: random.Random) -> str:
    """The value in a form that the fixed formats don't know."""
    digits = _digits(value)
    if kind == "email":
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), ("[at]", ".")])
        name, host = value.split("@", 1)
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return value.replace(".", rng.choice(["[.]", " . ", "(.)"]))
    if kind == "card":
        return rng.choice([".", "/", "_", "  "]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"001 {a} {b} {c}"])


def reworded_text(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The text with its spans reworded, and where they are then; of overlapping spans the first stands."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    parts, out, at, size = [], [], 0, 0
    for a, b, kind in sorted(spans):
        if a < at:
            continue
        value = reworded(kind, text[a:b], rng)
        parts += [text[at:a], value]
        size += a - at
        out.append((size, size + len(value), kind))
        size += len(value)
        at = b
    return "".join([*parts, text[at:]]), out


def tags_of(spans: list[Span], size: int) -> np.ndarray:
    out = np.zeros(size, np.uint8)
    for a, b, k in spans:
        out[a:b] = 2 + 2 * KINDS.index(k)
        out[a] -= 1
    return out


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, else very low: inside a kind comes after its begin or inside."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for j in range(2, TAGS, 2):
        out[:, j] = -1e4
        out[j - 1, j] = out[j, j] = 0
    return out


ALLOWED = _allowed()


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Tagger:
    """Parameters and passes of the network."""

    def __init__(self, windows: np.ndarray, tags: np.ndarray, plain: np.ndarray | None = None) -> None:
        """Train on windows, then again with those of the plain ones in which it has seen something."""
        rng = np.random.default_rng(7)
        h = HIDDEN
        self.p = {
            "x0": rng.normal(0, 0.3, (SYMBOLS, 4 * h)), "x1": rng.normal(0, 0.3, (SYMBOLS, 4 * h)),
            "h0": rng.normal(0, h**-0.5, (h, 4 * h)), "h1": rng.normal(0, h**-0.5, (h, 4 * h)),
            "o": rng.normal(0, (2 * h) ** -0.5, (2 * h, TAGS)), "b": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        for d in "01":
            self.p["x" + d][:, h : 2 * h] += 1
        self._train(windows, tags, rng, STEPS)
        if plain is not None and len(plain):
            wrong = plain[self.spans(plain)[0].any(1)]
            if len(wrong):
                wrong = np.repeat(wrong, -(-len(windows) // (4 * len(wrong))), axis=0)
                self._train(np.concatenate([windows, wrong]), np.concatenate([tags, np.zeros(wrong.shape, tags.dtype)]), rng, STEPS // 2)

    def _run(self, codes: np.ndarray, d: int, keep: list | None = None) -> np.ndarray:
        """Hidden states in the order of the text; d 1 reads backwards."""
        n, length, h = len(codes), codes.shape[1], HIDDEN
        inputs, weights = self.p[f"x{d}"], self.p[f"h{d}"]
        out = np.empty((length, n, h), np.float32)
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            z = inputs[codes[:, t]] + state @ weights
            gates = _sigmoid(np.concatenate([z[:, : 2 * h], z[:, 3 * h :]], 1))
            new = np.tanh(z[:, 2 * h : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, cell = cell, f * cell + i * new
            squashed = np.tanh(cell)
            if keep is not None:
                keep.append((t, state, before, i, f, new, o, squashed))
            state = o * squashed
            out[t] = state
        return out

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Scores of the tags by character and window. As two runs of _run, but both directions step together.

        A gate's values of all windows lie side by side, the sigmoids' gates first. Half of the sigmoids' arguments is in the
        weights, so that one tanh serves all gates; their values and the states are kept doubled, and later weights halved.
        """
        h, (n, length), kind = HIDDEN, codes.shape, self.p["o"].dtype
        order = np.r_[: 2 * h, 3 * h : 4 * h, 2 * h : 3 * h]
        half = np.full(4 * h, 0.5, kind)
        half[3 * h :] = 1
        inputs = [np.ascontiguousarray(self.p[f"x{d}"][:, order] * half) for d in (0, 1)]
        weights = np.stack([(self.p[f"h{d}"][:, order] * half).T for d in (0, 1)]) / 2
        scores = np.ascontiguousarray(self.p["o"].reshape(2, h, TAGS).transpose(0, 2, 1)) / 2
        places = np.ascontiguousarray(codes.T).astype(np.intp)
        e, part = np.zeros((length, TAGS, n), kind), np.empty((2, TAGS, n), kind)
        state, cell, squashed = (np.zeros((2, h, n), kind) for _ in range(3))
        taken, z = np.empty((2, n, 4 * h), kind), np.empty((2, 4 * h, n), kind)
        turned = taken.transpose(0, 2, 1)
        gates, (i, f, o, new) = z[:, : 3 * h], (z[:, k : k + h] for k in range(0, 4 * h, h))
        for t in range(length):
            np.take(inputs[0], places[t], 0, out=taken[0], mode="clip")
            np.take(inputs[1], places[length - 1 - t], 0, out=taken[1], mode="clip")
            np.matmul(weights, state, out=z)
            z += turned
            np.tanh(z, out=z)
            gates += 1
            cell *= f
            i *= new
            cell += i
            cell *= 0.5
            np.tanh(cell, out=squashed)
            np.multiply(o, squashed, out=state)
            np.matmul(scores, state, out=part)
            e[t] += part[0]
            e[length - 1 - t] += part[1]
        e += self.p["b"][:, None]
        return e.transpose(0, 2, 1)

    def plain(self, e: np.ndarray) -> np.ndarray:
        """Windows whose best path is plain text throughout, by the paths' scores alone; they are taken above that path's, which is 0.

        Most are told by a bound on all paths, in which each character has the best of the kinds; the others' paths are followed.
        """
        out = self._below(e)
        rest = np.flatnonzero(~out)
        if len(rest):
            out[rest] = self._plain(e[:, rest])
        return out

    def _below(self, e: np.ndarray) -> np.ndarray:
        """Windows in which no run of tagged characters can have a score above -0.001.

        A run begins after a path of 0 at most, so bound is the best that can end in each character.
        """
        move = self.p["t"] + ALLOWED - self.p["t"][0, 0]
        best = move.max(0)
        best[0] = 0
        bound = (e[0, :, 1:] - e[0, :, :1]).max(1)
        top = bound.copy()
        for at in range(1, len(e), BLOCK):
            part = (e[at : at + BLOCK] + best).transpose(2, 0, 1)
            begin, inside = part[1::2].max(0) - part[0], part[2::2].max(0) - part[0]
            for t in range(len(begin)):
                bound = np.maximum(begin[t], inside[t] + bound)
                np.maximum(top, bound, out=top)
        return top + max(0.0, float(move[1:, 0].max())) <= -1e-3

    def _plain(self, e: np.ndarray) -> np.ndarray:
        """As plain, by following the paths of every window."""
        move = (self.p["t"] + ALLOWED - self.p["t"][0, 0])[:, :, None]
        e = np.ascontiguousarray((e - e[:, :, :1]).transpose(0, 2, 1))
        score = e[0]
        for t in range(1, len(e)):
            score = (score[:, None, :] + move).max(0) + e[t]
        return score.max(0) <= 0

    def spans(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window its best tags and, by character, the probability that the tag is not plain text's."""
        tags, sure = np.zeros(codes.shape, np.uint8), np.zeros(codes.shape, np.float32)
        for k in range(0, len(codes), CHUNK):
            rows, e = self.suspects(codes[k : k + CHUNK])
            some = np.flatnonzero(~self._plain(e))
            if len(some):
                tags[k + rows[some]], sure[k + rows[some]] = self.marks(e[:, some])
        return tags, sure

    def suspects(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows that the bound does not tell to be plain, and their emissions."""
        e = self.emissions(codes)
        rows = np.flatnonzero(~self._below(e))
        return rows, np.ascontiguousarray(e[:, rows])

    def marks(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As spans, from emissions."""
        ahead, behind, total = self.passes(e)
        return self.decode(e), 1 - np.exp(ahead[:, :, 0] + behind[:, :, 0] - total).T

    def passes(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums over the paths up to and from each character, and over all."""
        move = self.p["t"] + ALLOWED
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[0] = e[0]
        for t in range(1, len(e)):
            ahead[t] = _logsumexp(ahead[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(len(e) - 1, 0, -1):
            behind[t - 1] = _logsumexp((behind[t] + e[t])[:, None, :] + move, 2)
        return ahead, behind, _logsumexp(ahead[-1], 1)

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags for each window, from emissions."""
        move = self.p["t"] + ALLOWED
        score = e[0].copy()
        back = np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            both = score[:, :, None] + move
            back[t] = both.argmax(1)
            score = np.take_along_axis(both, back[t][:, None, :].astype(np.int64), 1)[:, 0] + e[t]
        out = np.empty((e.shape[1], len(e)), np.uint8)
        at = score.argmax(1)
        rows = np.arange(e.shape[1])
        for t in range(len(e) - 1, -1, -1):
            out[:, t] = at
            if t:
                at = back[t][rows, at]
        return out

    def _train(self, windows: np.ndarray, tags: np.ndarray, rng: np.random.Generator, steps: int) -> None:
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        # Crops of half a window: around a random tagged character where there is one, else anywhere.
        some = tags > 0
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), BATCH)
            at = (rng.random((BATCH, WINDOW)) * (some[pick] + 1e-6)).argmax(1)
            start = np.clip(at - rng.integers(0, CROP, BATCH), 0, WINDOW - CROP)
            place = start[:, None] + np.arange(CROP)
            grads = self._gradients(np.take_along_axis(windows[pick], place, 1), np.take_along_axis(tags[pick], place, 1))
            size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                rate = LEARN * min(1.0, 2 * (1 - step / (steps + 1)))
                self.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def _gradients(self, codes: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        p, h, (n, length) = self.p, HIDDEN, codes.shape
        kept: list[list] = [[], []]
        states = np.concatenate([self._run(codes, d, kept[d]) for d in (0, 1)], 2)
        e = states @ p["o"] + p["b"]
        move = p["t"] + ALLOWED
        ahead, behind, total = self.passes(e)
        grad_t = np.zeros_like(p["t"])
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            after = (behind[t] + e[t])[:, None, :] + move
            grad_t += np.exp(ahead[t - 1][:, :, None] + after - total[:, None, None]).sum(0)
            np.subtract.at(grad_t, (tags[:, t - 1], tags[:, t]), 1)
        de = np.exp(ahead + behind - total[None, :, None])
        for t in range(length):
            de[t, rows, tags[:, t]] -= 1
        de /= n
        grads = {"t": grad_t / n, "b": de.sum((0, 1)), "o": np.einsum("tnh,tnk->hk", states, de)}
        dstates = de @ p["o"].T
        for d in (0, 1):
            gx, gh = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"h{d}"])
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, state, before, i, f, new, o, squashed in reversed(kept[d]):
                dh = dh + dstates[t][:, d * h : (d + 1) * h]
                dc = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - new**2), dh * squashed * o * (1 - o)], 1)
                np.add.at(gx, codes[:, t], dz)
                gh += state.T @ dz
                dh, dc = dz @ p[f"h{d}"].T, dc * f
            grads |= {f"x{d}": gx, f"h{d}": gh}
        return grads


def reconcile(size: int, windows: np.ndarray) -> np.ndarray:
    """Values of the whole text: each character's from the window where it is farthest from an edge, the earlier of equals."""
    margin = (WINDOW - STRIDE) // 2
    parts = [windows[0, : WINDOW - margin], windows[1:, margin : WINDOW - margin].ravel(), windows[-1, WINDOW - margin :]]
    return np.concatenate(parts)[:size]


def spans_of(text: str, tags: np.ndarray, sure: np.ndarray) -> list[Span]:
    """Runs of one kind's tags whose mean probability is SURE or more; cards must pass Luhn's test."""
    out: list[Span] = []
    for a in np.flatnonzero(tags % 2 == 1).tolist():
        kind, b = int(tags[a] - 1) // 2, a + 1
        while b < len(tags) and tags[b] == tags[a] + 1:
            b += 1
        b = min(b, len(text))
        if b - a > 1 and float(sure[a:b].mean()) >= SURE and (KINDS[kind] != "card" or _luhn(_digits(text[a:b]))):
            out.append((a, b, KINDS[kind]))
    return out


class Finder:
    """Fixed spans, and the network's where one was learned."""

    def __init__(self, tagger: Tagger | None) -> None:
        self.tagger = tagger

    def learned(self, texts: list[str]) -> Iterator[list[Span]]:
        """The network's spans for each text.

        The windows of a run of texts go through the network together; those that the bound leaves wait for CHUNK of them.
        """
        part: list[np.ndarray] = []
        waiting: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]] = []
        size = done = 0
        for k, t in enumerate(texts):
            part.append(cut(symbols(t)))
            size += len(t)
            if size < TOGETHER and k + 1 < len(texts):
                continue
            windows = np.concatenate(part)
            step = -(-len(windows) // max(1, -(-len(windows) // CHUNK))) or 1  # equal chunks: a small rest would take a chunk's calls
            found = [(at + rows, e) for at in range(0, len(windows), step) for rows, e in [self.tagger.suspects(windows[at : at + step])]]
            found = found or [(np.zeros(0, int), np.zeros((WINDOW, 0, TAGS), np.float32))]
            waiting.append((part, np.concatenate([rows for rows, _ in found]), np.concatenate([e for _, e in found], 1)))
            part, size = [], 0
            if sum(len(rows) for _, rows, _ in waiting) >= CHUNK or k + 1 == len(texts):
                yield from self._spans(texts[done : k + 1], waiting)
                waiting, done = [], k + 1

    def _spans(self, texts: list[str], waiting: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]) -> Iterator[list[Span]]:
        """The spans of texts, whose windows wait in parts, each with the rows that the bound leaves and their emissions."""
        sizes = np.cumsum([0, *(len(w) for part, _, _ in waiting for w in part)])
        starts = np.cumsum([0, *(sum(map(len, part)) for part, _, _ in waiting)])
        rows = np.concatenate([at + r for at, (_, r, _) in zip(starts, waiting, strict=False)])
        e = np.concatenate([e for _, _, e in waiting], 1)
        waiting.clear()
        some = np.concatenate([k + np.flatnonzero(~self.tagger._plain(e[:, k : k + CHUNK])) for k in range(0, len(rows), CHUNK)] or [np.zeros(0, int)])
        rows, e = rows[some], e[:, some]
        marks = [self.tagger.marks(e[:, k : k + CHUNK]) for k in range(0, len(rows), CHUNK)]
        tags, sure = (np.concatenate([m[j] for m in marks]) if marks else None for j in (0, 1))
        for t, a, b in zip(texts, sizes[:-1], sizes[1:], strict=True):
            first, last = np.searchsorted(rows, (a, b))
            if first == last:
                yield []
                continue
            mine, certain = np.zeros((b - a, WINDOW), np.uint8), np.zeros((b - a, WINDOW), np.float32)
            mine[rows[first:last] - a], certain[rows[first:last] - a] = tags[first:last], sure[first:last]
            yield spans_of(t, reconcile(len(t), mine), reconcile(len(t), certain)) if mine.any() else []

    def __call__(self, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
        """(fixed, added) spans for each text."""
        more = self.learned(texts) if self.tagger else ([] for _ in texts)
        for t, found in zip(texts, more, strict=True):
            base = base_spans(t)
            yield base, outside(found, base)


def examples(text: str) -> Iterator[tuple[int, bytes, bytes]]:
    """(class, window, tags) of a text and of its reworded form; classes: 0 plain, 1 with digits or at signs, 2 with spans, 3 reworded."""
    base = base_spans(text)
    for k, (t, spans) in enumerate([(text, base), reworded_text(text, base)] if base else [(text, base)]):
        codes = symbols(t)
        near = (codes >= 48) & (codes <= 57) | (codes == 64)
        for w, y, some in zip(cut(codes), cut(tags_of(spans, len(t))), cut(near), strict=True):
            if y.any():
                yield 2 + k, w.tobytes(), y.tobytes()
            elif not k and (some.any() or zlib.crc32(w.tobytes()) % PLAIN == 0):
                yield int(some.any()), w.tobytes(), y.tobytes()


def learn(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> Finder:
    """Train on at most SAMPLE_WINDOWS windows of each class of examples, from at most SAMPLE_DOCUMENTS documents.

    POOL times as many plain windows are looked through for those that the first training gets wrong.
    """

    def found(texts):
        for t in texts:
            yield from examples(t or "")

    rows = sample_rows(documents.select(id_column, F.col(text).alias("_text")), id_column, SAMPLE_DOCUMENTS).select("_text")
    rows = stash(map_rows(rows, found, "c int, w binary, y binary").distinct())
    got = []
    for c, most in enumerate((POOL * SAMPLE_WINDOWS, SAMPLE_WINDOWS, SAMPLE_WINDOWS, SAMPLE_WINDOWS)):
        part = rows.where(F.col("c") == c).orderBy(F.md5("w"), "w", "y").limit(most)
        got.append(sorted(((bytes(w), bytes(y)) for w, y in part.select("w", "y").collect()), key=lambda x: (zlib.crc32(x[0]), *x)))

    def windows(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        w, y = (np.frombuffer(b"".join(r[k] for r in rows), np.uint8).reshape(-1, WINDOW) for k in (0, 1))
        return w, y.astype(np.int64)

    w, y = windows([*got[0][:SAMPLE_WINDOWS], *got[1], *got[2], *got[3]])
    return Finder(Tagger(w, y, windows(got[0])[0]) if y.any() else None)


def find(documents: DataFrame, id_column: str = "doc_id", text: str = "text", model: Finder | None = None) -> DataFrame:
    """One row per input row: doc_id and spans, structs of kind, start, end and base.

    Positions are code points, ends exclusive; spans are ordered by start, then kind;
    base marks those of the fixed formats. Null texts count as empty; repeated rows
    and null ids each give their row; where the sample has no fixed span nothing is
    learned and none is added; an empty table gives no rows. Other columns are not read.
    model is what learn has returned, for several tables or runs to share.
    """
    finder = Shared(documents.sparkSession, model or learn(documents, id_column, text))

    def found(ids, texts):
        for i, (base, more) in zip(ids, finder.value([t or "" for t in texts]), strict=True):
            yield i, span_rows(base, more, KINDS)

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(rows, found, f"doc_id long, spans {SPANS}")


def masked(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans as <KIND> of its first."""
    out, at, k = [], 0, 0
    spans = sorted(spans)
    while k < len(spans):
        a, b, kind = spans[k]
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, id_column: str = "doc_id", text: str = "text", model: Finder | None = None) -> DataFrame:
    """The documents with personal data in the text replaced by <EMAIL>, <IP>, <CARD>, <PHONE>.

    Null texts stay null, empty ones empty; repeated rows change alike; an empty table gives none.
    """
    finder = Shared(documents.sparkSession, model or learn(documents, id_column, text))

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = finder.value([t or "" for t in texts])
            yield pd.Series([None if t is None else masked(t, a + b) for t, (a, b) in zip(texts, found, strict=True)], dtype=object)

    return documents.withColumn(text, clean(F.col(text)))
