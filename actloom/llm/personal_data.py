"""Personal data by a character-level bidirectional LSTM with CRF transitions, beside fixed base rules.

Base rules find e-mail addresses, IP addresses, card and phone numbers by pattern and check. A BiLSTM-CRF in
numpy adds spans in forms that the rules don't know (spelt-out addresses, unusual separators, numbers without
a plus). It is trained on spans that the rules label in at most MAX_TRAIN documents, and on the same spans
rewritten, with like-looking numbers that are no personal data as counter-examples.

Every personal span holds a site: a digit, an at sign or a spelt at between a name and a host (a constraint on
decoding), so windows without one decode to nothing and are left out. A stretch reaches from its sites to the ends
of the names and hosts beside them and MARGIN further; overlapping windows of WINDOW characters of it are decoded, each
character takes its tag from the window in which it lies furthest from an edge, and the tags of the whole text
are read once. An added span must pass its kind's check (digits, Luhn, parts) and must not touch a base span.

Defined cases: null and empty texts have no spans; long texts are never cut; repeated rows give equal rows; an
empty table gives no rows; where no span can be learned from, only the base rules speak; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.llm.common import documents, map_rows, narrow

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
DOT = r"(?:\.|[\[(]\s?dot\s?[\])]|(?<=\s)dot(?=\s))"
#: What every span holds; a bare at counts where a name stands before it and a host with a dot after it.
SITES = re.compile(rf"[0-9@＠]+|[\[(]\s?at\s?[\])]|(?<=[\w.%+-]\s)at(?=\s[\w-]+\s?{DOT}\s?[\w-])", re.I)
HOST = re.compile(rf"\s?[\w-]+(?:\s?{DOT}\s?[\w-]+)*", re.I)

AT_SIGN = re.compile(r"[@＠]|[\[(]\s?at\s?[\])]|(?<=\s)at(?=\s)", re.I)
#: A host to its end: a plain dot stands between its parts without blanks, so a sentence's end doesn't go on.
WHOLE_HOST = re.compile(r"\s?[\w-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[\w-]+)+", re.I)
GROUP_BEFORE = re.compile(r"(?<![0-9])([0-9]{1,4})[\s()./_–-]{1,3}\Z")
GROUP_AFTER = re.compile(r"[\s()./_–-]{1,3}[0-9]{1,4}(?![0-9])")

#: Documents that are fitted on, drawn evenly by a hash of the id.
MAX_TRAIN = 600
#: Windows, rules' spans and other sites of a training document, drawn evenly from the whole of it.
TRAIN_WINDOWS, TRAIN_SPANS, TRAIN_SITES = 20, 6, 12
WINDOW, STRIDE, MARGIN = 96, 48, 28
EMBED, HIDDEN, BATCH, STEPS, RATE = 12, 24, 64, 380, 0.015
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
Span = tuple[int, int, int]  # start, end, kind


# Base rules ----------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def passes(kind: int, text: str) -> bool:
    if kind == 0:
        return True
    digits = "".join(DIGITS.findall(text))
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in re.findall("[0-9]+", text))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules by start, then kind."""
    out = []
    for kind, (pattern, sign) in enumerate(((EMAIL, "@"), (IP, "."), (CARD, ""), (PHONE, "+"))):
        if sign in text:
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if passes(kind, m.group())]
    return sorted(out, key=lambda s: (s[0], s[2]))


# The network ---------------------------------------------------------------------------------------------


def codes(text: str) -> np.ndarray:
    """A class for each character: printable ASCII by itself, line ends, other letters, the rest."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where((points >= 32) & (points < 127), points - 31, 0)
    out[points == 10] = 96
    beyond = points >= 127
    out[beyond] = 97
    out[points == 0xFF20] = ord("@") - 31
    return out.astype(np.int64)


CLASSES = 98


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Network:
    """Weights by name. Windows are (time, batch) arrays of character classes with a mask of real places."""

    def __init__(self, seed: int = 5):
        r = np.random.Generator(np.random.PCG64(seed))
        make = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"embed": make(CLASSES, EMBED) * 3, "out": make(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32)}
        for side in "fb":
            self.w |= {f"x{side}": make(EMBED, 4 * HIDDEN), f"h{side}": make(HIDDEN, 4 * HIDDEN)}
            self.w[f"c{side}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # the forget gate starts open
        self.w |= {"moves": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        # An inside tag follows only a tag of its own kind.
        self.barred = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            self.barred[:, 2 + 2 * k] = -1e4
            self.barred[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.first_barred = np.where(np.arange(TAGS) % 2 == 0, -1e4, 0).astype(np.float32)
        self.first_barred[0] = 0

    def run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """States of one direction; x is (time, batch, embed)."""
        times = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        pre = x @ self.w["x" + side] + self.w["c" + side]
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c = np.zeros_like(h)
        out, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), {}
        for t in times:
            z = pre[t] + h @ self.w["h" + side]
            gate = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = (h, c), (f * c + i * g) * mask[t][:, None]
            tc = np.tanh(c)
            h = o * tc * mask[t][:, None]
            out[t] = h
            if keep:
                kept[t] = (i, f, o, g, tc, before)
        return out, kept

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        e = self.w["embed"][x]
        hf, kf = self.run(e, mask, "f", keep)
        hb, kb = self.run(e, mask, "b", keep)
        both = np.concatenate([hf, hb], 2)
        return both @ self.w["out"] + self.w["bias"], (e, both, kf, kb)

    def back(self, dh: np.ndarray, e: np.ndarray, kept: dict, mask: np.ndarray, side: str, grads: dict) -> np.ndarray:
        times = range(len(e) - 1, -1, -1) if side == "f" else range(len(e))
        wx, wh = self.w["x" + side], self.w["h" + side]
        dz_all = np.zeros((*e.shape[:2], 4 * HIDDEN), np.float32)
        hidden = np.zeros((*e.shape[:2], HIDDEN), np.float32)
        dh_next = np.zeros((e.shape[1], HIDDEN), np.float32)
        dc = np.zeros_like(dh_next)
        for t in times:
            i, f, o, g, tc, (h0, c0) = kept[t]
            m = mask[t][:, None]
            d = (dh[t] + dh_next) * m
            dc = dc + d * o * (1 - tc**2)
            dcm = dc * m
            dz = np.concatenate([dcm * g * i * (1 - i), dcm * c0 * f * (1 - f), d * tc * o * (1 - o), dcm * i * (1 - g**2)], 1)
            dc = dcm * f
            dh_next = dz @ wh.T
            dz_all[t], hidden[t] = dz, h0
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads["x" + side] = e.reshape(-1, EMBED).T @ flat
        grads["h" + side] = hidden.reshape(-1, HIDDEN).T @ flat
        grads["c" + side] = flat.sum(0)
        return dz_all @ wx.T

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags and its gradients."""
        s, (e, both, kf, kb) = self.scores(x, mask, True)
        moves, first = self.w["moves"] + self.barred, self.w["first"] + self.first_barred
        times, n = x.shape
        fwd, bwd = np.zeros_like(s), np.zeros_like(s)
        fwd[0] = s[0] + first
        for t in range(1, times):
            step = lse(fwd[t - 1][:, :, None] + moves[None], 1) + s[t]
            fwd[t] = np.where(mask[t][:, None] > 0, step, fwd[t - 1])
        for t in range(times - 2, -1, -1):
            step = lse(moves[None] + (s[t + 1] + bwd[t + 1])[:, None, :], 2)
            bwd[t] = np.where(mask[t + 1][:, None] > 0, step, bwd[t + 1])
        total = lse(fwd[-1], 1)
        ds = np.exp(fwd + bwd - total[None, :, None]) * mask[:, :, None]
        gold = np.zeros_like(ds)
        np.put_along_axis(gold, y[:, :, None], mask[:, :, None], 2)
        pair = fwd[:-1, :, :, None] + moves + (s + bwd)[1:, :, None, :] - total[None, :, None, None]
        d_moves = (np.exp(pair) * mask[1:, :, None, None]).sum((0, 1))
        np.add.at(d_moves, (y[:-1][mask[1:] > 0], y[1:][mask[1:] > 0]), -1)
        gold_score = (s * gold).sum() + first[y[0]].sum() + (moves[y[:-1], y[1:]] * mask[1:]).sum()
        ds = (ds - gold) / n
        grads = {"moves": d_moves / n, "first": ds[0].sum(0), "bias": ds.sum((0, 1))}
        grads["out"] = both.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, TAGS)
        dboth = ds @ self.w["out"].T
        de = self.back(dboth[:, :, :HIDDEN], e, kf, mask, "f", grads) + self.back(dboth[:, :, HIDDEN:], e, kb, mask, "b", grads)
        grads["embed"] = np.zeros_like(self.w["embed"])
        np.add.at(grads["embed"], x.ravel(), de.reshape(-1, EMBED))
        return float((total.sum() - gold_score) / n), grads

    def decode(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Best tags, (time, batch), by Viterbi."""
        s, _ = self.scores(x, mask)
        moves = self.w["moves"] + self.barred
        best = s[0] + self.w["first"] + self.first_barred
        back = np.zeros(s.shape, np.int8)
        same = np.arange(TAGS, dtype=np.int8)[None, :]
        for t in range(1, len(s)):
            step = best[:, :, None] + moves[None]
            real = mask[t][:, None] > 0
            back[t] = np.where(real, step.argmax(1), same)
            best = np.where(real, step.max(1) + s[t], best)
        tags = np.zeros(x.shape, np.int8)
        tags[-1] = best.argmax(1)
        for t in range(len(s) - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None].astype(np.int64), 1)[:, 0]
        return tags


def batch_of(parts: list[np.ndarray], fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(time, batch) of padded sequences, and their mask."""
    longest = max(map(len, parts))
    x, mask = np.full((longest, len(parts)), fill, np.int64), np.zeros((longest, len(parts)), np.float32)
    for i, p in enumerate(parts):
        x[: len(p), i], mask[: len(p), i] = p, 1
    return x, mask


def train(samples: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 3) -> Network | None:
    """Adam over random batches of (classes, tags) windows; none without samples."""
    if not samples:
        return None
    net, r = Network(), np.random.Generator(np.random.PCG64(seed))
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, steps + 1):
        chosen = r.integers(0, len(samples), BATCH)
        x, mask = batch_of([samples[i][0] for i in chosen])
        y, _ = batch_of([samples[i][1] for i in chosen])
        _, grads = net.gradients(x, y, mask)
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g**2
            net.w[k] = (net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


# Labelled spans ------------------------------------------------------------------------------------------


def fresh(kind: int, rng: random.Random) -> str:
    """Personal data that nobody has, in a form of the base rules; what a kind looks like must not hang on the names,
    hosts and numbers of the table."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def word(most: int = 4) -> str:
        w = "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiouy") for _ in range(rng.randint(1, most)))
        return w + rng.choice(["", "", rng.choice("nrst"), digits(rng.randint(1, 3))])

    if kind == 0:
        name = rng.choice(["", "", word() + rng.choice("._-+")]) + word()
        ends = ["com", "org", "net", "io", "de", "fr", "co.uk", "edu", "info", "example.com", "example.org", word(1)]
        hosts = [rng.choice([word(), word() + "-" + word(2)]) for _ in range(rng.choice([1, 1, 1, 2]))]
        return name + "@" + ".".join([*hosts, rng.choice(ends)])
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        body = rng.choice("3456") + digits(rng.choice([13, 14, 14, 14, 14]))
        return body + next(d for d in "0123456789" if luhn(body + d))
    return "+" + rng.choice(["1", "1", "44", "49", "33", "7"]) + " " + digits(3) + " " + digits(3) + " " + digits(4)


def rewritten(kind: int, text: str, rng: random.Random) -> str:
    """The same personal data in a form that the base rules don't know."""
    if kind == 0:
        at = rng.choice([" [at] ", "[at]", " (at) ", "(at)", " at ", "＠", " @ ", " [ at ] "])
        dot = rng.choice([" [dot] ", " (dot) ", " dot ", ".", ".", " [ dot ] "])
        name, _, host = text.partition("@")
        return name + at + host.replace(".", dot)
    if kind == 1:
        return text.replace(".", rng.choice(["[.]", "(.)", " . ", "[dot]", "-", ". "]))
    digits = "".join(DIGITS.findall(text))
    if kind == 2:
        sep = rng.choice([".", "/", "_", "  ", " - ", "–"])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[-10:-7] or "555", digits[-7:-4] or "555", digits[-4:]
    return rng.choice([
        f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"1 ({a}) {b}-{c}", f"1-{a}-{b}-{c}",
        f"00 1 {a} {b}{c}", f"({a}){b}-{c}", f"{a} {b} {c}", f"+ 1 {a} {b} {c}", f"+1/{a}/{b}/{c}",
    ])


def lookalike(rng: random.Random) -> str:
    """Numbers and words that are no personal data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    return rng.choice([
        lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2099)}",
        lambda: f"{rng.randint(0, 23)}:{rng.randint(0, 59):02}", lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 30)}",
        lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}", lambda: n(rng.randint(1, 8)),
        lambda: f"{rng.randint(1, 999)},{n(3)}", lambda: f"${rng.randint(1, 999)}.{n(2)}", lambda: n(rng.randint(9, 11)),
        lambda: n(rng.randint(12, 24)), lambda: f"pp. {rng.randint(1, 400)}-{rng.randint(401, 900)}", lambda: "@" + rng.choice(["home", "noon"]),
        lambda: f"ISBN 978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"{rng.randint(1, 99)}%", lambda: f"{n(5)}-{n(4)}", lambda: f"#{n(rng.randint(2, 7))}", lambda: f"{n(4)}/{n(2)}",
        lambda: f"{rng.randint(1, 9)} at {rng.randint(10, 99)}", lambda: f"{n(3)}.{n(3)}.{n(3)}", lambda: f"{rng.randint(256, 999)}.{n(3)}.{n(3)}.{n(3)}",
    ])()


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    out, taken = np.zeros(length, np.int64), -1
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= taken:
            out[a:b] = 2 + 2 * kind
            out[a] = 1 + 2 * kind
            taken = b
    return out


def drawn(items: list, at_most: int, rng: random.Random) -> list:
    """At most so many of the items, from all places alike, in order."""
    return items if len(items) <= at_most else [items[i] for i in sorted(rng.sample(range(len(items)), at_most))]


def training_windows(texts: list[str], seed: int = 17, each: int = TRAIN_SPANS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows with tags: around the rules' spans, around the same spans rewritten, and around lookalikes."""
    rng, out = random.Random(seed), []
    if not any(base_spans(t) for t in texts):
        return out

    def add(before: str, mid: str, after: str, kind: int | None):
        before, after = before[max(0, len(before) - rng.randint(0, MARGIN)) :], after[: rng.randint(0, MARGIN)]
        spans = [] if kind is None else [(len(before), len(before) + len(mid), kind)]
        whole = before + mid + after
        spans += [s for s in base_spans(whole) if s[1] <= len(before) or s[0] >= len(before) + len(mid)]
        out.append((codes(whole)[:WINDOW], tags_of(len(whole), spans)[:WINDOW]))

    for text in texts:
        spans = drawn(base_spans(text), each, rng)
        for a, b, kind in spans:
            add(text[:a], text[a:b], text[b:], kind)
            for source in (text[a:b], fresh(kind, rng), fresh(kind, rng)):
                add(text[:a], rewritten(kind, source, rng), text[b:], kind)
        for kind in range(len(KINDS)):  # every kind alike, however rare it is in the table
            for _ in range(2):
                cut = text.find(" ", rng.randrange(len(text) + 1)) + 1
                add(text[:cut], rewritten(kind, fresh(kind, rng), rng), rng.choice([" ", " ", ". ", ", "]) + text[cut:], kind)
        sites = drawn([m.start() for m in SITES.finditer(text)], TRAIN_SITES, rng)
        for at in [*sites, *(rng.randrange(len(text) + 1) for _ in range(2))]:
            w = text[max(0, at - MARGIN) : at + WINDOW - MARGIN]
            out.append((codes(w), tags_of(len(w), base_spans(w))))
            cut = text.find(" ", at) + 1
            add(text[:cut], lookalike(rng), " " + text[cut:], None)
    return [s for s in out if len(s[0])]


# Decoding whole texts ------------------------------------------------------------------------------------


def reach(text: str, site: re.Match) -> tuple[int, int]:
    """The site, and where it is an at the name before and the host after it."""
    a, b = site.span()
    if not any(c in "@＠tT" for c in site[0]):
        return a, b
    if site[0][0] in "@＠0123456789":  # a run of digits and at signs
        signs = [i for i, c in enumerate(site[0]) if c in "@＠"]
        a, b = a + signs[0], a + signs[-1] + 1
    if a and text[a - 1].isspace():
        a -= 1
    while a and (text[a - 1].isalnum() or text[a - 1] in "_.%+-"):
        a -= 1
    host = HOST.match(text, b)
    return min(a, site.start()), max(host.end() if host else b, site.end())


def windows_of(text: str) -> list[tuple[int, int]]:
    """Overlapping windows around every site; a stretch of sites longer than a window gets several."""
    out, start, end = [], None, 0
    stretches = []
    for m in SITES.finditer(text):
        a, b = reach(text, m)
        if start is not None and a - end <= MARGIN:
            start, end = min(start, a), max(end, b)
        else:
            if start is not None:
                stretches.append((start, end))
            start, end = a, b
    if start is not None:
        stretches.append((start, end))
    for a, b in stretches:
        a, b = max(0, a - MARGIN), min(len(text), b + MARGIN)
        while True:
            out.append((a, min(a + WINDOW, b)))
            if a + WINDOW >= b:
                break
            a += STRIDE
    return out


def reconciled(windows: list[tuple[int, int]], tags: list[np.ndarray]) -> list[Span]:
    """Spans of a text from its windows' tags: a character's tag comes from the window where it is furthest from
    an edge; adjoining tags of one kind make a span."""
    chosen: dict[int, tuple[int, int]] = {}
    for (a, b), tag in zip(windows, tags):
        for t in np.flatnonzero(tag).tolist() if len(windows) == 1 else range(b - a):
            depth = min(t, b - a - 1 - t)
            if depth > chosen.get(a + t, (-1, 0))[0]:
                chosen[a + t] = (depth, int(tag[t]))
    out: list[list[int]] = []
    for at in sorted(chosen):
        tag = chosen[at][1]
        if not tag:
            continue
        kind = (tag - 1) // 2
        if out and out[-1][1] == at and out[-1][2] == kind and tag % 2 == 0:
            out[-1][1] = at + 1
        else:
            out.append([at, at + 1, kind])
    return [tuple(s) for s in out]


def whole(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    """A decoded span grown to the ends of what it is part of: an address to its whole name and host, a number to
    whole groups of digits, as few as make it one."""
    if kind == 0:
        for m in AT_SIGN.finditer(text, max(0, a - 9), min(len(text), b + 9)):
            if m.end() < a - 1 or m.start() > b + 1:
                continue
            start = m.start() - (m.start() > 0 and text[m.start() - 1].isspace())
            name = start
            while name and (text[name - 1].isalnum() or text[name - 1] in "_.%+-"):
                name -= 1
            host = WHOLE_HOST.match(text, m.end())
            if host and name < start:
                return name, host.end()
        return a, b
    while b > a and not text[b - 1].isdigit():
        b -= 1
    while a < b and not (text[a].isdigit() or kind == 3 and text[a] in "(+"):
        a += 1
    while a and text[a].isdigit() and text[a - 1].isdigit():
        a -= 1
    while a < b < len(text) and text[b].isdigit():
        b += 1
    if a == b:
        return a, b

    def good(x: int, y: int) -> bool:
        piece = text[x:y]
        enough = kind != 3 or len(DIGITS.findall(piece)) >= 10
        return enough and form(kind, piece) and passes(kind, piece)

    lefts, rights = [a], [b]
    for _ in range(2):
        m = GROUP_BEFORE.search(text, max(0, lefts[-1] - 12), lefts[-1])
        if m:
            lefts.append(m.start(1))
        m = GROUP_AFTER.match(text, rights[-1])
        if m:
            rights.append(m.end())
    sizes = sorted((x + y, x, y) for x in range(len(lefts)) for y in range(len(rights)))
    x, y = next(((lefts[i], rights[j]) for _, i, j in sizes if good(lefts[i], rights[j])), (a, b))
    if kind == 3:
        if ")" in text[x:y] and "(" not in text[x:y] and x and text[x - 1] == "(":
            x -= 1
        plus = re.search(r"\+[ (]?$", text[max(0, x - 2) : x])
        x -= len(plus[0]) if plus else 0
    return x, y


def form(kind: int, text: str) -> bool:
    """What a span must look like besides its check: an address has a name and a host, a number enough digits."""
    if not SITES.search(text) or text != text.strip() or "\n" in text:
        return False
    if kind == 0:
        return bool(re.fullmatch(rf"[\w.%+-]+\s?(?:@|＠|[\[(]\s?at\s?[\])]|(?<=\s)at(?=\s))\s?[\w-]+(?:\s?{DOT}\s?[\w-]+)+", text, re.I))
    parts = re.findall("[0-9]+", text)
    if kind == 1:
        return len(parts) == 4
    return not re.search(r"[A-Za-z]", text)


def added_spans(texts: list[str], base: list[list[Span]], net: Network | None, block: int = 512) -> list[list[Span]]:
    """Spans that the network adds to each text."""
    out: list[list[Span]] = [[] for _ in texts]
    if net is None:
        return out
    where = [(i, w) for i, t in enumerate(texts) for w in windows_of(t)]
    order = sorted(range(len(where)), key=lambda j: where[j][1][1] - where[j][1][0])
    tags: dict[int, np.ndarray] = {}
    for at in range(0, len(order), block):
        part = order[at : at + block]
        parts = [codes(texts[where[j][0]][where[j][1][0] : where[j][1][1]]) for j in part]
        x, mask = batch_of(parts)
        got = net.decode(x, mask)
        for n, j in enumerate(part):
            tags[j] = got[: len(parts[n]), n]
    by_text: dict[int, list[int]] = {}
    for j, (i, _) in enumerate(where):
        by_text.setdefault(i, []).append(j)
    for i, mine in by_text.items():
        if not any(tags[j].any() for j in mine):
            continue
        for a, b, kind in reconciled([where[j][1] for j in mine], [tags[j] for j in mine]):
            a, b = whole(kind, texts[i], a, b)
            piece = texts[i][a:b]
            taken = (*base[i], *out[i])
            if form(kind, piece) and passes(kind, piece) and not any(a < y and x < b for x, y, _ in taken):
                out[i].append((a, b, kind))
    return out


def find_spans(texts: list[str | None], net: Network | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """(base spans, all spans) of each text."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    more = added_spans(texts, base, net)
    return base, [sorted(b + m, key=lambda s: (s[0], s[2])) for b, m in zip(base, more)]


def spelt(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def fit(df: DataFrame, at_most: int = MAX_TRAIN) -> Network | None:
    """A network trained on at most so many documents that hold a digit or an at sign, each as the stretches
    around its sites. One task trains (on one core, away from the driver) and returns the weights."""

    def make():
        def work(cols: dict) -> dict:
            texts = [t or "" for t in cols["text"]]
            some = [drawn(windows_of(t), TRAIN_WINDOWS, random.Random(zlib.crc32(t.encode()))) for t in texts]
            return {"text": ["\n".join(t[max(0, a - 40) : b + 40] for a, b in w) for t, w in zip(texts, some)]}

        return work

    def learn(batches):
        texts = [t for batch in batches for t in batch.column(0).to_pylist()]
        net = train(training_windows(sorted(texts)))
        if net is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.w)], pa.binary())], names=["weights"])

    chosen = narrow(df).filter(F.col("text").rlike("[0-9@]"))
    ids = chosen.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)
    stretches = map_rows(chosen.join(F.broadcast(ids), "doc_id").select("text"), "text string", make).limit(2 * at_most)
    found = stretches.repartition(1).mapInArrow(learn, "weights binary").collect()
    if not found:
        return None
    net = Network()
    net.w = pickle.loads(found[0].weights)
    return net


def find(df: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts and checksum of the base spans, and all spans of every whole text."""

    def make():
        def work(cols: dict) -> dict:
            base, full = find_spans(cols["text"], net)
            out = {f"n_{k}": [sum(s[2] == i for s in b) for b in base] for i, k in enumerate(KINDS)}
            sums = [hashlib.sha256(spelt(b).encode()).hexdigest() for b in base]
            return {"doc_id": cols["doc_id"], **out, "base_sha256": sums, "spans": list(map(spelt, full))}

        return work

    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    return map_rows(narrow(df, key, text), schema, make, rows_at_once=1024)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find(docs, fit(docs))
