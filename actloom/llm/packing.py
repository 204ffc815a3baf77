"""Packing of documents into sequences of bounded length by exact complements.

A packing depends on lengths alone, and a length is a whole number up to the limit. So the documents' lengths
are counted, at most `limit` counts reach the driver whatever the table's size, and the plan is made on the
counts: the longest waiting piece opens a sequence, and the gap that it leaves is looked up among the single
lengths, the sums of two and the sums of three waiting lengths. A combination that fills the gap exactly is
consumed as often as its lengths last. Where there is none, the longest piece that fits goes in and the smaller
gap is looked up anew (best fit). Every combination uses up a length, so the plan has at most a few thousand
patterns. Pieces find their places by their rank among the pieces of their length, without a search.

Tokens: a text is split at ASCII white space, which no token of this vocabulary spans, and every distinct
stretch is encoded by the library; a worker remembers stretches up to a bound in characters.

Defined cases: a null or empty text is the end token alone; repeated rows are packed once each; a null doc_id is
kept; equal lengths take places in the order of doc_id and piece; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.llm.common import documents, map_rows, narrow, stage_table
from actloom.llm.sharding import gapless

LIMIT = 4096
END = 1
#: Characters of stretches that a worker remembers, and the longest stretch worth it.
REMEMBER_CHARS = 10_000_000
LONG_STRETCH = 200
#: Stretches are handed to the library in lines of so many, each followed by a mark: a control character, which is a
#: token of its own between blanks.
CORES_A_LINE = 128
MARK = "\x01"
#: Letters whose lower case is one letter in every version of Unicode, composed and without context.
PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿА-яЁё]+").fullmatch
#: Bytes as the letters that stand for them in byte-level vocabularies; printable ones stand for themselves.
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_HIDDEN)}
#: Ranks are counted in blocks of about so many rows of a length, in at least so many blocks.
ROWS_A_BLOCK = 200_000
LEAST_BLOCKS = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = PIECES + ", sequence_id long, offset long"
TAIL = ",.;:!?)"

_loaded: dict[str, Stretches] = {}


class Stretches:
    """Token ids of stretches without white space, as little-endian bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [spaced(t or "").split(" ") for t in texts]
        seen = set().union(*split)
        if self.chars > REMEMBER_CHARS:  # what is met again right now stays
            self.known = {w: self.known[w] for w in seen if w in self.known}
            self.chars = sum(map(len, self.known))
        known = self.known
        here = self.learn(seen.difference(known))
        short = {w: i for w, i in here.items() if len(w) <= LONG_STRETCH}
        known.update(short)
        self.chars += sum(map(len, short))
        if len(short) < len(here):
            return [b"".join([known[w] if w in known else here[w] for w in words]) for words in split]
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of stretches; the library sees each core once, and only cores that aren't known."""
        parts = {w: core_and_tail(w) for w in missing}
        known = self.known
        new = {x for two in parts.values() for x in two if x not in known}
        ids = self.encoded(list(new))
        found = {w: (ids[c] if c in ids else known[c]) + (ids[t] if t in ids else known[t]) for w, (c, t) in parts.items()}
        return ids | found

    def encoded(self, cores: list[str]) -> dict[str, bytes]:
        """Ids by the library. Words of plain letters go to its model at once: lower case and the byte alphabet are
        all that stands before it. A call for the others has its price, so they go in lines, with a mark of one
        token between blanks after each. A core that holds the mark goes alone."""
        out: dict[str, bytes] = {}
        tokens, plain = self.model.tokenize, []
        for x in cores:
            if not PLAIN_WORD(x):
                plain.append(x)
                continue
            low = x.lower()
            letters = low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_LETTERS)
            out[x] = array("I", [t.id for t in tokens(letters)]).tobytes()
        cores, plain = plain, [x for x in plain if MARK not in x]
        lines = [plain[i : i + CORES_A_LINE] for i in range(0, len(plain), CORES_A_LINE)]
        made = self.tokenizer.encode_batch_fast(["".join([f"{x} {MARK} " for x in line]) for line in lines], add_special_tokens=False)
        for line, e in zip(lines, made):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(line):
                raise ValueError("a line of stretches has not as many marks as stretches")
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            out.update(zip(line, [raw[a:b] for a, b in zip([0, *[x + 4 for x in ends]], ends)]))
        if len(plain) < len(cores):
            alone = [x for x in cores if MARK in x]
            made = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
            out.update((x, np.array(e.ids, "<u4").tobytes()) for x, e in zip(alone, made))
        return out


def spaced(text: str) -> str:
    for blank in "\n\t\x0b\x0c\r":
        text = text.replace(blank, " ")
    return text


def core_and_tail(stretch: str) -> tuple[str, str]:
    """A stretch in two parts whose tokens stand one after the other: ASCII punctuation after an ASCII letter is
    a token of its own. Plain ASCII is lowered here as the tokenizer would (not what may name a special token)."""
    if "|" not in stretch and stretch.isascii():
        stretch = stretch.lower()
    if not stretch or stretch[-1] not in TAIL:
        return stretch, ""
    core = stretch.rstrip(TAIL)
    if core and core[-1].isascii() and core[-1].isalpha():
        return core, stretch[len(core) :]
    return stretch, ""


def load(path: str) -> Stretches:
    if path not in _loaded:
        _loaded[path] = Stretches(path)
    return _loaded[path]


def cut_documents(df: DataFrame, path: str, limit: int = LIMIT, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length and the checksum of its ids. Only documents over
    the limit have more than one piece."""

    def make():
        stretches = load(path)
        last = np.array([end], "<u4").tobytes()

        def work(cols: dict) -> dict:
            out: dict = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(cols["doc_id"], stretches.encode(cols["text"])):
                ids += last
                for i, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    for name, value in zip(out, (doc, i, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[name].append(value)
            return out

        return work

    return map_rows(narrow(df, key, text).select(F.col("doc_id").cast("long"), "text"), PIECES, make)


class Waiting:
    """Pieces that wait, counted by length, with the sums of two waiting lengths as an index."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64).copy()
        self.index()

    def index(self) -> None:
        """pairs[s]: in how many ordered ways s is a sum of two waiting pieces."""
        there = (self.counts > 0).astype(np.float64)
        size = len(there)
        wave = np.fft.rfft(there, 2 * size)
        self.pairs = np.rint(np.fft.irfft(wave * wave, 2 * size)[:size]).astype(np.int64)
        alone = np.flatnonzero(self.counts == 1)
        alone = alone[2 * alone < size]
        self.pairs[2 * alone] -= 1

    def pair(self, total: int) -> tuple[int, int] | None:
        """The two waiting pieces of this sum whose longer one is longest."""
        x = np.arange(total - 1, (total - 1) // 2, -1)
        y = total - x
        good = (self.counts[x] > 0) & (self.counts[y] > (x == y))
        at = int(good.argmax()) if len(good) else 0
        return (int(x[at]), int(y[at])) if len(good) and good[at] else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three waiting pieces that fill the gap, the longest first."""
        if self.counts[gap] > 0:
            return (gap,)
        if self.pairs[gap] > 0 and (two := self.pair(gap)):
            return two
        x = np.arange(gap - 2, 0, -1)
        for longest in x[(self.counts[x] > 0) & (self.pairs[gap - x] > 0)].tolist():
            self.counts[longest] -= 1
            two = self.pair(gap - longest)
            self.counts[longest] += 1
            if two:
                return (longest, *two)
        return None

    def sequence(self, first: int) -> list[int]:
        """Lengths of a sequence that the given length opens; counts stay as they were."""
        parts, gap = [first], len(self.counts) - 1 - first
        self.counts[first] -= 1
        while gap > 0:
            found = self.exact(gap)
            if not found:
                fits = np.flatnonzero(self.counts[: gap + 1])
                if not len(fits):
                    break
                found = (int(fits[-1]),)
            for x in found:
                self.counts[x] -= 1
            parts.extend(found)
            gap -= sum(found)
        np.add.at(self.counts, parts, 1)
        return parts

    def consume(self, parts: list[int]) -> int:
        """How often the sequence can be made; it is, and the index follows."""
        lengths, times = np.unique(parts, return_counts=True)
        n = int((self.counts[lengths] // times).min())
        self.counts[lengths] -= n * times
        self.index()
        return n


def plan(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """(how often, lengths) of sequences that hold all pieces; counts[n] pieces have length n, none 0."""
    waiting, out = Waiting(counts), []
    for first in range(len(counts) - 1, 0, -1):
        while waiting.counts[first]:
            parts = waiting.sequence(first)
            out.append((waiting.consume(parts), parts))
    return out


class Places:
    """The plan as arrays: for ranges of ranks of a length, the first sequence and the place in it."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for times, parts in patterns:
            at = 0
            for length in sorted(set(parts), reverse=True):
                k, rank = parts.count(length), used.get(length, 0)
                rows.append((length << 48 | rank, rank, k, sequence, at))
                used[length] = rank + times * k
                at += k * length
            sequence += times
        self.sequences = sequence
        rows.sort()
        self.key, self.rank, self.k, self.sequence, self.at = np.array(rows or [(0, 0, 1, 0, 0)], np.int64).T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank among the pieces of their length."""
        i = np.searchsorted(self.key, length << 48 | rank, side="right") - 1
        past = rank - self.rank[i]
        return self.sequence[i] + past // self.k[i], self.at[i] + past % self.k[i] * length


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of PIECES, a stored table)."""
    found = pieces.groupBy("length").count().collect()  # at most `limit` rows
    counts = np.zeros(limit + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["count"]
    places = Places(plan(counts))
    blocks = max(LEAST_BLOCKS, int(counts.sum()) // ROWS_A_BLOCK)
    # The block follows from all that tells rows apart, so copies of one text spread as well.
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks))
    ranked = gapless(pieces, "length", ["doc_id", "piece", "ids_crc32"], block, blocks)

    def make():
        def work(cols: dict) -> dict:
            sequence, offset = places.find(np.array(cols["length"], np.int64), np.array(cols["slot"], np.int64))
            return cols | {"sequence_id": sequence, "offset": offset}

        return work

    return map_rows(ranked, PLACES, make, rows_at_once=65_536)


def pack_documents(df: DataFrame, path: str | None = None, limit: int = LIMIT, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with sequence_id and offset. path: a vocabulary file of the tokenizers library."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(stage_table(cut_documents(df, str(path), limit, end, key, text), "pieces"), limit)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
