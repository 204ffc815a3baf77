"""Spelling variants by Bloom-guided neighbourhoods.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced letter tells them
apart. Every word generates its edits: all deletions, and at each place all smaller letters, so that each pair of
near words is generated from exactly one side. An edit's hash follows from the word's polynomial hash in constant
time and is probed against Bloom filters of the vocabulary; only hits become strings, and an exact join with the
vocabulary removes the false ones.

Filters are kept by word length, in segments of a fixed size: a hash names a segment of the length, a block of 64
bits in it and four bits in the block. A round broadcasts at most ROUND_BYTES of segments and probes them with all
words; a larger vocabulary takes more rounds, not a larger broadcast.

Defined cases: a null text has no words; a null doc_id counts as the empty text in the checksum; repeated rows
count again; of near words equally frequent the first in code-point order is the form; an empty table gives no
rows; words of any length take part; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.llm.common import CRC_TABLE, UPPER_CHARS, crc32_sql, documents, map_rows, narrow, stage_table

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: One lower-cased run in so many loses a letter.
LOSS = 31
#: A form is at least so many times as frequent as the word.
RATIO = 10
RUNS = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
ALPHABET = np.array([*range(97, 123), *range(0xC0, 0x100)], np.uint64)
RANK = np.zeros(256, np.int64)
RANK[ALPHABET.astype(np.int64)] = np.arange(len(ALPHABET))
LOWER_CHARS = str.maketrans(UPPER_CHARS, UPPER_CHARS.lower())
#: Lengths from this one on share their filter.
LONG = 64
BITS_A_WORD = 20
SEGMENT_BLOCKS = 8192
ROUND_BYTES = 64_000_000
#: Edits that a task hashes at once.
EDITS_AT_ONCE = 2_000_000
BASE = 0x9E3779B97F4A7C15 | 1


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n, its occurrences over all texts after the losses, for words of LEAST_LENGTH and LEAST_COUNT."""

    def make():
        def work(cols: dict) -> dict:
            found: Counter = Counter()
            for doc, whole in zip(cols["doc_id"], cols["text"]):
                if not whole:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                here: Counter = Counter()
                for run, n in Counter(RUNS.findall(whole)).items():
                    here[run.translate(LOWER_CHARS)] += n
                for run, n in here.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % LOSS == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LENGTH:
                            continue
                    found[run] += n
            return {"word": list(found), "n": list(found.values())}

        return work

    parts = map_rows(narrow(df, key, text), "word string, n long", make, rows_at_once=8192)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit hash spread over all places."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """BASE to the n-1, ..., 0, modulo 2**64."""
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = BASE
    return np.multiply.accumulate(out)[::-1]


def letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)


def masks(h: np.ndarray) -> np.ndarray:
    """Four bits of a block, from the low 24 bits of the hash."""
    one = np.uint64(1)
    out = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        out |= one << ((h >> np.uint64(shift)) & np.uint64(63))
    return out


class Shape:
    """How many segments and blocks the filter of each length has."""

    def __init__(self, counts: dict[int, int]):
        self.segments, self.blocks = np.zeros(LONG + 1, np.int64), np.zeros(LONG + 1, np.int64)
        for length, n in counts.items():
            need = max(1, -(-n * BITS_A_WORD // 64))
            self.segments[length] = -(-need // SEGMENT_BLOCKS)
            self.blocks[length] = min(SEGMENT_BLOCKS, 1 << (need - 1).bit_length())

    def place(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment and block of each hash."""
        segment = (h >> np.uint64(40)) % np.uint64(self.segments[length])
        block = (h >> np.uint64(24)) & np.uint64(self.blocks[length] - 1)
        return segment.astype(np.int64), block.astype(np.int64)

    def rounds(self, most: int) -> list[dict[int, tuple[int, int]]]:
        """Ranges of segments by length, at most so many bytes in a round."""
        out: list[dict[int, tuple[int, int]]] = []
        room = 0
        for length in np.flatnonzero(self.segments).tolist():
            size, at, end = 8 * int(self.blocks[length]), 0, int(self.segments[length])
            while at < end:
                if room < size:
                    out.append({})
                    room = max(most, size)
                to = min(end, at + room // size)
                out[-1][length] = (at, to)
                room -= (to - at) * size
                at = to
        return out


def by_length(words: list[str]):
    """(length, words of it) over the words."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    return groups.items()


def segments(words: DataFrame, shape: Shape) -> DataFrame:
    """The filters: for each length and segment its blocks as bytes. Tasks send words' bits, packed; a segment
    takes those of about SEGMENT_BLOCKS * 64 / BITS_A_WORD words."""

    def make():
        def work(cols: dict) -> dict:
            out: dict = {"length": [], "segment": [], "bits": []}
            for n, same in by_length(cols["word"]):
                length = min(n, LONG)
                h = mixed((letters(same, n) * powers(n)).sum(axis=1, dtype=np.uint64))
                segment, block = shape.place(length, h)
                pair = np.stack([block.astype(np.uint64), masks(h)], axis=1)
                order = np.argsort(segment, kind="stable")
                edges = np.flatnonzero(np.diff(segment[order], prepend=-1, append=-1))
                for x, y in zip(edges[:-1], edges[1:]):
                    out["length"].append(length)
                    out["segment"].append(int(segment[order[x]]))
                    out["bits"].append(pair[order[x:y]].tobytes())
            return out

        return work

    parts = map_rows(words.select("word"), "length int, segment int, bits binary", make, rows_at_once=65_536)

    def union(table: pa.Table) -> pa.Table:
        length, segment = table["length"][0].as_py(), table["segment"][0].as_py()
        filled = np.zeros(shape.blocks[length], np.uint64)
        for bits in table["bits"]:
            pair = np.frombuffer(bits.as_buffer(), np.uint64).reshape(-1, 2)
            np.bitwise_or.at(filled, pair[:, 0].astype(np.int64), pair[:, 1])
        return pa.table({"length": [length], "segment": [segment], "filled": [filled.tobytes()]}, schema=schema)

    schema = pa.schema([("length", pa.int32()), ("segment", pa.int32()), ("filled", pa.binary())])
    return parts.groupBy("length", "segment").applyInArrow(union, "length int, segment int, filled binary")


class Filters:
    """The segments of one round."""

    def __init__(self, shape: Shape, ranges: dict[int, tuple[int, int]], filled: dict[tuple[int, int], bytes]):
        self.shape, self.ranges = shape, ranges
        self.blocks = {}
        for length, (low, high) in ranges.items():
            empty = bytes(8 * int(shape.blocks[length]))
            self.blocks[length] = np.frombuffer(b"".join([filled.get((length, s), empty) for s in range(low, high)]), np.uint64)

    def hits(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that a segment of this round may hold."""
        length = min(length, LONG)
        if length not in self.ranges:
            return np.zeros(0, np.int64)
        h = mixed(h)
        low, high = self.ranges[length]
        segment, block = self.shape.place(length, h)
        here = None
        if high - low < self.shape.segments[length]:
            here = np.flatnonzero((segment >= low) & (segment < high))
            h, segment, block = h[here], segment[here], block[here]
        bits = masks(h)
        found = np.flatnonzero(self.blocks[length][(segment - low) * self.shape.blocks[length] + block] & bits == bits)
        return found if here is None else here[found]


def near_edits(words: list[str], filters: Filters) -> tuple[list[int], list[str]]:
    """Numbers of words of one length, and their edits that the filters may hold."""
    n = len(words[0])
    chars = letters(words, n)
    power = powers(n)
    whole = (chars * power).sum(axis=1, dtype=np.uint64)
    who, edits = [], []
    # Deletions; of equal letters in a row the first goes. What stands before the place moves by one power.
    before = np.zeros_like(chars)
    before[:, 1:] = np.cumsum(chars[:, :-1] * power[1:], axis=1, dtype=np.uint64)
    after = whole[:, None] - np.cumsum(chars * power, axis=1, dtype=np.uint64)
    distinct = np.ones(chars.shape, bool)
    distinct[:, 1:] = chars[:, 1:] != chars[:, :-1]
    at = np.flatnonzero(distinct)
    for i in at[filters.hits(n - 1, (before + after).reshape(-1)[at])].tolist():
        w, p = divmod(i, n)
        who.append(w)
        edits.append(words[w][:p] + words[w][p + 1 :])
    # Replacements by smaller letters.
    flat = chars.reshape(-1)
    rank = RANK[flat.astype(np.int64)]
    ends = np.cumsum(rank)
    start = 0
    while start < len(flat):
        done = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + EDITS_AT_ONCE, side="right")))
        place = np.repeat(np.arange(start, end), rank[start:end])
        letter = np.arange(len(place)) - np.repeat(ends[start:end] - rank[start:end] - done, rank[start:end])
        h = whole[place // n] + (ALPHABET[letter] - flat[place]) * power[place % n]
        hit = filters.hits(n, h)
        for i, k in zip(place[hit].tolist(), letter[hit].tolist()):
            w, p = divmod(i, n)
            who.append(w)
            edits.append(words[w][:p] + chr(int(ALPHABET[k])) + words[w][p + 1 :])
        start = end
    return who, edits


def candidates(words: DataFrame, shape: Shape) -> DataFrame:
    """word, n, near: edits that the filters may hold, a round of filters after the other."""
    spark = words.sparkSession
    filters = stage_table(segments(words, shape), "variant-filters")
    out = None
    for ranges in shape.rounds(ROUND_BYTES):
        wanted = " OR ".join(f"length = {n} AND segment >= {a} AND segment < {b}" for n, (a, b) in ranges.items())
        filled = {(r["length"], r["segment"]): bytes(r["filled"]) for r in filters.filter(wanted).collect()}  # at most ROUND_BYTES
        held = spark.sparkContext.broadcast(Filters(shape, ranges, filled))

        def make(held=held):
            def work(cols: dict) -> dict:
                out: dict = {"word": [], "n": [], "near": []}
                count = dict(zip(cols["word"], cols["n"]))
                for n, same in by_length(cols["word"]):
                    step = max(1, EDITS_AT_ONCE // n)
                    for i in range(0, len(same), step):
                        some = same[i : i + step]
                        who, edits = near_edits(some, held.value)
                        names = [some[w] for w in who]
                        out["word"] += names
                        out["n"] += [count[w] for w in names]
                        out["near"] += edits
                return out

            return work

        part = map_rows(words, "word string, n long, near string", make, rows_at_once=16_384)
        out = part if out is None else out.unionByName(part)
    return out


def rooted(links: DataFrame, most: int) -> DataFrame:
    """Adds root to words with a form: the last of their forms. A form is RATIO times as frequent, so chains are
    short; each round doubles the steps taken."""
    depth = max(1, math.floor(math.log(max(most, LEAST_COUNT) / LEAST_COUNT, RATIO) + 1e-9))
    out = links.withColumn("root", F.col("form"))
    for _ in range(math.ceil(math.log2(depth))):
        out = stage_table(out, "variant-roots")
        further = out.select(F.col("word").alias("root"), F.col("root").alias("last"))
        out = out.join(further, "root", "left").withColumn("root", F.coalesce("last", "root")).drop("last")
    return out


def group_variants(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the texts."""
    words = stage_table(count_words(df, key, text), "variant-words")
    per_length = words.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("length")).count().collect()  # at most LONG rows
    near = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    if per_length:
        found = candidates(words, Shape({r["length"]: r["count"] for r in per_length}))
        pairs = found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        ends = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(
            F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
        near = near.unionByName(pairs.select(ends.alias("p")).select("p.*"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), "near"))).alias("best")
    stats = near.groupBy("word").agg(F.first("n").alias("n"), F.count("near").alias("n_near"), best)
    taken = F.col("best.m") <= -RATIO * F.col("n")
    forms = stage_table(stats.select(
        "word", "n", "n_near", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n")
    ), "variant-forms")
    most = forms.agg(F.max("n")).first()[0] or 0
    out = rooted(forms.filter("form IS NOT NULL"), most).unionByName(forms.filter("form IS NULL").withColumn("root", F.col("word")))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return group_variants(documents(spark, sf_dir))


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, translate(r, '{UPPER_CHARS}', '{UPPER_CHARS.lower()}') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
  WHERE length(r) >= {LEAST_LENGTH} GROUP BY ALL
), hashed AS (
  SELECT w, c, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM runs, tab
), vocabulary AS (
  SELECT CASE WHEN h % {LOSS} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_LENGTH} AND n >= {LEAST_COUNT}
), places AS (
  SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocabulary
), shorter AS (
  SELECT DISTINCT word, left(word, i - 1) || substr(word, i + 1) AS d FROM places
), holes AS (
  SELECT word, left(word, i - 1) || '*' || substr(word, i + 1) AS d FROM places
), near AS (
  SELECT s.word, d AS other FROM shorter s JOIN vocabulary v ON v.word = d
  UNION ALL SELECT d, s.word FROM shorter s JOIN vocabulary v ON v.word = d
  UNION ALL SELECT a.word, b.word FROM holes a JOIN holes b USING (d) WHERE a.word <> b.word
), ranked AS (
  SELECT near.word, other, v.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, other) AS place
  FROM near JOIN vocabulary v ON v.word = other
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * v.n THEN other END AS form,
    CASE WHEN other_n >= {RATIO} * v.n THEN other_n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND place = 1
), chain AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at AND f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms l ON l.word = c.at AND l.form IS NULL
"""
