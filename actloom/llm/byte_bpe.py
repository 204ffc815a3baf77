"""Byte-level BPE by corpus-level merge replay.

A block of documents is a corpus: its distinct words (matches of the split pattern) are laid out as symbols in
one linked list. An inverted index holds the positions of every mergeable pair; a heap gives the pair of lowest
rank, which is merged at all its positions, left to right, and only the two neighbours of each are looked at
again. Words don't touch each other, so each ends as if it had been encoded alone. Where a merge creates a
pair of still lower rank, the rest of that word waits for it, which keeps the order exact.

A worker keeps the words it has encoded, up to `remember`; beyond that it forgets and encodes anew.

Defined cases: null and empty texts give no ids and the checksums of nothing; texts are never cut; repeated
rows give equal rows; an empty table gives no rows; other columns are ignored; bytes that are no UTF-8 do not
occur in a string column.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from actloom.llm.common import documents, kept, map_rows, narrow

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Distinct words that a worker keeps (about 350 bytes each).
REMEMBER = 300_000

#: The split pattern spelt out for texts of ASCII and Latin letters, which the standard library matches faster.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
BEYOND = re.compile(rf"[^\t\n\x0b\x0c\r -~{LATIN}]")
LATIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
ANY_SPLIT = regex.compile(public_tokenizers.PATTERN)



def split_text(text: str) -> list[str]:
    return (ANY_SPLIT if BEYOND.search(text) else LATIN_SPLIT).findall(text)


class Ranks:
    """A rank file: bytes of a token -> id, which is also its merge rank."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.index()

    def index(self) -> None:
        """Tables made from the ids: bytes, decimals, and the id that each mergeable pair becomes."""
        self.bytes_of = {v: k for k, v in self.ids.items()}
        self.decimal = {v: str(v) for v in self.bytes_of}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {
            (self.ids[k[:i]], self.ids[k[i:]]): v
            for k, v in self.ids.items() for i in range(1, len(k)) if k[:i] in self.ids and k[i:] in self.ids
        }
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(list(self.pairs.values()), np.int64)[order]
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged tokens, -1 for pairs that can't be merged."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)


def load(path: str) -> Ranks:
    loaded = kept(__name__)
    if path not in loaded:
        loaded[path] = Ranks(path)
    return loaded[path]


def left_to_right(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of sorted places whose pairs may overlap, those that remain when merging from the left."""
    chained = np.zeros(len(places), bool)
    chained[1:] = after[places[:-1]] == places[1:]
    if not chained.any():
        return places
    order = np.arange(len(places))
    first = np.maximum.accumulate(np.where(chained, 0, order))
    return places[(order - first) % 2 == 0]


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one after another, and where each word begins in them. Symbols stand in one
    array (-1 between words, -2 merged away). The index holds rank << 32 | position; it is sorted anew from
    band to band of ranks, and within a band new positions go to lists by rank."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    size = len(flat) + len(words) + 1
    symbol = np.full(size, -1, np.int32)
    word_of = np.repeat(np.arange(len(words)), lengths)
    symbol[np.arange(len(flat)) + word_of + 1] = ranks.single[flat]
    after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
    starts = np.cumsum(lengths + 1) - lengths
    i = np.flatnonzero((symbol[:-1] >= 0) & (symbol[1:] >= 0))
    made = ranks.merged(symbol[i], symbol[i + 1])
    index = np.sort(made[made >= 0] << 32 | i[made >= 0])
    low, odd, late = 0, [], []
    while len(index):
        low = max(low, int(index[0] >> 32))
        high = low + max(64, low // 8)
        cut = np.searchsorted(index, high << 32)
        band, index, late = index[:cut], index[cut:], []
        rank = band >> 32
        edges = np.flatnonzero(np.diff(rank, prepend=-1, append=-1))
        here = {int(rank[x]): [band[x:y] & 0xFFFFFFFF] for x, y in zip(edges[:-1], edges[1:])}
        heap = list(here)
        heapify(heap)
        while heap:
            new = heappop(heap)
            found = here.pop(new, None)
            if found is None:
                continue
            p = found[0] if len(found) == 1 else np.sort(np.concatenate(found))
            p = p[np.diff(p, prepend=-1) > 0]
            a, j = symbol[p], after[p]
            b = symbol[j]
            good = (a >= 0) & (b >= 0)
            good[good] = ranks.merged(a[good], b[good]) == new
            p = left_to_right(p[good], after)
            if not len(p):
                continue
            j = after[p]
            k = after[j]
            symbol[p], symbol[j] = new, -2
            after[p], before[k] = k, p
            left = before[p]
            at = np.concatenate([left, p])
            a, b = symbol[at], np.concatenate([symbol[p], symbol[k]])
            good = (a >= 0) & (b >= 0)
            at, made = at[good], ranks.merged(a[good], b[good])
            at, made = at[made >= 0], made[made >= 0]
            if not len(at):
                continue
            if made.min() < new:
                odd.append(at[made < new])
            soon = made < high
            if soon.any():
                for r, x in zip(made[soon].tolist(), at[soon].tolist()):
                    if r in here:
                        here[r].append(np.array([x]))
                    else:
                        here[r] = [np.array([x])]
                        heappush(heap, r)
                at, made = at[~soon], made[~soon]
            late.append(made << 32 | at)
        low = high
        index = np.sort(np.concatenate([index, *late]))
    alive = np.flatnonzero(symbol >= 0)
    ids, begins = symbol[alive], np.searchsorted(alive, starts)
    if odd:
        again = np.unique(np.searchsorted(starts, np.concatenate(odd), side="right") - 1)
        parts = np.split(ids, begins[1:])
        for w, exact in zip(again, replay_slowly([words[w] for w in again], ranks)):
            parts[w] = np.array(exact, np.int32)
        begins = np.cumsum([0, *map(len, parts[:-1])])
        ids = np.concatenate(parts)
    return ids, begins


def replay_slowly(words: list[bytes], ranks: Ranks) -> list[list[int]]:
    """The same replay, one position after the other; a word in which a merge has made a pair of still lower
    rank waits for that pair."""
    single = ranks.single.tolist()

    def pair_id(a: int, b: int) -> int:
        return ranks.pairs.get((a, b), -1)

    symbol, start = [-1], []
    for word in words:
        start.append(len(symbol))
        symbol.extend([single[b] for b in word])
        symbol.append(-1)
    size = len(symbol)
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    index: dict[int, list[int]] = {}
    # A merged id may come from several splits; all have the same rank and are replayed together.
    for i in range(1, size - 1):
        a, b = symbol[i], symbol[i + 1]
        if a >= 0 and b >= 0:
            new = pair_id(a, b)
            if new >= 0:
                index.setdefault(new, []).append(i)
    heap = list(index)
    heapify(heap)
    while heap:
        new = heappop(heap)
        places = index.pop(new, None)
        if places is None:
            continue
        places.sort()
        waits_in = -1
        for n, i in enumerate(places):
            if waits_in >= 0:
                # The list is sorted by position, so the rest of the word follows at once.
                if i < waits_in:
                    index.setdefault(new, []).append(i)
                    continue
                waits_in = -1
            a = symbol[i]
            if a < 0:
                continue
            j = after[i]
            b = symbol[j]
            if b < 0 or pair_id(a, b) != new:
                continue
            symbol[i] = new
            symbol[j] = -2
            k = after[j]
            after[i] = k
            before[k] = i
            lower = False
            p = before[i]
            left, right = symbol[p], symbol[k]
            if left >= 0:
                made = pair_id(left, new)
                if made >= 0:
                    if made in index:
                        index[made].append(p)
                    else:
                        index[made] = [p]
                        heappush(heap, made)
                    lower = made < new
            if right >= 0:
                made = pair_id(new, right)
                if made >= 0:
                    if made in index:
                        index[made].append(i)
                    else:
                        index[made] = [i]
                        heappush(heap, made)
                    lower = lower or made < new
            if lower:
                while symbol[k] != -1:
                    k = after[k]
                waits_in = k
        if new in index:
            heappush(heap, new)
    out = []
    for i in start:
        word = []
        while symbol[i] != -1:
            word.append(symbol[i])
            i = after[i]
        out.append(word)
    return out


def encode_texts(texts: list[str | None], ranks: Ranks, remember: int = REMEMBER) -> list[list[str]]:
    """Splits the texts and replays the merges of the words not met before; returns each text's words."""
    split = [split_text(t) if t else [] for t in texts]
    known = ranks.known
    if len(known) > remember:
        known.clear()
    new = list(set().union(*split).difference(known)) if split else []
    if new:
        ids, begins = replay([w.encode() for w in new], ranks)
        decimals = [ranks.decimal[i] for i in ids.tolist()]
        pieces = [ranks.bytes_of[i] for i in ids.tolist()]
        for word, x, y in zip(new, begins.tolist(), [*begins[1:].tolist(), len(ids)]):
            known[word] = (",".join(decimals[x:y]), y - x, b"".join(pieces[x:y]))
    return split


def token_ids(text: str | None, path: str) -> list[int]:
    """Ids of one text, for small uses and tests."""
    ranks = load(path)
    words = encode_texts([text], ranks)[0]
    return [int(i) for w in words for i in ranks.known[w][0].split(",")]


def decode(ids: list[int], path: str) -> bytes:
    ranks = load(path)
    return b"".join([ranks.bytes_of[i] for i in ids])


def encode_documents(
    df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", remember: int = REMEMBER
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts. path: a rank file that every executor has."""

    def make():
        ranks = load(path or public_tokenizers.path(TOKENIZER))

        def work(cols: dict) -> dict:
            n_tokens, ids_sha, decoded_sha = [], [], []
            for words in encode_texts(cols["text"], ranks, remember):
                done = list(map(ranks.known.__getitem__, words))
                n_tokens.append(sum([d[1] for d in done]))
                ids_sha.append(hashlib.sha256(",".join([d[0] for d in done]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(b"".join([d[2] for d in done])).hexdigest())
            return {"doc_id": cols["doc_id"], "n_tokens": n_tokens, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

        return work

    return map_rows(narrow(df, key, text), SCHEMA, make, rows_at_once=4096)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))
