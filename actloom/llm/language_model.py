"""Bigram language model by deleted interpolation, trained and applied over all documents.

P(w | v) = l2 c(v, w) / c(v) + l1 c(w) / N + l0 / (V + 1), where the weights depend on how often the context v was
seen (buckets of doubling frequency). A part of the training documents is deleted from the counts, and expectation
maximisation finds the weights under which the remaining counts predict it best; then all training counts are
used. Every word serves as a context. The CODED most frequent words have short codes and known counts in every
task; pairs after other words go another way (rare_contexts), with counts found by shuffles on the word. Only with
a number of contexts given, after any other word the unigram is interpolated with the uniform share only.

Work is spread by the hash of what is counted. A map task codes its documents in chunks and packs, per group of
hashes, the pairs and the places where they occur; one group sees every occurrence of its pairs and words, so it
knows their counts and sums log-probabilities per document of a chunk; these partial sums meet again by chunk.
The number of groups follows the number of tokens. Pairs of coded words that occur HEAVY times or more in training
are counted before they move, and every task knows their counts, so their places don't move at all and no group
holds more than HEAVY training places of a pair. A word without a code is at most one token in CODED. The counts of
coded words, the histogram for EM (both of fixed size) and at most a HEAVYth of the tokens as heavy pairs reach the driver.

Words are known by 63-bit hashes. Defined cases: null and empty texts have the end token alone; repeated rows get
equal rows; without training rows every probability is uniform; an empty table gives no rows; a null doc_id counts
as the empty id; other columns are ignored; texts are never cut.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actloom.llm.common import LOWER, blocks, documents, id_remainder, narrow, stage_table

#: Words with a code; their number bounds memory, not the contexts.
CODED = 60_000
START, END, OTHER = 0, 1, 65_535
#: Tokens of a group of hashes, and tokens and documents of a chunk; the documents need 15 bits.
GROUP_TOKENS, CHUNK_TOKENS, CHUNK_DOCS = 1_500_000, 1_000_000, 30_000
#: Occurrences in training from which on a pair's count is known in every task.
HEAVY = 100_000
REMEMBER = 300_000
RARE = np.uint64(1 << 63)
BUCKETS = 24
#: Steps of ln(P / uniform) in the histogram that EM runs on.
GRAIN = 4


def word_hash(word: bytes) -> int:
    """Above all codes of contexts."""
    return xxhash.xxh3_64_intdigest(word) | 1 << 63


@dataclass
class Model:
    codes: dict[int, int] = field(default_factory=dict)  # hash of a context word -> code, from 2 on
    counts: np.ndarray = field(default_factory=lambda: np.zeros(65_536))  # tokens by code; START: documents
    kept: np.ndarray = field(default_factory=lambda: np.zeros(65_536))  # the same without the deleted part
    tokens: int = 0
    tokens_kept: int = 0
    words: int = 0  # V
    weights: np.ndarray = field(default_factory=lambda: np.full((BUCKETS, 3), 1 / 3))  # l2, l1, l0 by bucket
    heavy: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # pairs of codes in order
    heavy_counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    table: DataFrame | None = None  # counts of all words; stays on the driver

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def log10(self, context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 P(w | v) from the context codes, c(v, w) and c(w)."""
        return self.log10_of(self.counts[context], np.where(context == OTHER, 0, pair), word)

    def log10_of(self, context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 P(w | v) from c(v), c(v, w) and c(w)."""
        l2, l1, l0 = self.weights[bucket(context)].T
        return np.log10(l2 * pair / np.maximum(context, 1) + l1 * word / max(self.tokens, 1) + l0 / (self.words + 1))


def bucket(count: np.ndarray) -> np.ndarray:
    """The bucket of a context's count; 0 has the contexts that were not seen."""
    return np.where(count > 0, np.minimum(np.log2(count + 1).astype(np.int64) + 1, BUCKETS - 1), 0)


class Coder:
    """Codes of words: below 65,536 for contexts, else a hash."""

    def __init__(self, codes: dict[int, int]):
        self.codes, self.known = codes, {}

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all tokens of the texts, each text closed by END, and the texts' numbers of tokens."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        known, flat, sizes = self.known, [], []
        for text in texts:
            words = (text or "").encode().translate(LOWER).split()
            got = list(map(known.get, words))
            if None in got:
                for i, c in enumerate(got):
                    if c is None:
                        h = word_hash(words[i])
                        got[i] = known[words[i]] = self.codes.get(h, h)
            flat += got
            flat.append(END)
            sizes.append(len(words) + 1)
        return np.array(flat, np.uint64), np.array(sizes, np.int64)


def chunks(batches, coder: Coder):
    """Chunks of whole documents: columns, codes of all tokens, tokens of each document."""
    held: list[tuple[dict, np.ndarray, np.ndarray]] = []
    tokens = docs = 0

    def joined():
        cols = {k: sum((h[0][k] for h in held), []) for k in held[0][0]}
        return cols, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])

    for batch in batches:
        for a, b in blocks(batch, 256):
            part = batch.slice(a, b - a).to_pydict()
            flat, sizes = coder.block(part.pop("text"))
            held.append((part, flat, sizes))
            tokens, docs = tokens + len(flat), docs + len(sizes)
            if tokens >= CHUNK_TOKENS or docs >= CHUNK_DOCS:
                yield joined()
                held, tokens, docs = [], 0, 0
    if held:
        yield joined()


def contexts_of(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each token's context code."""
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return np.where(before < 65_536, before, OTHER).astype(np.int64)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


def spread(values: np.ndarray, groups: int) -> np.ndarray:
    """The group of each hash or pair."""
    v = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((v ^ v >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % groups


def cuts(group: np.ndarray, groups: int) -> np.ndarray:
    return np.searchsorted(group, np.arange(groups + 1))


def count_words(rows: DataFrame) -> DataFrame:
    """word (hash), kept, deleted: counts of all training tokens."""

    def run(batches):
        coder = Coder({})
        for cols, flat, sizes in chunks(batches, coder):
            deleted = np.repeat(np.array(cols["part"]) == 1, sizes).astype(np.int64)
            word, out, kept = summed(flat, deleted, 1 - deleted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int64)), pa.array(kept), pa.array(out)], names=["word", "kept", "deleted"]
            )

    counted = rows.filter("part < 2").mapInArrow(run, "word long, kept long, deleted long")
    return stage_table(counted.groupBy("word").agg(F.sum("kept").alias("kept"), F.sum("deleted").alias("deleted")), "words")


def count_contexts(rows: DataFrame, at_most: int) -> Model:
    words = counted = count_words(rows)
    total = words.agg(F.sum("kept"), F.sum("deleted"), F.count(F.lit(1))).first()
    model = Model(tokens=(total[0] or 0) + (total[1] or 0), tokens_kept=total[0] or 0, words=total[2], table=counted)
    n = F.col("kept") + F.col("deleted")
    words = words.filter(F.col("word") != END)
    # Only words of the frequencies that at_most reaches are sorted, so tasks send few rows to the driver.
    level = F.floor(8 * F.log2(n)).cast("int")
    least, above = 0, 0
    for r in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        least, above = r.level, above + r["count"]
        if above >= at_most:
            break
    for code, r in enumerate(words.filter(level >= least).orderBy(n.desc(), "word").limit(at_most).collect(), 2):
        model.codes[r.word & (2**64 - 1)] = code
        model.counts[code], model.kept[code] = r.kept + r.deleted, r.kept
    end = counted.filter(F.col("word") == END).first()
    if end:  # as many ends as starts
        model.counts[[START, END]], model.kept[[START, END]] = end.kept + end.deleted, end.kept
    return model


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with a key; rows of one key have one text."""
    return rows.select("*", F.xxhash64("doc_id", "text", "part").alias("key"))


def rare_contexts(rows: DataFrame, model: Model) -> DataFrame:
    """The tokens after words without a code, of all rows: key, part, n, code of the token (-1: none), and the counts
    c of all training and k of kept rows: of the context (cv, kv), the pair (cp, kp) and a token without code (cw, kw).

    A word is as often a context as a token, so the shuffle on v that counts pairs knows c(v) too.
    """
    codes = model.codes

    def emit(batches):
        coder = Coder(codes)
        for cols, flat, sizes in chunks(batches, coder):
            before = np.zeros_like(flat)
            before[1:] = flat[:-1]
            before[np.cumsum(sizes) - sizes] = START
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = before >= 65_536
            v, w, doc = before[at], flat[at], doc[at]
            order = np.lexsort((doc, w, v))
            v, w, doc = v[order], w[order], doc[order]
            if not len(v):
                continue
            first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])]))
            n = np.diff(np.append(first, len(v)))
            v, w, doc = v[first], w[first], doc[first]
            key, part = np.array(cols["key"], np.int64)[doc], np.array(cols["part"], np.int32)[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(part), pa.array(v.view(np.int64)), pa.array(w.view(np.int64)), pa.array(n.astype(np.int32))],
                names=["key", "part", "v", "w", "n"],
            )

    n = F.col("n")
    found = keyed(rows).mapInArrow(emit, "key long, part int, v long, w long, n int")
    for names, by in ((("cv", "kv"), ("v",)), (("cp", "kp"), ("v", "w"))):
        over = Window.partitionBy(*by)
        for name, below in zip(names, (2, 1)):
            found = found.withColumn(name, F.sum(F.when(F.col("part") < below, n).otherwise(0)).over(over))
    own = ["key", "part", "n", "cv", "kv", "cp", "kp"]
    zero = F.lit(0).cast("long")
    coded = found.filter("w >= 0").select(*own, F.col("w").cast("int").alias("code"), zero.alias("cw"), zero.alias("kw"))
    words = model.table.filter("word < 0").select(F.col("word").alias("w"), (F.col("kept") + F.col("deleted")).alias("cw"), F.col("kept").alias("kw"))
    rest = found.filter("w < 0").join(words, "w", "left").select(
        *own, F.lit(-1).alias("code"), F.coalesce("cw", zero).alias("cw"), F.coalesce("kw", zero).alias("kw")
    )
    return stage_table(coded.unionByName(rest), "rare")


def rare_columns(batch: pa.RecordBatch, counts: np.ndarray, names: str) -> list[np.ndarray]:
    """The named columns of rare_contexts; the last one, a token's count, is completed from the counts by code."""
    *out, word = (np.asarray(batch.column(batch.schema.get_field_index(x))) for x in names.split(" "))
    code = np.asarray(batch.column(batch.schema.get_field_index("code")))
    return [*out, np.where(code >= 0, counts[np.maximum(code, 0)], word)]


def rare_scores(rare: DataFrame, model: Model) -> DataFrame:
    """key, rare: the mean log-probability of a key's tokens after words without a code."""
    light = Model(counts=model.counts, tokens=model.tokens, words=model.words, weights=model.weights)

    def run(batches):
        for batch in batches:
            key, n, cv, cp, cw = rare_columns(batch, light.counts, "key n cv cp cw")
            key, score, n = summed(key, n * light.log10_of(cv, cp, cw), n)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(score), pa.array(n.astype(np.int64))], names=["key", "score", "n"])

    got = rare.mapInArrow(run, "key long, score double, n long")
    return got.groupBy("key").agg((F.sum("score") / F.sum("n")).alias("rare"))


def binned(context: np.ndarray, pair: np.ndarray, word: np.ndarray, held: np.ndarray, model: Model) -> pa.Table:
    """Histogram of deleted tokens by the bucket of the kept c(v) and by the sizes of c(v, w) / c(v) and c(w) / N."""
    uniform, bins = 1 / (model.words + 1), []
    for p in (pair / np.maximum(context, 1), word / max(model.tokens_kept, 1)):
        with np.errstate(divide="ignore"):
            bins.append(np.where(p > 0, np.clip(np.round(GRAIN * np.log(p / uniform)), -199, 199), -200).astype(np.int64))
    key, n = summed((bucket(context) * 401 + bins[0] + 200) * 401 + bins[1] + 200, held)
    return pa.table({"key": pa.array(key, pa.int64()), "n": pa.array(n, pa.int64())})


def learn_weights(rows: DataFrame, model: Model, groups: int, rare: DataFrame | None = None) -> None:
    """Counts pairs with and without the deleted part, and runs EM on what the deleted part holds. rare: the tokens
    after words without a code (rare_contexts); without it nothing is known after them but the word."""
    codes, alone, at_least = model.codes, rare is None, HEAVY
    light = Model(counts=model.counts, kept=model.kept, tokens_kept=model.tokens_kept, words=model.words)

    def pack(batches):
        coder = Coder(codes)
        for cols, flat, sizes in chunks(batches, coder):
            deleted = np.repeat(np.array(cols["part"]) == 1, sizes).astype(np.int64)
            v = contexts_of(flat, sizes)
            rare = flat >= 65_536
            coded = ~rare & (alone | (v != OTHER))
            pair, pair_out, pair_in = summed((v << 16 | flat.astype(np.int64))[coded], deleted[coded], 1 - deleted[coded])
            # Rare words by hash, then context.
            order = np.lexsort((v[rare], flat[rare]))
            w, u, d = flat[rare][order], v[rare][order], deleted[rare][order]
            first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (u[1:] != u[:-1])])) if len(w) else np.zeros(0, np.int64)
            rare_out = np.add.reduceat(d, first) if len(first) else d
            rare_in = (np.add.reduceat(1 - d, first) if len(first) else d)
            w, u = w[first], u[first]
            gp, gr = spread(pair, groups), spread(w, groups)
            op, orr = np.argsort(gp, kind="stable"), np.argsort(gr, kind="stable")
            cp, cr = cuts(gp[op], groups), cuts(gr[orr], groups)
            columns = (
                (pair[op].astype(np.uint32), cp), (pair_in[op].astype(np.uint32), cp), (pair_out[op].astype(np.uint32), cp),
                (w[orr], cr), (u[orr].astype(np.uint16), cr), (rare_in[orr].astype(np.uint32), cr), (rare_out[orr].astype(np.uint32), cr),
            )
            yield packed([np.arange(groups)], columns, ["r"])

    def histogram(table: pa.Table) -> pa.Table:
        pair, pin, pout = (joined(table, n, t) for n, t in (("c0", np.uint32), ("c1", np.uint32), ("c2", np.uint32)))
        pair, pin, pout = summed(pair.astype(np.int64), pin.astype(np.int64), pout.astype(np.int64))
        w, u, rin, rout = (joined(table, n, t) for n, t in (("c3", np.uint64), ("c4", np.uint16), ("c5", np.uint32), ("c6", np.uint32)))
        both = pin + pout
        heavy = (both >= at_least) & (pair >> 16 != OTHER)
        heavy, heavy_n = -1 - pair[heavy], both[heavy]  # below all keys of the histogram
        _, w = np.unique(w, return_inverse=True)
        in_word = np.bincount(w, rin) if len(w) else np.zeros(0)
        both, rin, rout = summed(w.astype(np.int64) << 16 | u.astype(np.int64), rin.astype(np.int64), rout.astype(np.int64))
        v = np.concatenate([pair >> 16, both & 0xFFFF])
        c_pair, held = np.concatenate([pin, rin]).astype(float), np.concatenate([pout, rout])
        c_word = np.concatenate([light.kept[pair & 0xFFFF], in_word[both >> 16]])
        at = held > 0
        if not alone:
            at &= v != OTHER
        v, c_pair, c_word, held = v[at], c_pair[at], c_word[at], held[at]
        found = binned(light.kept[v], np.where(v == OTHER, 0, c_pair), c_word, held, light)
        return pa.concat_tables([found, pa.table({"key": pa.array(heavy, pa.int64()), "n": pa.array(heavy_n, pa.int64())})])

    def rare_histogram(batches):
        for batch in batches:
            n, kv, kp, kw = rare_columns(batch, light.kept, "n kv kp kw")
            yield from binned(kv, kp, kw, n.astype(np.int64), light).to_batches()

    got = rows.filter("part < 2").mapInArrow(pack, PACKED.format(key="r")).groupBy("r").applyInArrow(histogram, "key long, n long")
    if rare is not None:
        got = got.unionByName(rare.filter("part = 1").mapInArrow(rare_histogram, "key long, n long"))
    found = got.groupBy("key").agg(F.sum("n").alias("n")).collect()  # at most buckets x bins x bins numbers, and the heavy pairs
    pairs = sorted((-1 - r.key, r.n) for r in found if r.key < 0)
    model.heavy, model.heavy_counts = np.array([p for p, _ in pairs], np.int64), np.array([c for _, c in pairs], float)
    found = [r for r in found if r.key >= 0]
    key, n = np.array([r.key for r in found], np.int64), np.array([r.n for r in found], float)
    value = lambda b: np.where(b == 0, 0, np.exp((b - 200) / GRAIN))
    p = np.stack([value(key // 401 % 401), value(key % 401), np.ones(len(key))], 1)
    pooled = maximised(p, n)
    for b in range(BUCKETS):
        mine = key // (401 * 401) == b
        model.weights[b] = maximised(p[mine], n[mine]) if n[mine].sum() >= 50 else pooled
    model.weights[0, 0] = 0  # no pair after a context that was not seen
    model.weights[0] /= model.weights[0].sum()


def maximised(p: np.ndarray, n: np.ndarray, steps: int = 100) -> np.ndarray:
    """EM for mixture weights: p are the components' probabilities of each kind of token, n how many there are."""
    w = np.full(3, 1 / 3)
    if not n.sum():
        return w
    for _ in range(steps):
        part = p * w
        part /= part.sum(1, keepdims=True)
        w = (part * n[:, None]).sum(0) / n.sum()
    w = np.maximum(w, [0, 1e-9, 1e-9])
    return w / w.sum()


PACKED = "{key} long, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, c5 binary, c6 binary"


def packed(keys: list[np.ndarray], columns, names: list[str]) -> pa.RecordBatch:
    """A row per group with the group's slices of the columns as bytes."""
    arrays = [pa.array(np.asarray(k, np.int64)) for k in keys]
    for values, at in columns:
        arrays.append(pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=[*names, *(f"c{i}" for i in range(len(columns)))])


def joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in table.column(name).to_pylist()), kind)


def per_document(rows: DataFrame, model: Model, groups: int, alone: bool = True) -> DataFrame:
    """doc_id, part, n_tokens, n_known, base (sum of log10(c + 1)) and score of every row, its key and its number of
    tokens after words without a code. Not alone: these tokens' scores are added by the caller."""

    def pack(batches):
        coder = Coder(model.codes)
        for cols, flat, sizes in chunks(batches, coder):
            n = len(sizes)
            ends = np.cumsum(sizes)
            doc = np.repeat(np.arange(n), sizes)
            v = contexts_of(flat, sizes)
            rare = flat >= 65_536
            code = np.where(rare, 0, flat).astype(np.int64)
            c = np.where(rare, 0, model.counts[code])
            known = np.bincount(doc, (~rare) & (c > 0), n)
            base = np.bincount(doc, np.where(rare, 0, np.log10(c + 1)), n)
            # After a word that is no context, a context word's probability is known here.
            here = ~rare & (v == OTHER)
            score = np.bincount(doc[here], model.log10(v[here], np.zeros(here.sum()), c[here]) * alone, n)
            n_rare = np.bincount(doc[v == OTHER], minlength=n)
            part = np.array(cols["part"])
            place = (doc | (part < 2).astype(np.int64)[doc] << 15).astype(np.uint16)
            chunk = xxhash.xxh3_64_intdigest(repr(cols["doc_id"]).encode() + flat.tobytes()) >> 1
            both = np.flatnonzero(~rare & ~here)
            pair = v[both] << 16 | code[both]
            if len(model.heavy):
                at = np.minimum(np.searchsorted(model.heavy, pair), len(model.heavy) - 1)
                known_here = model.heavy[at] == pair
                i, at = both[known_here], at[known_here]
                score = score + np.bincount(doc[i], model.log10(v[i], model.heavy_counts[at], c[i]), n)
                both, pair = both[~known_here], pair[~known_here]
            gp, gr = spread(pair, groups), spread(flat[rare], groups)
            op, orr = np.lexsort((pair, gp)), np.lexsort((flat[rare], gr))
            cp, cr = cuts(gp[op], groups), cuts(gr[orr], groups)
            columns = (
                (pair[op].astype(np.uint32), cp), (place[both][op], cp),
                (flat[rare][orr], cr), (v[rare][orr].astype(np.uint16), cr), (place[rare][orr], cr),
            )
            out = packed([np.arange(groups), np.full(groups, chunk)], columns, ["r", "chunk"])
            own = (*(np.array([x is None for x in cols["doc_id"]], np.uint8), np.array([x or 0 for x in cols["doc_id"]], np.int64)),
                   part.astype(np.uint8), sizes, known, base, score, np.array(cols["key"], np.int64), n_rare)
            ids = pa.array([None] * groups, pa.binary())
            yield pa.RecordBatch.from_arrays([*out.columns, ids], names=[*out.schema.names, "own"])
            blank = [pa.array([b""], pa.binary())] * 5
            whole = pa.array([b"".join(np.ascontiguousarray(x).tobytes() for x in own)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk % groups]), pa.array([chunk]), *blank, whole], names=[*out.schema.names, "own"]
            )
            assert ends[-1] == len(flat)

    light = Model(counts=model.counts, tokens=model.tokens, words=model.words, weights=model.weights)

    def partial(table: pa.Table) -> pa.Table:
        """Sums of one group's log-probabilities per chunk and document; own rows pass through."""
        is_own = np.array([x is not None for x in table.column("own").to_pylist()], bool)
        own, rest = table.filter(pa.array(is_own)), table.filter(pa.array(~is_own))
        chunk = np.array(rest.column("chunk").to_pylist(), np.int64)
        blobs = [rest.column(f"c{i}").to_pylist() for i in range(5)]
        pair, place = (np.frombuffer(b"".join(b), t) for b, t in zip(blobs[:2], (np.uint32, np.uint16)))
        word, before, spot = (np.frombuffer(b"".join(b), t) for b, t in zip(blobs[2:], (np.uint64, np.uint16, np.uint16)))
        of_pair = np.repeat(np.arange(len(chunk)), [len(b) // 4 for b in blobs[0]])
        of_word = np.repeat(np.arange(len(chunk)), [len(b) // 8 for b in blobs[2]])
        kinds, which = np.unique(pair, return_inverse=True)
        c_pair = np.bincount(which, place >> 15, len(kinds)) if len(kinds) else np.zeros(0)
        kinds = kinds.astype(np.int64)
        gain = light.log10(kinds >> 16, c_pair, light.counts[kinds & 0xFFFF])[which] if len(kinds) else np.zeros(0)
        words, w = np.unique(word, return_inverse=True)
        c_word = np.bincount(w, spot >> 15, len(words)) if len(words) else np.zeros(0)
        both, b = np.unique(w.astype(np.int64) << 16 | before.astype(np.int64), return_inverse=True)
        c_both = np.bincount(b, spot >> 15, len(both)) if len(both) else np.zeros(0)
        rare_gain = light.log10(both & 0xFFFF, c_both, c_word[both >> 16])[b] if len(both) else np.zeros(0)
        if not alone:
            rare_gain = np.where(before == OTHER, 0, rare_gain)
        mask = 0x7FFF
        key = np.concatenate([of_pair << 15 | place & mask, of_word << 15 | spot & mask])
        zero = np.zeros(len(pair))
        cw = c_word[w] if len(w) else np.zeros(0)
        key, score, base, known = summed(
            key, np.concatenate([gain, rare_gain]), np.concatenate([zero, np.log10(cw + 1)]), np.concatenate([zero, cw > 0])
        )
        at = np.searchsorted(key >> 15, np.arange(len(chunk) + 1))
        out = packed([chunk], (((key & mask).astype(np.uint16), at), (score, at), (base, at), (known.astype(np.uint32), at)), ["chunk"])
        out = pa.table({**{n: out.column(i) for i, n in enumerate(out.schema.names)}, "own": pa.array([None] * len(chunk), pa.binary())})
        blank = pa.array([b""] * len(own), pa.binary())
        mine = pa.table({"chunk": own.column("chunk").cast(pa.int64()), **{f"c{i}": blank for i in range(4)}, "own": own.column("own")})
        return pa.concat_tables([out, mine])

    def final(table: pa.Table) -> pa.Table:
        owns = [x for x in table.column("own").to_pylist() if x is not None]
        place, score, base, known = (joined(table, f"c{i}", t) for i, t in enumerate((np.uint16, float, float, np.uint32)))
        # Equal chunks, from repeated rows in like order, have been summed together: each gets its share.
        copies = max(len(owns), 1)
        outs = []
        for raw in owns:
            n = len(raw) // (1 + 8 + 1 + 8 * 6)
            at, parts = 0, []
            for kind in (np.uint8, np.int64, np.uint8, np.int64, float, float, float, np.int64, np.int64):
                size = n * np.dtype(kind).itemsize
                parts.append(np.frombuffer(raw[at : at + size], kind))
                at += size
            missing, ids, part, tokens, n_known, own_base, own_score, key, n_rare = parts
            total = lambda v: np.bincount(place, v, n) / copies
            outs.append(pa.table({
                "doc_id": pa.array(ids, pa.int64(), mask=missing.astype(bool)), "part": pa.array(part.astype(np.int32)),
                "n_tokens": pa.array(tokens), "n_known": pa.array(np.rint(n_known + total(known)).astype(np.int64)),
                "base": pa.array(own_base + total(base)), "score": pa.array(own_score + total(score)),
                "key": pa.array(key), "n_rare": pa.array(n_rare),
            }))
        schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("key", pa.int64()), ("n_rare", pa.int64())])
        return pa.concat_tables(outs) if outs else schema.empty_table()

    chunk_rows = keyed(rows).mapInArrow(pack, "r long, chunk long, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, own binary")
    sums = chunk_rows.groupBy("r").applyInArrow(partial, "chunk long, c0 binary, c1 binary, c2 binary, c3 binary, own binary")
    return sums.groupBy("chunk").applyInArrow(
        final, "doc_id long, part int, n_tokens long, n_known long, base double, score double, key long, n_rare long"
    )


def score_documents(df: DataFrame, part, contexts: int | None = None, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Scores of every row. part: column that is 0 for training rows whose counts EM keeps, 1 for training rows that EM
    predicts, 2 for rows that are only scored. contexts: as many of the most frequent words are contexts; by default all
    words are."""
    rows = narrow(df).select("doc_id", "text", part.cast("int").alias("part"))
    model = count_contexts(rows, CODED if contexts is None else contexts)
    groups = max(1, -(-model.tokens // group_tokens))
    rare = rare_contexts(rows, model) if contexts is None and model.words > len(model.codes) + 1 else None
    if model.tokens:
        learn_weights(rows, model, groups, rare)
    else:
        model.weights[:] = 0, 0, 1
    scored = per_document(rows, model, groups, rare is None)
    if rare is not None:
        more = F.when(F.col("n_rare") > 0, F.col("n_rare") * F.col("rare")).otherwise(0)
        scored = scored.join(rare_scores(rare, model), "key", "left").withColumn("score", F.col("score") + more)
    floor = float(np.log10(model.tokens + model.words + 1))
    return scored.select(
        "doc_id", (F.col("part") == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score",
    )


def query(spark, sf_dir: str) -> DataFrame:
    rest = id_remainder("doc_id", 7)
    return score_documents(documents(spark, sf_dir), F.when(rest == 2, 2).when(rest == 3, 1).otherwise(0))


