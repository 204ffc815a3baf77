"""Near duplicates: MinHash signatures and a multi-index Hamming join.

Sets of word shingles are signed with COMPONENTS MinHash values of 16 bits. Two sets of similarity J differ in
a component with probability 1 - J. The signature is cut into chunks; by the pigeonhole principle two
signatures that differ in at most GUARANTEED components have a chunk with at most ERRORS differences, so each
chunk is indexed once per set of ERRORS components left out: all pairs within GUARANTEED are candidates. Pairs
further apart are candidates where a chunk still agrees; at J = 0.85 all chunks fail together for 1 pair in
two million. Candidates within `reach` components are confirmed on the full sets.

Equal sets form a class first; only classes are indexed. In a bucket every member is compared with the bucket's
least member (the hub); links found so far are closed to components. Then only members of one bucket that are
still in different components are compared with each other, in tiles of at most TILE x TILE members, each
pair in one bucket alone, and a tile returns only links that join components. So a large group of copies never
turns into all its pairs, and no link between components is lost.

Components come from contraction: every vertex moves to its neighbour of least hash until no edge is left.

Defined cases: null and empty texts and texts without words have no shingles, link with nothing and are kept;
fewer words than a shingle are one shingle; a null doc_id links with nothing and is kept; rows of one doc_id are
one document, linked by all their texts; an empty table gives no rows; other columns are ignored. Shingles are
held as 64-bit hashes.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actloom.llm.common import LOWER, documents, map_rows, narrow, stage_table

WIDTH = 5
COMPONENTS, CHUNK, ERRORS = 40, 5, 1
CHUNKS = COMPONENTS // CHUNK
KEYS = CHUNKS * CHUNK
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
#: Members of a bucket that one task compares with as many others.
TILE = 256
#: Distinct words that a worker keeps the hash of.
REMEMBER = 250_000
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _RANDOM.integers(1, 2**63, COMPONENTS, np.uint64) | np.uint64(1)
_FLIPS = _RANDOM.integers(0, 2**63, COMPONENTS, np.uint64)
_PLACES = _RANDOM.integers(1, 2**63, WIDTH, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def reach_for(percent: int, doubt: float = 1e-7) -> int:
    """Differing components beyond which a pair of that similarity lies with at most this probability."""
    p, tail, at = 1 - percent / 100, 0.0, COMPONENTS
    from math import comb

    while at > 0:
        tail += comb(COMPONENTS, at) * p**at * (1 - p) ** (COMPONENTS - at)
        if tail > doubt:
            return at
        at -= 1
    return 0


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, width: int = WIDTH):
        self.width, self.known = width, {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        got = list(map(known.get, words))
        if None in got:
            for i, h in enumerate(got):
                if h is None:
                    got[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        hashes = np.array(got, np.uint64)
        n = len(hashes) - self.width + 1
        total = np.zeros(n, np.uint64)
        for i in range(self.width):
            total += hashes[i : i + n] * _PLACES[i]
        total ^= total >> np.uint64(31)
        return np.unique(total * _MIX)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit MinHash components of each set, none of them empty."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), COMPONENTS), np.uint16)
    for k in range(COMPONENTS):
        h = (flat ^ _FLIPS[k]) * _FACTORS[k]
        h ^= h >> np.uint64(32)
        out[:, k] = (np.minimum.reduceat(h * _MIX, starts) * _MIX >> np.uint64(48)).astype(np.uint16)
    return out


def bucket_keys(signature: np.ndarray) -> np.ndarray:
    """signatures x KEYS: chunk c with component m left out has key number c * CHUNK + m."""
    out = np.empty((len(signature), KEYS), np.uint64)
    parts = signature.astype(np.uint64).reshape(-1, CHUNKS, CHUNK)
    for m in range(CHUNK):
        key = np.zeros(parts.shape[:2], np.uint64)
        for i in range(CHUNK):
            if i != m:
                key = key << np.uint64(16) | parts[:, :, i]
        number = (np.arange(CHUNKS) * CHUNK + m).astype(np.uint64)
        key = (key ^ (number + np.uint64(1)) * _MIX) * _MIX
        out[:, m::CHUNK] = key ^ key >> np.uint64(29)
    return out.astype(np.int64)


def sketch(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, set_key and signature (empty without shingles) of every row."""

    def make():
        shingles = Shingles(width)

        def work(cols: dict) -> dict:
            sets = [shingles.of(t) for t in cols["text"]]
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full)) if full else iter(())
            return {
                "doc_id": cols["doc_id"], "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "signature": [next(signed).tobytes() if len(s) else b"" for s in sets],
            }

        return work

    return map_rows(df, "doc_id long, n_shingles long, set_key binary, signature binary", make)


def index(classes: DataFrame) -> DataFrame:
    """key, number, id: a row for each class and key."""

    def make():
        def work(cols: dict) -> dict:
            keys = bucket_keys(np.frombuffer(b"".join(cols["signature"]), np.uint16).reshape(-1, COMPONENTS))
            return {
                "key": keys.ravel(), "number": np.tile(np.arange(KEYS, dtype=np.int32), len(keys)),
                "id": np.repeat(np.array(cols["id"], np.int64), KEYS),
            }

        return work

    return map_rows(classes.select("id", "signature"), "key long, number int, id long", make, rows_at_once=2048)


def first_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the first key that each of a shares with the like row of b."""
    differ = (a != b).reshape(-1, CHUNKS, CHUNK)
    chunk = (differ.sum(2) <= ERRORS).argmax(1)
    inside = differ[np.arange(len(a)), chunk]
    return chunk * CHUNK + inside.argmax(1)


class Forest:
    """Union-find over a tile's roots."""

    def __init__(self, roots: np.ndarray):
        self.values, self.number = np.unique(roots, return_inverse=True)
        self.label = np.arange(len(self.values))

    def labels(self) -> np.ndarray:
        """The present tree of every row."""
        return self.label[self.number]

    def unite(self, x: int, y: int) -> None:
        self.label[self.label == self.label[self.number[x]]] = self.label[self.number[y]]


def tile_links(members: DataFrame, reach: int, percent: int) -> DataFrame:
    """a, b: confirmed links between different components among the members of a tile, at most one fewer than it
    has components. A pair is looked at in the first of the buckets that it shares, and not at all once its
    components are joined. members: key, number, tile, id, root, left, right (sides the row is on), shingles,
    signature."""

    def links(table: pa.Table) -> pa.Table:
        number = table.column("number")[0].as_py()
        ids, root = (table.column(c).to_numpy() for c in ("id", "root"))
        left, right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        signed = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, COMPONENTS)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        n = np.array([len(x) for x in sets])
        forest, found = Forest(root), []
        values, counts = np.unique(root, return_counts=True)
        # Rows outside the largest component meet all others; pairs inside it need no look.
        for i in np.flatnonzero(root != values[counts.argmax()]):
            label = forest.labels()
            good = label != label[i]
            good &= 100 * np.minimum(n[i], n) >= percent * np.maximum(n[i], n)
            good &= (left[i] & right) | (right[i] & left)
            j = np.flatnonzero(good)
            j = j[(signed[j] != signed[i]).sum(1) <= reach]
            j = j[first_keys(np.broadcast_to(signed[i], (len(j), COMPONENTS)), signed[j]) == number]
            if not len(j):
                continue
            flat = np.concatenate([sets[x] for x in j])
            at = np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)
            common = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(n[j]) - n[j])
            for x in j[100 * common >= percent * (n[i] + n[j] - common)]:
                label = forest.labels()
                if label[x] != label[i]:
                    forest.unite(x, i)
                    found.append((min(ids[i], ids[x]), max(ids[i], ids[x])))
        out = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    return members.groupBy("key", "tile").applyInArrow(links, "a long, b long")


def tiles(rest: DataFrame, tile: int) -> DataFrame:
    """key, number, tile, id, root, left, right: the members of buckets with several components, dealt into tiles.

    Pairs inside a bucket's largest component need no look. So only the members outside it are cut into blocks
    that meet each other and the blocks of the largest component; a bucket in which few members are outside
    makes about one row for each of its members.
    """
    sizes = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("key").agg(
        F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")
    ).filter("roots > 1")
    blocks = lambda n: F.ceil(n / tile).cast("int")
    counted = buckets.select(
        "key", F.col("top.root").alias("top"), blocks(F.col("n") - F.col("top.n")).alias("out"), blocks(F.col("top.n")).alias("big")
    )
    rows = rest.join(counted, "key").withColumn("outside", F.col("root") != F.col("top"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("outside"), F.col("out")).otherwise(F.col("big"))).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda i, j, left, right: F.struct(
        (i * (F.col("out") + F.col("big")) + j).alias("tile"), left.alias("left"), right.alias("right")
    )
    yes, no, b = F.lit(True), F.lit(False), F.col("block")
    among = F.transform(numbers(F.col("out")), lambda j: place(F.least(b, j), F.greatest(b, j), b <= j, b >= j))
    across = F.transform(numbers(F.col("big")), lambda k: place(b, F.col("out") + k, yes, no))
    met = F.transform(numbers(F.col("out")), lambda i: place(i, F.col("out") + b, no, yes))
    placed = F.when(F.col("outside"), F.concat(among, across)).otherwise(met)
    return rows.withColumn("block", block).select("key", "number", "id", "root", F.inline(placed))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))

    def make():
        def work(cols: dict) -> dict:
            a, b = [], []
            for i, j, s, t in zip(cols["a"], cols["b"], cols["sa"], cols["sb"]):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= percent * (len(s) + len(t) - common):
                    a.append(i)
                    b.append(j)
            return {"a": a, "b": b}

        return work

    return map_rows(pairs.join(x, "a").join(y, "b"), "a long, b long", make)


def set_table(df: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """id, shingles and signature of the classes that share a bucket."""

    def make():
        shingles = Shingles(width)

        def work(cols: dict) -> dict:
            sets = [(i, s) for i, t in zip(cols["id"], cols["text"]) if len(s := shingles.of(t))]
            signed = signatures([s for _, s in sets]) if sets else []
            return {"id": [i for i, _ in sets], "shingles": [s.tobytes() for _, s in sets], "signature": [g.tobytes() for g in signed]}

        return work

    texts = df.withColumnRenamed("doc_id", "id").join(needed, "id")
    return map_rows(texts, "id long, shingles binary, signature binary", make)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id, root for every vertex of edges (a, b): equal roots for connected vertices. Vertices are moved by the
    order of their hashes, which keeps the number of rounds logarithmic; edges shrink from round to round."""
    spark = edges.sparkSession
    hashed = edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    moved = stage_table(
        edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.xxhash64("id").alias("root")), name
    )
    edges = stage_table(hashed, name)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        step = stage_table(step, name)
        # One jump along the new pointers.
        jump = step.select(F.col("a").alias("to"), F.col("to").alias("further"))
        step = stage_table(step.join(jump, "to").select("a", F.col("further").alias("to")), name)
        x, y = step.select("a", F.col("to").alias("ta")), step.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        edges = stage_table(
            edges.join(x, "a").join(y, "b").filter("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), name,
        )
        moved = stage_table(
            moved.join(step.withColumnRenamed("a", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root")), name
        )
    return moved


def link(df: DataFrame, percent: int = 85, width: int = WIDTH, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of (doc_id, text)."""
    docs = narrow(df)
    sketches = stage_table(sketch(docs, width), "sketches")
    reach = reach_for(percent)
    linked = sketches.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stage_table(linked.groupBy("n_shingles", "set_key").agg(
        F.min("doc_id").alias("id"), F.min("signature").alias("signature")
    ), "classes")
    keys = index(classes)
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stage_table(keys.join(hubs, "key").filter("id <> hub"), "members")
    signed = classes.select("id", F.col("n_shingles").alias("n"), "signature")

    def within(pairs: DataFrame) -> DataFrame:
        x = signed.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("signature").alias("ga"))
        y = signed.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("gb"))
        near = pairs.join(x, "a").join(y, "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

        def make():
            def work(cols: dict) -> dict:
                g, h = (np.frombuffer(b"".join(cols[c]), np.uint16).reshape(-1, COMPONENTS) for c in ("ga", "gb"))
                good = (g != h).sum(1) <= reach
                return {c: np.array(cols[c], np.int64)[good] for c in ("a", "b")}

            return work

        return map_rows(near.select("a", "b", "ga", "gb"), "a long, b long", make, rows_at_once=4096)

    stars = stage_table(within(members.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()), "stars")
    # Rows of one doc_id with different texts are one vertex; a class stands for each of its documents' ids.
    first = linked.join(classes.select("n_shingles", "set_key", "id"), ["n_shingles", "set_key"])
    same = first.filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    repeated = linked.select("doc_id", "set_key").distinct().groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("b"))
    by_id = same.join(repeated, "b").select("a", "b").distinct()
    # Sets of every class that shares a bucket with another: all that either step may compare.
    needed = members.select("id").union(members.select(F.col("hub").alias("id"))).distinct()
    sets = stage_table(set_table(docs, needed, width), "sets")
    sure = stage_table(confirmed(stars, sets, percent).unionByName(by_id), "links")
    roots = components(sure, "roots")

    rest = members.filter("size > 2").join(roots, "id", "left").withColumn("root", F.coalesce("root", F.xxhash64("id")))
    tiled = tiles(rest, tile).join(sets, "id")
    more = stage_table(tile_links(tiled, reach, percent), "more-links")
    if not more.isEmpty():
        roots = components(sure.unionByName(more), "roots")
    least = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = stage_table(roots.join(least, "root").select("id", "component_id"), "class-components")
    own = linked.groupBy("n_shingles", "set_key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    own = own.join(of_class, "id", "left").filter("copies > 1 OR component_id IS NOT NULL").select(
        "n_shingles", "set_key", F.coalesce("component_id", "id").alias("component_id")
    )
    out = sketches.join(own, ["n_shingles", "set_key"], "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    )
    return out.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir))


ORACLE = """
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
  FROM doc, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0
), sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY ALL
), linked AS (
  SELECT a, b FROM pair JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b
  WHERE 100 * common >= 85 * (p.n + q.n - common)
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM doc UNION SELECT r.a, l.b FROM r JOIN linked l ON r.b = l.a)
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM doc d LEFT JOIN sized s ON s.doc_id = d.doc_id JOIN reach c ON c.doc_id = d.doc_id
"""
