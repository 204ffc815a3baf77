"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed; the hashes of GRAM consecutive words make k-grams. Of every SPAN consecutive k-grams the
least is kept (all that are equal), so two texts that share WINDOW = SPAN + GRAM - 1 words keep a k-gram in common. Kept k-grams of
documents meet those of the benchmark; each hit is extended to the windows around it, and windows are compared
by their words with the item's, so a span counts exactly if its words agree. Items of fewer words than a window
are looked for whole, among the documents' k-grams of that very length.

Only documents that hold a benchmark k-gram carry words through a shuffle. Benchmark tables are broadcast
while they have at most BROADCAST_ROWS rows (counted first); beyond that the joins shuffle by k-gram.

Defined cases: null and empty texts have no words, items without words or id match nothing; equal items count
each; rows are told apart by doc_id and text, so repeated rows get equal results and a null doc_id is an id;
empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.llm.common import UPPER_CHARS, documents, narrow, stage_table

#: Words of a window, of a k-gram, and k-grams of which the least is kept.
WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
BROADCAST_ROWS = 500_000
PRINTS = "array<struct<kind:int,h:bigint,p:int>>"
#: Everything that is no word once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER_CHARS, UPPER_CHARS.lower()), GAP), "")


def grams(hashes: str, width: int) -> Column:
    """Hashes of each `width` consecutive values of a column of hashes; none where there are fewer."""
    parts = ", ".join(f"{hashes}[i + {j}]" for j in range(width))
    return F.expr(
        f"CASE WHEN size({hashes}) >= {width} THEN transform(sequence(0, size({hashes}) - {width}), i -> xxhash64({parts})) END"
    )


def run_minima(gram_hashes: str) -> Column:
    """The least of each SPAN consecutive k-gram hashes; none where there are fewer."""
    run = ", ".join(f"{gram_hashes}[i + {j}]" for j in range(SPAN))
    return F.expr(
        f"CASE WHEN size({gram_hashes}) >= {SPAN} THEN transform(sequence(0, size({gram_hashes}) - {SPAN}), i -> least({run})) END"
    )


def winnowed(gram_hashes: str, minima: str) -> Column:
    """(h, p) of the k-grams that are least in some run they lie in (all of equal ones); a run's minimum is at most
    each of its members, so a k-gram is one where the greatest minimum of its runs equals it."""
    runs = ", ".join(f"get({minima}, k.p - {j})" for j in range(SPAN))
    return F.expr(
        f"CASE WHEN {minima} IS NOT NULL THEN filter(transform({gram_hashes}, (x, i) -> struct(x AS h, i AS p)), "
        f"k -> k.h = greatest({runs})) END"
    )


def hashed(df: DataFrame) -> DataFrame:
    """Adds w, the words, and wh, their hashes; one-element generators keep both from being computed twice."""
    return df.withColumn("w", F.explode(F.array(F.coalesce(words(F.col("text")), F.array().cast("array<string>"))))).withColumn(
        "wh", F.explode(F.array(F.transform("w", lambda x: F.xxhash64(x))))
    )


def benchmark_tables(items: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(kind, h): what documents' k-grams meet; kind is WINDOW for winnowed k-grams, else the words of a short
    item. (window_hash, window, item_id): each distinct window of each item. And the short items' lengths."""
    items = stage_table(
        hashed(items.filter(F.col("item_id").isNotNull()).select("item_id", F.col("text").cast("string")))
        .filter(F.size("w") > 0).select("item_id", "w", "wh"), "items",
    )
    windows = items.select("item_id", F.expr(
        f"explode(CASE WHEN size(w) < {WINDOW} THEN array(w) "
        f"ELSE transform(sequence(1, size(w) - {WINDOW - 1}), i -> slice(w, i, {WINDOW})) END) AS window"
    )).distinct().withColumn("window_hash", F.xxhash64("window"))
    short = sorted(r.n for r in items.filter(F.size("w") < WINDOW).select(F.size("w").alias("n")).distinct().collect())
    prints = items.withColumn("g", grams("wh", GRAM)).withColumn("m", run_minima("g")).select(
        F.lit(WINDOW).alias("kind"), F.explode(winnowed("g", "m")).alias("x")
    ).select("kind", F.col("x.h").alias("h"))
    for n in short:
        whole = items.filter(F.size("w") == n).select(F.lit(n).alias("kind"), grams("wh", n)[0].alias("h"))
        prints = prints.unionByName(whole)
    return stage_table(prints.distinct(), "prints"), stage_table(windows, "item-windows"), short


def document_prints(docs: DataFrame, short: list[int]) -> DataFrame:
    """doc_id, text_key, w and x, a print (kind, h, p) of the row. The print of kind 0 stands for the row itself,
    with its number of words as p."""
    kept = [
        "array(struct(0 AS kind, 0L AS h, size(w) AS p))",
        f"coalesce(transform(kept, k -> struct({WINDOW} AS kind, k.h AS h, k.p AS p)), array())",
    ]
    for n in short:
        parts = ", ".join(f"wh[i + {j}]" for j in range(n))
        kept.append(
            f"CASE WHEN size(wh) >= {n} THEN transform(sequence(0, size(wh) - {n}), "
            f"i -> struct({n} AS kind, xxhash64({parts}) AS h, i AS p)) ELSE array() END"
        )
    rows = hashed(docs.withColumn("text_key", F.xxhash64("text")))
    steps = (("g", grams("wh", GRAM)), ("m", run_minima("g")), ("kept", winnowed("g", "m")), ("prints", F.expr(f"concat({', '.join(kept)})")))
    for name, made in steps:
        rows = rows.withColumn(name, F.explode(F.array(made)))
    return rows.select("doc_id", "text_key", "w", F.explode("prints").alias("x"))


def around() -> Column:
    """The words that windows over print x may hold, from the first such window on."""
    first = F.greatest(F.col("x.p") - (SPAN - 1), F.lit(0))
    return F.when(F.col("x.kind") == WINDOW, F.slice("w", first + 1, F.col("x.p") - first + WINDOW)).when(
        F.col("x.kind") > 0, F.slice("w", F.col("x.p") + 1, F.col("x.kind"))
    )


def meet(docs: DataFrame, prints: DataFrame, short: list[int], broadcast_rows: int) -> DataFrame:
    """doc_id, text_key, kind, p, near: the prints that documents share with the benchmark, with the words around
    them, and each row's print of kind 0."""
    key = [F.col("x.kind") == F.col("kind"), F.col("x.h") == F.col("h")]
    out = ("doc_id", "text_key", "x.kind", "x.p", around().alias("near"))
    rows = document_prints(docs, short)
    own = docs.sparkSession.createDataFrame([(0, 0)], "kind int, h long")
    if prints.count() <= broadcast_rows:
        return rows.join(F.broadcast(prints.unionByName(own)), key).select(*out)
    # Too many for a broadcast: the prints are shuffled without words, and the rows that hit are read again.
    row = ["doc_id", "text_key"]
    hits = rows.select(*row, "x").filter("x.kind > 0").join(prints, key).select(*row, "x").distinct()
    hits = hits.groupBy(*row).agg(F.collect_list("x").alias("xs"))
    again = hashed(docs.withColumn("text_key", F.xxhash64("text")))
    both = again.alias("a").join(hits.alias("b"), F.expr("a.doc_id <=> b.doc_id AND a.text_key <=> b.text_key"), "left")
    none = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h"), F.size("w").alias("p")))
    return both.select(
        "a.doc_id", "a.text_key", "w", F.explode(F.concat(none, F.coalesce("xs", F.array().cast(PRINTS)))).alias("x")
    ).select(*out)


def find(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words and spans for every row: (at, width, item_id) of every occurrence of a benchmark window."""
    prints, windows, short = benchmark_tables(items)
    met = stage_table(meet(narrow(docs), prints, short, broadcast_rows), "met")
    row = ["doc_id", "text_key"]
    candidates = met.filter("kind > 0").select(*row, F.expr(
        f"explode(CASE WHEN kind < {WINDOW} THEN array(struct(p AS at, near AS window)) "
        f"WHEN size(near) >= {WINDOW} THEN transform(sequence(0, size(near) - {WINDOW}), "
        f"i -> struct(greatest(p - {SPAN - 1}, 0) + i AS at, slice(near, i + 1, {WINDOW}) AS window)) ELSE array() END) AS c"
    )).select(*row, "c.at", "c.window").withColumn("window_hash", F.xxhash64("window"))
    if windows.count() <= broadcast_rows:
        windows = F.broadcast(windows)
    hits = candidates.join(windows, ["window_hash", "window"]).select(
        *row, F.struct("at", F.size("window").alias("width"), "item_id").alias("hit")
    ).distinct().groupBy(*row).agg(F.collect_list("hit").alias("hits"))
    rows = met.filter("kind = 0").select(*row, F.col("p").cast("long").alias("n_words"))
    return rows.alias("r").join(
        hits.alias("h"), F.expr("r.doc_id <=> h.doc_id AND r.text_key <=> h.text_key"), "left"
    ).select("r.doc_id", "n_words", F.array_sort(F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType))).alias("hits"))


def summarise(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated of the rows of find()."""
    covered = F.expr(
        "aggregate(hits, struct(0 AS reach, 0L AS n), (a, x) -> struct(greatest(a.reach, x.at + x.width) AS reach, "
        "a.n + greatest(0, x.at + x.width - greatest(a.reach, x.at)) AS n), a -> a.n)"
    )
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item_id"].cast("string"))))
    return found.withColumns({"n_hit": covered.cast("long"), "_ids": ids}).select(
        "doc_id", "n_words", "n_hit", F.size("_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return summarise(find(documents(spark, sf_dir), items))


_WORDS = (
    "list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
ORACLE = f"""
WITH item AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
pattern AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) < {WINDOW} THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i : i + {WINDOW - 1}], ' ') END AS seq, least(len(w), {WINDOW}) AS width
  FROM item, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i) WHERE len(w) > 0
), doc AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
place AS (
  SELECT doc_id, i, width, array_to_string(w[i : i + width - 1], ' ') AS seq
  FROM doc, (SELECT DISTINCT width FROM pattern), LATERAL (SELECT unnest(range(1, len(w) - width + 2)) AS i)
), hit AS (SELECT doc_id, i, p.width, item_id FROM place JOIN pattern p USING (seq, width)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, LATERAL (SELECT unnest(range(0, width)) AS k) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
