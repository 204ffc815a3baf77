"""Ordered scans over long tables that survive hot keys.

A plain window partitioned by the key puts all rows of a key into one task. Here
a key is cut into chunks that follow the order (days, page blocks): the window
runs inside a chunk, and what a chunk hands on to the next ones (counts, last
values) is computed on one summary row per chunk and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing


def chunked_scan(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    *,
    sums: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds columns computed over the rows of a key in ``order`` (a total order).

    ``sums``: sum over the earlier rows (0 for the first row). ``previous`` /
    ``following``: nearest non-NULL value in an earlier / later row. ``chunk``
    must not decrease along ``order``.
    """
    sums, previous, following = sums or {}, previous or {}, following or {}
    keys = list(keys)
    base = df.withColumn("_chunk", chunk)
    rank = F.struct(*order)

    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    earlier, later = local.rowsBetween(_FIRST, -1), local.rowsBetween(1, _LAST)
    rows = base.withColumns(
        {
            **{f"_l_{n}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()},
            **{f"_l_{n}": F.last(c, ignorenulls=True).over(earlier) for n, c in previous.items()},
            **{f"_l_{n}": F.first(c, ignorenulls=True).over(later) for n, c in following.items()},
        }
    )

    summary = base.groupBy(*keys, "_chunk").agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), rank)).alias(f"_s_{n}") for n, c in previous.items()],
        *[F.min_by(c, F.when(c.isNotNull(), rank)).alias(f"_s_{n}") for n, c in following.items()],
    )
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    before, after = chunks.rowsBetween(_FIRST, -1), chunks.rowsBetween(1, _LAST)
    carried = summary.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in previous],
        *[F.first(f"_s_{n}", ignorenulls=True).over(after).alias(f"_c_{n}") for n in following],
    )
    out = rows.join(carried, [*keys, "_chunk"])
    return out.select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in (*previous, *following)],
    )


def page_offsets(pages: DataFrame, block: int = 512, separator: int = 2) -> DataFrame:
    """Offset interval of every page of a document, without gathering its pages."""
    out = chunked_scan(
        pages.withColumn("_len", F.length("text").cast("bigint")),
        ["doc_id"], F.floor(F.col("page") / block), ["page"],
        sums={"start_offset": F.col("_len") + separator},
    )
    return out.select(
        "doc_id", "page", F.col("start_offset").cast("bigint").alias("start_offset"),
        (F.col("start_offset") + F.col("_len")).cast("bigint").alias("end_offset"),
    )


def forward_fill(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], marker: Column, name: str
) -> DataFrame:
    """Value of the last marker at or before each row."""
    out = chunked_scan(df, keys, chunk, order, previous={name: marker})
    return out.withColumn(name, F.coalesce(marker, F.col(name)))


def anchor_windows(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], anchor: Column
) -> DataFrame:
    """Members of the windows around anchor rows (merge gap 2, context 1).

    Adds ``position`` (0-based), ``is_anchor`` and ``window_no`` (1-based); rows
    outside all windows are left out. A row opens a window when the next row is
    the first anchor of an island, or when it is an anchor and the first row.
    Neighbour flags and running counts come from two chunked scans.
    """
    flagged = df.withColumn("is_anchor", F.coalesce(anchor, F.lit(False)))
    near = chunked_scan(
        flagged, keys, chunk, order,
        sums={"position": F.lit(1)},
        previous={"_prev": F.col("is_anchor")},
        following={"_next": F.col("is_anchor")},
    )
    prev, nxt = F.coalesce("_prev", F.lit(False)), F.coalesce("_next", F.lit(False))
    members = near.filter(F.col("is_anchor") | prev | nxt).withColumn(
        "_opens",
        ((~F.col("is_anchor") & ~prev & nxt) | (F.col("is_anchor") & F.col("_prev").isNull())).cast("int"),
    )
    out = chunked_scan(members, keys, chunk, order, sums={"window_no": F.col("_opens")})
    return out.withColumn("window_no", F.col("window_no") + F.col("_opens")).drop("_opens", "_prev", "_next")
