"""Array helpers that keep per-document work inside one row (no shuffle).

A document is one row and its sentences are an array in that row, so ordering,
gap detection and neighbour access need no exchange at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Catalyst inlines aliases, so an expensive expression used n times may be
    computed n times (or once per lambda call). A lambda variable never is.
    """
    # The wrapper keeps defaults of ``body`` from being taken for the element index.
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns so that each is computed exactly once per row.

    ``withColumn`` may be inlined into later projections and even into lambda
    bodies, where it would run once per element. A one-element ``inline`` is a
    boundary the optimizer keeps; it is map-only.
    """
    keep = [c for c in df.columns if c not in columns]
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*keep, made)


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """Keeps filters and lambdas from computing the columns again. What a generator computes itself is interpreted;
    expressions in the projection in front of it are compiled."""
    return stage(df, **{c: F.col(c) for c in columns})


def indices(arr: Column) -> Column:
    """0-based positions of an array; empty for an empty array."""
    return F.transform(arr, lambda _x, i: i)


def first_index(arr: Column, pred: Callable[..., Column]) -> Column:
    """0-based position of the first element that satisfies ``pred``, else NULL."""
    pos = F.array_position(F.transform(arr, lambda x, i: F.coalesce(pred(x, i), F.lit(False))), True)
    return F.nullif(pos, F.lit(0).cast("bigint")).cast("int") - 1


def any_of(arr: Column, pred: Callable[[Column], Column]) -> Column:
    return F.exists(arr, pred)


def runs(starts: Column, total: Column) -> Column:
    """Turn sorted run-start positions into ``array<struct<lo,hi>>`` (inclusive)."""
    return let(
        starts,
        lambda s: F.transform(
            s,
            lambda lo, k: F.struct(
                lo.alias("lo"),
                (F.coalesce(F.get(s, k + 1), total) - 1).alias("hi"),
            ),
        ),
    )


def cut(arr: Column, lo: Column, hi: Column) -> Column:
    """Inclusive 0-based slice."""
    return F.slice(arr, lo + 1, F.greatest(hi - lo + 1, F.lit(0)))


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0), lambda a, x: a + x)


def exclusive_running_sum(values: Column) -> Column:
    """Exclusive prefix sums of an ``array<int>``.

    A plain fold that appends to an array copies it at every step; block totals
    keep the copying to one element per block. Short arrays take short blocks:
    adding inside a block costs more than copying until there are many of them.
    """

    def with_blocks(v: Column, block: Column) -> Column:
        n_blocks = F.floor((F.size(v) + block - 1) / block).cast("int")
        totals = F.aggregate(
            F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(
                F.array().cast("array<int>")
            ),
            F.array(F.lit(0)),
            lambda acc, b: F.concat(
                acc,
                F.array(F.element_at(acc, -1) + array_sum(F.slice(v, b * block + 1, block))),
            ),
        )
        return let(
            totals,
            lambda t: F.transform(
                v,
                lambda _x, i: F.get(t, F.floor(i / block).cast("int"))
                + F.when(i % block == 0, 0).otherwise(array_sum(F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block))),
            ),
        )

    block = lambda v: F.when(F.size(v) <= 256, 4).when(F.size(v) <= 65_536, 16).otherwise(64)
    return let(values, lambda v: let(block(v), lambda b: with_blocks(v, b)))


def unique_in_order(arr: Column) -> Column:
    """Distinct non-empty values, first occurrence kept."""
    return F.array_distinct(F.filter(arr, lambda x: x.isNotNull() & (x != "")))
