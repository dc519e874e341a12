"""Running totals, previous rows and positions over groups of any size.

A plain window puts a whole group into one task, and one executor or one
application may hold a third of all rows. These operators work in two levels
instead: rows of a group are cut into chunks of bounded size by their place in
the log (an order-preserving cut, so no sampling), windows run inside a chunk,
and one small row per chunk carries the state from chunk to chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Places in the log per chunk: at most 2**17 events of a group in one window.
CHUNK_BITS = 17


def chunk_of(place: str | Column, bits: int | None = None) -> Column:
    """Chunk number of a place in the log; rises with it, also below zero."""
    return F.shiftright(F.col(place) if isinstance(place, str) else place, bits or CHUNK_BITS)


def running_total(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    totals_of: DataFrame | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Adds inclusive running sums and maxima per ``keys`` in ``order``.

    ``order[0]`` is the place in the log. ``totals_of`` gives the rows the chunk
    totals are taken from, when ``rows`` leaves out chunks nobody asks about.
    Shuffles: rows once, by (keys, chunk); one row per (keys, chunk) for the rest.
    """
    sums, maxima = sums or {}, maxima or {}
    part = [*keys, "_chunk"]
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    chunked = rows.withColumn("_chunk", chunk_of(order[0], bits))
    source = chunked if totals_of is None else totals_of.withColumn("_chunk", chunk_of(order[0], bits))
    totals = source.groupBy(*part).agg(
        *[F.sum(value).alias(f"_c_{name}") for name, value in sums.items()],
        *[F.max(value).alias(f"_c_{name}") for name, value in maxima.items()],
    )
    carried = totals.select(
        *part,
        *[F.sum(f"_c_{name}").over(earlier).alias(f"_c_{name}") for name in sums],
        *[F.max(f"_c_{name}").over(earlier).alias(f"_c_{name}") for name in maxima],
    )
    local = chunked.select(
        "*",
        *[F.sum(value).over(inside).alias(f"_l_{name}") for name, value in sums.items()],
        *[F.max(value).over(inside).alias(f"_l_{name}") for name, value in maxima.items()],
    )
    zero = F.lit(0).cast("bigint")
    return local.join(carried, part).select(
        *[F.col(name) for name in rows.columns],
        *[
            (F.coalesce(f"_l_{name}", zero) + F.coalesce(f"_c_{name}", zero)).alias(name)
            for name in sums
        ],
        *[F.greatest(f"_l_{name}", f"_c_{name}").alias(name) for name in maxima],
    )


def record_highs(
    rows: DataFrame, keys: Sequence[str], place: str, value: str, bits: int | None = None
) -> DataFrame:
    """Rows whose ``value`` is above that of every earlier row of ``keys``; it rises with ``place``."""
    part = [*keys, "_chunk"]
    before = Window.partitionBy(*part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunked = rows.withColumn("_chunk", chunk_of(place, bits))
    carried = (
        chunked.groupBy(*part)
        .agg(F.max(value).alias("_high"))
        .select(*part, F.max("_high").over(earlier).alias("_carried"))
    )
    above = lambda high: F.coalesce(F.col(value) > F.col(high), F.lit(True))
    return (
        chunked.withColumn("_before", F.max(value).over(before))
        .where(above("_before"))
        .join(carried, part)
        .where(above("_carried"))
        .select(*rows.columns)
    )


def lowest_running_sum(
    rows: DataFrame, keys: Sequence[str], place: str, step: str, bits: int | None = None
) -> DataFrame:
    """Per ``keys``: ``first`` place, ``total`` of ``step``, ``lowest`` value its running sum takes."""
    part = [*keys, "_chunk"]
    inside = Window.partitionBy(*part).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_chunk", chunk_of(place, bits))
        .withColumn("_run", F.sum(step).over(inside))
        .groupBy(*part)
        .agg(F.min(place).alias("_first"), F.sum(step).alias("_total"), F.min("_run").alias("_low"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .groupBy(*keys)
        .agg(
            F.min("_first").alias("first"),
            F.sum("_total").alias("total"),
            F.min(F.col("_before") + F.col("_low")).alias("lowest"),
        )
    )


def neighbour_values(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    following: bool = False,
    bits: int | None = None,
) -> DataFrame:
    """Adds values of the previous (or following) row per ``keys`` in ``order``.

    ``values`` maps a new column to the column read from the neighbour; NULL
    where there is none.
    """
    part = [*keys, "_chunk"]
    inside = Window.partitionBy(*part).orderBy(*order)
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    chunked = rows.withColumn("_chunk", chunk_of(order[0], bits))
    step = F.lead if following else F.lag
    pick = F.min_by if following else F.max_by

    edge = chunked.groupBy(*part).agg(
        pick(F.struct(*values.values()), F.struct(*order)).alias("_edge")
    )
    carried = edge.select(*part, step("_edge").over(chunks).alias("_carried"))
    local = chunked.select(
        "*",
        step(F.struct(*values.values())).over(inside).alias("_near"),
    )
    near = F.coalesce(F.col("_near"), F.col("_carried"))
    return local.join(carried, part).select(
        *[F.col(name) for name in rows.columns],
        *[near.getField(source).alias(name) for name, source in values.items()],
    )


def position(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    bits: int | None = None,
) -> DataFrame:
    """Adds the row's number (from 0) per ``keys`` in ``order``."""
    counted = running_total(rows, keys, order, sums={name: F.lit(1)}, bits=bits)
    return counted.withColumn(name, F.col(name) - 1)
