"""Ordered computations without a single-task sort.

``Window.partitionBy(key).orderBy(...)`` puts one key into one task. The functions here cut
every key into chunks that are contiguous in the order, work inside the chunks in parallel,
and carry the chunk totals forward over a table with one row per chunk.

The chunk-level carry table is joined on (group, chunk), which is the partitioning the local
window already needed, so the large side is shuffled once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoreline.plans.materialize import stored
from shoreline.plans.sizing import broadcast_if_small

CHUNK = "_chunk"
_LOCAL_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in 33 bits


def _ordering(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def range_chunks(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Range-partition by (group, order) and store the result with its chunk number.

    ``order`` must be total. Range bounds come from a sample, so the layout is stored before
    anything is counted on it. Adds ``_chunk`` and the row's place ``_local`` in the chunk.
    """
    keys = [F.col(g) for g in group] + _ordering(order)
    laid_out = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ident = F.monotonically_increasing_id()
    numbered = laid_out.withColumn("_id", ident)
    return stored(
        numbered.select(
            *df.columns,
            F.shiftright("_id", 33).alias(CHUNK),
            F.col("_id").bitwiseAND(F.lit(_LOCAL_BITS)).alias("_local"),
        ),
        "chunks",
    )


def dense_index(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str
) -> DataFrame:
    """Number the rows of each group from 0 in ``order`` (a distributed row_number)."""
    chunks = range_chunks(df, group, order)
    per_chunk = chunks.groupBy(*group, CHUNK).agg(
        F.count("*").alias("_rows"), F.min("_local").alias("_first")
    )
    before = Window.partitionBy(*group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *group,
        CHUNK,
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_offset"),
    )
    return (
        chunks.join(broadcast_if_small(stored(offsets, "offsets")), [*group, CHUNK])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop(CHUNK, "_local", "_offset")
    )


def running(
    df: DataFrame,
    group: Sequence[str],
    chunk: str,
    order: Sequence[str | Column],
    *,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    maxima_before: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running sums and maxima over ``order`` within ``group``.

    ``chunk`` is a column that is constant on contiguous stretches of the order. Sums and maxima
    include the current row, ``maxima_before`` does not. Maxima skip nulls and are null until
    the first non-null value. Group columns must not be null.
    """
    sums = dict(sums or {})
    upto_now, upto_last = dict(maxima or {}), dict(maxima_before or {})
    peaks = {**upto_now, **upto_last}
    key = [*group, chunk]
    local = Window.partitionBy(*key).orderBy(*_ordering(order))
    now = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = local.rowsBetween(Window.unboundedPreceding, -1)
    frame = {**{n: now for n in upto_now}, **{n: last for n in upto_last}}
    inputs = df.select("*", *[e.alias(f"_in_{n}") for n, e in {**sums, **peaks}.items()])
    totals = inputs.groupBy(*key).agg(
        *[F.sum(f"_in_{n}").alias(f"_c_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_c_{n}") for n in peaks],
    )
    # One row per chunk.
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *key,
        *[F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in sums],
        *[F.max(f"_c_{n}").over(before).alias(f"_p_{n}") for n in peaks],
    )
    local_runs = inputs.select(
        *df.columns,
        *[F.sum(f"_in_{n}").over(now).alias(f"_r_{n}") for n in sums],
        *[F.max(f"_in_{n}").over(frame[n]).alias(f"_r_{n}") for n in peaks],
    )
    return local_runs.join(carry, key).select(
        *df.columns,
        *[(F.coalesce(F.col(f"_r_{n}"), F.lit(0)) + F.col(f"_p_{n}")).alias(n) for n in sums],
        *[F.greatest(F.col(f"_r_{n}"), F.col(f"_p_{n}")).alias(n) for n in peaks],
    )
