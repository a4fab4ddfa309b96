"""Cubes from one partial table, with exact distinct counts that merge.

Detail rows are read once, into sums for each finest group and bucket of customers together with
a bitmap of the customers seen.  Every coarser set comes from that table: sums are added,
bitmaps are combined, and a customer who is in several finer groups counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.session import stored


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """``(column, id)``: a number for each distinct value, written once so that it stays.

    Numbers run on within a task, so the bitmap buckets they fall in are filled well.
    """
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    return stored(distinct.withColumn("id", F.monotonically_increasing_id()), f"{column}-ids")


def partial(
    rows: DataFrame, dimensions: Sequence[str], sums: dict[str, str], member: str, ids: DataFrame
) -> DataFrame:
    """``(dimensions, bucket, sums, seen)``: the finest groups; ``seen`` is a bitmap of ``member`` ids.

    ``sums`` gives SQL aggregates by name that are added up later (sums and counts).  Rows of
    one group and member are combined before the ids are joined.
    """
    pairs = rows.groupBy(*dimensions, member).agg(*[F.expr(sql).alias(name) for name, sql in sums.items()])
    named = pairs.join(ids, member, "left")
    return named.groupBy(*dimensions, F.bitmap_bucket_number("id").alias("bucket")).agg(
        *[F.sum(name).alias(name) for name in sums],
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("seen"),
    )


def cube(parts: DataFrame, dimensions: Sequence[str], sums: Sequence[str], distinct: str) -> DataFrame:
    """All sets of the dimensions from a partial table: ``(dimensions, grouping, sums, distinct)``.

    ``grouping`` has a bit for each dimension that is summed over, the first dimension's is the
    highest; it tells a null value from "all".
    """
    keys = [f"_by_{name}" for name in dimensions]
    named = parts.withColumnsRenamed(dict(zip(dimensions, keys, strict=True)))
    # A bucket is in no set of its own: it only keeps bitmaps at their fixed size.
    sets = [[key for k, key in enumerate(keys) if not mask >> (len(keys) - 1 - k) & 1] for mask in range(1 << len(keys))]
    merged = named.groupingSets([[*x, "bucket"] for x in sets], *keys, "bucket").agg(
        *[F.sum(name).alias(name) for name in sums],
        F.bitmap_count(F.bitmap_or_agg("seen")).alias("members"),
        F.grouping_id(*keys, "bucket").alias("grouping"),
    )
    whole = merged.groupBy(*keys, F.shiftright("grouping", 1).alias("grouping")).agg(
        *[F.sum(name).alias(name) for name in sums], F.sum("members").alias(distinct)
    )
    return whole.withColumnsRenamed(dict(zip(keys, dimensions, strict=True)))
