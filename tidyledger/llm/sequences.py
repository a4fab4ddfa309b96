"""Places of rows within long groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyledger.session import stored


def positions(rows: DataFrame, key: str, order: list[Column], purpose: str) -> DataFrame:
    """``rows`` with ``position``, 1 for the first row of its key in this order.

    All rows are sorted in ranges of (key, order), so a key with a third of all rows lies in
    many ranges; a range's rows are numbered where they are and each range of a key starts
    after the ranges before it.  Rows equal in key and order keep an arbitrary, fixed order.
    A null key is a key.  Columns may not begin with ``__``.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"__order{k}" for k in range(len(order))]
    wide = rows.withColumns({**dict(zip(names, order, strict=True)), "__salt": F.monotonically_increasing_id()})
    by = [F.col(key).asc_nulls_first(), *(F.col(x).asc_nulls_first() for x in names), F.col("__salt").asc()]
    ranges = wide.repartitionByRange(tasks, *by).sortWithinPartitions(*by).drop(*names, "__salt")
    numbered = ranges.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    numbered = stored(numbered, f"{purpose}-ranges")
    runs = numbered.groupBy(F.col(key).alias("__key"), "__part").agg(
        F.min("__row").alias("__first"), F.count("*").alias("__count")
    )
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__count").over(earlier), F.lit(0))).withColumnRenamed(
        "__part", "__range"
    )
    placed = numbered.join(
        runs, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__range")), "inner"
    )
    place = F.col("__before") + F.col("__row") - F.col("__first") + 1
    return placed.select(*rows.columns, place.cast("long").alias("position"))
