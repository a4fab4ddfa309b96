"""Duplicate business keys: first occurrence by source row, without hot tasks.

A key may hold a large part of all rows, so no operator here brings the rows of
one key together: they are compared within parts of a key first, and only the
first rows of its parts meet.  The rows are computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.schema import SOURCE_ROW


def keep_first(df: DataFrame, key: str) -> DataFrame:
    """Keep the first row of every key.

    Spark limits the groups before the shuffle (window group limit), so each map
    task sends at most one row per key, however frequent the key is.
    """
    window = Window.partitionBy(key).orderBy(SOURCE_ROW)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.filter("_rank = 1").drop("_rank")


def first_rows(df: DataFrame, key: str) -> DataFrame:
    """``(key, source_row of the first occurrence, number of rows)`` per key."""
    return df.groupBy(key).agg(
        F.min(SOURCE_ROW).alias(SOURCE_ROW), F.count("*").alias("occurrences")
    )


PARTS = 64  # of a key, by the hash of the source row


def _in_parts(df: DataFrame, key: str) -> DataFrame:
    """Place and number of a row in its part of the key, and those of the part's first among all parts' firsts.

    Rows with one source row share a place.
    """
    part = F.pmod(F.xxhash64(SOURCE_ROW), F.lit(PARTS)).cast("int")
    inside = Window.partitionBy(key, "_part")
    rows = df.withColumn("_part", part).withColumns(
        {"_place": F.rank().over(inside.orderBy(SOURCE_ROW)), "_rows": F.count("*").over(inside)}
    )
    # The firsts of a key's parts are one more part; all other rows stay among those of their own.
    rows = rows.withColumn("_part", F.when(F.col("_place") == 1, F.lit(-1)).otherwise(F.col("_part")))
    return rows.withColumns(
        {"_first_place": F.rank().over(inside.orderBy(SOURCE_ROW)), "_firsts": F.count("*").over(inside)}
    )


def later_duplicates(df: DataFrame, key: str) -> DataFrame:
    """All rows after the first of their key."""
    return _in_parts(df, key).where("_place > 1 OR _first_place > 1").select(df.columns)


def duplicated_rows(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key occurs more than once, the first occurrence included."""
    return _in_parts(df, key).where("_rows > 1 OR _firsts > 1").select(df.columns)


def duplicate_totals(df: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are duplicated, and how many rows come after a first one."""
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .agg(
            F.count_if(F.col("_n") > 1).alias("duplicate_ids"),
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )
