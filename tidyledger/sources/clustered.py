"""Tables clustered by several columns, and reads that open only the files they need.

Each column's values are cut into ranges of about equal share; the numbers of a row's ranges,
their bits interleaved, are its place on a Morton curve, and files are ranges of that curve.
So a file holds a narrow range of *every* clustered column, not of the first one alone.  Next to the
files lies a table with the least and greatest value of each column in each file; a read with
bounds compares them first and opens the files that can hold a row.

Ranges come from a bounded sample of rows (``SAMPLE``, those with the least hash of the clustered columns and
a salt).  It decides the layout only: bounds are kept exactly for every file, so a poor sample
costs time, never rows.  Rows of one frequent place are dealt over files by a hash of the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 4096  # rows that decide the ranges, whatever the table's size
PLACE, DEALT = "_place", "_dealt"


def range_limits(rows: DataFrame, columns: Sequence[str], bits: int) -> dict[str, list]:
    """Inner limits of up to ``2 ** bits`` ranges of each column, ascending and distinct."""
    picked = rows.select(*columns, F.xxhash64(F.lit(7), F.struct(*columns), F.rand(11)).alias(DEALT))
    sample = picked.orderBy(DEALT).limit(SAMPLE).collect()
    limits = {}
    for name in columns:
        values = sorted(row[name] for row in sample if row[name] is not None)
        cuts = {values[len(values) * k >> bits] for k in range(1, 1 << bits)} if values else set()
        limits[name] = sorted(cuts)
    return limits


def _range_number(column: Column, limits: Sequence, numbers: Sequence[int]) -> Column:
    """The number of the range a value falls in, by halving; null values are in the first range."""
    if not limits:
        return F.lit(numbers[0]).cast("bigint")
    middle = len(limits) // 2
    above = _range_number(column, limits[middle + 1 :], numbers[middle + 1 :])
    below = _range_number(column, limits[:middle], numbers[: middle + 1])
    return F.when(column >= F.lit(limits[middle]), above).otherwise(below)


def morton(limits: dict[str, list], bits: int) -> Column:
    """Place of a row: the range numbers' bits taken in turns, highest first."""
    place = F.lit(0).cast("bigint")
    for offset, (name, cuts) in enumerate(limits.items()):
        # A column with few ranges spreads them over all numbers, so that its highest bits tell them apart.
        numbers = [(k << bits) // (len(cuts) + 1) for k in range(len(cuts) + 1)]
        number = _range_number(F.col(name), cuts, numbers)
        for bit in range(bits):
            taken = F.shiftright(number, bit).bitwiseAND(F.lit(1).cast("bigint"))
            place = place.bitwiseOR(F.shiftleft(taken, bit * len(limits) + offset))
    return place


def write_clustered(rows: DataFrame, folder: str, columns: Sequence[str], files: int, bits: int = 6) -> None:
    """Write ``rows`` to ``folder/data`` in about ``files`` files and their bounds to ``folder/bounds``.

    ``rows`` is read three times (sample, range borders, data): pass a written table.
    """
    limits = range_limits(rows, columns, bits)
    placed = rows.withColumns({PLACE: morton(limits, bits), DEALT: F.xxhash64(*rows.columns)})
    dealt = placed.repartitionByRange(files, PLACE, DEALT).sortWithinPartitions(PLACE, *columns)
    dealt.drop(PLACE, DEALT).write.parquet(f"{folder}/data")
    written = rows.sparkSession.read.parquet(f"{folder}/data")
    bounds = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("rows"),
        *[F.min(name).alias(f"least_{name}") for name in columns],
        *[F.max(name).alias(f"most_{name}") for name in columns],
        *[F.count_if(F.col(name).isNull()).alias(f"nulls_{name}") for name in columns],
    )
    bounds.write.parquet(f"{folder}/bounds")


def files_for(spark: SparkSession, folder: str, ranges: dict[str, tuple]) -> list[str]:
    """Files that can hold a row within the ranges; only their names reach the driver."""
    bounds = spark.read.parquet(f"{folder}/bounds")
    wanted = F.lit(True)
    for name, (least, most) in ranges.items():
        if least is not None:
            wanted = wanted & (F.col(f"most_{name}") >= F.lit(least))
        if most is not None:
            wanted = wanted & (F.col(f"least_{name}") <= F.lit(most))
    return sorted(row["file"] for row in bounds.where(wanted).select("file").collect())


def read_clustered(spark: SparkSession, folder: str, ranges: dict[str, tuple]) -> DataFrame:
    """Rows whose columns lie within ``(least, most)``, both included; None leaves a side open.

    A null is in no range with a bound.  A column without stored bounds is an analysis error.
    """
    bounded = {name: pair for name, pair in ranges.items() if pair != (None, None)}
    schema = spark.read.parquet(f"{folder}/data").schema
    found = files_for(spark, folder, bounded)
    rows = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    for name, (least, most) in bounded.items():
        if least is not None:
            rows = rows.where(F.col(name) >= F.lit(least))
        if most is not None:
            rows = rows.where(F.col(name) <= F.lit(most))
    return rows
