"""Do the numbers in a text match known figures?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.functions.texts import extract_numbers, needs_check, number_value

# Tolerance of a match.
ABSOLUTE, RELATIVE = 0.01, 0.005


def numbers_in(texts: DataFrame, key: str, column: str) -> DataFrame:
    """One row per number of a text: ``(key, position, token, value)``, position from 1."""
    found = texts.select(key, F.posexplode(extract_numbers(F.col(column))).alias("_pos", "token"))
    return found.select(
        key, (F.col("_pos") + 1).alias("position"), "token", number_value(F.col("token")).alias("value")
    )


def _bucket(value: Column) -> Column:
    """Monotone bucket about as wide as the tolerance, so a fact spans two or three."""
    size = F.floor(F.log1p(F.abs(value) / 2) / F.lit(0.01))
    return F.when(value < 0, -size - 1).otherwise(size).cast("bigint")


def _fact_ranges(facts: DataFrame, column: str) -> DataFrame:
    """Every fact and its absolute value as a tolerance range, one row per bucket it touches."""
    value = F.col(column).cast("double")
    both = facts.select(F.explode(F.array(value, F.abs(value))).alias("fact")).filter(
        "fact IS NOT NULL"
    ).distinct()
    reach = F.greatest(F.lit(ABSOLUTE), F.abs(F.col("fact")) * RELATIVE)
    return both.withColumn("reach", reach).select(
        "fact",
        "reach",
        F.explode(
            F.sequence(
                _bucket(F.col("fact") - F.col("reach") * 1.001),
                _bucket(F.col("fact") + F.col("reach") * 1.001),
            )
        ).alias("bucket"),
    )


def unmatched_numbers(numbers: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """Numbers worth a check that lie within the tolerance of no fact.

    A tolerance match becomes an equality on buckets plus an exact test, without any
    hint: Spark broadcasts the facts by their measured size.  Beyond that both sides are
    shuffled by value, and equal values, however many texts hold them, arrive as one row
    for each task.
    """
    checked = numbers.filter(needs_check(F.col("value")))
    values = checked.select("value").distinct().withColumn("bucket", _bucket(F.col("value")))
    ranges = _fact_ranges(facts, column).withColumnRenamed("bucket", "_bucket")
    near = F.abs(F.col("value") - F.col("fact")) <= F.col("reach")
    matched = values.join(ranges, (F.col("bucket") == F.col("_bucket")) & near, "left_semi").select("value")
    return checked.join(matched, "value", "left_anti").select(*numbers.columns)


def _to_cents(value: Column) -> Column:
    """Two decimals, rounded on the decimal digits; a huge value stays as it is."""
    return F.coalesce(F.round(value.try_cast("decimal(38,10)"), 2).cast("double"), value)


def verify_numbers(
    texts: DataFrame, key: str, column: str, facts: DataFrame, fact: str, most: int | None = None
) -> DataFrame:
    """The distinct unverified numbers of every text, by position; at most ``most`` of a text if given.

    Texts that share a key keep their own lists (rows that repeat key and text count once),
    a null key is a key.  Only numbers without a match are shuffled, by text; the numbers
    of one text are bounded by the text itself.
    """
    told = texts.select(key, column, F.xxhash64(column).alias("_told"))
    found = told.select(key, "_told", F.posexplode(extract_numbers(F.col(column))).alias("_pos", "token"))
    numbers = found.select(
        key, "_told", (F.col("_pos") + 1).alias("position"), number_value(F.col("token")).alias("value")
    )
    loose = unmatched_numbers(numbers, facts, fact)
    return first_distinct(loose, key, most, "_told").drop("_told")


def first_distinct(numbers: DataFrame, key: str, most: int | None = None, *more: str) -> DataFrame:
    """The distinct values (two decimals) per text, by position; all of them or the first ``most``.

    ``more`` are columns that tell the texts of one key apart.
    """
    keys = [key, *more]
    distinct = (
        numbers.select(*keys, "position", _to_cents(F.col("value")).alias("value"))
        .groupBy(*keys, "value")
        .agg(F.min("position").alias("position"))
    )
    window = Window.partitionBy(*keys).orderBy("position")
    ranked = distinct.withColumn("rank", F.row_number().over(window))
    ranked = ranked if most is None else ranked.filter(F.col("rank") <= most)
    return ranked.select(*keys, "rank", "value")
