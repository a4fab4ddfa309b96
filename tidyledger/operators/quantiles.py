"""Exact quantiles of many groups at once, without sorting a group.

Values are whole numbers (money in cents).  A wanted rank is narrowed down digit by digit:
each round counts the values that share the digits found so far by their next digit, so a
group, however large, is at most ``2**BITS`` counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.session import stored

BITS = 12


def exact_quantiles(
    rows: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], digits: int = 0
) -> DataFrame:
    """``(by, probability, n, quantile)``: linear between the two nearest ranks, as DOUBLE.

    ``value`` is taken as a number with ``digits`` decimals; null values take no part, a
    null group is a group.
    """
    keys = [f"_by{k}" for k in range(len(by))]
    named = [F.col(x).alias(key) for x, key in zip(by, keys, strict=True)]
    scaled = (F.col(value).cast("decimal(38,6)") * F.lit(10**digits)).cast("decimal(20,0)").cast("bigint")
    counts = rows.select(*named, scaled.alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(
        F.count("*").alias("_n")
    )
    # Rows of one value are one from here on.
    counts = stored(counts, "quantile-counts")
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    ends = counts.agg(F.min("_v").alias("low"), F.max("_v").alias("high")).first()
    low = ends["low"] or 0
    rounds = max(1, -(-((ends["high"] or 0) - low).bit_length() // BITS))

    at = (F.col("n") - 1) * F.col("probability")
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    asked = sizes.select(*keys, "n", wanted).withColumn("_below", F.floor(at).cast("bigint"))
    asked = asked.withColumn("_part", at - F.col("_below"))
    ranks = F.array_distinct(F.array(F.col("_below"), F.least(F.col("_below") + 1, F.col("n") - 1)))
    asked = stored(asked, "quantile-asked")
    targets = asked.select(*keys, F.explode(ranks).alias("_rank")).distinct()
    targets = targets.withColumns({"_prefix": F.lit(0).cast("bigint"), "_left": F.col("_rank")})

    def same(a: str, b: str):
        return [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in [*keys, "_prefix"]]

    for k in range(rounds):
        shift = BITS * (rounds - 1 - k)
        digit = F.shiftright(F.col("_v") - low, shift)
        placed = counts.withColumns({"_prefix": F.shiftright(digit, BITS), "_next": digit})
        open_ = targets.select(*keys, "_prefix").distinct()
        near = placed.alias("a").join(open_.alias("b"), same("a", "b"), "left_semi")
        steps = near.groupBy(*keys, "_prefix", "_next").agg(F.sum("_n").alias("_n"))
        until = Window.partitionBy(*keys, "_prefix").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
        steps = steps.withColumn("_until", F.sum("_n").over(until))
        met = targets.alias("a").join(steps.alias("b"), same("a", "b"))
        met = met.where("a._left < b._until AND a._left >= b._until - b._n")
        targets = met.select(
            *[F.col(f"a.{x}").alias(x) for x in keys],
            "a._rank",
            F.col("b._next").alias("_prefix"),
            (F.col("a._left") - F.col("b._until") + F.col("b._n")).alias("_left"),
        )
        targets = stored(targets, "quantile-round")
    exact = targets.select(*keys, "_rank", (F.col("_prefix") + low).alias("_value"))

    def at_rank(frame: DataFrame, rank, name: str) -> DataFrame:
        other = exact.select(*[F.col(x).alias(f"_o{x}") for x in keys], F.col("_rank").alias("_or"), F.col("_value").alias(name))
        met = [F.col(x).eqNullSafe(F.col(f"_o{x}")) for x in keys]
        return frame.join(other, [*met, rank == F.col("_or")]).drop(*[f"_o{x}" for x in keys], "_or")

    found = at_rank(asked, F.col("_below"), "_from")
    found = at_rank(found, F.least(F.col("_below") + 1, F.col("n") - 1), "_to")
    quantile = (F.col("_from") + (F.col("_to") - F.col("_from")) * F.col("_part")) / F.lit(10.0**digits)
    return found.select(
        *[F.col(key).alias(x) for x, key in zip(by, keys, strict=True)], "probability", "n", quantile.alias("quantile")
    )
