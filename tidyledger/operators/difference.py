"""What changed between two written versions of a table.

A version is written in buckets of its key, with a digest for each bucket.  Digests are
summed up to one for each branch of ``FAN`` buckets; only buckets of differing branches are compared, and
only buckets whose digests differ are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 16


def write_version(rows: DataFrame, folder: str, keys: Sequence[str], buckets: int = 256) -> None:
    """Write ``rows`` below ``folder``: ``rows/bucket=N`` and the digests of the buckets.

    Rows are dealt by bucket and by a hash of the whole row, so a key that repeats does not lie
    in one task.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    dealt = rows.withColumn("bucket", bucket)
    whole = dealt.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(4)))
    whole.write.partitionBy("bucket").parquet(f"{folder}/rows")
    # A sum, unlike an exclusive or, sees rows that come twice; nulls are hashed by their place.
    cells = [F.struct(F.col(x).isNull().alias("no"), F.col(x)) for x in rows.columns]
    digest = F.xxhash64(*cells).cast("decimal(20,0)")
    second = F.xxhash64(F.lit(1), *cells).cast("decimal(20,0)")
    digests = dealt.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum(digest).alias("first"), F.sum(second).alias("second")
    )
    digests.write.parquet(f"{folder}/digests")


def changed_buckets(spark: SparkSession, before: str, after: str) -> list[int]:
    """Buckets whose digests differ; at most as many numbers as the version has buckets."""
    sides = [spark.read.parquet(f"{folder}/digests") for folder in (before, after)]
    parts = ["n", "first", "second"]

    def differing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
        a, b = a.select(key, F.struct(*parts).alias("a")), b.select(key, F.struct(*parts).alias("b"))
        return a.join(b, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(key)

    branch = F.floor(F.col("bucket") / FAN).alias("branch")
    tops = [x.groupBy(branch).agg(*[F.sum(p).alias(p) for p in parts]) for x in sides]
    open_ = differing(*tops, "branch")
    leaves = [x.withColumn("branch", branch).join(open_, "branch", "left_semi") for x in sides]
    return sorted(x["bucket"] for x in differing(*leaves, "bucket").collect())


def read_changed(spark: SparkSession, folder: str, buckets: Sequence[int]) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows").where(F.col("bucket").isin(list(buckets))).drop("bucket")


def cell_changes(spark: SparkSession, before: str, after: str, keys: Sequence[str]) -> DataFrame:
    """``(keys, change, column, before, after)``: one row for each added or removed row, one for each changed cell.

    ``keys`` identify a row in both versions (null keys are keys).  Cells come out as text.
    """
    buckets = changed_buckets(spark, before, after)
    old, new = (read_changed(spark, folder, buckets) for folder in (before, after))
    columns = [x for x in old.columns if x not in keys]
    if set(columns) != {x for x in new.columns if x not in keys}:
        raise ValueError("the versions have different columns")

    def side(rows: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.col(x).cast("string") for x in columns]).alias(name)
        return rows.select(*[F.col(x).alias(f"{name}_{x}") for x in keys], cells, F.lit(True).alias(f"{name}_there"))

    a, b = side(old, "a"), side(new, "b")
    both = a.join(b, [F.col(f"a_{x}").eqNullSafe(F.col(f"b_{x}")) for x in keys], "full_outer")
    whole = F.when(F.col("a_there").isNull(), F.lit("added")).when(F.col("b_there").isNull(), F.lit("removed"))
    nothing = F.lit(None).cast("string")
    row = F.array(F.struct(F.lit("*").alias("column"), nothing.alias("before"), nothing.alias("after")))
    cells = F.array(
        *[
            F.struct(F.lit(x).alias("column"), F.col("a")[k].alias("before"), F.col("b")[k].alias("after"))
            for k, x in enumerate(columns)
        ]
    )
    differing = F.filter(cells, lambda x: ~x["before"].eqNullSafe(x["after"]))
    listed = both.select(
        *[F.when(F.col("a_there").isNull(), F.col(f"b_{x}")).otherwise(F.col(f"a_{x}")).alias(x) for x in keys],
        F.coalesce(whole, F.lit("changed")).alias("change"),
        F.explode(F.when(whole.isNotNull(), row).otherwise(differing)).alias("cell"),
    )
    return listed.select(*keys, "change", "cell.*")
