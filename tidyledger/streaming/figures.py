"""Figures kept up to date from arriving batches, duplicates that move included.

Of all rows with one key, over all batches, the one with the smallest order counts.  A batch
that brings a smaller row for a key moves it: the row that counted before is taken back, the
new one is added.  Figures are sums over cells (one for each combination of dimensions and
member), which merge: every batch leaves only its differences, and adding them up gives what
a computation over all rows would give.  A cell has a row count, so a member whose rows were
all taken back is no longer counted.

Folders below the run's folder, one directory for each batch, overwritten if a batch is repeated:

* ``batches``: the best row of each key of the batch, emptied when the batch is done,
* ``winners``: keys whose row changed, with the row before; a row only gives way to a smaller
  one, so the smallest entry of a key is its present row,
* ``deltas``: differences of the cells.

A batch looks up its own keys only, in the key buckets that it touches.  :func:`compact` folds
the directories so far into one; results are the same before and after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.session import CLEANUP, setting
from tidyledger.streaming.incremental import EPOCH, _numbers, _write, output

BUCKET = "bucket"


@dataclass(frozen=True)
class FigurePlan:
    """What is kept: ``sums`` gives a SQL expression for the contribution of a row by name.

    A null key is a key, a null order is the smallest, a null contribution is 0; null dimensions
    are groups of their own and null members are not counted.
    """

    key: str
    order: str
    dimensions: tuple[str, ...]
    member: str
    sums: dict[str, str]
    buckets: int = 256

    @property
    def cell(self) -> list[str]:
        return [*self.dimensions, self.member]

    def entry(self) -> Column:
        """What is kept of a row; entries are compared by order first, ties by what they hold."""
        parts = [F.coalesce(F.expr(sql), F.lit(0)).alias(name) for name, sql in self.sums.items()]
        return F.struct(F.col(self.order).alias("order"), *self.cell, *parts)


def _directories(spark: SparkSession, folder: str, name: str, before: int | None = None) -> list[str]:
    """Directories of an output before a batch: the last folded one and those after it."""
    folded = [n for n in _numbers(spark, output(folder, f"{name}_folded"), EPOCH) if before is None or n < before]
    last = folded[-1] if folded else -1
    single = [n for n in _numbers(spark, output(folder, name), EPOCH) if n > last and (before is None or n < before)]
    found = [f"{output(folder, f'{name}_folded')}/{EPOCH}={last}"] if folded else []
    return found + [f"{output(folder, name)}/{EPOCH}={n}" for n in single]


def _read_all(spark: SparkSession, paths: Sequence[str], schema: str | None = None) -> DataFrame | None:
    """The union of directories; one plan node for each, as sums may have grown wider in folded ones."""
    union = None
    for path in paths:
        rows = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
        union = rows if union is None else union.unionByName(rows)
    return union


def _bucketed(df: DataFrame, path: str) -> None:
    with setting(df.sparkSession, CLEANUP, "true"):
        df.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def present_rows(spark: SparkSession, folder: str, before: int, buckets: Sequence[int]) -> DataFrame | None:
    """``(key, was)``: the rows that counted for a key before a batch, read from the given buckets."""
    paths = _directories(spark, folder, "winners", before)
    if not paths:
        return None
    known = [n for n in _numbers(spark, output(folder, "batches"), EPOCH) if n < before]
    log = _read_all(spark, paths, _winner_schema(spark, folder, known[-1]))
    return log.where(F.col(BUCKET).isin(list(buckets))).select("key", F.col("won").alias("was"))


def apply_batch(rows: DataFrame, epoch: int, folder: str, plan: FigurePlan) -> None:
    """Bring the figures up to date with the rows of one batch."""
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(plan.key)), F.lit(plan.buckets)).cast("int")
    best = rows.groupBy(F.col(plan.key).alias("key"), bucket.alias(BUCKET)).agg(F.min(plan.entry()).alias("won"))
    _write(best, output(folder, "batches"), epoch, EPOCH)
    best = _best(spark, folder, epoch)
    touched = [row[0] for row in best.select(BUCKET).distinct().collect()]  # at most the number of buckets
    before = present_rows(spark, folder, epoch, touched)
    if before is None:
        moved = best.withColumn("was", F.lit(None).cast(best.schema["won"].dataType))
    else:
        keys = best.select(F.col("key").alias("mine"))
        mine = before.join(keys, F.col("key").eqNullSafe(F.col("mine")), "left_semi")
        latest = mine.groupBy(F.col("key").alias("old_key")).agg(F.min("was").alias("was"))
        moved = best.join(latest, F.col("key").eqNullSafe(F.col("old_key")), "left").drop("old_key")
        moved = moved.where("was IS NULL OR won < was")
    winners = f"{output(folder, 'winners')}/{EPOCH}={epoch}"
    _bucketed(moved.select("key", "won", "was", BUCKET), winners)
    written = _read_all(spark, [winners], _winner_schema(spark, folder, epoch))
    _write(_differences(written, plan), output(folder, "deltas"), epoch, EPOCH)
    # The winners hold what counts; later batches only read the columns' types here.
    _write(spark.createDataFrame([], best.schema), output(folder, "batches"), epoch, EPOCH)


def _best(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    return spark.read.parquet(f"{output(folder, 'batches')}/{EPOCH}={epoch}")


def _winner_schema(spark: SparkSession, folder: str, epoch: int) -> str:
    """Columns of ``winners``; a batch that moves nothing leaves no file to read them from."""
    best = _best(spark, folder, epoch)
    key, won = best.schema["key"].dataType.simpleString(), best.schema["won"].dataType.simpleString()
    return f"key {key}, won {won}, was {won}, {BUCKET} int"


def _differences(winners: DataFrame, plan: FigurePlan) -> DataFrame:
    """``(dimensions, member, rows, sums)``: what the moved keys change."""
    signed = [F.struct(F.lit(sign).alias("sign"), F.col(x).alias("row")) for sign, x in ((1, "won"), (-1, "was"))]
    parts = winners.select(F.inline(F.array(*signed))).where("row IS NOT NULL").select("sign", "row.*")
    added = F.col("sign") > 0
    return parts.groupBy(*plan.cell).agg(
        F.sum("sign").alias("rows"),
        *[F.sum(F.when(added, F.col(name)).otherwise(-F.col(name))).alias(name) for name in plan.sums],
    )


def cells(spark: SparkSession, folder: str, plan: FigurePlan) -> DataFrame:
    """``(dimensions, member, rows, sums)`` of all batches so far; cells without a row are gone."""
    deltas = _read_all(spark, _directories(spark, folder, "deltas"))
    if deltas is None:
        raise ValueError(f"{folder}: no batch has arrived")
    return _summed(deltas, plan).where("rows > 0")


def _summed(deltas: DataFrame, plan: FigurePlan) -> DataFrame:
    return deltas.groupBy(*plan.cell).agg(F.sum("rows").alias("rows"), *[F.sum(x).alias(x) for x in plan.sums])


def figures(spark: SparkSession, folder: str, plan: FigurePlan, by: Sequence[str]) -> DataFrame:
    """``(by, rows, sums, members)`` for any of the plan's dimensions, from the cells alone."""
    return cells(spark, folder, plan).groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        *[F.sum(name).alias(name) for name in plan.sums],
        F.count_distinct(plan.member).alias("members"),
    )


def compact(spark: SparkSession, folder: str, plan: FigurePlan) -> None:
    """Fold all batches so far, so that later ones and readers open one directory for them.

    The directories that were folded stay until the folder is removed: a reader may have them open.
    """
    done = _numbers(spark, output(folder, "deltas"), EPOCH)
    if not done:
        return
    last = done[-1]
    paths = _directories(spark, folder, "deltas", last + 1)
    winners = _directories(spark, folder, "winners", last + 1)
    if len(paths) > 1:
        _write(_summed(_read_all(spark, paths), plan).where("rows <> 0"), output(folder, "deltas_folded"), last, EPOCH)
    if len(winners) > 1:
        log = _read_all(spark, winners, _winner_schema(spark, folder, last)).groupBy("key", BUCKET).agg(F.min("won").alias("won"))
        log = log.select("key", "won", F.lit(None).cast(log.schema["won"].dataType).alias("was"), BUCKET)
        _bucketed(log, f"{output(folder, 'winners_folded')}/{EPOCH}={last}")


def maintain(stream: DataFrame, folder: str, plan: FigurePlan) -> None:
    """Apply all rows that have arrived on a stream since the last run; a run that broke off is finished."""

    def handle(rows: DataFrame, epoch: int) -> None:
        apply_batch(rows, epoch, folder, plan)

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", output(folder, "_checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
