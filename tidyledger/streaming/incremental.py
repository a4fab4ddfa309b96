"""Recurring quality runs over newly arrived files, with Structured Streaming.

The row rules need no other row, so a micro-batch runs through the same plan as a batch
run.  Which key came first over all batches is kept by a second stream: an aggregation
over the keys of the batches, whose state store looks up the keys of a batch instead of
reading all earlier ones, so a batch costs what it holds, however long the history is.
The first arrival of a key wins, within a batch the smallest source row.

Outputs are folders of ``batch_id=<n>`` directories that are overwritten, so a step that
is repeated after a failure leaves the same files as one that ran once.  A batch is done
when its line in ``run_log`` is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyledger.operators import clean as cleaning
from tidyledger.operators import dedupe, validate
from tidyledger.plans.quality import QualityRun, run_quality
from tidyledger.schema import ORDER_SCHEMA, SOURCE_ROW, QualityPolicy, Schema
from tidyledger.session import CLEANUP, setting
from tidyledger.sources.grid import HeaderMapping, plan_headers

BATCH = "batch_id"
EPOCH = "epoch"
REPEATED_LATER = "order id was accepted in an earlier batch"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def output(root: str, name: str) -> str:
    """Folder of one output; it holds ``batch_id=<n>`` directories."""
    return f"{root.rstrip('/')}/{name}"


def _write(df: DataFrame, folder: str, number: int, by: str = BATCH) -> None:
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.mode("overwrite").parquet(f"{folder}/{by}={number}")


def _read(spark: SparkSession, root: str, name: str, batch: int) -> DataFrame:
    return spark.read.parquet(f"{output(root, name)}/{BATCH}={batch}")


def _numbers(spark: SparkSession, folder: str, by: str = BATCH) -> list[int]:
    """Numbers of the complete directories of an output (names only, no data)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path(folder)):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(path(folder))]
    numbers = [name.removeprefix(f"{by}=") for name in names if name.startswith(f"{by}=")]
    return sorted(int(n) for n in numbers if system.exists(path(f"{folder}/{by}={n}/_SUCCESS")))


# ---------------------------------------------------------------------------
# Steps of a batch
# ---------------------------------------------------------------------------
def check_batch(rows: DataFrame, batch: int, root: str, schema: Schema, policy: QualityPolicy) -> None:
    """Parse and check the rows of a batch; its first rows by key are candidates."""
    spark = rows.sparkSession
    run = run_quality(rows, schema, policy, gate=False)
    _write(run.audit, output(root, "audit"), batch)
    run = _checked(spark, root, batch, schema, policy, run.mapping)
    first = dedupe.keep_first(validate.valid_rows(run.checked), policy.duplicate_column)
    _write(first, output(root, "candidates"), batch)
    _write(first.select(F.col(policy.duplicate_column).alias("key"), SOURCE_ROW), output(root, "keys"), batch)


def _checked(
    spark: SparkSession, root: str, batch: int, schema: Schema, policy: QualityPolicy, mapping: HeaderMapping
) -> QualityRun:
    audit = _read(spark, root, "audit", batch)
    return QualityRun(audit, mapping, schema, policy, kept=audit)


def _first_arrivals(spark: SparkSession, root: str) -> None:
    """Bring the state of all keys up to date; touched keys go to ``arrivals`` with their first row."""
    fields = f"key string, {SOURCE_ROW} bigint, {BATCH} int"
    keys = spark.readStream.schema(fields).parquet(output(root, "keys"))
    first = keys.groupBy("key").agg(F.min(F.struct(BATCH, SOURCE_ROW)).alias("first"))

    def handle(touched: DataFrame, epoch: int) -> None:
        _write(touched, output(root, "arrivals"), epoch, EPOCH)

    with setting(spark, STORE, ROCKSDB):
        query = (
            first.writeStream.foreachBatch(handle)
            .outputMode("update")
            .option("checkpointLocation", output(root, "_checkpoint_keys"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def settle_batch(
    spark: SparkSession,
    arrivals: DataFrame,
    batch: int,
    root: str,
    schema: Schema,
    policy: QualityPolicy,
    mapping: HeaderMapping,
) -> None:
    """Outputs of a batch: clean rows, quarantine, findings, actions and a log line.

    A key that came in an earlier batch is a finding and an action of this one.
    """
    key = policy.duplicate_column
    run = _checked(spark, root, batch, schema, policy, mapping)
    candidates = _read(spark, root, "candidates", batch)
    placed = candidates.join(arrivals, F.col(key) == F.col("key"))
    mine = F.col("first.batch_id") == batch
    accepted = placed.filter(mine).select(candidates.columns)
    _write(cleaning.apply_value_rules(accepted, schema), output(root, "clean"), batch)
    _write(run.rejected, output(root, "rejected"), batch)
    earlier = placed.filter(~mine).select(SOURCE_ROW, key, F.col("first.batch_id").alias("first_batch"))
    _write(earlier, output(root, "repeated"), batch)
    repeated = _read(spark, root, "repeated", batch)
    example = F.concat(F.lit("row "), F.col(SOURCE_ROW), F.lit(": "), F.col(key))
    listed = repeated.orderBy(SOURCE_ROW).limit(validate.EXAMPLES).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct(SOURCE_ROW, example.alias("t"))))["t"], "; ").alias("examples")
    )
    count = repeated.agg(F.count("*").alias("records"))
    both = count.unionByName(listed, allowMissingColumns=True)
    found = both.agg(F.max("records").alias("records"), F.max("examples").alias("examples")).filter("records > 0")
    found = found.select(
        F.lit(validate.DUPLICATE_ORDER_ID).alias("code"),
        F.lit("warning").alias("severity"),
        F.lit(key).alias("column"),
        "records",
        F.lit(REPEATED_LATER).alias("message"),
        "examples",
    )
    _write(run.findings.unionByName(found), output(root, "findings"), batch)
    entered = _read(spark, root, "clean", batch).select(SOURCE_ROW)
    actions = cleaning.preparation_actions(run.audit, schema, mapping).unionByName(
        cleaning.cleaning_actions(run.checked, schema, policy, entered)
    )
    _write(actions, output(root, "actions"), batch)
    counts = run.checked.agg(
        F.count("*").alias("rows_read"),
        F.count_if(~F.col(validate.REJECTED)).alias("rows_valid"),
        F.count_if(F.col(validate.REJECTED)).alias("rows_rejected"),
    )
    cleaned = _read(spark, root, "clean", batch).agg(F.count("*").alias("rows_cleaned"))
    late = repeated.agg(F.count("*").alias("rows_repeated"))
    names = ("rows_read", "rows_valid", "rows_rejected", "rows_cleaned", "rows_repeated")
    parts = counts.unionByName(cleaned, allowMissingColumns=True).unionByName(late, allowMissingColumns=True)
    _write(parts.agg(*[F.max(name).alias(name) for name in names]), output(root, "run_log"), batch)


# ---------------------------------------------------------------------------
# Runs
# ---------------------------------------------------------------------------
def incremental_quality(
    stream: DataFrame,
    folder: str,
    schema: Schema = ORDER_SCHEMA,
    policy: QualityPolicy | None = None,
) -> list[int]:
    """Process all files that have arrived since the last run; returns the batches that were settled.

    A run that breaks off is finished by the next one.
    """
    policy = policy or QualityPolicy()
    spark = stream.sparkSession
    headers = [name for name in stream.columns if name != SOURCE_ROW]
    mapping = plan_headers(headers, schema)

    def handle(rows: DataFrame, batch: int) -> None:
        check_batch(rows, batch, folder, schema, policy)

    arrived = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", output(folder, "_checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    arrived.awaitTermination()
    done = set(_numbers(spark, output(folder, "run_log")))
    waiting = [n for n in _numbers(spark, output(folder, "keys")) if n not in done]
    if not waiting:
        return []
    _first_arrivals(spark, folder)
    settled = set(_numbers(spark, output(folder, "settled"), EPOCH))
    epochs = [n for n in _numbers(spark, output(folder, "arrivals"), EPOCH) if n not in settled]
    paths = [f"{output(folder, 'arrivals')}/{EPOCH}={n}" for n in epochs]
    arrivals = spark.read.parquet(*paths).groupBy("key").agg(F.min("first").alias("first"))
    for batch in waiting:
        settle_batch(spark, arrivals, batch, folder, schema, policy, mapping)
    for epoch in epochs:
        _write(spark.range(1), output(folder, "settled"), epoch, EPOCH)
    return waiting


def read_raw_stream(
    spark: SparkSession, folder: str, headers: tuple[str, ...], files_per_batch: int | None = None
) -> DataFrame:
    """Raw exports as a stream of Parquet files: ``source_row`` plus text cells."""
    fields = [T.StructField(SOURCE_ROW, T.LongType())]
    fields += [T.StructField(header, T.StringType()) for header in headers]
    reader = spark.readStream.schema(T.StructType(fields))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def batch_table(spark: SparkSession, folder: str) -> DataFrame:
    """All batches of an output; an empty batch reads as no rows."""
    return spark.read.option("basePath", folder).parquet(folder)
