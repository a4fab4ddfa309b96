"""Results that need several looks at the rows compute them once, in code that the JVM compiles."""

import re
import time
from datetime import date, datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from tidyledger.operators import dedupe, kpi, prepare, timeline
from tidyledger.plans.quality import partition_difference, run_quality
from tidyledger.plans.queries import QUERIES
from tidyledger.schema import ORDER_SCHEMA, SOURCE_ROW
from tidyledger.session import CLEANUP, deliver, stored
from tidyledger.sources import sinks, tables
from tidyledger.sources.grid import grid_from_values
from tidyledger.streaming import figures

SMALL = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def run(spark, dirty):
    return run_quality(grid_from_values(spark, dirty), gate=False)


def test_cells_are_parsed_outside_of_the_one_method_of_a_stage(run):
    for frame in (prepare.typed_cells(run.source, ORDER_SCHEMA), prepare.coerce(run.source, ORDER_SCHEMA)):
        text = plan(frame.select("date", "unit_price"))
        assert re.search(r"^(\+- )?Project \[", text, re.M) and not re.search(r"\*\(\d+\) Project \[", text)


def test_summary_computes_the_rows_once(run):
    assert plan(run.summary).count("Scan ExistingRDD") == 1
    row = run.summary.first()
    assert row.total_rows == row.valid_rows + row.rejected_rows == 20
    assert (row.duplicate_ids, row.duplicate_rows) == (2, 2)


def test_partition_reads_written_flags(run):
    broken = partition_difference(run)
    assert "Scan ExistingRDD" not in plan(broken) and broken.isEmpty()


def test_issues_read_written_rows(run):
    assert "Scan ExistingRDD" not in plan(run.issues)
    assert {(r.source_row, r.code) for r in run.issues.collect() if r.code == "DUPLICATE_ORDER_ID"} == {
        (4, "DUPLICATE_ORDER_ID"), (5, "DUPLICATE_ORDER_ID")
    }


def test_duplicates_compute_the_rows_once(spark):
    random = Random(4)
    rows = [(n, random.choice([None, "hot", "hot", "hot", f"k{random.randrange(300)}"])) for n in range(800)]
    rows += rows[:20]  # one row twice shares its place
    frame = spark.createDataFrame(rows, f"{SOURCE_ROW} bigint, key string")
    least = {key: min(n for n, k in rows if k == key) for _, key in rows}
    later = sorted((r for r in rows if r[0] > least[r[1]]), key=repr)
    several = sorted((r for r in rows if [k for _, k in rows].count(r[1]) > 1), key=repr)
    for operator, expected in ((dedupe.later_duplicates, later), (dedupe.duplicated_rows, several)):
        found = operator(frame, "key")
        assert plan(found).count("Scan ExistingRDD") == 1
        assert sorted(map(tuple, found.collect()), key=repr) == expected


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(12,2)"])
def test_trailing_totals_only_use_frames_that_grow(spark, kind):
    random, start = Random(9), datetime(2025, 1, 1)
    rows = [(n, random.choice("ab"), start + timedelta(seconds=random.randrange(20_000)), random.choice([None, 1, 2, 5]))
            for n in range(400)]
    rows += [(1000 + n, "a", None, 3) for n in range(3)]
    frame = spark.createDataFrame(rows, "id int, kind string, at timestamp, value int")
    frame = frame.withColumn("value", F.col("value").cast(kind))
    found = timeline.trailing_total(frame, ["kind"], "at", F.col("value"), "total", 3600)
    assert "RangeFrame, -" not in plan(found)
    for r in found.collect():
        near = [v or 0 for _, k, at, v in rows if k == r.kind and at and r.at and timedelta(0) <= r.at - at < timedelta(hours=1)]
        assert r.total == (sum(near) if r.at else None)


def test_placeholder_and_guard_read_no_lines_again(spark, monkeypatch):
    assert "lineitem" not in plan(QUERIES["report_placeholder"](spark, SMALL))
    asked, real = [], kpi.analytics_available
    monkeypatch.setattr(kpi, "analytics_available", lambda rows, valid: asked.append(plan(valid)) or real(rows, valid))
    outcomes = [tuple(r) for r in QUERIES["analytics_guard"](spark, SMALL).collect()]
    assert len(asked) == 4 and not [text for text in asked if "lineitem" in text]
    assert [available for _, available, _ in outcomes] == [True, False, False, False]


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", found))


def test_shuffle_files_go_with_the_table_they_were_for(spark):
    before = shuffle_files(spark)
    table = stored(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.count("*").alias("n")), "cleanup")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP) != "true"
    assert sorted(map(tuple, table.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_rows_are_written_once_for_all_arrivals(spark, tmp_path):
    rows = spark.range(10).select((F.col("id") + 2).alias(SOURCE_ROW), F.lit("x").alias("cell")).where(f"{SOURCE_ROW} % 3 <> 1")
    parts = tables.staged_parts(rows, str(tmp_path / "staged"), 3)
    seen = []
    for part in parts:
        deliver(spark, part, str(tmp_path / "arrivals"))
        found = spark.read.schema(rows.schema).parquet(str(tmp_path / "arrivals"))
        seen.append(sorted(r.source_row for r in found.collect()))
    assert seen == [[3, 6, 9], [3, 6, 9], [2, 3, 5, 6, 8, 9, 11]]
    assert not list((tmp_path / "staged").rglob("part-*.parquet"))


def test_a_batch_leaves_no_second_copy_of_its_rows(spark, tmp_path):
    plan_ = figures.FigurePlan("k", SOURCE_ROW, ("dim",), "who", {"v": "v"}, buckets=2)
    for epoch, first in enumerate((5, 1)):
        rows = spark.createDataFrame([(first, "a", "x", "w", 1 + epoch), (first + 1, "b", "x", "u", 1)],
                                     f"{SOURCE_ROW} bigint, k string, dim string, who string, v bigint")
        figures.apply_batch(rows, epoch, str(tmp_path), plan_)
        assert spark.read.parquet(f"{tmp_path}/batches/epoch={epoch}").isEmpty()
    assert [tuple(r) for r in figures.figures(spark, str(tmp_path), plan_, ["dim"]).collect()] == [("x", 2, 3, 2)]


def test_figures_of_sets_count_customers_apart_from_sums(spark):
    rows = spark.createDataFrame(
        [("a", "x", date(2025, 1, 1), "ann", 1, 2, "Completed"), ("a", None, date(2025, 1, 2), "ann", 2, 3, "Completed"),
         (None, "x", None, "bob", 4, 5, "Refunded"), ("b", "x", date(2025, 1, 3), None, 1, 1, None)],
        "product string, region string, date date, customer string, quantity bigint, revenue bigint, status string",
    )
    rows = rows.withColumns({"date": F.col("date").cast("timestamp_ntz"), "revenue": F.col("revenue").cast("decimal(12,2)")})
    found = {(r.dimension, r.key): (r.order_count, r.distinct_customers, r.total_quantity, r.gross_revenue)
             for r in kpi.multi_dimension(rows, ["product", "region"]).collect()}
    assert found == {
        ("overall", None): (4, 2, 8, 11.0), ("product", "a"): (2, 1, 3, 5.0), ("product", None): (1, 1, 4, 5.0),
        ("product", "b"): (1, 0, 1, 1.0), ("region", "x"): (3, 2, 6, 8.0), ("region", None): (1, 1, 2, 3.0),
    }


def test_a_report_may_be_written_compressed(spark, tmp_path):
    frame = spark.createDataFrame([("a\nb", ""), ('say "x"', None)], "p string, q string")
    path = sinks.write_tables({"t": frame}, str(tmp_path), compression="gzip")[0]
    assert list((tmp_path / "t").glob("*.csv.gz"))
    assert sorted(map(tuple, sinks.read_table_csv(spark, path).collect())) == [("a\nb", ""), ('say "x"', "")]
