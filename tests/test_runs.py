import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import HEADERS, order
from tidyledger.plans.quality import run_quality
from tidyledger.plans.run import RunOptions, full_run
from tidyledger.schema import SOURCE_ROW
from tidyledger.session import shared_folder, stored
from tidyledger.sources import sinks
from tidyledger.sources.grid import grid_from_values
from tidyledger.streaming import incremental


def arrive(spark, folder, first_row, rows):
    data = [(first_row + i, *row) for i, row in enumerate(rows)]
    schema = "source_row bigint, " + ", ".join(f"`{name}` string" for name in HEADERS)
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


def test_incremental_runs(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    source, out = f"{root}/in", f"{root}/out"

    def run_once():
        stream = incremental.read_raw_stream(spark, source, tuple(HEADERS))
        return incremental.incremental_quality(stream, out)

    arrive(spark, source, 2, [order(Order_ID="A"), order(Order_ID="B"), order(Order_ID="A", Qty="3"), order(Order_ID="C", Qty="0")])
    assert run_once() == [0]
    arrive(spark, source, 6, [order(Order_ID="B", Qty="9"), order(Order_ID="C"), order(Order_ID="D", Region="x"), order(Order_ID="B")])
    assert run_once() == [1]
    assert run_once() == []  # nothing new
    clean = incremental.batch_table(spark, incremental.output(out, "clean"))
    assert sorted((r.order_id, r[SOURCE_ROW]) for r in clean.collect()) == [("A", 2), ("B", 3), ("C", 7)]
    rejected = incremental.batch_table(spark, incremental.output(out, "rejected"))
    assert sorted(r[SOURCE_ROW] for r in rejected.collect()) == [5, 8]
    log = incremental.batch_table(spark, incremental.output(out, "run_log")).orderBy("batch_id").collect()
    assert [(r.rows_read, r.rows_valid, r.rows_rejected, r.rows_cleaned, r.rows_repeated) for r in log] == [
        (4, 3, 1, 2, 0), (4, 3, 1, 1, 1)]
    findings = incremental.batch_table(spark, incremental.output(out, "findings"))
    repeated = findings.filter("code = 'DUPLICATE_ORDER_ID'").orderBy("batch_id", "message").collect()
    assert [(r.batch_id, r.records, r.examples) for r in repeated] == [
        (0, 1, "row 4: 'A'"), (1, 1, "row 9: 'B'"), (1, 1, "row 6: B")]
    actions = incremental.batch_table(spark, incremental.output(out, "actions"))
    removed = actions.filter("action = 'duplicate_orders_removed'").orderBy("batch_id").collect()
    assert [(r.batch_id, r.records, r.examples) for r in removed] == [(0, 1, "rows 4"), (1, 2, "rows 6, 9")]


def test_a_run_that_broke_off_is_finished_by_the_next(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    source, out = f"{root}/in", f"{root}/out"
    arrive(spark, source, 2, [order(Order_ID="A"), order(Order_ID="B")])

    def broken(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(incremental, "settle_batch", broken)
        with pytest.raises(RuntimeError):
            incremental.incremental_quality(incremental.read_raw_stream(spark, source, tuple(HEADERS)), out)
    arrive(spark, source, 4, [order(Order_ID="A"), order(Order_ID="C")])
    assert incremental.incremental_quality(incremental.read_raw_stream(spark, source, tuple(HEADERS)), out) == [0, 1]
    clean = incremental.batch_table(spark, incremental.output(out, "clean"))
    assert sorted((r.order_id, r[SOURCE_ROW]) for r in clean.collect()) == [("A", 2), ("B", 3), ("C", 5)]


def test_repeated_batch_leaves_the_same_files(spark, dirty):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    raw = grid_from_values(spark, dirty)
    from tidyledger.schema import ORDER_SCHEMA, QualityPolicy

    for _ in range(2):
        incremental.check_batch(raw, 0, root, ORDER_SCHEMA, QualityPolicy())
    candidates = incremental.batch_table(spark, incremental.output(root, "candidates"))
    assert candidates.count() == 10


def test_full_run(spark, dirty):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    raw = grid_from_values(spark, dirty)
    result = full_run(raw, RunOptions(f"{root}/report", f"{root}/log", digest_by="region"))
    assert result.outcome == "success"
    log = sinks.read_run_log(spark, result.run_log).collect()
    assert [(r.rows_cleaned, r.ai_status) for r in log] == [(10, "generated")]
    assert {r.rows_read for r in log} == {21}
    names = {path.rsplit("/", 1)[1] for path in result.tables}
    assert {"Clean_Data", "Data_Quality", "KPI_Summary", "Product_Analysis", "AI_Insights", "Feedback_Analysis"} <= names
    clean = sinks.read_table_csv(spark, f"{root}/report/Clean_Data")
    assert clean.columns[:3] == [SOURCE_ROW, "date", "order_id"] and clean.columns[-1] == "feedback"
    assert clean.count() == 10
    summary = spark.read.json(f"{root}/report/run_summary").first()
    assert summary.outcome == "success" and summary.rows_rejected == 8


def test_injected_functions_are_called_once(spark, dirty):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    asked, labelled = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def write(digest):
        asked.add(1)
        return "no json"

    def label(batch):
        labelled.add(len(batch))
        return ["neutral"] * len(batch)

    options = RunOptions(f"{root}/report", f"{root}/log", digest_by="region", writer=write, labeller=label)
    result = full_run(grid_from_values(spark, dirty), options)
    clean = sinks.read_table_csv(spark, f"{root}/report/Clean_Data")
    assert asked.value == clean.select("region").distinct().count()
    assert labelled.value == clean.filter("feedback <> ''").count()
    log = sinks.read_run_log(spark, result.run_log).first()
    assert (log.outcome, log.ai_status) == ("success", "failed") and "interpretation failed" in log.message


def test_intermediate_tables_go_when_the_run_ends(spark, dirty):
    import os

    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    full_run(grid_from_values(spark, dirty), RunOptions(f"{root}/report", work=f"{root}/work"))
    assert os.listdir(f"{root}/work") == []


def test_full_run_reports_bad_input(spark):
    result = full_run(grid_from_values(spark, [HEADERS]), RunOptions("/tmp/unused"))
    assert result.outcome == "failed" and "no data rows" in result.message


def test_nothing_found_is_said(spark):
    from tidyledger.plans import report

    run = run_quality(grid_from_values(spark, [HEADERS, order()]))
    rows = report.or_placeholder(report.rejected_table(run), report.NOTHING["rejected"]).collect()
    assert [r.reason for r in rows] == ["no records were rejected"]
    found = report.or_placeholder(run.findings, report.NOTHING["findings"]).collect()
    assert [(r.code, r.records) for r in found] == [("none", 0)]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_unverified_numbers_reach_the_report(spark):
    from tidyledger.operators import facts
    from tidyledger.plans import report

    rows = [order(Order_ID=f"T-{i}", Order_Date=f"2025-0{1 + i % 2}-05") for i in range(6)]
    clean = stored(run_quality(grid_from_values(spark, [HEADERS, *rows])).clean, "clean")
    digests = stored(facts.facts_digest(clean), "digests")
    insights = facts.interpret(digests, lambda text: '{"executive_summary": "hit 999999.99 and 120.0"}')
    lines = {r.section: r.text for r in report.insight_rows(digests, insights).collect()}
    assert lines["Numbers not matched to a calculated metric"] == "1e+06"
    assert lines["Executive summary"] == "hit 999999.99 and 120.0"
    failed = report.insight_rows(digests, facts.interpret(digests, lambda text: "prose")).collect()
    assert [r.text for r in sorted(failed, key=lambda r: r.line)][0] == "failed"
    assert {r.section for r in failed} == {"Status"}


def test_shared_folder_follows_the_cluster_setting(spark, monkeypatch):
    class Settings:
        def get(self, name, default=None):
            return "hdfs://cluster/checkpoints/" if name == "spark.checkpoint.dir" else default

    class Session:
        conf = Settings()

    assert shared_folder(Session(), "clean").startswith("hdfs://cluster/checkpoints/clean-")


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return default

        class sparkContext:  # noqa: N801
            master = "yarn"

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        Session.sparkContext.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(Session(), "clean")
