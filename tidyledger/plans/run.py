"""A full run: raw rows in, report tables and a run-log line out."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from tidyledger.operators import classify, facts, kpi
from tidyledger.plans import report
from tidyledger.plans.quality import run_quality
from tidyledger.schema import ORDER_SCHEMA, DataQualityError, QualityPolicy, Schema
from tidyledger.session import drop_folder, shared_folder
from tidyledger.sources.sinks import append_run_log, trim_run_log, write_tables


@dataclass(frozen=True)
class RunOptions:
    output: str
    run_log: str | None = None
    data_source: str = "export"
    top_n: int = 5
    max_log_rows: int = 500
    digest_by: str | None = None
    table_format: str = "csv"
    writer: facts.Writer | None = None
    labeller: classify.Labeller | None = None
    categories: tuple[str, ...] = classify.CATEGORIES
    max_chars: int = facts.MAX_CHARS
    work: str | None = None  # folder for intermediate tables; else one in the session's shared folder


@dataclass(frozen=True)
class RunResult:
    run_id: str
    outcome: str
    message: str
    tables: list[str] = field(default_factory=list)
    run_log: str | None = None


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def full_run(
    raw: DataFrame,
    options: RunOptions,
    schema: Schema = ORDER_SCHEMA,
    policy: QualityPolicy | None = None,
) -> RunResult:
    """Quality, figures, sentences and classification, written as report tables.

    The audited and the clean rows, the digests, the replies and the labels are written
    once, so every table only scans what it needs and no injected function is called
    twice.  They are deleted when the run ends.  Bad input is a failed result.
    """
    folder = f"{options.work.rstrip('/')}/run-{uuid.uuid4().hex}" if options.work else None
    work = folder or shared_folder(raw.sparkSession, "run")
    try:
        return _run(raw, options, schema, policy, work)
    finally:
        drop_folder(raw.sparkSession, work)


def _run(
    raw: DataFrame, options: RunOptions, schema: Schema, policy: QualityPolicy | None, work: str
) -> RunResult:
    spark = raw.sparkSession
    started, clock = _now(), time.monotonic()
    run_id = f"{started.replace('-', '').replace(':', '')}-{uuid.uuid4().hex[:8]}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    try:
        run = run_quality(raw, schema, policy).written(f"{work}/audit")
        kpi.analytics_guard(run.clean, options.top_n, run.valid)
    except DataQualityError as error:
        return RunResult(run_id, "failed", str(error))
    clean = kept(run.clean, "clean")
    digests = kept(facts.facts_digest(clean, options.digest_by, options.max_chars), "digests")
    insights = kept(report.report_insights(digests, options.writer), "insights")
    classified = None
    if "feedback" in clean.columns:
        labelled = classify.classify_text(clean, "feedback", options.labeller, options.categories)
        classified = kept(labelled, "classified")
    tables = report.build_report(run, clean, digests, insights, classified)
    tables["Top_Products"] = kpi.top_products(clean, options.top_n)
    tables["Bottom_Products"] = kpi.bottom_products(clean, options.top_n)
    written = write_tables(tables, options.output, options.table_format)
    ai_status = report.insight_status(insights).first()["ai_status"]
    message = f"report written to {options.output}"
    if ai_status == "failed":
        message += "; the interpretation failed"
    details = {
        "run_id": run_id,
        "started_at": started,
        "finished_at": _now(),
        "duration_seconds": time.monotonic() - clock,
        "outcome": "success",
        "data_source": options.data_source,
        "ai_status": ai_status,
        "message": message,
    }
    row = kept(report.run_log_row(run, clean, details), "log-row")
    summary = report.run_summary(row, {"mode": options.table_format}, list(tables))
    summary.write.mode("overwrite").text(f"{options.output.rstrip('/')}/run_summary")
    if options.run_log is not None:
        append_run_log(row, options.run_log)
        trim_run_log(spark, options.run_log, options.max_log_rows)
    return RunResult(run_id, "success", message, written, options.run_log)
