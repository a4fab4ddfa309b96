"""The registered queries: every operator over the driver tables.

Each query takes ``(spark, sf_dir)`` and reads whole tables.  Results carry
plain types (text, BIGINT, DOUBLE), so another engine can be compared directly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.functions import cells, texts
from tidyledger.operators import (
    classify,
    clean,
    dedupe,
    facts,
    kpi,
    numbercheck,
    prepare,
    replies,
    validate,
)
from tidyledger.plans import quality, report
from tidyledger.schema import (
    ORDER_MONTH,
    ORDER_SCHEMA,
    SOURCE_ROW,
    DataQualityError,
    QualityPolicy,
)
from tidyledger.session import deliver, shared_folder, stored
from tidyledger.sources import grid, sinks, tables
from tidyledger.streaming import incremental

# The largest generated line is just below 50 000, so this threshold is exceeded.
POLICY = QualityPolicy(outlier_threshold=40_000.0)
MONEY = ["quantity", "revenue", "status"]
SPEC = {spec.name: spec for spec in ORDER_SCHEMA}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under its function name."""
    QUERIES[function.__name__] = function
    return function


def _run(spark: SparkSession, sf_dir: str, feedback: bool = False, blanks: bool = False) -> quality.QualityRun:
    source = tables.raw_export if blanks else tables.raw_orders
    return quality.run_quality(source(spark, sf_dir, feedback), policy=POLICY, gate=False)


def _written(spark: SparkSession, sf_dir: str, blanks: bool = False) -> quality.QualityRun:
    """A run whose audited rows are written first, for results that scan them several times."""
    return _run(spark, sf_dir, blanks=blanks).written(shared_folder(spark, "checked"))


def _clean(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _run(spark, sf_dir).clean_columns(list(columns))


def _source(spark: SparkSession, sf_dir: str, feedback: bool = False, blanks: bool = False) -> DataFrame:
    read = tables.raw_export if blanks else tables.raw_orders
    return grid.map_headers(read(spark, sf_dir, feedback), ORDER_SCHEMA)[0]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(tables.read_table(spark, sf_dir, "documents"), "doc_id")


# ---------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------
@query
def grid_ragged_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = grid.read_numbered_parquet(spark, f"{sf_dir}/lineitem.parquet")
    values = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    whole = F.array(*[F.col(name).cast("string") for name in values], F.lit("end"))
    ragged = lines.select(SOURCE_ROW, F.slice(whole, F.lit(1), F.col("l_linenumber")).alias("cells"))
    return grid.grid_frame(ragged, ["Order", None, "Supplier", "N/A"])


@query
def csv_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three CSV files with their own column order, blank lines, and line breaks within cells."""
    root = shared_folder(spark, "csv")
    supplier = tables.read_table(spark, sf_dir, "supplier")
    customer = tables.read_table(spark, sf_dir, "customer")
    nation = tables.read_table(spark, sf_dir, "nation")
    files = {
        "a": (supplier, "s_suppkey", "Supplier,Nation,Note",
              F.concat(F.col("s_suppkey"), F.lit(","), F.col("s_nationkey"), F.lit(',"'), F.col("s_name"),
                       F.lit("\n"), F.col("s_suppkey"), F.lit('"'),
                       F.when(F.col("s_suppkey") % 5 == 0, "\n").otherwise(""))),
        "b": (customer, "c_custkey", "Note,Buyer,Supplier",
              F.concat(F.lit('"say ""'), F.col("c_name"), F.lit('"", ok",'), F.col("c_custkey"), F.lit(","),
                       F.col("c_custkey") % 100, F.when(F.col("c_custkey") % 7 == 0, ",over").otherwise(""))),
        "c": (nation, "n_nationkey", "Nation,Supplier", F.concat(F.col("n_name"), F.lit(","), F.col("n_nationkey"))),
    }
    for name, (rows, key, header, line) in files.items():
        start = spark.range(1).select(F.lit(None).cast("bigint").alias("o"), F.lit(header).alias("value"))
        text = start.unionByName(rows.select(F.col(key).cast("bigint").alias("o"), line.alias("value")))
        text.coalesce(1).sortWithinPartitions(F.asc_nulls_first("o")).select("value").write.text(f"{root}/{name}")
    return grid.read_csv_grid(spark, f"{root}/*")


@query
def source_row_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = grid.read_numbered_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return lines.select(SOURCE_ROW, "l_orderkey", "l_linenumber", "l_partkey")


@query
def source_row_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.read_table(spark, sf_dir, "events").select("event_id", "user_id")
    return grid.with_source_row(events)


@query
def sink_cell_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.read_table(spark, sf_dir, "lineitem")
    return sinks.format_cells(
        lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                     "l_tax", "l_returnflag", "l_shipdate")
    )


@query
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "report")
    table = report.clean_table(stored(_run(spark, sf_dir, feedback=True).clean, "clean"))
    path = sinks.write_tables({"Clean_Data": table}, folder, compression="gzip")[0]
    return sinks.read_table_csv(spark, path)


@query
def run_log_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "run-log")
    log = tables.read_table(spark, sf_dir, "events")
    sinks.append_run_log(log, folder)
    sinks.trim_run_log(spark, folder, 500, ("ts", "event_id"))
    return sinks.read_run_log(spark, folder).select("event_id", "user_id", "event_type", "value")


LOG_DETAILS = {
    "run_id": "run-1",
    "started_at": "2025-01-01T00:00:00Z",
    "finished_at": "2025-01-01T00:00:01Z",
    "duration_seconds": 1.0,
    "outcome": "success",
    "data_source": "export",
    "ai_status": "skipped",
    "message": "ok",
}


def _log_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _written(spark, sf_dir, blanks=True)
    return report.run_log_row(run, run.clean_columns(["revenue", "status"]), LOG_DETAILS)


@query
def run_log_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_row(spark, sf_dir)


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = report.run_summary(_log_row(spark, sf_dir), {"mode": "csv"}, ["Clean_Data"])
    fields = {"outcome": "string", "mode": "string", "rows_read": "bigint", "rows_valid": "bigint",
              "rows_rejected": "bigint", "rows_cleaned": "bigint", "net_revenue": "double"}
    return summary.select(
        *[F.get_json_object("summary", f"$.{n}").cast(t).alias(n) for n, t in fields.items()]
    )


# ---------------------------------------------------------------------------
# Cells
# ---------------------------------------------------------------------------
@query
def blank_cells_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _source(spark, sf_dir, feedback=True, blanks=True)
    names = prepare.data_columns(source)
    counts = source.agg(*[F.count_if(cells.is_blank(F.col(name))).alias(name) for name in names])
    entries = [F.struct(F.lit(n).alias("column"), F.col(n).alias("blank_cells")) for n in names]
    return counts.select(F.inline(F.array(*entries)))


@query
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return documents.select("doc_id", cells.normalise_text(F.col("text")).alias("text"))


@query
def map_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.raw_orders(spark, sf_dir, feedback=False)
    raw = raw.withColumns({"Cost Centre": F.col("Region"), "Units Sold": F.col("Qty")})
    mapped, _ = grid.map_headers(raw, ORDER_SCHEMA)
    names = prepare.data_columns(mapped)
    filled = mapped.agg(*[F.count_if(F.col(name) != "").alias(name) for name in names])
    entries = [
        F.struct(F.lit(p).alias("position"), F.lit(n).alias("name"), F.col(n).alias("filled"))
        for p, n in enumerate(names, start=1)
    ]
    return filled.select(F.inline(F.array(*entries)))


@query
def drop_blank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _source(spark, sf_dir, blanks=True)
    return prepare.drop_blank_rows(source).select(SOURCE_ROW, "order_id")


@query
def whitespace_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _source(spark, sf_dir, feedback=True, blanks=True)
    changes = prepare.whitespace_changes(source, ORDER_SCHEMA)
    return changes.groupBy("column").agg(F.count("*").alias("changed_cells"))


def _parsed(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    source = _source(spark, sf_dir)
    return source.select(
        SOURCE_ROW, cells.parse_cell(F.col(column), SPEC[column]).alias(column)
    )


@query
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _source(spark, sf_dir)
    return source.select(
        SOURCE_ROW,
        *[cells.parse_number(F.col(n)).cast("double").alias(n) for n in ("unit_price", "revenue")],
    )


@query
def parse_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "quantity")


@query
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir, "date")
    return parsed.select(SOURCE_ROW, cells.date_text(F.col("date")).alias("date"))


def _canonical(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    source = _source(spark, sf_dir)
    value = cells.canonical_value(F.col(column), SPEC[column])
    return source.groupBy(F.col(column).alias("spelling"), value.alias("canonical")).agg(
        F.count("*").alias("cells")
    )


@query
def canonical_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir, "category")


@query
def canonical_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir, "region")


@query
def canonical_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir, "status")


@query
def canonical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = prepare.normalise_cells(_source(spark, sf_dir), ORDER_SCHEMA)
    spellings = spark.createDataFrame(
        list(SPEC["category"].lookup().items()), "spelling string, canonical string"
    )
    return clean.canonical_join(source.select(SOURCE_ROW, "category"), "category", spellings)


@query
def coercion_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.coercion_failures(_run(spark, sf_dir).checked, ORDER_SCHEMA)


@query
def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = prepare.normalise_cells(_source(spark, sf_dir), ORDER_SCHEMA)
    return clean.fill_defaults(source.select(SOURCE_ROW, "customer"), ORDER_SCHEMA)


@query
def recompute_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.valid_rows(
        _run(spark, sf_dir).complete, [SOURCE_ROW, "quantity", "unit_price", "revenue"]
    )
    given = rows.withColumn("given", F.col("revenue").cast("double"))
    return clean.recompute_revenue(given).select(
        SOURCE_ROW, "given", F.col("revenue").cast("double").alias("revenue")
    )


# ---------------------------------------------------------------------------
# Validation
# ---------------------------------------------------------------------------
@query
def schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _source(spark, sf_dir)
    cases = {"complete": source, "no quantity": source.drop("quantity", "status"),
             "no rows": source.filter("source_row < 0")}
    outcomes = []
    for name, rows in cases.items():
        try:
            validate.schema_gate(rows, ORDER_SCHEMA)
            outcomes.append((name, "ok"))
        except DataQualityError as error:
            outcomes.append((name, str(error)))
    return spark.createDataFrame(outcomes, "input string, outcome string")


@query
def issues_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).issues


@query
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).findings


@query
def rows_with_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.rows_with_code(_written(spark, sf_dir).findings)


def _issue_rows(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    issues = validate.row_issues(_run(spark, sf_dir).checked, ORDER_SCHEMA, POLICY)
    return validate.findings_for(issues, code).select(SOURCE_ROW, "message", "example")


@query
def revenue_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issue_rows(spark, sf_dir, validate.REVENUE_OUTLIER)


@query
def revenue_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issue_rows(spark, sf_dir, validate.REVENUE_MISMATCH)


@query
def duplicate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicate_issues(_run(spark, sf_dir).checked, POLICY).select(
        SOURCE_ROW, "message", "example"
    )


@query
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicate_ids(_run(spark, sf_dir).complete, POLICY)


@query
def duplicate_order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = validate.valid_rows(_run(spark, sf_dir).checked, [SOURCE_ROW, "order_id"])
    return dedupe.duplicated_rows(valid, "order_id").select(SOURCE_ROW, "order_id")


@query
def rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = _run(spark, sf_dir).rejected
    shown = [spec.name for spec in ORDER_SCHEMA if spec.name != "feedback"]
    return rejected.select(
        SOURCE_ROW,
        "order_id",
        F.array_join("codes", ", ").alias("codes"),
        F.array_join("reasons", "; ").alias("reasons"),
        F.concat_ws(" | ", *[F.col("values")[name] for name in shown]).alias("cells"),
    )


@query
def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.valid_rows(_run(spark, sf_dir).complete, [SOURCE_ROW, "order_id", "product"])


@query
def valid_rows_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _run(spark, sf_dir).checked
    quarantine = validate.rejected_rows(checked, [SOURCE_ROW])
    rows = checked.select(SOURCE_ROW, "order_id", "product")
    return clean.exclude_rows(rows, quarantine)


@query
def partition_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.partition_difference(_run(spark, sf_dir, blanks=True))


@query
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, blanks=True).summary


@query
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary_lines(_run(spark, sf_dir, blanks=True).summary)


@query
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_metrics(_written(spark, sf_dir, blanks=True))


# ---------------------------------------------------------------------------
# Cleaning
# ---------------------------------------------------------------------------
@query
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = validate.valid_rows(_run(spark, sf_dir).complete, [SOURCE_ROW, "order_id", "product"])
    return dedupe.keep_first(valid, "order_id")


@query
def categorical_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [SOURCE_ROW, "order_id", "category", "region", "status"]
    kept = dedupe.keep_first(
        validate.valid_rows(_run(spark, sf_dir).complete, columns), "order_id"
    )
    return (
        clean.categorical_changes(kept, ORDER_SCHEMA)
        .groupBy("column", "before", "after")
        .agg(F.count("*").alias("cells"))
    )


@query
def cleaning_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, blanks=True).actions


@query
def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written before the sort, so that the shuffle files of joins and keys are gone when it begins.
    rows = clean.export_order(stored(_run(spark, sf_dir, feedback=True).clean, "clean"))
    return report.clean_table(rows).withColumns(
        {
            "date": cells.date_text(F.col("date")),
            "unit_price": F.col("unit_price").cast("double"),
            "revenue": F.col("revenue").cast("double"),
        }
    )


# ---------------------------------------------------------------------------
# Figures
# ---------------------------------------------------------------------------
@query
def kpi_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.kpi_overall(_clean(spark, sf_dir, *kpi.SNAPSHOT_INPUTS))


@query
def analytics_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    rows, valid = run.clean_columns(list(kpi.ANALYTICS_COLUMNS)), validate.valid_rows(run.complete, [SOURCE_ROW])

    def first(found: DataFrame) -> DataFrame:
        """The first valid row, if there is one: two cases ask for it, and it costs the joins before it."""
        return spark.createDataFrame(found.take(1), found.schema)

    # Asked before the rules, so that no line is joined for the case without rows.
    nothing = first(validate.valid_rows(run.complete.where("source_row < 0"), [SOURCE_ROW]))
    some = first(valid)
    cases = {
        "complete": (rows, some),
        "no region": (rows.drop("region"), some),
        "nothing valid": (rows, nothing),
        "nothing valid, no region": (rows.drop("region"), nothing),
    }
    outcomes = [(name, *kpi.analytics_available(*case)) for name, case in cases.items()]
    return spark.createDataFrame(outcomes, "input string, available boolean, reason string")


@query
def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.status_distribution(_clean(spark, sf_dir, "status"))


@query
def by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.dimension_metrics(_clean(spark, sf_dir, "product", *MONEY), "product")


@query
def by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.dimension_metrics(_clean(spark, sf_dir, "category", *MONEY), "category")


@query
def by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.dimension_metrics(_clean(spark, sf_dir, "region", *MONEY), "region")


@query
def kpi_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimensions = ["product", "category", "region", ORDER_MONTH]
    rows = _clean(spark, sf_dir, *dimensions, "date", "customer", *MONEY)
    return kpi.multi_dimension(rows, [*dimensions, "status"])


@query
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.trend(_clean(spark, sf_dir, ORDER_MONTH, *MONEY))


@query
def dimension_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(_clean(spark, sf_dir, *kpi.DIMENSIONS, *MONEY), "clean")
    focus = [kpi.dimension_focus(rows, name) for name in kpi.DIMENSIONS]
    return focus[0].unionByName(focus[1]).unionByName(focus[2])


@query
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.top_products(_clean(spark, sf_dir, "product", *MONEY), 5)


@query
def bottom_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.bottom_products(_clean(spark, sf_dir, "product", *MONEY), 5)


@query
def latest_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.latest_periods(_clean(spark, sf_dir, ORDER_MONTH))


@query
def period_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.period_snapshots(_clean(spark, sf_dir, *kpi.SNAPSHOT_INPUTS))


@query
def period_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.compare_periods(_clean(spark, sf_dir, *kpi.SNAPSHOT_INPUTS))


@query
def trend_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.trend_change(_clean(spark, sf_dir, *kpi.SNAPSHOT_INPUTS))


@query
def kpi_summary_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.kpi_summary_long(stored(_clean(spark, sf_dir, *kpi.SNAPSHOT_INPUTS), "clean"))


# ---------------------------------------------------------------------------
# Texts
# ---------------------------------------------------------------------------
@query
def classify_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = classify.classify_text(_documents(spark, sf_dir), "text")
    return classified.select("doc_id", "category", "classification")




def _by_length() -> classify.Labeller:
    """A stand-in classifier: a label for short and long texts, none for very long ones."""

    def label(batch: list[str]) -> list[str | None]:
        return [
            "neutral" if len(text) < 500 else "complaint" if len(text) < 5000 else "other"
            for text in batch
        ]

    return label


@query
def classify_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = classify.classify_text(_documents(spark, sf_dir), "text", _by_length())
    return classified.select("doc_id", "category", "classification")


def _by_index() -> classify.Labeller:
    """A stand-in for a chat model: replies by index, backwards, with gaps, repeats and broken entries."""

    def reply(batch: list[str]) -> list:
        entries: list = [{"index": 99, "category": "neutral"}, {"category": "neutral"}, {"index": "x", "category": "neutral"}]
        for place, text in reversed(list(enumerate(batch))):
            if len(text) % 7:  # every seventh length gets no entry
                if len(text) % 2:
                    entries.append({"index": place, "category": "positive"})  # put right by the next one
                entries.append((str(place), "neutral" if len(text) < 500 else "complaint" if len(text) < 5000 else "other"))
        return entries

    return reply


@query
def classify_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = classify.classify_text(_documents(spark, sf_dir), "text", _by_index())
    return classified.select("doc_id", "category", "classification")


@query
def classification_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a classification is skipped, or what it made, for several inputs."""
    rows = _documents(spark, sf_dir).select("doc_id", "lang", "text")
    cases = {
        "whole": (rows, "text", True),
        "switched off": (rows, "text", False),
        "no column": (rows, "review", True),
        "nothing to classify": (rows.withColumn("text", F.lit(" ")), "text", True),
    }
    out = []
    for name, (frame, column, enabled) in cases.items():
        found, reason = classify.classify_or_skip(frame, column, _by_index(), enabled)
        if found is None:
            out.append(spark.range(1).select(
                F.lit(name).alias("input"), F.lit(classify.SKIPPED).alias("status"), F.lit(reason).alias("reason"),
                *[F.lit(0).cast("bigint").alias(x) for x in ("texts", "classified", "unclassified", "failed")],
            ))
        else:
            status = classify.classification_status(found)
            out.append(status.select(F.lit(name).alias("input"), "status", F.lit(None).cast("string").alias("reason"),
                                     "texts", "classified", "unclassified", "failed"))
    return reduce(DataFrame.unionByName, out)


KEYWORD_RULES = [
    (1, "complaint", "idiot"),
    (2, "complaint", "worthless"),
    (3, "complaint", "pathetic"),
    (4, "delivery_feedback", "license"),
    (4, "delivery_feedback", "rights"),
    (5, "product_feedback", "und"),
    (6, "neutral", "the"),
    (7, "positive", "la"),
    (7, "negative", "la"),
]


@query
def classify_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(KEYWORD_RULES, "rule int, category string, keyword string")
    found = classify.classify_keywords(_documents(spark, sf_dir), "text", rules)
    return found.select("doc_id", "category", "classification")


@query
def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = classify.classify_text(_documents(spark, sf_dir), "text", _by_length())
    return classify.classification_summary(classified.select("category", "classification"))


@query
def feedback_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, feedback=True).clean_columns([SOURCE_ROW, "order_id", "feedback"])
    return report.feedback_table(classify.classify_text(rows, "feedback"))


@query
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbercheck.numbers_in(_documents(spark, sf_dir), "doc_id", "text")


@query
def verify_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = kpi.trend(_clean(spark, sf_dir, ORDER_MONTH, *MONEY))
    figures = stored(
        months.select(
            F.explode(F.array("net_revenue", F.col("order_count").cast("double"))).alias("value")
        ),
        "figures",
    )
    return numbercheck.verify_numbers(
        _documents(spark, sf_dir), "doc_id", "text", figures, "value"
    )


@query
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    redacted = texts.redact_credentials(F.col("text"), ("secret",))
    return _documents(spark, sf_dir).select("doc_id", redacted.alias("text"))


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = F.posexplode(texts.chunk_text(F.col("text"))).alias("chunk", "text")
    return _documents(spark, sf_dir).select("doc_id", chunks)


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(_clean(spark, sf_dir, *facts.FACT_INPUTS), "clean")
    return facts.facts_digest(rows, "region")


@query
def facts_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(spark, sf_dir).select(facts.SCOPE, "digest")


@query
def metrics_supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.metrics_supplied(_digests(spark, sf_dir))


@query
def narrate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = facts.narrate(_digests(spark, sf_dir))
    return told.select(
        facts.SCOPE,
        "executive_summary",
        F.array_join("positive_trends", "; ").alias("positive_trends"),
        F.array_join("negative_trends", "; ").alias("negative_trends"),
        F.array_join("watch_items", "; ").alias("watch_items"),
        "management_summary",
    )


@query
def insights_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = stored(_digests(spark, sf_dir), "digests")
    return report.insight_rows(digests, report.report_insights(digests))


def _writer() -> facts.Writer:
    """A stand-in model: it answers with the size of the digest, in prose around JSON."""

    def write(digest: str) -> str:
        found = '{"executive_summary": "The digest is complete.", "watch_items": [" a ", "", "b"], "positive_trends": "x"}'
        return f"Here: {found} - done" if digest.startswith("{") else "no"

    return write


@query
def interpret_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    insights = stored(facts.interpret(_digests(spark, sf_dir), _writer()), "insights")
    return insights.select(
        facts.SCOPE,
        "status",
        "status_detail",
        "executive_summary",
        F.array_join("watch_items", "; ").alias("watch_items"),
        F.size("positive_trends").alias("positive_trends"),
    )


@query
def feedback_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, feedback=True).clean_columns([SOURCE_ROW, "order_id", "feedback"])
    labelled = stored(classify.classify_text(rows, "feedback", _by_length()), "labelled")
    status = classify.classification_status(labelled)
    summary = classify.classification_summary(labelled)
    records = report.feedback_table(labelled)
    return (
        status.select(F.lit("status").alias("part"), F.col("status").alias("category"), F.col("texts").alias("records"))
        .unionByName(summary.select(F.lit("summary").alias("part"), "category", "records"))
        .unionByName(records.groupBy("category").agg(F.count("*").alias("records")).withColumn("part", F.lit("records")))
    )


@query
def action_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = stored(_written(spark, sf_dir, blanks=True).actions, "actions")
    names = ["blank_rows_dropped", "duplicate_orders_removed", "no_such_action"]
    counted = [clean.action_records(actions, name).withColumn("action", F.lit(name)) for name in names]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query
def report_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = stored(report.rejected_table(_run(spark, sf_dir)).select(SOURCE_ROW, "reason"), "rejected")
    nothing = report.or_placeholder(rejected.filter("reason = ''"), report.NOTHING["rejected"])
    some = report.or_placeholder(rejected, report.NOTHING["rejected"]).groupBy().agg(F.count("*").alias(SOURCE_ROW))
    return nothing.unionByName(some.withColumn("reason", F.lit("rows with a reason")))

def _wrapped_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a model reply of one of eleven shapes."""
    said = tables.read_table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct(F.col("text").alias("text"), F.col("turn").alias("turn")))
    shape = (F.col("conv_id") + F.col("turn")) % 11
    trailing = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(", }"))
    reply = (
        F.when(shape == 0, body)
        .when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 2, trailing)
        .when(shape == 3, F.concat(F.lit("Here you are: "), body, F.lit(" - anything else?")))
        .when(shape == 5, F.repeat(F.lit("["), 3000 + F.col("turn")))
        .when(shape == 6, F.concat(F.lit("see ["), F.repeat(F.lit("x"), F.lit(10)), F.lit("] or "), body))
        .when(shape == 7, F.concat(F.lit('x {"a": NaN} '), F.lit("y")))
        .when(shape == 8, F.lit("1] junk"))
        .when(shape == 9, F.concat(F.lit('{"a":1}] tail ["'), F.lit("")))
        .when(shape == 10, F.concat(body, F.lit(", "), body))
        .otherwise(F.concat(F.lit("Sorry, "), F.translate("text", "{}[]", "")))
    )
    return tables.spread(said, "conv_id").select("conv_id", "turn", reply.alias("reply"))


@query
def parse_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = replies.parse_model_json(_wrapped_replies(spark, sf_dir), "reply")
    return parsed.select(
        "conv_id",
        "turn",
        "parse_status",
        F.try_variant_get("parsed", "$.text", "string").alias("text"),
        "parse_detail",
    )


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as logged chat payloads of eight shapes."""
    said = tables.spread(tables.read_table(spark, sf_dir, "conversations"), "conv_id")
    quoted = F.to_json(F.struct(F.col("text").alias("text")))
    usage = F.concat(
        F.lit(', "usage": {"prompt_tokens": '), F.col("turn"),
        F.lit(', "completion_tokens_details": {"reasoning_tokens": '), F.col("turn") + 1, F.lit("}}"),
    )

    def message(content, reason: str):
        return F.concat(
            F.lit('{"choices": [{"message": {"content": '), content,
            F.lit(f'}}, "finish_reason": "{reason}"}}]'), usage, F.lit("}"),
        )

    text_only = F.substring(quoted, F.lit(9), F.length(quoted) - 9)
    deep = text_only
    for level in range(5):
        deep = F.concat(F.lit('[{"content": '), deep, F.lit(f'}}, "level {level}"]'))
    shape = (F.col("conv_id") + F.col("turn")) % 8
    payload = (
        F.when(shape == 0, message(text_only, "stop"))
        .when(shape == 1, message(F.concat(F.lit('[{"type": "image"}, '), quoted, F.lit(', "end"]')), "stop"))
        .when(shape == 2, message(F.lit("null"), "length"))
        .when(shape == 3, F.lit('{"error": {"message": "model not found", "code": 404}}'))
        .when(shape == 4, F.lit('{"choices": []}'))
        .when(shape == 6, message(deep, "stop"))
        .when(shape == 7, message(F.concat(F.lit('{"value": ['), quoted, F.lit("]}")), "stop"))
        .otherwise(F.concat(F.lit("<html>"), F.col("role")))
    )
    return said.select("conv_id", "turn", payload.alias("payload"))


@query
def extract_chat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = replies.extract_chat_text(_payloads(spark, sf_dir), "payload")
    return extracted.select(
        "conv_id", "turn", "outcome", "reply", "detail", "finish_reason", "prompt_tokens", "reasoning_tokens"
    )


# ---------------------------------------------------------------------------
# Streaming
# ---------------------------------------------------------------------------
@query
def incremental_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals of rows, one run after each."""
    root = shared_folder(spark, "incremental")
    arrivals, out = f"{root}/arrivals", f"{root}/out"
    raw = tables.raw_orders(spark, sf_dir, feedback=False)
    headers = tuple(name for name in raw.columns if name != SOURCE_ROW)
    parts = tables.staged_parts(raw, f"{root}/staged", 3)
    for part in range(3):
        deliver(spark, parts[part], arrivals)
        stream = incremental.read_raw_stream(spark, arrivals, headers)
        incremental.incremental_quality(stream, out, policy=POLICY)

    def rows(name: str) -> DataFrame:
        return incremental.batch_table(spark, incremental.output(out, name))

    def ids(name: str) -> DataFrame:
        return rows(name).select(F.lit(name).alias("kind"), F.col(SOURCE_ROW).cast("string").alias("item"),
                                 F.lit(1).cast("bigint").alias("records"))

    found = rows("findings").groupBy(F.concat_ws(" ", "code", "severity", "column").alias("item")).agg(
        F.sum("records").alias("records"))
    removed = rows("actions").filter("action = 'duplicate_orders_removed'").groupBy("action").agg(
        F.sum("records").alias("records"))
    log = rows("run_log").agg(F.sum("rows_read").alias("records"))
    return (
        ids("clean").unionByName(ids("rejected"))
        .unionByName(found.withColumn("kind", F.lit("findings")))
        .unionByName(removed.select(F.lit("actions").alias("kind"), F.col("action").alias("item"), "records"))
        .unionByName(log.select(F.lit("run_log").alias("kind"), F.lit("rows_read").alias("item"), "records"))
    )
