"""Report tables as tidy DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.functions.cells import display_value, short_number
from tidyledger.functions.texts import chunk_text
from tidyledger.operators import classify, facts, kpi, numbercheck
from tidyledger.operators.clean import export_order
from tidyledger.plans.quality import QualityRun, quality_metrics
from tidyledger.schema import ORDER_MONTH, SOURCE_ROW

# ---------------------------------------------------------------------------
# Labels, section titles and columns of the report tables.
# ---------------------------------------------------------------------------
CLEAN_ORDER = (
    SOURCE_ROW,
    "date",
    "order_id",
    "customer",
    "product",
    "category",
    "quantity",
    "unit_price",
    "revenue",
    "region",
    "status",
    ORDER_MONTH,
    "feedback",
)
OVERALL_LABELS = {
    "Records analysed": "order_count",
    "Distinct customers": "distinct_customers",
    "Units sold": "total_quantity",
    "Gross revenue": "gross_revenue",
    "Net revenue (excludes cancelled/refunded)": "net_revenue",
    "Cancelled/refunded revenue": "excluded_revenue",
    "Average order value (net)": "average_order_value",
    "Average unit price (net)": "average_unit_price",
    "Cancelled/refunded share of orders": "cancellation_rate_pct",
}
PERIOD_LABELS = {
    "Orders": "order_count",
    "Revenue bearing orders": "revenue_orders",
    "Units sold": "total_quantity",
    "Distinct customers": "distinct_customers",
    "Gross revenue": "gross_revenue",
    "Net revenue": "net_revenue",
    "Average order value (net)": "average_order_value",
}
INSIGHT_SECTIONS = {
    "Executive summary": "executive_summary",
    "Positive trends": "positive_trends",
    "Negative trends": "negative_trends",
    "Items requiring attention": "watch_items",
    "Management summary": "management_summary",
}
UNVERIFIED = "Numbers not matched to a calculated metric"
VERIFIED = "no unverified figures detected in the AI narrative"
NUMBER_CHECK = "Number check"
METRICS_SUPPLIED = "Metrics supplied to the model"
RUN_LOG_COLUMNS = (
    "run_id",
    "started_at",
    "finished_at",
    "duration_seconds",
    "outcome",
    "data_source",
    "rows_read",
    "rows_valid",
    "rows_rejected",
    "rows_cleaned",
    "net_revenue",
    "ai_status",
    "message",
)
# How much of the lists a report shows; the operators have no limits of their own.
LIST_ITEMS, ITEM_CHARS, LISTED_NUMBERS, LISTED_CHANGES = 8, 300, 10, 5
NOTHING = {
    "findings": {"code": "none", "records": 0, "message": "no validation findings"},
    "rejected": {"reason": "no records were rejected"},
    "actions": {"action": "none", "records": 0, "detail": "the dataset required no cleaning"},
}


def clean_table(clean: DataFrame) -> DataFrame:
    """Clean rows with the free text last, then extra columns."""
    known = [name for name in CLEAN_ORDER if name in clean.columns]
    return clean.select(*known, *[name for name in clean.columns if name not in known])


def or_placeholder(table: DataFrame, values: dict[str, object]) -> DataFrame:
    """The table, or one row that says there is nothing to show."""
    empty = table.limit(1).agg(F.count("*").alias("_rows")).filter("_rows = 0")
    columns = [
        F.lit(values.get(field.name, "" if field.dataType.typeName() == "string" else None))
        .cast(field.dataType)
        .alias(field.name)
        for field in table.schema.fields
    ]
    return table.unionByName(empty.select(*columns))


def rejected_table(run: QualityRun) -> DataFrame:
    """Quarantine as flat text: source row, order id, codes, reasons and the cells, shortened for display."""
    return run.rejected.select(
        SOURCE_ROW,
        F.coalesce("order_id", F.lit("")).alias("order_id"),
        F.array_join("codes", ", ").alias("codes"),
        F.array_join("reasons", "; ").alias("reason"),
        F.to_json(F.transform_values("values", lambda _, cell: display_value(cell))).alias("record"),
    )


def report_insights(digests: DataFrame, fn: facts.Writer | None = None) -> DataFrame:
    """Insight records with lists as long as a report shows them."""
    return facts.interpret(
        digests, fn, most_items=LIST_ITEMS, item_chars=ITEM_CHARS, most_changes=LISTED_CHANGES
    )


def insight_status(insights: DataFrame) -> DataFrame:
    """One row: ``failed`` if a record failed, else ``generated`` if there is one, else ``skipped``."""
    status = F.col("status")
    return insights.agg(
        F.when(F.count_if(status == "failed") > 0, "failed")
        .when(F.count_if(status == "generated") > 0, "generated")
        .otherwise("skipped")
        .alias("ai_status")
    )


def _labelled(block: Column, position: int, labels: dict[str, str]) -> list[Column]:
    return [
        F.struct(
            block.alias("block"),
            F.lit(position + offset).alias("position"),
            F.lit(label).alias("metric"),
            F.col(name).cast("double").alias("value"),
        )
        for offset, (label, name) in enumerate(labels.items())
    ]


def kpi_summary_long(clean: DataFrame) -> DataFrame:
    """Headline figures of all periods, the current and the previous month, long form."""
    overall = kpi.kpi_overall(clean).select(
        F.inline(F.array(*_labelled(F.lit("Overall"), 1, OVERALL_LABELS)))
    )
    months = kpi.last_two(clean)
    block = F.when(F.col("rank") == 1, "Current period").otherwise("Previous period")
    figures = kpi.snapshot_figures(months, block)
    periods = figures.select(F.inline(F.array(*_labelled(F.col("label"), 1, PERIOD_LABELS))))
    return overall.unionByName(periods)


def insight_rows(digests: DataFrame, insights: DataFrame) -> DataFrame:
    """Insight records as report lines: ``(scope, section_position, section, line, text)``.

    Every record starts with its status.  A generated one goes on with its
    sentences (long paragraphs are chunked, list items become bullets), its
    number check and the figures it was given.
    """
    status = insights.select(
        facts.SCOPE,
        F.lit(0).alias("section_position"),
        F.lit("Status").alias("section"),
        F.posexplode(F.array("status", "status_detail")).alias("line", "text"),
    )
    insights = insights.filter("status = 'generated'")
    digests = digests.join(insights.select(facts.SCOPE), facts.SCOPE, "left_semi")
    lists = ("positive_trends", "negative_trends", "watch_items")
    entries = []
    for position, (title, name) in enumerate(INSIGHT_SECTIONS.items(), start=1):
        if name in lists:
            lines = F.transform(F.col(name), lambda item: F.concat(F.lit("- "), item))
        else:
            lines = chunk_text(F.col(name))
        entries.append(
            F.struct(F.lit(position).alias("section_position"), F.lit(title).alias("section"),
                     lines.alias("lines"))
        )
    sections = insights.select(facts.SCOPE, F.inline(F.array(*entries))).select(
        facts.SCOPE, "section_position", "section", F.posexplode("lines").alias("line", "text")
    )
    loose = unverified_by_scope(digests, insights)
    listed = loose.groupBy(facts.SCOPE).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "value"))),
                lambda item: short_number(item["value"]),
            ),
            ", ",
        ).alias("text")
    )
    check = (
        insights.select(facts.SCOPE)
        .join(listed, facts.SCOPE, "left")
        .select(
            facts.SCOPE,
            F.lit(6).alias("section_position"),
            F.when(F.col("text").isNull(), NUMBER_CHECK).otherwise(UNVERIFIED).alias("section"),
            F.lit(0).alias("line"),
            F.coalesce("text", F.lit(VERIFIED)).alias("text"),
        )
    )
    supplied = facts.metrics_supplied(digests).select(
        facts.SCOPE,
        F.lit(7).alias("section_position"),
        F.lit(METRICS_SUPPLIED).alias("section"),
        F.col("position").alias("line"),
        F.col("line").alias("text"),
    )
    return status.unionByName(sections).unionByName(check).unionByName(supplied)


def unverified_by_scope(digests: DataFrame, insights: DataFrame) -> DataFrame:
    """Numbers in a scope's sentences that match no figure of that same scope.

    A scope has a bounded digest, so its figures fit into one array next to the
    sentences and are compared there.
    """
    values = facts.supplied_values(digests).groupBy(facts.SCOPE).agg(
        F.collect_set("value").alias("values")
    )
    texts = facts.narrative_text(insights).join(values, facts.SCOPE)
    numbers = texts.select(
        facts.SCOPE,
        "values",
        F.posexplode(numbercheck.extract_numbers(F.col("narrative"))).alias("position", "token"),
    ).withColumn("value", numbercheck.number_value(F.col("token")))

    def near(fact: Column) -> Column:
        gap = F.least(F.abs(F.col("value") - fact), F.abs(F.col("value") - F.abs(fact)))
        reach = F.greatest(F.lit(numbercheck.ABSOLUTE), F.abs(fact) * numbercheck.RELATIVE)
        return gap <= reach

    loose = numbers.filter(
        numbercheck.needs_check(F.col("value")) & ~F.exists("values", near)
    ).drop("values", "token")
    return numbercheck.first_distinct(loose, facts.SCOPE, LISTED_NUMBERS)


def feedback_table(classified: DataFrame) -> DataFrame:
    """Classified records: source row, order id, category and text."""
    done = classified.filter(F.col("classification") == classify.CLASSIFIED)
    return done.select(SOURCE_ROW, "order_id", "category", "feedback")


def run_log_row(run: QualityRun, clean: DataFrame, details: dict[str, object]) -> DataFrame:
    """The run's line for the log: counts and net revenue next to the given details."""
    summary = run.summary.select(
        F.col("valid_rows").alias("rows_valid"),
        F.col("rejected_rows").alias("rows_rejected"),
        (F.col("valid_rows") - F.col("duplicate_rows")).alias("rows_cleaned"),
    )
    read = run.audit.agg(F.count("*").alias("rows_read"))
    net = clean.agg(
        F.coalesce(F.sum(F.when(kpi.revenue_bearing(), F.col("revenue"))), F.lit(0))
        .cast("double")
        .alias("net_revenue")
    )
    parts = summary.unionByName(read, allowMissingColumns=True)
    parts = parts.unionByName(net, allowMissingColumns=True)
    counted = ("rows_read", "rows_valid", "rows_rejected", "rows_cleaned", "net_revenue")
    totals = parts.agg(*[F.max(name).alias(name) for name in counted])
    given = {name: F.lit(details.get(name)) for name in RUN_LOG_COLUMNS if name not in counted}
    given["duration_seconds"] = F.round(F.lit(details.get("duration_seconds", 0.0)).cast("double"), 2)
    return totals.select(
        *[given.get(name, F.col(name)).alias(name) if name in given else F.col(name)
          for name in RUN_LOG_COLUMNS]
    )


def run_summary(log_row: DataFrame, extra: dict[str, str], tables: list[str]) -> DataFrame:
    """The run as one JSON document with sorted keys."""
    fields = {name: F.col(name) for name in log_row.columns}
    fields |= {name: F.lit(value) for name, value in extra.items()}
    fields["tables"] = F.array(*[F.lit(name) for name in tables]).cast("array<string>")
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return log_row.select(F.to_json(F.struct(*ordered)).alias("summary"))


def build_report(run: QualityRun, clean: DataFrame, digests: DataFrame, insights: DataFrame,
                 classified: DataFrame | None = None) -> dict[str, DataFrame]:
    """All report tables by name; the run log is appended separately.

    Several tables use the digests, insights and classified rows: pass written tables.
    """
    tables = {
        "Clean_Data": clean_table(export_order(clean)),
        "Data_Quality": quality_metrics(run),
        "Findings": or_placeholder(run.findings, NOTHING["findings"]),
        "Rejected_Records": or_placeholder(rejected_table(run), NOTHING["rejected"]),
        "Cleaning_Actions": or_placeholder(run.actions, NOTHING["actions"]),
        "KPI_Summary": kpi_summary_long(clean),
        "Period_Comparison": kpi.compare_periods(clean),
        "Monthly_Trend": kpi.trend(clean),
        "Status_Distribution": kpi.status_distribution(clean),
        "Product_Analysis": kpi.dimension_metrics(clean, "product"),
        "Category_Analysis": kpi.dimension_metrics(clean, "category"),
        "Regional_Analysis": kpi.dimension_metrics(clean, "region"),
        "AI_Insights": insight_rows(digests, insights),
    }
    if classified is not None:
        tables["Feedback_Summary"] = classify.classification_summary(classified)
        tables["Feedback_Analysis"] = feedback_table(classified)
    return tables
