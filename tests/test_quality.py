import pytest
from pyspark.sql import functions as F

from conftest import order
from tidyledger.operators import clean, dedupe, prepare, validate
from tidyledger.plans.quality import partition_difference, quality_metrics, run_quality
from tidyledger.schema import ORDER_SCHEMA, SOURCE_ROW, ColumnSpec, DataQualityError, QualityPolicy
from tidyledger.sources.grid import grid_from_values

REJECTED = [9, 10, 11, 12, 13, 14, 16, 17]


@pytest.fixture(scope="module")
def run(spark, dirty):
    return run_quality(grid_from_values(spark, dirty)).persist()


def numbers(frame):
    return sorted(row[0] for row in frame.select(SOURCE_ROW).collect())


def test_rejected_rows_and_reasons(run):
    rejected = {r.source_row: r for r in run.rejected.collect()}
    assert sorted(rejected) == REJECTED
    assert rejected[9].reasons == ["date: '31/02/2025' is not an accepted date format"]
    assert rejected[9].order_id == "A-6"
    assert rejected[16]["values"]["region"] == "Central"
    assert rejected[9]["values"]["date"] == "31/02/2025"  # as written, though it is no date
    assert rejected[11].codes == ["OUT_OF_RANGE"]
    assert rejected[11].reasons == ["quantity: 0 is below the documented minimum of 1"]


def test_findings(run):
    found = {(r.code, r.severity, r.column): r for r in run.findings.collect()}
    errors = {key for key in found if key[1] == "error"}
    assert errors == {
        ("INVALID_DATE", "error", "date"), ("MISSING_VALUE", "error", "date"),
        ("OUT_OF_RANGE", "error", "quantity"), ("MISSING_VALUE", "error", "quantity"),
        ("INVALID_NUMBER", "error", "unit_price"), ("MISSING_VALUE", "error", "product"),
        ("INVALID_CATEGORY", "error", "region"), ("INVALID_CATEGORY", "error", "status"),
    }
    assert found["DUPLICATE_ORDER_ID", "warning", "order_id"].records == 2
    assert found["DUPLICATE_ORDER_ID", "warning", "order_id"].examples == "row 4: 'A-1'; row 5: 'A-2'"
    # a broken derived value is reported as not numeric and as blank
    assert found["INVALID_NUMBER", "warning", "revenue"].examples == "row 21: 'n.a.x'"
    assert found["MISSING_VALUE", "warning", "revenue"].examples == "row 20; row 21"
    assert found["REVENUE_OUTLIER", "warning", "revenue"].examples == "row 18: 60000.00"
    assert found["REVENUE_MISMATCH", "warning", "revenue"].examples == "row 8: given 100.00 -> 200.00"
    assert "'Unknown Customer'" in found["MISSING_VALUE", "warning", "customer"].message
    ordered = [(r.severity != "error", r.code, r.column) for r in run.findings.collect()]
    assert ordered == sorted(ordered)


def test_summary_and_metrics(run):
    summary = run.summary.first()
    assert (summary.total_rows, summary.valid_rows, summary.rejected_rows) == (20, 12, 8)
    assert (summary.duplicate_ids, summary.duplicate_rows, summary.outlier_rows) == (2, 2, 1)
    total = {r.severity: r[1] for r in run.issues.groupBy("severity").count().collect()}
    assert (summary.errors, summary.warnings) == (total["error"], total["warning"])
    metrics = {r.metric: r.value for r in quality_metrics(run).collect()}
    assert metrics["Rows read from the source"] == 21
    assert metrics["Blank rows dropped before validation"] == 1
    assert metrics["Rows written to Clean_Data"] == 10
    assert metrics["Rows removed by cleaning"] == 10


def test_clean_rows(run):
    rows = {r.source_row: r for r in run.clean.collect()}
    assert sorted(rows) == [2, 3, 6, 7, 8, 15, 18, 20, 21, 22]
    assert rows[3].category == "Home & Kitchen" and rows[3].region == "South"
    assert rows[6].order_id == "A-3" and rows[6]["product"] == "Desk Lamp"
    assert rows[6].status == "Completed"
    assert rows[15].customer == "Unknown Customer"
    assert str(rows[8].revenue) == "200.00"
    assert rows[22].order_month == "2025-03"
    assert run.clean.columns[:3] == ["source_row", "date", "order_id"]


def test_pruned_and_full_paths_agree(spark, dirty, run):
    fresh = run_quality(grid_from_values(spark, dirty))
    columns = ["order_id", "revenue", "status", "order_month"]
    assert fresh.clean_columns(columns).exceptAll(run.clean.select(columns)).isEmpty()
    assert run.clean.select(columns).exceptAll(fresh.clean_columns(columns)).isEmpty()
    assert numbers(fresh.complete.filter("is_rejected")) == sorted([*REJECTED, 19])


def test_actions(run):
    actions = {r.action: r for r in run.actions.collect()}
    assert actions["blank_rows_dropped"].examples == "row 19"
    assert actions["headers_normalised"].records == 11
    assert actions["rejected_rows_removed"].examples == "rows 9, 10, 11"
    assert actions["duplicate_orders_removed"].examples == "rows 4, 5"
    assert actions["default_values_filled"].examples == "customer = 'Unknown Customer'"
    assert actions["default_values_filled"].records == 1
    assert actions["revenue_recalculated"].records == 3
    assert actions["revenue_recalculated"].examples == (
        "row 8: '100.00' -> '200.00'; blank revenue cells were derived from quantity * unit_price"
    )
    assert actions["categorical_values_normalised"].records == 4
    assert actions["whitespace_normalised"].records == 3
    assert actions["derived_columns_added"].records == 1
    assert clean.action_records(run.actions, "no_such_action").first()[0] == 0


def test_partition_law(run):
    assert partition_difference(run).isEmpty()


def test_gate(spark):
    header = ["date", "order_id"]
    with pytest.raises(DataQualityError, match="no data rows"):
        run_quality(grid_from_values(spark, [header]))
    with pytest.raises(DataQualityError, match="required column"):
        run_quality(grid_from_values(spark, [header, ["2025-01-01", "x"]]))


def test_threshold_and_key_are_configurable(spark):
    from conftest import HEADERS

    rows = [order(Order_ID="T-1", Qty="10", Unit_Price="100", Revenue="1000"), order(Order_ID="T-2")]
    raw = grid_from_values(spark, [HEADERS, *rows])
    run = run_quality(raw, policy=QualityPolicy(500.0, "customer"))
    assert run.summary.first().outlier_rows == 1
    assert numbers(run.clean) == [2]
    assert run_quality(raw).summary.first().outlier_rows == 0


def test_custom_schema(spark):
    schema = (
        ColumnSpec("order_id", "text"),
        ColumnSpec("score", "numeric", required=False, minimum=1, maximum=5),
        ColumnSpec("day", "date", required=False),
        ColumnSpec("size", "category", allowed=("Big", "Small"), spellings={"b": "Big"}),
    )
    values = [["order id", "score", "day", "size"], ["1", "6", "", "B"], ["2", "", "x", "small"],
              ["3", "2.5", "2025-01-01", ""], ["4", "5", None, "big"]]
    run = run_quality(grid_from_values(spark, values), schema)
    reasons = {r.source_row: r.reasons for r in run.rejected.collect()}
    assert reasons == {
        2: ["score: 6 is above the documented maximum of 5"],
        3: ["day: 'x' is not an accepted date format"],
        4: ["size: value is missing"],
    }
    assert [(r.order_id, r.size) for r in run.clean.collect()] == [("4", "Big")]


def test_hot_key_is_kept_once(spark):
    rows = spark.range(0, 3000).select(
        (F.col("id") + 2).alias(SOURCE_ROW),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
    )
    kept = dedupe.keep_first(rows, "key")
    assert kept.count() == 2001
    assert kept.filter("key = 'hot'").first()[0] == 2
    assert dedupe.later_duplicates(rows, "key").count() == 999
    assert dedupe.duplicated_rows(rows, "key").count() == 1000
    assert dedupe.duplicate_totals(rows, "key").first().duplicate_rows == 999


def test_anti_join_equals_filter(run):
    stored = validate.rejected_rows(run.checked, [SOURCE_ROW])
    assert numbers(clean.exclude_rows(run.checked, stored)) == numbers(run.valid)


def test_coercion_failures(run):
    found = {(r.source_row, r.column, r.raw) for r in prepare.coercion_failures(run.checked, ORDER_SCHEMA).collect()}
    assert found == {(9, "date", "31/02/2025"), (13, "unit_price", "abc"), (21, "revenue", "n.a.x")}
