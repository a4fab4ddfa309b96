"""What the plans must look like to hold at scale, and SQL comparison on small tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from tidyledger.plans.oracle import ORACLE
from tidyledger.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()
NO_PYTHON = [
    "by_category", "by_product", "kpi_overall", "kpi_grouping_sets", "trend", "period_comparison",
    "valid_rows", "dedup_keep_first", "rejected_records", "normalise_text", "extract_numbers",
    "redact_documents", "chunk_documents", "parse_date", "coercion_failures",
]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_in_the_plan(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "EvalPython" not in text and "MapInPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_duplicates_are_limited_before_the_shuffle(spark):
    text = plan(QUERIES["dedup_keep_first"](spark, SMALL))
    assert text.count("WindowGroupLimit") == 2


def test_examples_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["findings"](spark, SMALL))


def test_figures_do_not_read_free_text(spark):
    text = plan(QUERIES["by_category"](spark, SMALL))
    assert "documents" not in text and "c_name" not in text


def test_top_list_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_products"](spark, SMALL))


def test_share_reuses_the_grouped_shuffle(spark):
    frame = QUERIES["by_product"](spark, SMALL)
    frame.collect()
    assert "ReusedExchange" in plan(frame)


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = [tuple(None if isinstance(row[i], float) and math.isnan(row[i]) else row[i] for i in order) for row in rows]
    return sorted(clean, key=repr)


@pytest.mark.parametrize("name", [
    "by_category", "kpi_overall", "rejected_records", "clean_orders", "cleaning_actions", "findings",
    "facts_digest", "verify_numbers", "chunk_documents", "parse_model_json", "trend_change",
    "csv_grid", "classify_keywords", "kpi_grouping_sets", "extract_chat_text",
])
def test_query_equals_sql(spark, sql, name):
    frame = QUERIES[name](spark, SMALL)
    cursor = sql.execute(driver.oracle_sql()[name])
    columns = [entry[0] for entry in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert comparable(cursor.fetchall(), columns) == comparable([tuple(r) for r in frame.collect()], frame.columns)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())


def test_library_imports_nothing_from_the_text_operators():
    folder = Path(__file__).resolve().parents[1] / "tidyledger"
    for path in folder.rglob("*.py"):
        if "llm" not in path.relative_to(folder).parts:
            assert "tidyledger.llm" not in path.read_text(), path


def test_entry(spark):
    assert driver.entry(spark).count() == 5
