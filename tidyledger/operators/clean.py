"""Cleaning of valid rows, and the audit log of every change."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidyledger.functions.cells import canonical_key, line_revenue, money_text, month_of, normalise_text
from tidyledger.operators.dedupe import keep_first, later_duplicates
from tidyledger.operators.prepare import BLANK, SPACES, change_example, present, text_columns
from tidyledger.operators.validate import EXAMPLES, rejected_rows, valid_rows
from tidyledger.schema import (
    MONEY_TYPE,
    ORDER_MONTH,
    SOURCE_ROW,
    ColumnSpec,
    QualityPolicy,
    Schema,
)
from tidyledger.sources.grid import HeaderMapping

# ---------------------------------------------------------------------------
# Names and wording of the actions, in reporting order.
# ---------------------------------------------------------------------------
PREPARATION = {
    "blank_rows_dropped": "rows where every cell is blank carry no information",
    "headers_normalised": "accepted header spellings mapped to canonical column names",
    "unrecognised_columns_retained": (
        "columns outside the business schema are kept but not analysed"
    ),
    "whitespace_normalised": (
        "leading/trailing/duplicated whitespace collapsed in text values"
    ),
}
CLEANING = {
    "rejected_rows_removed": (
        "records that failed validation are excluded from analytics (details in Data_Quality)"
    ),
    "duplicate_orders_removed": (
        "duplicate order ids removed; the first occurrence (by source row) is kept"
    ),
    "categorical_values_normalised": "categorical values mapped onto canonical business values",
    "default_values_filled": "missing {} values replaced by the documented default",
    "revenue_recalculated": (
        "revenue recomputed as quantity * unit_price (single source of truth for money metrics)"
    ),
    "derived_columns_added": "order_month derived from date for period-over-period analysis",
}
BLANK_REVENUE_EXAMPLE = "blank revenue cells were derived from quantity * unit_price"


# ---------------------------------------------------------------------------
# Value rules
# ---------------------------------------------------------------------------
def _categories(schema: Schema, columns: list[str]) -> list[ColumnSpec]:
    return [spec for spec in present(schema, columns) if spec.kind == "category"]


def canonicalise(df: DataFrame, schema: Schema) -> DataFrame:
    """Replace every category by its canonical value."""
    return df.withColumns(
        {spec.name: canonical_key(F.col(spec.name), spec) for spec in _categories(schema, df.columns)}
    )


def canonical_join(df: DataFrame, column: str, spellings: DataFrame) -> DataFrame:
    """Canonical values from a ``(spelling, canonical)`` table instead of a literal map.

    For lists too long for an expression.  Spark broadcasts the table when its
    measured size allows it and otherwise joins by key, splitting skewed keys.
    """
    key = F.lower(F.col(column))
    lookup = spellings.select(F.col("spelling").alias("_spelling"), "canonical")
    joined = df.join(lookup, key == F.col("_spelling"), "left")
    return joined.withColumn(column, F.col("canonical")).drop("_spelling", "canonical")


def fill_defaults(df: DataFrame, schema: Schema) -> DataFrame:
    return df.withColumns(
        {
            spec.name: F.coalesce(F.col(spec.name), F.lit(spec.default))
            for spec in present(schema, df.columns)
            if spec.default
        }
    )


def recompute_revenue(df: DataFrame) -> DataFrame:
    """``revenue = quantity * unit_price`` always replaces the given value."""
    if not {"quantity", "unit_price"} <= set(df.columns):
        return df
    return df.withColumn("revenue", line_revenue(F.col("quantity"), F.col("unit_price")))


def derive_period(df: DataFrame) -> DataFrame:
    return df.withColumn(ORDER_MONTH, month_of(F.col("date"))) if "date" in df.columns else df


def apply_value_rules(kept: DataFrame, schema: Schema) -> DataFrame:
    """Value rules and final column order; prices are rounded after revenue was computed."""
    cleaned = derive_period(recompute_revenue(fill_defaults(canonicalise(kept, schema), schema)))
    if "unit_price" in cleaned.columns:
        cleaned = cleaned.withColumn("unit_price", F.round("unit_price", 2).cast(MONEY_TYPE))
    ordered = [SOURCE_ROW, *[spec.name for spec in schema], ORDER_MONTH]
    known = [name for name in ordered if name in cleaned.columns]
    extras = [
        name for name in cleaned.columns if name not in ordered and not name.endswith("__raw")
    ]
    return cleaned.select(*known, *extras)


# Inputs of the columns that cleaning computes.
INPUTS = {"revenue": ["quantity", "unit_price"], ORDER_MONTH: ["date"]}


def clean_rows(
    checked: DataFrame, schema: Schema, policy: QualityPolicy, columns: list[str] | None = None
) -> DataFrame:
    """Valid rows, first occurrence per key, value rules applied; not sorted.

    ``columns`` names the cleaned columns a caller needs; only their inputs then
    travel through the shuffle by key.
    """
    key = policy.duplicate_column
    needed = None
    if columns is not None:
        inputs = {name for wanted in columns for name in INPUTS.get(wanted, [wanted])}
        inputs |= {SOURCE_ROW, key}
        needed = [name for name in checked.columns if name in inputs]
    rows = valid_rows(checked, needed)
    if key in rows.columns:
        rows = keep_first(rows, key)
    cleaned = apply_value_rules(rows, schema)
    return cleaned if columns is None else cleaned.select(*columns)


def export_order(clean: DataFrame) -> DataFrame:
    """Rows in report order.  A range-partitioned sort, needed for an export only."""
    keys = [name for name in ("date", "order_id", SOURCE_ROW) if name in clean.columns]
    return clean.orderBy(*keys)


def exclude_rows(df: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows not listed in a stored quarantine (when validation ran earlier)."""
    return df.join(rejected.select(SOURCE_ROW), SOURCE_ROW, "left_anti")


# ---------------------------------------------------------------------------
# Audit log
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Change:
    """One kind of change: when it happens and how an example is shown.

    ``place`` orders the examples of an action before the row number does;
    ``once`` marks an example that is the same text for every row.
    """

    action: str
    place: int
    fires: Column
    example: Callable[[], Column]
    once: bool = False
    detail: str | None = None

    def text(self) -> str:
        return self.detail or {**PREPARATION, **CLEANING}[self.action]


def _row_number() -> Column:
    return F.col(SOURCE_ROW).cast("string")


def category_edits(schema: Schema, columns: list[str]) -> list[tuple[str, Column, Column]]:
    """``(column, before, after)`` of every category column."""
    return [
        (spec.name, F.col(spec.name), canonical_key(F.col(spec.name), spec))
        for spec in _categories(schema, columns)
    ]


def categorical_changes(kept: DataFrame, schema: Schema) -> DataFrame:
    """Every category cell that changes, in long form."""
    edits = [
        F.when(
            before != after,
            F.array(
                F.struct(
                    F.lit(place).alias("position"),
                    F.lit(name).alias("column"),
                    before.alias("before"),
                    after.alias("after"),
                )
            ),
        ).otherwise(F.array())
        for place, (name, before, after) in enumerate(category_edits(schema, kept.columns))
    ]
    return kept.select(SOURCE_ROW, F.inline(F.concat(*edits)))


def value_changes(schema: Schema, columns: list[str]) -> list[Change]:
    """What the value rules change in a kept row."""
    changes = []
    for place, (_, before, after) in enumerate(category_edits(schema, columns)):
        changes.append(
            Change("categorical_values_normalised", place, before != after,
                   lambda x=before, y=after: change_example(x, y))
        )
    for place, spec in enumerate(spec for spec in present(schema, columns) if spec.default):
        example = f"{spec.name} = {spec.default!r}"
        detail = CLEANING["default_values_filled"].format(repr(spec.name))
        changes.append(
            Change("default_values_filled", place, F.col(spec.name).isNull(), lambda x=example: F.lit(x), True, detail)
        )
    if {"quantity", "unit_price", "revenue"} <= set(columns):
        given = F.col("revenue")
        computed = line_revenue(F.col("quantity"), F.col("unit_price"))
        changes += [
            Change("revenue_recalculated", 0, F.round(given, 2) != computed,
                   lambda: change_example(money_text(given), money_text(computed))),
            Change("revenue_recalculated", 1, given.isNull(), lambda: F.lit(BLANK_REVENUE_EXAMPLE), True),
        ]
    return changes


def _fired(rows: DataFrame, changes: list[Change], first: int = 0) -> DataFrame:
    """``(source_row, change)``: the numbers of the changes of every row."""
    numbers = [F.when(change.fires, F.lit(first + k)) for k, change in enumerate(changes)]
    return rows.select(SOURCE_ROW, F.explode(F.array_compact(F.array(*numbers))).alias("change"))


def _summarise(fired: DataFrame, rows: DataFrame, changes: list[Change], stage: str, order: list[str]) -> DataFrame:
    """Count changes per action and show the first three distinct examples.

    Changes are counted and ranked by number.  Example texts are built from ``rows`` only
    for the changes that are shown, at most three of each action, so they can be broadcast.
    """
    facts = F.array(
        *[
            F.struct(
                F.lit(order.index(change.action) + 1).alias("position"),
                F.lit(change.place).alias("place"),
                F.lit(change.once).alias("once"),
            )
            for change in changes
        ]
    )
    known = fired.withColumn("fact", F.get(facts, F.col("change"))).select(SOURCE_ROW, "change", "fact.*")
    counts = known.groupBy("position", "change", "place", "once").agg(
        F.count("*").alias("records"), F.min(SOURCE_ROW).alias(SOURCE_ROW)
    )
    place = Window.partitionBy("position").orderBy("place", SOURCE_ROW)
    varying = known.filter(~F.col("once")).withColumn("rank", F.row_number().over(place))
    varying = varying.filter(F.col("rank") <= EXAMPLES).select(SOURCE_ROW, "change", "position", "place")
    texts = [F.when(F.col("change") == k, change.example().cast("string")) for k, change in enumerate(changes)]
    shown = rows.join(F.broadcast(varying), SOURCE_ROW).select(
        "position", F.struct("place", SOURCE_ROW, F.coalesce(*texts).alias("example")).alias("entry")
    )
    constant = [
        F.when(F.col("change") == k, change.example().cast("string")) for k, change in enumerate(changes) if change.once
    ]
    entry = F.struct("place", SOURCE_ROW, (F.coalesce(*constant) if constant else F.lit("")).alias("example"))
    details = F.array(*[F.lit(change.text()) for change in changes])
    totals = counts.groupBy("position").agg(
        F.sum("records").alias("records"),
        F.max(F.struct("place", F.get(details, F.col("change")).alias("detail"))).alias("last"),
        F.collect_list(F.when(F.col("once"), entry)).alias("constants"),
    )
    listed = shown.groupBy("position").agg(F.collect_list("entry").alias("entries"))
    every = F.array_sort(F.concat(F.coalesce("entries", F.array().cast("array<struct<place:int,source_row:bigint,example:string>>")), F.col("constants")))
    examples = F.slice(F.array_distinct(F.transform(every, lambda e: e["example"])), 1, EXAMPLES)
    action, numbers = F.get(F.array(*[F.lit(x) for x in order]), F.col("position") - 1), F.array_join(examples, ", ")
    return totals.join(listed, "position", "left").select(
        F.lit(stage).alias("stage"),
        "position",
        action.alias("action"),
        "records",
        F.col("last.detail").alias("detail"),
        F.when(action == "blank_rows_dropped", F.concat(F.lit("row "), numbers))
        .when(action.isin("rejected_rows_removed", "duplicate_orders_removed"), F.concat(F.lit("rows "), numbers))
        .otherwise(F.array_join(examples, "; "))
        .alias("examples"),
    )


def _known_actions(spark: SparkSession, stage: str, entries: list[tuple[str, int, list[str]]],
                   order: list[str]) -> DataFrame:
    """Actions known from metadata alone, such as renamed headers."""
    rows = [
        (stage, order.index(action) + 1, action, records, {**PREPARATION, **CLEANING}[action],
         "; ".join(list(dict.fromkeys(examples))[:EXAMPLES]))
        for action, records, examples in entries
    ]
    return spark.createDataFrame(
        rows,
        "stage string, position int, action string, records bigint, detail string, examples string",
    )


def preparation_actions(audit: DataFrame, schema: Schema, mapping: HeaderMapping) -> DataFrame:
    """What preparation changed: ``(stage, position, action, records, detail, examples)``.

    ``audit`` holds the prepared rows, blank ones included, with the texts that
    white-space normalisation changed (see :func:`prepare.audited`).
    """
    order = list(PREPARATION)
    texts = text_columns(audit, schema)
    changes = [Change(order[0], 0, F.col(BLANK), _row_number)]
    def in_place(place: int) -> Callable[[Column], Column]:
        return lambda change: change["place"] == place

    for place, _ in enumerate(texts):
        before = F.get(F.filter(SPACES, in_place(place)), F.lit(0))["before"]
        changes.append(
            Change(order[3], place, F.exists(SPACES, in_place(place)),
                   lambda x=before: change_example(x, normalise_text(x)))
        )
    rows = audit.select(SOURCE_ROW, BLANK, SPACES)
    changed = _summarise(_fired(rows, changes), rows, changes, "prepare", order)
    renamed = [f"{before!r} -> {after!r}" for before, after in mapping.recognised]
    entries = [
        (action, len(items), items)
        for action, items in ((order[1], renamed), (order[2], list(mapping.retained)))
        if items
    ]
    if not entries:
        return changed
    return changed.unionByName(_known_actions(audit.sparkSession, "prepare", entries, order))


def cleaning_actions(
    checked: DataFrame, schema: Schema, policy: QualityPolicy, entered: DataFrame | None = None
) -> DataFrame:
    """What cleaning changed, same columns as :func:`preparation_actions`.

    ``entered`` lists the source rows of the clean table where more than these rows decide
    about duplicates (an incremental run).
    """
    key = policy.duplicate_column
    order = list(CLEANING)
    valid = valid_rows(checked)
    values = value_changes(schema, valid.columns)
    changes = [
        Change("rejected_rows_removed", 0, F.lit(True), _row_number),
        Change("duplicate_orders_removed", 0, F.lit(True), _row_number),
        *values,
    ]
    fired = rejected_rows(checked, [SOURCE_ROW]).withColumn("change", F.lit(0))
    kept = valid
    if entered is not None:
        kept = valid.join(entered, SOURCE_ROW, "left_semi")
        repeated = valid.select(SOURCE_ROW).join(entered, SOURCE_ROW, "left_anti")
        fired = fired.unionByName(repeated.select(SOURCE_ROW, F.lit(1).alias("change")))
    elif key in checked.columns:
        kept = keep_first(valid, key)
        repeated = later_duplicates(valid.select(SOURCE_ROW, key), key)
        fired = fired.unionByName(repeated.select(SOURCE_ROW, F.lit(1).alias("change")))
    fired = fired.unionByName(_fired(kept, values, first=2))
    actions = _summarise(fired, checked, changes, "clean", order)
    if "date" not in checked.columns:
        return actions
    derived = valid_rows(checked, [SOURCE_ROW]).limit(1).select(
        F.lit("clean").alias("stage"),
        F.lit(len(order)).alias("position"),
        F.lit("derived_columns_added").alias("action"),
        F.lit(1).cast("bigint").alias("records"),
        F.lit(CLEANING["derived_columns_added"]).alias("detail"),
        F.lit("").alias("examples"),
    )
    return actions.unionByName(derived)


def action_records(actions: DataFrame, action: str) -> DataFrame:
    """Records changed by one action, 0 when it did not occur."""
    return actions.filter(F.col("action") == action).agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records")
    )
