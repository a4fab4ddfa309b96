"""Validation: every finding of every row, as expressions compiled from the schema.

Validation never changes data.  A row with at least one error is rejected and
stays visible; warnings mark cells a documented rule repairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.functions.cells import (
    canonical_key,
    line_revenue,
    money_text,
    quoted,
    short_number,
)
from tidyledger.operators.dedupe import later_duplicates
from tidyledger.operators.prepare import (
    data_columns,
    parse_failed,
    present,
    raw_name,
    rows_where,
)
from tidyledger.schema import (
    SOURCE_ROW,
    ColumnSpec,
    DataQualityError,
    QualityPolicy,
    Schema,
    required_columns,
)
from tidyledger.session import stored

REJECTED = "is_rejected"
EXAMPLES = 3

# ---------------------------------------------------------------------------
# Codes and wording of the findings.
# ---------------------------------------------------------------------------
INVALID_DATE = "INVALID_DATE"
INVALID_INTEGER = "INVALID_INTEGER"
INVALID_NUMBER = "INVALID_NUMBER"
MISSING_VALUE = "MISSING_VALUE"
OUT_OF_RANGE = "OUT_OF_RANGE"
INVALID_CATEGORY = "INVALID_CATEGORY"
DUPLICATE_ORDER_ID = "DUPLICATE_ORDER_ID"
REVENUE_OUTLIER = "REVENUE_OUTLIER"
REVENUE_MISMATCH = "REVENUE_MISMATCH"

PARSE_CODES = {
    "date": (INVALID_DATE, " is not an accepted date format"),
    "integer": (INVALID_INTEGER, " is not a whole number"),
    "numeric": (INVALID_NUMBER, " is not numeric"),
}
DERIVED_NOT_NUMERIC = "{}: not numeric - the value is recalculated during cleaning"
MISSING_DEFAULTED = "{}: missing value replaced by the documented default '{}'"
MISSING_REQUIRED = "{}: value is missing"
BELOW_MINIMUM = " is below the documented minimum of {:g}"
ABOVE_MAXIMUM = " is above the documented maximum of {:g}"
NOT_RECOGNISED = " is not a recognised value (allowed: {})"
OUTLIER = (
    "revenue exceeds the configured outlier threshold ({:g}) - kept, but worth a manual review"
)
BLANK_REVENUE = "revenue is blank - derived from quantity * unit_price"
MISMATCH = "revenue does not match quantity * unit_price - recalculated during cleaning"
DUPLICATE = "duplicate order id - only the first occurrence is used for analytics"
EMPTY_INPUT = "the source range contains no data rows (only a header row was found)"
MISSING_COLUMNS = "required column(s) missing from the source data: "


@dataclass(frozen=True)
class Rule:
    """One check: when it fires, and what it reports.

    The texts are built on demand: most plans only need to know whether it fires.
    """

    fires: Column
    code: str
    severity: str
    column: str
    message: Callable[[], Column]
    example: Callable[[], Column]

    def issue(self) -> Column:
        return F.struct(
            F.lit(self.code).alias("code"),
            F.lit(self.severity).alias("severity"),
            F.lit(self.column).alias("column"),
            self.message().alias("message"),
            self.example().alias("example"),
        )


def _row_example(*detail: Column) -> Column:
    number = F.concat(F.lit("row "), F.col(SOURCE_ROW).cast("string"))
    return F.concat(number, F.lit(": "), *detail) if detail else number


def _error(fires: Column, code: str, column: str, message: Callable[[], Column]) -> Rule:
    return Rule(fires, code, "error", column, message, _row_example)


def _warning(
    fires: Column, code: str, column: str, message: str, detail: Callable[[], list[Column]] = list
) -> Rule:
    return Rule(
        fires, code, "warning", column, lambda: F.lit(message), lambda: _row_example(*detail())
    )


def _parse_rule(spec: ColumnSpec) -> Rule:
    code, wording = PARSE_CODES[spec.kind]

    def shown() -> Column:
        return quoted(F.col(raw_name(spec.name)))

    if spec.kind == "numeric" and spec.derived:
        message = DERIVED_NOT_NUMERIC.format(spec.name)
        return _warning(parse_failed(spec), code, spec.name, message, lambda: [shown()])
    return _error(
        parse_failed(spec),
        code,
        spec.name,
        lambda: F.concat(F.lit(f"{spec.name}: "), shown(), F.lit(wording)),
    )


def _range_rule(spec: ColumnSpec) -> Rule:
    cell = F.col(spec.name)
    bounds = []
    if spec.minimum is not None:
        bounds.append((cell < F.lit(spec.minimum), BELOW_MINIMUM.format(spec.minimum)))
    if spec.maximum is not None:
        bounds.append((cell > F.lit(spec.maximum), ABOVE_MAXIMUM.format(spec.maximum)))
    outside = F.coalesce(reduce(or_, [broken for broken, _ in bounds]), F.lit(False))

    def message() -> Column:
        wording = F.coalesce(*[F.when(broken, text) for broken, text in bounds])
        return F.concat(F.lit(f"{spec.name}: "), short_number(cell), wording)

    return _error(outside, OUT_OF_RANGE, spec.name, message)


def _value_rules(spec: ColumnSpec, columns: list[str]) -> list[Rule]:
    cell = F.col(spec.name)
    rules = []
    missing = cell.isNull()
    if raw_name(spec.name) in columns and not (spec.kind == "numeric" and spec.derived):
        missing = missing & F.col(raw_name(spec.name)).isNull()
    if spec.default:
        message = MISSING_DEFAULTED.format(spec.name, spec.default)
        rules.append(_warning(missing, MISSING_VALUE, spec.name, message))
    elif spec.required:
        required = MISSING_REQUIRED.format(spec.name)
        rules.append(_error(missing, MISSING_VALUE, spec.name, lambda: F.lit(required)))
    if spec.kind in ("integer", "numeric"):
        if spec.minimum is not None or spec.maximum is not None:
            rules.append(_range_rule(spec))
    elif spec.kind == "category":
        unknown = cell.isNotNull() & canonical_key(cell, spec).isNull()
        wording = NOT_RECOGNISED.format(", ".join(sorted(spec.allowed)))
        rules.append(
            _error(
                unknown,
                INVALID_CATEGORY,
                spec.name,
                lambda: F.concat(F.lit(f"{spec.name}: "), quoted(cell), F.lit(wording)),
            )
        )
    return rules


def cell_rules(schema: Schema, columns: list[str]) -> list[Rule]:
    """Rules on single cells, in the order in which reasons are listed.

    Cells that did not parse come first (dates, then integers, then numbers by
    column name), then the value rules in schema order.  A cell that did not
    parse is not reported as missing too.  Without the source text of a column
    both look alike, which is enough to know whether a row is rejected.
    """
    specs = present(schema, columns)
    rules = []
    for kind in PARSE_CODES:
        of_kind = sorted(
            (s for s in specs if s.kind == kind and raw_name(s.name) in columns),
            key=lambda s: s.name,
        )
        rules += [_parse_rule(spec) for spec in of_kind]
    for spec in specs:
        rules += _value_rules(spec, columns)
    return rules


def revenue_rules(policy: QualityPolicy, columns: list[str]) -> list[Rule]:
    """Checks of the given revenue; they apply to valid rows only."""
    if "revenue" not in columns:
        return []
    revenue = F.col("revenue")
    limit = policy.outlier_threshold
    rules = [
        _warning(
            F.coalesce(revenue > F.lit(limit), F.lit(False)),
            REVENUE_OUTLIER,
            "revenue",
            OUTLIER.format(limit),
            lambda: [money_text(revenue)],
        )
    ]
    if {"quantity", "unit_price"} <= set(columns):
        expected = line_revenue(F.col("quantity"), F.col("unit_price"))
        inputs = F.col("quantity").isNotNull() & F.col("unit_price").isNotNull()
        rules += [
            _warning(inputs & revenue.isNull(), MISSING_VALUE, "revenue", BLANK_REVENUE),
            _warning(
                F.coalesce(inputs & (F.round(revenue, 2) != expected), F.lit(False)),
                REVENUE_MISMATCH,
                "revenue",
                MISMATCH,
                lambda: [
                    F.lit("given "), money_text(revenue), F.lit(" -> "), money_text(expected)
                ],
            ),
        ]
    return rules


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


# ---------------------------------------------------------------------------
# Row-level operators
# ---------------------------------------------------------------------------
def schema_gate(df: DataFrame, schema: Schema, rows_known: bool = False) -> None:
    """Stop when a required column is absent (metadata) or there is no row (one row is read)."""
    missing = [name for name in required_columns(schema) if name not in df.columns]
    if not rows_known and df.isEmpty():
        raise DataQualityError(EMPTY_INPUT)
    if missing:
        raise DataQualityError(MISSING_COLUMNS + ", ".join(missing))


def check_rows(coerced: DataFrame, schema: Schema) -> DataFrame:
    """Add ``is_rejected``: does any error rule fire for the row?"""
    rules = cell_rules(schema, coerced.columns)
    return coerced.withColumn(REJECTED, _any([r.fires for r in rules if r.severity == "error"]))


def valid_rows(checked: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without errors; ``columns`` limits what is carried along."""
    kept = columns or [name for name in checked.columns if name != REJECTED]
    return rows_where(checked, ~F.col(REJECTED), kept)


def rejected_rows(checked: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return rows_where(checked, F.col(REJECTED), columns)


def issue_array(schema: Schema, policy: QualityPolicy, columns: list[str]) -> Column:
    """All findings of a row on its own cells, in order (duplicates need other rows)."""
    kept = ~F.col(REJECTED)
    pieces = [
        F.when(rule.fires, F.array(rule.issue())).otherwise(F.array())
        for rule in cell_rules(schema, columns)
    ] + [
        F.when(kept & rule.fires, F.array(rule.issue())).otherwise(F.array())
        for rule in revenue_rules(policy, columns)
    ]
    return F.concat(*pieces)


def row_issues(checked: DataFrame, schema: Schema, policy: QualityPolicy) -> DataFrame:
    """Findings on single rows in long form: source_row, code, severity, column, message, example."""
    # In a projection of its own, which Spark compiles in small methods, and not as part of the generator.
    found = checked.select(SOURCE_ROW, issue_array(schema, policy, checked.columns).alias("_issues"))
    return found.select(SOURCE_ROW, F.inline("_issues"))


def duplicate_issues(checked: DataFrame, policy: QualityPolicy) -> DataFrame:
    """A warning for every valid row that repeats the key of an earlier valid row."""
    key = policy.duplicate_column
    rows = valid_rows(checked, [SOURCE_ROW, key])
    return later_duplicates(rows, key).select(
        SOURCE_ROW,
        F.lit(DUPLICATE_ORDER_ID).alias("code"),
        F.lit("warning").alias("severity"),
        F.lit(key).alias("column"),
        F.lit(DUPLICATE).alias("message"),
        _row_example(quoted(F.col(key).cast("string"))).alias("example"),
    )


def all_issues(checked: DataFrame, schema: Schema, policy: QualityPolicy) -> DataFrame:
    """Findings in long form.  The few columns that both kinds need are written, so rows are computed once."""
    key = policy.duplicate_column
    if key not in checked.columns:
        return row_issues(checked, schema, policy)
    found = issue_array(schema, policy, checked.columns).alias("_issues")
    rows = stored(checked.select(SOURCE_ROW, key, REJECTED, found), "issues")
    issues = rows.select(SOURCE_ROW, F.inline("_issues"))
    return issues.unionByName(duplicate_issues(rows, policy))


def joined_examples(separator: str = "; ", k: int = EXAMPLES) -> Column:
    """The distinct examples of :func:`first_examples` as one text."""
    return F.array_join(F.array_distinct(F.array(*[f"example_{n}" for n in range(1, k + 1)])), separator)


def _numbered_rules(schema: Schema, policy: QualityPolicy, columns: list[str]) -> list[tuple[Rule, Column]]:
    """Every rule with the condition under which it is reported; the one on duplicate keys is last."""
    kept = ~F.col(REJECTED)
    rules = [(rule, rule.fires) for rule in cell_rules(schema, columns)]
    rules += [(rule, kept & rule.fires) for rule in revenue_rules(policy, columns)]
    key = policy.duplicate_column
    if key in columns:
        shown = quoted(F.col(key).cast("string"))
        rules.append(
            (_warning(F.lit(False), DUPLICATE_ORDER_ID, key, DUPLICATE, lambda: [shown]), F.lit(False))
        )
    return rules


def findings(checked: DataFrame, schema: Schema, policy: QualityPolicy) -> DataFrame:
    """Findings per code, severity and column: count, first message, first three examples.

    Rules are counted and ranked by number; texts are built only for the rows that are
    shown, at most three of each finding, which is why they can be broadcast.
    """
    columns = checked.columns
    rules = _numbered_rules(schema, policy, columns)
    heads = [(rule.code, rule.severity, rule.column) for rule, _ in rules]
    groups = list(dict.fromkeys(heads))
    fired = checked.select(
        SOURCE_ROW,
        F.explode(F.array_compact(F.array(*[F.when(fires, F.lit(k)) for k, (_, fires) in enumerate(rules)]))).alias("rule"),
    )
    key = policy.duplicate_column
    if key in columns:
        repeated = later_duplicates(valid_rows(checked, [SOURCE_ROW, key]), key)
        fired = fired.unionByName(repeated.select(SOURCE_ROW, F.lit(len(rules) - 1).alias("rule")))
    of_rule = F.array(*[F.lit(groups.index(head)) for head in heads])
    fired = fired.withColumn("finding", F.get(of_rule, F.col("rule")))
    counts = fired.groupBy("finding").agg(F.count("*").alias("records"))
    place = Window.partitionBy("finding").orderBy(SOURCE_ROW, "rule")
    shown = fired.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= EXAMPLES)
    texts = [F.when(F.col("rule") == k, F.struct(rule.message().alias("message"), rule.example().alias("example")))
             for k, (rule, _) in enumerate(rules)]
    written = checked.join(F.broadcast(shown), SOURCE_ROW).select("finding", "rank", F.coalesce(*texts).alias("text"))
    examples = written.groupBy("finding").agg(
        F.max(F.when(F.col("rank") == 1, F.col("text.message"))).alias("message"),
        *[F.max(F.when(F.col("rank") == n, F.col("text.example"))).alias(f"example_{n}") for n in range(1, EXAMPLES + 1)],
    )
    head = F.get(
        F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(g, ("code", "severity", "column"))]) for g in groups]),
        F.col("finding"),
    )
    return (
        counts.join(examples, "finding")
        .select(head.alias("head"), "records", "message", joined_examples().alias("examples"))
        .select("head.*", "records", "message", "examples")
        .orderBy(F.col("severity") != "error", "code", "column")
    )


def rejected_records(checked: DataFrame, schema: Schema, policy: QualityPolicy) -> DataFrame:
    """Quarantine: one row per rejected record with codes, reasons and the whole text of every cell.

    Dates and numbers are stored as they were written in the source.
    """
    columns = checked.columns
    errors = [
        F.when(rule.fires, F.array(rule.issue())).otherwise(F.array())
        for rule in cell_rules(schema, columns)
        if rule.severity == "error"
    ]
    shown = [
        name
        for name in data_columns(checked)
        if name != REJECTED and not name.endswith("__raw")
    ]
    sources = [raw_name(name) if raw_name(name) in columns else name for name in shown]
    none = F.array().cast("array<struct<code:string,message:string>>")
    rows = rejected_rows(checked).withColumn("_errors", F.concat(*errors) if errors else none)
    order_id = F.col("order_id") if "order_id" in columns else F.lit(None).cast("string")
    return rows.select(
        SOURCE_ROW,
        order_id.alias("order_id"),
        F.array_sort(F.array_distinct(F.col("_errors.code"))).alias("codes"),
        F.col("_errors.message").alias("reasons"),
        F.map_from_arrays(
            F.array(*[F.lit(name) for name in shown]),
            F.array(*[F.coalesce(F.col(name).cast("string"), F.lit("")) for name in sources]),
        ).alias("values"),
    )


def duplicate_ids(checked: DataFrame, policy: QualityPolicy) -> DataFrame:
    key = policy.duplicate_column
    counted = valid_rows(checked, [key]).groupBy(key).agg(F.count("*").alias("records"))
    return counted.filter("records > 1").orderBy(key)


def row_totals(checked: DataFrame, schema: Schema, policy: QualityPolicy) -> DataFrame:
    """One row of totals over single-row findings and duplicate keys; the rows are computed once.

    Findings are summed for each key of valid rows (all rejected rows are one group), which
    Spark combines before the shuffle; the totals are sums over the keys.
    """
    cells = cell_rules(schema, checked.columns)
    revenue = revenue_rules(policy, checked.columns)
    kept = ~F.col(REJECTED)

    def fired(rules: list[Rule], scope: Column | None = None) -> Column:
        hits = [
            F.when(r.fires if scope is None else scope & r.fires, 1).otherwise(0) for r in rules
        ]
        return F.sum(reduce(lambda a, b: a + b, hits, F.lit(0)))

    keys = checked.groupBy(F.when(kept, F.col(policy.duplicate_column)).alias("_key"), kept.alias("_kept")).agg(
        F.count("*").alias("_n"),
        fired([r for r in cells if r.severity == "error"]).alias("errors"),
        (fired([r for r in cells if r.severity == "warning"]) + fired(revenue, kept)).alias("row_warnings"),
        fired([r for r in revenue if r.code == REVENUE_OUTLIER], kept).alias("outlier_rows"),
    )

    def total(value: Column | str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    return keys.agg(
        total("_n").alias("total_rows"),
        total(F.when(F.col("_kept"), F.col("_n"))).alias("valid_rows"),
        total(F.when(~F.col("_kept"), F.col("_n"))).alias("rejected_rows"),
        *[total(name).alias(name) for name in ("errors", "row_warnings", "outlier_rows")],
        F.count_if(F.col("_kept") & (F.col("_n") > 1)).alias("duplicate_ids"),
        total(F.when(F.col("_kept"), F.col("_n") - 1)).alias("duplicate_rows"),
    )


def validation_summary(checked: DataFrame, schema: Schema, policy: QualityPolicy) -> DataFrame:
    """One row: totals of a validation run."""
    return row_totals(checked, schema, policy).select(
        "total_rows",
        "valid_rows",
        "rejected_rows",
        "errors",
        (F.col("row_warnings") + F.col("duplicate_rows")).alias("warnings"),
        "duplicate_ids",
        "duplicate_rows",
        "outlier_rows",
    )


def findings_for(found: DataFrame, code: str) -> DataFrame:
    return found.filter(F.col("code") == code)


def rows_with_code(found: DataFrame) -> DataFrame:
    """Findings per code, over all columns."""
    return found.groupBy("code").agg(F.sum("records").alias("records"))


def summary_lines(summary: DataFrame) -> DataFrame:
    """Readable lines of a validation summary, one row per line."""
    line = [
        F.concat(F.lit("rows read: "), F.col("total_rows")),
        F.concat(F.lit("rows valid: "), F.col("valid_rows")),
        F.concat(F.lit("rows rejected: "), F.col("rejected_rows")),
        F.concat(F.lit("errors: "), F.col("errors"), F.lit(" | warnings: "), F.col("warnings")),
        F.when(
            F.col("duplicate_ids") > 0,
            F.concat(F.lit("duplicate order ids: "), F.col("duplicate_ids")),
        ),
        F.when(
            F.col("outlier_rows") > 0,
            F.concat(F.lit("revenue outlier rows flagged for review: "), F.col("outlier_rows")),
        ),
    ]
    numbered = summary.select(F.posexplode(F.array(*line)).alias("position", "line"))
    return numbered.filter("line IS NOT NULL")
