"""Business figures over clean rows.

Every figure is a map-side combined aggregate; a frequent key is reduced on each
task before anything is shuffled.  Window functions only ever see aggregated
tables (one row per month).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.functions.cells import date_text
from tidyledger.functions.numbers import average_money, money_double, percent, share
from tidyledger.schema import MONEY_TYPE, NON_REVENUE_STATUSES, ORDER_MONTH, DataQualityError
from tidyledger.session import stored

# ---------------------------------------------------------------------------
# Columns the figures need, names of the compared metrics.
# ---------------------------------------------------------------------------
ANALYTICS_COLUMNS = (
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
)
DIMENSIONS = ("product", "category", "region")
COMPARED = {
    "net_revenue": "net revenue",
    "gross_revenue": "gross revenue",
    "order_count": "orders",
    "average_order_value": "average order value",
    "total_quantity": "units sold",
    "distinct_customers": "distinct customers",
}
ALL_PERIODS = "All periods"
AVAILABLE = "ok"
UNAVAILABLE = {"empty": "no cleaned rows are available", "columns": "missing column(s): "}
SNAPSHOT_INPUTS = ["date", "customer", "quantity", "revenue", "status", ORDER_MONTH]


def missing_columns(clean: DataFrame) -> list[str]:
    return [name for name in ANALYTICS_COLUMNS if name not in clean.columns]


def _no_figures(clean: DataFrame, valid: DataFrame | None) -> tuple[str, str] | None:
    """(what is wrong, which columns): no rows come before missing columns.

    There are cleaned rows exactly when there are ``valid`` rows, the ones before duplicates
    leave; given those, one row is read and nothing is shuffled.
    """
    if (clean if valid is None else valid).isEmpty():
        return "empty", ""
    missing = missing_columns(clean)
    return ("columns", ", ".join(missing)) if missing else None


def analytics_available(clean: DataFrame, valid: DataFrame | None = None) -> tuple[bool, str]:
    """Can the figures be computed, and if not, why?"""
    fault = _no_figures(clean, valid)
    return (True, AVAILABLE) if fault is None else (False, UNAVAILABLE[fault[0]] + fault[1])


def analytics_guard(clean: DataFrame, top_n: int, valid: DataFrame | None = None) -> None:
    """Raise when the figures cannot be computed; ``top_n`` is looked at last."""
    fault = _no_figures(clean, valid)
    if fault is not None:
        raise DataQualityError(f"no figures: {UNAVAILABLE[fault[0]]}{fault[1]}")
    check_top_n(top_n)


def check_top_n(top_n: int) -> None:
    if top_n < 1:
        raise DataQualityError("a ranking needs at least one place")


def revenue_bearing() -> Column:
    """Status stands for realised revenue; an unknown status counts as realised."""
    return ~F.coalesce(F.col("status").isin(*NON_REVENUE_STATUSES), F.lit(False))


def _sums() -> list[Column]:
    realised = revenue_bearing()

    def total(value: Column, name: str, kind) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast(kind).alias(name)

    return [
        F.count("*").alias("order_count"),
        F.count_if(realised).alias("revenue_orders"),
        total(F.col("quantity"), "total_quantity", "bigint"),
        total(F.col("revenue"), "gross", MONEY_TYPE),
        total(F.when(realised, F.col("revenue")), "net", MONEY_TYPE),
    ]


# ---------------------------------------------------------------------------
# Snapshots
# ---------------------------------------------------------------------------
MEMBERS = "distinct_customers"


def _snapshot_sums(members: Column | None = None) -> list[Column]:
    """``members`` stands in for the distinct customers where these are counted apart."""
    realised_units = F.sum(F.when(revenue_bearing(), F.col("quantity")))
    return [
        *_sums(),
        F.coalesce(realised_units, F.lit(0)).cast("bigint").alias("revenue_quantity"),
        (F.count_distinct("customer") if members is None else members).alias(MEMBERS),
        F.coalesce(date_text(F.min("date")), F.lit("")).alias("period_start"),
        F.coalesce(date_text(F.max("date")), F.lit("")).alias("period_end"),
    ]


def snapshot(clean: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Headline figures per group (or one row), money still exact.

    The distinct customers are counted from (group, customer) pairs, so the rows
    of a frequent customer are combined before the shuffle.
    """
    return clean.groupBy(*(by or [])).agg(*_snapshot_sums())


def snapshot_figures(snapshots: DataFrame, label: Column) -> DataFrame:
    """Snapshots with ratios, money as DOUBLE."""
    orders, net = F.col("order_count"), F.col("net")
    return snapshots.select(
        label.alias("label"),
        "period_start",
        "period_end",
        "order_count",
        "revenue_orders",
        "distinct_customers",
        "total_quantity",
        "revenue_quantity",
        money_double(F.col("gross")).alias("gross_revenue"),
        money_double(net).alias("net_revenue"),
        money_double(F.col("gross") - net).alias("excluded_revenue"),
        average_money(net, F.col("revenue_orders")).alias("average_order_value"),
        average_money(net, F.col("revenue_quantity")).alias("average_unit_price"),
        share(orders - F.col("revenue_orders"), orders).alias("cancellation_rate_pct"),
    )


def kpi_overall(clean: DataFrame) -> DataFrame:
    return snapshot_figures(snapshot(clean), F.lit(ALL_PERIODS))


def status_distribution(clean: DataFrame) -> DataFrame:
    """Orders per status; a missing status counts under its own NULL entry."""
    counts = clean.groupBy("status").agg(F.count("*").alias("orders"))
    total = counts.agg(F.sum("orders")).scalar()
    return counts.select(
        "status", "orders", share(F.col("orders"), total).alias("share_pct")
    ).orderBy(F.desc("orders"), "status")


# ---------------------------------------------------------------------------
# Dimensions
# ---------------------------------------------------------------------------
def dimension_sums(clean: DataFrame, dimension: str, by: list[str] | None = None) -> DataFrame:
    return clean.groupBy(*(by or []), F.col(dimension).alias("key")).agg(*_sums())


def with_share(sums: DataFrame) -> DataFrame:
    """Add share of total net revenue and the average order value.

    The total is an aggregate of the same sums that reads all of them, so both
    uses share one shuffle; no row of the detail data is read again.
    """
    columns = ("net", "gross", "total_quantity", "revenue_orders", "order_count")
    totals = sums.agg(F.struct(*[F.sum(name).alias(name) for name in columns])).scalar()
    return sums.select(
        "key",
        "order_count",
        "total_quantity",
        money_double(F.col("gross")).alias("gross_revenue"),
        money_double(F.col("net")).alias("net_revenue"),
        share(F.col("net") * 100, totals.getField("net") * 100).alias("revenue_share_pct"),
        average_money(F.col("net"), F.col("revenue_orders")).alias("average_order_value"),
    )


def dimension_metrics(clean: DataFrame, dimension: str, ordered: bool = True) -> DataFrame:
    """Performance per value of a dimension, best net revenue first."""
    metrics = with_share(dimension_sums(clean, dimension))
    return metrics.orderBy(F.desc("net_revenue"), "key") if ordered else metrics


def multi_dimension(clean: DataFrame, dimensions: list[str]) -> DataFrame:
    """All headline figures for every dimension and overall (grouping sets); the rows are computed and written once.

    ``key`` is NULL for the overall row; the share of net revenue is of that row's.  Sums and distinct
    customers are grouped apart: a row for each set and customer then carries no sums.
    """
    # A grouped column is NULL in the other sets, so the figures read the columns themselves.
    keys = [f"_by_{name}" for name in dimensions]
    needed = dict.fromkeys([*dimensions, "date", "customer", "quantity", "revenue", "status"])
    rows = stored(clean.select(*needed), "grouping-rows")
    keyed = rows.withColumns({key: F.col(name) for key, name in zip(keys, dimensions, strict=True)})
    sets = keyed.groupingSets([[], *[[F.col(key)] for key in keys]], *keys)
    place = F.grouping_id(*keys).alias("_set")
    sums = sets.agg(*_snapshot_sums(F.max(F.lit(None).cast("bigint"))), place)
    members = sets.agg(F.count_distinct("customer").alias(MEMBERS), place)
    both = sums.unionByName(members, allowMissingColumns=True)
    figured = [name for name in sums.columns if name not in (*keys, "_set")]
    grouped = both.groupBy(*keys, "_set").agg(*[F.max(name).alias(name) for name in figured])
    width = len(dimensions)
    names = {(1 << width) - 1: "overall"}
    for position, name in enumerate(dimensions):
        names[(1 << width) - 1 - (1 << (width - 1 - position))] = name
    pairs = [F.lit(item) for pair in names.items() for item in pair]
    dimension = F.create_map(*pairs)[F.col("_set").cast("int")]
    label = F.struct(dimension.alias("dimension"), F.coalesce(*keys).alias("key"))
    # The share needs the overall row: the few aggregated rows are written, the detail rows are read once.
    figures = stored(snapshot_figures(grouped, label), "grouping-sets")
    total = figures.filter(F.col("label.dimension") == "overall").agg(F.max("net_revenue")).scalar()
    exact = F.col("net_revenue").cast("decimal(38,2)") * 100
    return figures.select(
        "label.*",
        *[name for name in figures.columns if name != "label"],
        share(exact, total.cast("decimal(38,2)") * 100).alias("revenue_share_pct"),
    )


def trend(clean: DataFrame) -> DataFrame:
    """Orders and net revenue per available month, ascending; gaps stay gaps."""
    months = clean.filter(F.col(ORDER_MONTH).isNotNull()).groupBy(ORDER_MONTH).agg(*_sums())
    return months.select(
        ORDER_MONTH, "order_count", money_double(F.col("net")).alias("net_revenue")
    ).orderBy(ORDER_MONTH)


def dimension_focus(clean: DataFrame, dimension: str) -> DataFrame:
    """One row: best key, worst key and total net revenue of a dimension."""
    sums = dimension_sums(clean, dimension)
    ranked = sums.select("net", F.struct((-F.col("net")).alias("rank"), "key", "net").alias("entry"))
    picked = ranked.agg(
        F.min("entry").alias("best"), F.max("entry").alias("worst"), F.sum("net").alias("total")
    )
    return picked.select(
        F.lit(dimension).alias("dimension"),
        F.col("best.key").alias("best_key"),
        money_double(F.col("best.net")).alias("best_net_revenue"),
        F.col("worst.key").alias("worst_key"),
        money_double(F.col("worst.net")).alias("worst_net_revenue"),
        money_double(F.col("total")).alias("total_net_revenue"),
    )


def _ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Number a short, already limited list."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_products(clean: DataFrame, n: int = 5) -> DataFrame:
    """Best ``n`` products: each task keeps its best ``n``, no full sort."""
    check_top_n(n)
    order = (F.desc("net_revenue"), F.asc("key"))
    return _ranked(with_share(dimension_sums(clean, "product")).orderBy(*order).limit(n), *order)


def bottom_products(clean: DataFrame, n: int = 5) -> DataFrame:
    """Worst ``n`` products, worst first; ties in reverse key order."""
    check_top_n(n)
    order = (F.asc("net_revenue"), F.desc("key"))
    return _ranked(with_share(dimension_sums(clean, "product")).orderBy(*order).limit(n), *order)


# ---------------------------------------------------------------------------
# Periods
# ---------------------------------------------------------------------------
def latest_periods(clean: DataFrame) -> DataFrame:
    """One row: the latest month and the one before it among those available."""
    months = clean.select(ORDER_MONTH).filter(F.col(ORDER_MONTH).isNotNull()).distinct()
    latest = _ranked(months.orderBy(F.desc(ORDER_MONTH)).limit(2), F.desc(ORDER_MONTH))
    periods = latest.agg(
        F.max(F.when(F.col("rank") == 1, F.col(ORDER_MONTH))).alias("current_period"),
        F.max(F.when(F.col("rank") == 2, F.col(ORDER_MONTH))).alias("previous_period"),
    )
    current, previous = F.col("current_period"), F.col("previous_period")
    return periods.select(
        "current_period",
        "previous_period",
        F.coalesce(F.concat(previous, F.lit(" to "), current), current, F.lit(ALL_PERIODS)).alias(
            "period_label"
        ),
        F.coalesce(F.concat(current, F.lit(" vs "), previous), current, F.lit(ALL_PERIODS)).alias(
            "comparison_label"
        ),
    )


def month_snapshots(clean: DataFrame, by: list[str] | None = None) -> DataFrame:
    return snapshot(clean.filter(F.col(ORDER_MONTH).isNotNull()), [*(by or []), ORDER_MONTH])


def last_two(clean: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Snapshots of the latest two available months per group, ``rank`` 1 = latest."""
    window = Window.partitionBy(*(by or [])).orderBy(F.desc(ORDER_MONTH))
    months = month_snapshots(clean, by)
    return months.withColumn("rank", F.row_number().over(window)).filter("rank <= 2")


def period_snapshots(clean: DataFrame) -> DataFrame:
    return snapshot_figures(last_two(clean), F.col(ORDER_MONTH))


def compared_metrics(months: DataFrame) -> DataFrame:
    """The six compared metrics of every snapshot in long form, as exact decimals."""
    values = {
        "net_revenue": F.col("net"),
        "gross_revenue": F.col("gross"),
        "order_count": F.col("order_count"),
        "average_order_value": average_money(F.col("net"), F.col("revenue_orders")),
        "total_quantity": F.col("total_quantity"),
        "distinct_customers": F.col("distinct_customers"),
    }
    entries = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(label).alias("metric"),
            values[name].cast(MONEY_TYPE).alias("value"),
        )
        for position, (name, label) in enumerate(COMPARED.items(), start=1)
    ]
    keep = [name for name in months.columns if name in ("rank", ORDER_MONTH, "scope")]
    return months.select(*keep, F.inline(F.array(*entries)))


def change_columns(current: Column, previous: Column) -> list[Column]:
    change = current - previous
    return [
        money_double(current).alias("current"),
        money_double(previous).alias("previous"),
        money_double(change).alias("change"),
        percent(change * 100, previous * 100).alias("change_pct"),
    ]


def compare_periods(clean: DataFrame) -> DataFrame:
    """Latest month against the one before it; empty when there is only one month."""
    paired = (
        compared_metrics(last_two(clean))
        .groupBy("position", "metric")
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("current"),
            F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("previous"),
            F.max(F.when(F.col("rank") == 1, F.col(ORDER_MONTH))).alias("_now"),
            F.max(F.when(F.col("rank") == 2, F.col(ORDER_MONTH))).alias("_before"),
        )
        .filter("previous IS NOT NULL")
    )
    return paired.select(
        "position",
        "metric",
        *change_columns(F.col("current"), F.col("previous")),
        F.concat_ws(" vs ", "_now", "_before").alias("comparison_label"),
    ).orderBy("position")


def trend_change(clean: DataFrame) -> DataFrame:
    """Every month against the available month before it (one row per month and metric)."""
    window = Window.partitionBy("metric").orderBy(ORDER_MONTH)
    lagged = compared_metrics(month_snapshots(clean)).withColumn(
        "before", F.lag("value").over(window)
    )
    return lagged.filter("before IS NOT NULL").select(
        ORDER_MONTH, "metric", *change_columns(F.col("value"), F.col("before"))
    )
