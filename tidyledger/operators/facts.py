"""Fact digests per group, sentences made from them, and insight records.

A digest is a compact JSON text of the figures of one scope (everything, or one
region ...) that fits a character budget.  Lists are cut to what can possibly
fit before they are collected, so a group never carries an unbounded list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.functions.cells import float_text
from tidyledger.functions.numbers import divide_half_up, cents
from tidyledger.functions.texts import clean_string_list
from tidyledger.operators import kpi
from tidyledger.operators.replies import parse_model_json
from tidyledger.schema import MONEY_TYPE, ORDER_MONTH

# ---------------------------------------------------------------------------
# Budget, sections in the order they are cut, listed sentences.
# ---------------------------------------------------------------------------
MAX_CHARS = 12_000
SECTIONS = ("period_change", "monthly_trend", "top_products", "status_distribution")
SHORTEST_ENTRY = 30
ENDS = ("product_count", "best_product", "worst_product", "month_count", "first_month", "last_month",
        "changes")
SALTS = 64
SCOPE = "scope"
FACT_INPUTS = ["product", "region", *kpi.SNAPSHOT_INPUTS]


def _json_text(col: Column) -> Column:
    """A JSON string literal."""
    wrapped = F.to_json(F.struct(F.coalesce(col, F.lit("")).alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def _object(**fields: Column) -> Column:
    """JSON object text with sorted keys; values are JSON texts already."""
    parts = [F.concat(F.lit(f'"{name}": '), fields[name]) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _ratio_money(total: Column, count: Column) -> Column:
    value = divide_half_up(cents(total), count).cast("decimal(38,0)") / 100
    return F.coalesce(value.cast(MONEY_TYPE), F.lit(0).cast(MONEY_TYPE))


def _percent_text(part: Column, whole: Column) -> Column:
    tenths = divide_half_up(part.cast("decimal(38,0)") * 1000, whole).cast("decimal(38,0)")
    return float_text((tenths / 10).cast("decimal(38,1)"))


def _section(rows: DataFrame, name: str, order: list[Column], limit: int) -> DataFrame:
    """Collect at most ``limit`` ordered entries per scope: all that can fit the budget.

    The entries of a scope are first ranked in ``SALTS`` parts, each cut to the limit, so
    no task sorts all entries of a scope, whatever the budget is.
    """
    salt = F.pmod(F.xxhash64("json"), F.lit(SALTS))
    parts = rows.withColumn("_salt", salt)
    local = F.row_number().over(Window.partitionBy(SCOPE, "_salt").orderBy(*order))
    parts = parts.withColumn("_rank", local).filter(F.col("_rank") <= limit).drop("_salt", "_rank")
    window = Window.partitionBy(SCOPE).orderBy(*order)
    numbered = parts.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= limit)
    entry = F.struct("_rank", *[c for c in rows.columns if c != SCOPE])
    return numbered.groupBy(SCOPE).agg(F.array_sort(F.collect_list(entry)).alias(name))


def _lengths(entries: Column) -> Column:
    """Characters of the first 1, 2, ... entries, separators included."""
    return F.aggregate(
        entries,
        F.array().cast("array<int>"),
        lambda done, entry: F.array_append(
            done,
            F.coalesce(F.try_element_at(done, F.lit(-1)) + 2, F.lit(0)) + F.length(entry["json"]),
        ),
    )


def _total(lengths: Column) -> Column:
    return F.coalesce(F.try_element_at(lengths, F.lit(-1)), F.lit(0))


def fact_sections(clean: DataFrame, by: str | None = None, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per scope: exact figures plus ordered lists of every section."""
    scope = F.lit(kpi.ALL_PERIODS) if by is None else F.col(by)
    scoped = clean.withColumn(SCOPE, scope)
    limit = max_chars // SHORTEST_ENTRY + 1
    net = F.col("net")

    products = kpi.dimension_sums(scoped, "product", [SCOPE]).select(
        SCOPE,
        "key",
        "net",
        _object(net_revenue=float_text(net), product=_json_text(F.col("key"))).alias("json"),
    )
    months = kpi.month_snapshots(scoped, [SCOPE])
    orders = F.col("order_count").cast("string")
    points = months.select(
        SCOPE,
        F.col(ORDER_MONTH).alias("key"),
        "net",
        _object(
            net_revenue=float_text(net), orders=orders, period=_json_text(F.col(ORDER_MONTH))
        ).alias("json"),
    )
    status = scoped.groupBy(SCOPE, "status").agg(F.count("*").alias("orders"))
    statuses = status.select(
        SCOPE,
        "status",
        "orders",
        _object(orders=F.col("orders").cast("string"), status=_json_text(F.col("status"))).alias(
            "json"
        ),
    )
    latest = months.withColumn(
        "rank",
        F.row_number().over(Window.partitionBy(SCOPE).orderBy(F.desc(ORDER_MONTH))),
    ).filter("rank <= 2")
    paired = (
        kpi.compared_metrics(latest)
        .groupBy(SCOPE, "position", "metric")
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("current"),
            F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("previous"),
        )
        .filter("previous IS NOT NULL")
        .withColumn("change", F.col("current") - F.col("previous"))
        .withColumn("pct", _percent_text(F.col("change") * 100, F.col("previous") * 100))
    )
    changes = paired.select(
        SCOPE,
        "position",
        "metric",
        "change",
        "pct",
        _object(
            change=float_text(F.col("change")),
            change_pct=F.coalesce(F.col("pct"), F.lit("null")),
            current=float_text(F.col("current")),
            metric=_json_text(F.col("metric")),
            previous=float_text(F.col("previous")),
        ).alias("json"),
    )
    labels = latest.groupBy(SCOPE).agg(
        F.concat_ws(
            " to ",
            F.max(F.when(F.col("rank") == 2, F.col(ORDER_MONTH))),
            F.max(F.when(F.col("rank") == 1, F.col(ORDER_MONTH))),
        ).alias("period")
    )
    sections = {
        "period_change": _section(changes, "period_change", [F.col("position")], limit),
        "monthly_trend": _section(points, "monthly_trend", [F.col("key")], limit),
        "top_products": _section(products, "top_products", [F.desc("net"), F.col("key")], limit),
        "status_distribution": _section(
            statuses, "status_distribution", [F.desc("orders"), F.col("status")], limit
        ),
    }
    # First and last of the whole lists; the lists themselves are cut to the budget.
    ends = products.groupBy(SCOPE).agg(
        F.count("*").alias("product_count"),
        F.min(F.struct((-net).alias("rank"), "key", "net")).alias("best_product"),
        F.max(F.struct((-net).alias("rank"), "key", "net")).alias("worst_product"),
    )
    span = months.groupBy(SCOPE).agg(
        F.count("*").alias("month_count"),
        F.min(F.struct(F.col(ORDER_MONTH).alias("key"), "net")).alias("first_month"),
        F.max(F.struct(F.col(ORDER_MONTH).alias("key"), "net")).alias("last_month"),
    )
    # At most one entry for each compared metric.
    told = changes.groupBy(SCOPE).agg(
        F.array_sort(F.collect_list(F.struct("position", "metric", "change", "pct"))).alias("changes")
    )
    facts = kpi.snapshot(scoped, [SCOPE]).join(labels, SCOPE, "left").join(told, SCOPE, "left")
    facts = facts.join(ends, SCOPE, "left").join(span, SCOPE, "left")
    for name, rows in sections.items():
        facts = facts.join(rows, SCOPE, "left")
    return facts


def facts_digest(clean: DataFrame, by: str | None = None, max_chars: int = MAX_CHARS) -> DataFrame:
    """One digest per scope.

    Over budget, entries leave from the end of one list after the other; the
    headline figures always stay.  The number kept follows from the running
    lengths, so nothing is cut step by step.
    """
    facts = fact_sections(clean, by, max_chars)
    bearing = F.col("order_count") - F.col("revenue_orders")
    scalars = {
        "period": _json_text(F.coalesce(F.col("period"), F.lit(kpi.ALL_PERIODS))),
        "net_revenue": float_text(F.col("net")),
        "gross_revenue": float_text(F.col("gross")),
        "order_count": F.col("order_count").cast("string"),
        "revenue_orders": F.col("revenue_orders").cast("string"),
        "distinct_customers": F.col("distinct_customers").cast("string"),
        "total_quantity": F.col("total_quantity").cast("string"),
        "average_order_value": float_text(_ratio_money(F.col("net"), F.col("revenue_orders"))),
        "average_unit_price": float_text(_ratio_money(F.col("net"), F.col("revenue_quantity"))),
        "cancellation_rate_pct": _percent_text(bearing, F.col("order_count")),
    }
    facts = facts.withColumns({f"_{name}": text for name, text in scalars.items()})
    facts = facts.withColumns({f"_len_{name}": _lengths(F.col(name)) for name in SECTIONS})
    empty = _object(
        **{name: F.col(f"_{name}") for name in scalars}, **{name: F.lit("[]") for name in SECTIONS}
    )
    room = F.lit(max_chars) - F.length(empty)
    for position, name in enumerate(SECTIONS):
        free = room
        for later in SECTIONS[position + 1 :]:
            free = free - _total(F.col(f"_len_{later}"))
        for earlier in SECTIONS[:position]:
            free = free - F.col(f"_used_{earlier}")
        facts = facts.withColumn("_free", free)
        facts = facts.withColumn(
            f"_keep_{name}",
            F.coalesce(
                F.size(F.filter(F.col(f"_len_{name}"), lambda used: used <= F.col("_free"))),
                F.lit(0),
            ),
        )
        kept = F.col(f"_keep_{name}")
        facts = facts.withColumn(
            f"_used_{name}",
            F.when(kept > 0, F.try_element_at(F.col(f"_len_{name}"), kept)).otherwise(0),
        )
        facts = facts.withColumn(
            name,
            F.slice(F.coalesce(F.col(name), F.array().cast(facts.schema[name].dataType)), F.lit(1), kept),
        )
    lists = {
        name: F.concat(F.lit("["), F.array_join(F.col(f"{name}.json"), ", "), F.lit("]"))
        for name in SECTIONS
    }
    digest = _object(**{name: F.col(f"_{name}") for name in scalars}, **lists)
    return facts.select(
        SCOPE,
        F.coalesce(F.col("period"), F.lit(kpi.ALL_PERIODS)).alias("period"),
        *[F.col(f"_{name}").alias(name) for name in scalars if name != "period"],
        *ENDS,
        *SECTIONS,
        digest.alias("digest"),
    )


def metrics_supplied(digests: DataFrame) -> DataFrame:
    """The scalar figures of a digest as ``metric: value`` lines, in order."""
    names = [
        "net_revenue",
        "gross_revenue",
        "order_count",
        "revenue_orders",
        "distinct_customers",
        "total_quantity",
        "average_order_value",
        "average_unit_price",
        "cancellation_rate_pct",
    ]
    lines = [F.concat(F.lit(f"{name}: "), F.col(name)) for name in names]
    return digests.select(SCOPE, F.posexplode(F.array(*lines)).alias("position", "line"))


def supplied_values(digests: DataFrame) -> DataFrame:
    """Every number a digest states, long form: ``(scope, value)``."""
    scalars = [
        F.col(name).cast("double")
        for name in ("net_revenue", "gross_revenue", "order_count", "revenue_orders",
                     "distinct_customers", "total_quantity", "average_order_value",
                     "average_unit_price", "cancellation_rate_pct")
    ]
    pattern = F.lit(r'"(?:net_revenue|orders|current|previous|change|change_pct)": (-?[0-9.]+)')
    listed = F.concat(*[F.col(f"{name}.json") for name in SECTIONS])
    numbers = F.flatten(F.transform(listed, lambda text: F.regexp_extract_all(text, pattern, F.lit(1))))
    every = F.concat(F.array(*scalars), F.transform(numbers, lambda n: n.cast("double")))
    return digests.select(SCOPE, F.explode(every).alias("value"))


# ---------------------------------------------------------------------------
# Sentences
# ---------------------------------------------------------------------------
def narrate(digests: DataFrame, most_changes: int | None = None) -> DataFrame:
    """Template sentences from the facts of every scope; no number is computed here.

    At most ``most_changes`` changes are told if given.
    """
    first, last = F.col("best_product"), F.col("worst_product")
    start, end = F.col("first_month"), F.col("last_month")
    summary = F.concat(
        F.lit("Over "), F.col("period"), F.lit(" the business recorded a net revenue of "),
        F.col("net_revenue"), F.lit(" across "), F.col("order_count"),
        F.lit(" orders (average order value "), F.col("average_order_value"), F.lit(")."),
    )
    leader = F.when(
        F.col("product_count") >= 1,
        F.concat(first["key"], F.lit(" led net revenue with "), float_text(first["net"])),
    )
    moved = F.when(
        F.col("month_count") >= 2,
        F.concat(
            F.lit("net revenue moved from "), float_text(start["net"]), F.lit(" in "), start["key"],
            F.lit(" to "), float_text(end["net"]), F.lit(" in "), end["key"],
        ),
    )
    watch = F.when(
        F.col("cancellation_rate_pct") != "0.0",
        F.concat(
            F.lit("cancelled or refunded orders accounted for "),
            F.col("cancellation_rate_pct"), F.lit("% of all orders"),
        ),
    )
    kind = "array<struct<position:int,metric:string,change:decimal(38,2),pct:string>>"
    every = F.coalesce(F.col("changes").cast(kind), F.array().cast(kind))
    changes = F.transform(
        F.filter(every, lambda change: change["pct"].isNotNull()),
        lambda change: F.concat(
            change["metric"], F.lit(" was "), F.when(change["change"] >= 0, "up").otherwise("down"),
            F.lit(" "), F.ltrim(change["pct"], F.lit("-")), F.lit("% versus the previous period"),
        ),
    )
    management = F.when(
        F.col("product_count") >= 2,
        F.concat(
            F.lit("protect momentum in "), first["key"], F.lit(" while reviewing "), last["key"],
            F.lit(" performance"),
        ),
    ).otherwise("keep focusing on the strongest product lines")
    return digests.select(
        SCOPE,
        summary.alias("executive_summary"),
        F.array_compact(F.array(leader, moved)).alias("positive_trends"),
        (changes if most_changes is None else F.slice(changes, 1, most_changes)).alias("negative_trends"),
        F.array_compact(F.array(watch)).alias("watch_items"),
        management.alias("management_summary"),
    )


NARRATIVE = (
    "executive_summary",
    "positive_trends",
    "negative_trends",
    "watch_items",
    "management_summary",
)
Writer = Callable[[str], str]


def replies(digests: DataFrame, fn: Writer | None = None, most_changes: int | None = None) -> DataFrame:
    """One reply per digest: from ``fn(digest)`` in Arrow batches, or from the templates.

    ``fn`` may be remote or random: write the replies once before several tables use them.
    """
    if fn is None:
        written = narrate(digests, most_changes).select(SCOPE, F.to_json(F.struct(*NARRATIVE)).alias("reply"))
        return written.withColumn("error", F.lit(None).cast("string"))

    @F.pandas_udf("reply string, error string")
    def write(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple[str | None, str | None]] = []
            for digest in batch:
                try:
                    rows.append((str(fn(digest)), None))
                except Exception as error:  # noqa: BLE001 - a failed reply is a result
                    rows.append((None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["reply", "error"], dtype=object)

    write = write.asNondeterministic()
    answered = digests.select(SCOPE, write(F.col("digest")).alias("_answer"))
    return answered.select(SCOPE, "_answer.*")


def _text_field(payload: Column, name: str) -> Column:
    value = F.try_variant_get(payload, f"$.{name}", "variant")
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, F.btrim(value.cast("string"))).otherwise("")


def _list_field(payload: Column, name: str, most: int | None, chars: int | None) -> Column:
    entries = F.try_variant_get(payload, f"$.{name}", "array<variant>")
    texts = F.filter(entries, lambda item: F.schema_of_variant(item) == "STRING")
    cleaned = clean_string_list(F.transform(texts, lambda item: item.cast("string")), most, chars)
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def interpret(
    digests: DataFrame,
    fn: Writer | None = None,
    enabled: bool = True,
    most_items: int | None = None,
    item_chars: int | None = None,
    most_changes: int | None = None,
) -> DataFrame:
    """One insight record per scope; a failure is a status, never an exception.

    Lists are whole unless limits are given.  With ``fn``, write the records before several
    tables use them: every use of this plan would call it again.
    """
    if not enabled:
        empty = F.array().cast("array<string>")
        return digests.select(
            SCOPE,
            F.lit("skipped").alias("status"),
            F.lit("interpretation is disabled").alias("status_detail"),
            *[
                (empty if name.endswith(("trends", "items")) else F.lit("")).alias(name)
                for name in NARRATIVE
            ],
        )
    parsed = parse_model_json(replies(digests, fn, most_changes), "reply")
    payload = F.col("parsed")
    is_object = F.coalesce(F.schema_of_variant(payload).startswith("OBJECT"), F.lit(False))
    detail = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(payload.isNull(), F.col("parse_detail"))
        .when(~is_object, "the interpretation response must be a JSON object")
        .otherwise("interpretation generated from the deterministic KPI output")
    )
    fields = [
        F.when(is_object, _list_field(payload, name, most_items, item_chars)
               if name.endswith(("trends", "items"))
               else _text_field(payload, name)).alias(name)
        for name in NARRATIVE
    ]
    return parsed.select(
        SCOPE,
        F.when(is_object, "generated").otherwise("failed").alias("status"),
        detail.alias("status_detail"),
        *fields,
    )


def narrative_text(insights: DataFrame) -> DataFrame:
    """All sentences of a record as one text, for number checks."""
    return insights.select(
        SCOPE,
        F.concat_ws(
            " ",
            "executive_summary",
            F.concat_ws(" ", "positive_trends"),
            F.concat_ws(" ", "negative_trends"),
            F.concat_ws(" ", "watch_items"),
            "management_summary",
        ).alias("narrative"),
    )
