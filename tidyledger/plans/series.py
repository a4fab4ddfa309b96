"""Registered queries over time, sets, versions, layouts and kept figures, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.functions.numbers import money_double
from tidyledger.operators import clean, difference, lattice, quantiles, timeline, validate
from tidyledger.operators.kpi import revenue_bearing
from tidyledger.plans import quality, report
from tidyledger.plans.oracle import BASE, COLUMNS, ISSUES, REJECTED, shown
from tidyledger.plans.queries import MONEY, _clean, _run
from tidyledger.schema import ORDER_MONTH, ORDER_SCHEMA, SOURCE_ROW, ColumnSpec, QualityPolicy
from tidyledger.session import deliver, shared_folder, stored
from tidyledger.sources import clustered, grid, tables
from tidyledger.streaming import figures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CUBED = ["category", "region", "status", ORDER_MONTH]
CENTS = "CAST(round({} * 100) AS BIGINT)"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, sf_dir, "events")


@query
def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of the customer at or before each order, orders moved to the events' years."""
    orders = tables.read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.pmod("o_custkey", F.lit(500)).alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("o_orderdate"),
    ).withColumn("at", F.expr("o_orderdate + INTERVAL 26 YEARS"))
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type", "value")
    found = timeline.asof_join(
        orders, events, ["user_id"], "at", "ts", ["event_id", "event_type", "value"], order=["event_id"]
    )
    return found.select("o_orderkey", "user_id", "event_id", "event_type", "value")


ORACLE["asof_orders"] = """
    SELECT o.o_orderkey, o.user_id, e.event_id, e.event_type, e.value
    FROM (SELECT o_orderkey, o_custkey % 500 AS user_id, o_orderdate + INTERVAL 26 YEARS AS at FROM orders) o
    ASOF LEFT JOIN events e ON o.user_id = e.user_id AND o.at >= e.ts"""


@query
def asof_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view of the 24 hours before."""
    events = _events(spark, sf_dir)
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    viewed = events.where("event_type = 'view'").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id")
    )
    found = timeline.asof_join(
        bought, viewed, ["user_id"], "ts", "view_ts", ["view_id", "view_ts"], order=["view_id"], tolerance=86_400
    )
    waited = timeline.micros("ts") - timeline.micros("view_ts")
    return found.select("event_id", "user_id", "view_id", waited.alias("waited_us"))


ORACLE["asof_views"] = """
    WITH m AS (SELECT b.event_id, b.user_id, b.ts, v.event_id AS view_id, v.ts AS view_ts
               FROM (SELECT * FROM events WHERE event_type = 'purchase') b
               ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
               ON b.user_id = v.user_id AND b.ts >= v.ts)
    SELECT event_id, user_id, CASE WHEN ts - view_ts <= INTERVAL 24 HOURS THEN view_id END AS view_id,
           CASE WHEN ts - view_ts <= INTERVAL 24 HOURS THEN epoch_us(ts) - epoch_us(view_ts) END AS waited_us
    FROM m"""


@query
def overlapping_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of a customer that fall into the time between an order and its last shipment."""
    orders = tables.read_table(spark, sf_dir, "orders")
    lines = tables.read_table(spark, sf_dir, "lineitem")
    last = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("closed"))
    spans = orders.join(last, "o_orderkey").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("opened"), "closed")
    ship = lines.select("l_orderkey", "l_linenumber", "l_shipdate").join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"
    )
    parcels = ship.select(
        "o_custkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("sent"),
        F.expr("l_shipdate + INTERVAL 3 DAYS").alias("due"),
    )
    found = timeline.overlap_join(spans, parcels, ["o_custkey"], ("opened", "closed"), ("sent", "due"), cell=7 * timeline.DAY)
    found = found.where("o_orderkey <> l_orderkey")
    return found.select("o_custkey", "o_orderkey", "l_orderkey", "l_linenumber")


ORACLE["overlapping_orders"] = """
    WITH spans AS (SELECT o_custkey, o_orderkey, o_orderdate AS opened, max(l_shipdate) AS closed
                   FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    parcels AS (SELECT o_custkey, l_orderkey, l_linenumber, l_shipdate AS sent, l_shipdate + INTERVAL 3 DAYS AS due
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT s.o_custkey, s.o_orderkey, p.l_orderkey, p.l_linenumber
    FROM spans s JOIN parcels p ON s.o_custkey = p.o_custkey AND s.o_orderkey <> p.l_orderkey
         AND s.opened <= s.closed AND p.sent <= p.due AND s.opened <= p.due AND p.sent <= s.closed"""


@query
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events that are at most 30 minutes apart."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return timeline.sessions(_events(spark, sf_dir), "user_id", "ts", 1800, {"value_cents": cents})


@query
def type_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by type of event: few keys, each with a share of all events."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return timeline.sessions(_events(spark, sf_dir), "event_type", "ts", 1800, {"value_cents": cents})


for _name, _key in (("user_sessions", "user_id"), ("type_sessions", "event_type")):
    ORACLE[_name] = f"""
    WITH e AS (SELECT {_key}, epoch_us(ts) AS t, {CENTS.format('value')} AS cents FROM events),
    f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 1800000000 THEN 0 ELSE 1 END AS opens FROM e
          WINDOW w AS (PARTITION BY {_key} ORDER BY t)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY {_key} ORDER BY t) AS number FROM f)
    SELECT {_key}, min(t) AS session_start, max(t) AS session_end, count(*) AS events,
           CAST(sum(cents) AS BIGINT) AS value_cents
    FROM g GROUP BY {_key}, number"""


@query
def running_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of each type up to every event, and of the hour before it."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    rows = _events(spark, sf_dir).select("event_id", "event_type", "ts", cents.alias("cents"))
    total = timeline.running_total(rows, ["event_type"], "ts", F.col("cents"), "running_cents", order=["event_id"])
    found = timeline.trailing_total(total, ["event_type"], "ts", F.col("cents"), "hour_cents", 3600)
    return found.select("event_id", "event_type", "running_cents", "hour_cents")


ORACLE["running_events"] = f"""
    WITH e AS (SELECT event_id, event_type, ts, {CENTS.format('value')} AS cents FROM events)
    SELECT event_id, event_type,
           CAST(sum(cents) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS running_cents,
           CAST(sum(cents) OVER (PARTITION BY event_type ORDER BY ts
                RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS BIGINT) AS hour_cents
    FROM e"""


@query
def running_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net revenue by region and day, so far and over the last 30 days."""
    rows = _clean(spark, sf_dir, "region", "date", *MONEY).where(revenue_bearing() & F.col("date").isNotNull())
    days = rows.groupBy("region", "date").agg(F.sum("revenue").alias("net"))
    days = stored(days, "daily-net")
    total = timeline.running_total(days, ["region"], "date", F.col("net"), "running", block=90 * timeline.DAY)
    found = timeline.trailing_total(total, ["region"], "date", F.col("net"), "trailing", 30 * timeline.DAY)
    return found.select(
        "region",
        F.date_format("date", "yyyy-MM-dd").alias("day"),
        *[money_double(F.col(x).cast("decimal(38,2)")).alias(f"{y}_net") for x, y in
          (("net", "day"), ("running", "running"), ("trailing", "trailing"))],
    )


ORACLE["running_net"] = f"""{BASE},
    days AS (SELECT region, date, sum(revenue) AS net FROM clean WHERE realised AND date IS NOT NULL GROUP BY ALL),
    w AS (SELECT *, sum(net) OVER (PARTITION BY region ORDER BY date) AS running,
            sum(net) OVER (PARTITION BY region ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS recent
          FROM days)
    SELECT region, strftime(date, '%Y-%m-%d') AS day, CAST(net AS DOUBLE) AS day_net, CAST(running AS DOUBLE) AS running_net,
           CAST(recent AS DOUBLE) AS trailing_net FROM w"""


@query
def cube_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 16 sets of category, region, status and month from one partial table."""
    rows = _clean(spark, sf_dir, *CUBED, "customer", "quantity", "revenue")
    rows = stored(rows.select(*CUBED, "customer", "quantity", "revenue"), "cube-rows")
    sums = {"orders": "count(*)", "quantity": "coalesce(sum(quantity), 0)", "gross": "coalesce(sum(revenue), 0)"}
    parts = stored(
        lattice.partial(rows, CUBED, sums, "customer", lattice.dictionary(rows, "customer")), "cube-parts"
    )
    found = lattice.cube(parts, CUBED, list(sums), "distinct_customers")
    return found.select(
        *CUBED,
        F.col("grouping").cast("int").alias("grouping"),
        F.col("orders").cast("bigint").alias("order_count"),
        F.col("quantity").cast("bigint").alias("total_quantity"),
        money_double(F.col("gross").cast("decimal(38,2)")).alias("gross_revenue"),
        F.col("distinct_customers").cast("bigint").alias("distinct_customers"),
    )


ORACLE["cube_figures"] = f"""{BASE}
    SELECT category, region, status, order_month,
           CAST(grouping(category, region, status, order_month) AS INTEGER) AS grouping, count(*) AS order_count,
           CAST(coalesce(sum(quantity), 0) AS BIGINT) AS total_quantity,
           CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS gross_revenue, count(DISTINCT customer) AS distinct_customers
    FROM clean GROUP BY CUBE (category, region, status, order_month)"""


@query
def revenue_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 90th and 99th percentile of an order line's revenue, by category and region."""
    rows = _clean(spark, sf_dir, "category", "region", "revenue")
    found = quantiles.exact_quantiles(rows, ["category", "region"], "revenue", [0.5, 0.9, 0.99], digits=2)
    return found.select("category", "region", "probability", "n", F.round("quantile", 4).alias("quantile"))


ORACLE["revenue_quantiles"] = f"""{BASE},
    q AS (SELECT category, region, count(revenue) AS n, quantile_cont(CAST(revenue AS DOUBLE), [0.5, 0.9, 0.99]) AS v
          FROM clean WHERE revenue IS NOT NULL GROUP BY ALL)
    SELECT category, region, CAST(p.probability AS DOUBLE) AS probability, n, round(v[p.k], 4) AS quantile
    FROM q, (VALUES (1, 0.5), (2, 0.9), (3, 0.99)) p(k, probability)"""


@query
def version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that differ between two versions of the orders; the later one is derived by keys."""
    before = tables.read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        "o_orderpriority",
    )
    key = F.col("o_orderkey")
    after = before.where(~key.between(300, 309)).withColumns(
        {
            "o_orderkey": F.when(key.between(400, 404), key + 1_000_000_000).otherwise(key),
            "o_orderstatus": F.when(key.between(100, 119), F.lit("X")).otherwise(F.col("o_orderstatus")),
            "o_orderpriority": F.when(key.between(115, 124), F.lit(None)).otherwise(F.col("o_orderpriority")),
        }
    )
    folders = [shared_folder(spark, "version") for _ in range(2)]
    for rows, folder in zip((before, after), folders, strict=True):
        difference.write_version(rows, folder, ["o_orderkey"], buckets=64)
    return difference.cell_changes(spark, *folders, ["o_orderkey"])


ORACLE["version_changes"] = """
    WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders)
    SELECT k AS o_orderkey, 'changed' AS change, 'o_orderstatus' AS "column", s AS before, 'X' AS after
    FROM b WHERE k BETWEEN 100 AND 119 AND s <> 'X'
    UNION ALL SELECT k, 'changed', 'o_orderpriority', p, NULL FROM b WHERE k BETWEEN 115 AND 124 AND p IS NOT NULL
    UNION ALL SELECT k, 'removed', '*', NULL, NULL FROM b WHERE k BETWEEN 300 AND 309 OR k BETWEEN 400 AND 404
    UNION ALL SELECT k + 1000000000, 'added', '*', NULL, NULL FROM b WHERE k BETWEEN 400 AND 404"""


NET = "CASE WHEN coalesce(status NOT IN ('Cancelled', 'Refunded'), true) THEN revenue END"
KEPT = figures.FigurePlan(
    "order_id", SOURCE_ROW, ("category", "region", ORDER_MONTH), "customer",
    {"quantity": "quantity", "gross": "revenue", "net": NET}, buckets=32,
)


@query
def maintained_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures by category and month after three arrivals; most later rows take the place of earlier ones."""
    root = shared_folder(spark, "figures")
    arrivals, out = f"{root}/arrivals", f"{root}/out"
    valid = validate.valid_rows(_run(spark, sf_dir).checked)
    names = [SOURCE_ROW, "order_id", "customer", "category", "region", "status", "quantity", "revenue", ORDER_MONTH]
    rows = clean.apply_value_rules(valid, ORDER_SCHEMA).select(*names)
    parts = tables.staged_parts(rows, f"{root}/staged", 3)
    for part in (2, 1, 0):
        deliver(spark, parts[part], arrivals)
        figures.maintain(spark.readStream.schema(rows.schema).parquet(arrivals), out, KEPT)
        if part == 1:
            figures.compact(spark, out, KEPT)
    found = figures.figures(spark, out, KEPT, ["category", ORDER_MONTH])
    return found.select(
        "category",
        ORDER_MONTH,
        F.col("rows").alias("order_count"),
        F.col("quantity").cast("bigint").alias("total_quantity"),
        *[money_double(F.col(x).cast("decimal(38,2)")).alias(f"{x}_revenue") for x in ("gross", "net")],
        F.col("members").alias("distinct_customers"),
    )


ORACLE["maintained_figures"] = f"""{BASE}
    SELECT category, order_month, count(*) AS order_count, CAST(sum(quantity) AS BIGINT) AS total_quantity,
           CAST(sum(revenue) AS DOUBLE) AS gross_revenue,
           CAST(coalesce(sum(revenue) FILTER (WHERE realised), 0) AS DOUBLE) AS net_revenue,
           count(DISTINCT customer) AS distinct_customers
    FROM clean GROUP BY ALL"""


@query
def clustered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter's orders of a few products, from a table clustered by date, product and region."""
    rows = _clean(spark, sf_dir, "order_id", "date", "product", "region", "revenue")
    rows = stored(rows.select("order_id", "date", "product", "region", "revenue"), "cluster-rows")
    folder = shared_folder(spark, "clustered")
    clustered.write_clustered(rows, folder, ["date", "product", "region"], files=64)
    ranges = {"date": (date(1997, 4, 1), date(1997, 6, 30)), "product": ("red", "red zz")}
    found = clustered.read_clustered(spark, folder, ranges)
    day = F.date_format("date", "yyyy-MM-dd")
    return found.select("order_id", day.alias("day"), "product", "region", money_double(F.col("revenue")).alias("revenue"))


ORACLE["clustered_orders"] = f"""{BASE}
    SELECT order_id, strftime(date, '%Y-%m-%d') AS day, product, region, CAST(revenue AS DOUBLE) AS revenue
    FROM clean WHERE date BETWEEN DATE '1997-04-01' AND DATE '1997-06-30' AND product BETWEEN 'red' AND 'red zz'"""


@query
def rejected_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's quarantine: cells are shortened for display, free text included."""
    table = report.rejected_table(_run(spark, sf_dir, feedback=True))
    cells = F.from_json("record", "map<string,string>")
    shown_cells = F.concat_ws(" | ", *[cells[spec.name] for spec in ORDER_SCHEMA])
    return table.select(SOURCE_ROW, "order_id", "codes", "reason", shown_cells.alias("cells"))


def _short(cell: str) -> str:
    return f"CASE WHEN length({cell}) > 80 THEN left({cell}, 77) || '...' ELSE {cell} END"


_CELLS = " || ' | ' || ".join(f"({_short(shown(name))})" for name in COLUMNS)
ORACLE["rejected_display"] = f"""{BASE}, {ISSUES}, quarantine AS ({REJECTED.replace("reasons AS (", "SELECT * FROM (WITH reasons AS (", 1)}))
    SELECT q.source_row, coalesce(q.order_id, '') AS order_id, q.codes, q.reasons AS reason, w.cells
    FROM quarantine q JOIN (SELECT source_row, {_CELLS} AS cells FROM checked) w USING (source_row)"""


@query
def csv_unclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a file in which some quotes are never closed."""
    orders = tables.read_table(spark, sf_dir, "orders")
    closes = F.when(F.col("o_orderkey") % 1000 == 7, "").otherwise('"')
    line = F.concat(F.col("o_orderkey"), F.lit(',"'), F.col("o_orderpriority"), closes)
    folder = shared_folder(spark, "csv")
    rows = orders.select("o_orderkey", line.alias("value")).coalesce(1).sortWithinPartitions("o_orderkey", "value")
    rows.select("value").write.text(folder)
    return grid.csv_records(spark, folder, most_lines=50).select(
        F.col("_ordinal").alias("ordinal"), "value", F.col("_given_up").alias("given_up")
    )


ORACLE["csv_unclosed"] = """
    WITH o AS (SELECT o_orderkey % 1000 = 7 AS odd, o_orderkey,
                      o_orderkey || ',"' || o_orderpriority || CASE WHEN o_orderkey % 1000 = 7 THEN '' ELSE '"' END AS value
               FROM orders),
    n AS (SELECT *, sum(odd::int) OVER w AS opened, row_number() OVER w - 1 AS ordinal FROM o
          WINDOW w AS (ORDER BY o_orderkey, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT ordinal, value, odd OR opened % 2 = 1 AS given_up FROM n"""

EVENT_SCHEMA = (
    ColumnSpec("event", "text", headers=("event id",)),
    ColumnSpec("user", "integer", headers=("user id",), maximum=400),
    ColumnSpec("kind", "category", headers=("event type",), allowed=("View", "Buy"),
               spellings={"click": "View", "view": "View", "purchase": "Buy"}),
    ColumnSpec("value", "numeric", required=False, minimum=1, maximum=100),
)


@query
def custom_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under a schema of their own: accepted rows with their values, rejected ones with their codes."""
    events = grid.read_numbered_parquet(spark, f"{sf_dir}/events.parquet")
    raw = events.select(
        SOURCE_ROW,
        F.col("event_id").cast("string").alias("Event ID"),
        F.concat(F.lit(" "), "user_id").alias("User-ID"),
        F.upper("event_type").alias("Event  Type"),
        F.col("value").cast("decimal(12,2)").cast("string").alias("VALUE"),
    )
    run = quality.run_quality(raw, EVENT_SCHEMA, QualityPolicy(duplicate_column="event"), gate=False)
    told = F.concat_ws(" ", "event", "kind", F.col("user").cast("string"), F.col("value").cast("decimal(12,2)").cast("string"))
    accepted = run.clean.select(SOURCE_ROW, F.lit("accepted").alias("outcome"), told.alias("detail"))
    rejected = run.rejected.select(SOURCE_ROW, F.lit("rejected").alias("outcome"), F.array_join("codes", ", ").alias("detail"))
    return accepted.unionByName(rejected)


ORACLE["custom_schema"] = """
    WITH e AS (SELECT row_number() OVER () + 1 AS source_row, *, value::decimal(12,2) AS amount,
                      CASE event_type WHEN 'purchase' THEN 'Buy' WHEN 'click' THEN 'View' WHEN 'view' THEN 'View' END AS kind
               FROM events),
    f AS (SELECT *, coalesce(user_id > 400, false) OR coalesce(amount < 1 OR amount > 100, false) AS outside FROM e)
    SELECT source_row, CASE WHEN kind IS NULL OR outside THEN 'rejected' ELSE 'accepted' END AS outcome,
      CASE WHEN kind IS NULL AND outside THEN 'INVALID_CATEGORY, OUT_OF_RANGE' WHEN kind IS NULL THEN 'INVALID_CATEGORY'
           WHEN outside THEN 'OUT_OF_RANGE'
           ELSE concat_ws(' ', event_id, kind, user_id, amount) END AS detail FROM f"""
