r"""The registered queries as plain SQL, for comparison with another engine.

The text is built from common table expressions: the order export, its parsed
form, the checked rows and the clean rows.  It is written from the rules, not
from the Spark expressions: other functions, other patterns, other shapes.
"""

from __future__ import annotations

# The rules are spelled out here once more, so a wrong entry on one side shows.
COLUMNS = ["date", "order_id", "customer", "product", "category", "quantity", "unit_price", "revenue", "region",
           "status", "feedback"]
TEXTS = ["order_id", "customer", "product", "category", "region", "status", "feedback"]
ALLOWED = {
    "category": ["Apparel", "Electronics", "Home & Kitchen", "Office Supplies", "Outdoors"],
    "region": ["East", "North", "South", "West"],
    "status": ["Cancelled", "Completed", "Pending", "Refunded"],
}
SPELLED = {
    "category": "electronics=Electronics electronic=Electronics home_and_kitchen=Home_&_Kitchen "
                "home_&_kitchen=Home_&_Kitchen home-kitchen=Home_&_Kitchen kitchen=Home_&_Kitchen "
                "office_supplies=Office_Supplies office-supplies=Office_Supplies officesupplies=Office_Supplies "
                "outdoor=Outdoors outdoors=Outdoors apparel=Apparel clothing=Apparel",
    "region": "north=North n=North south=South s=South east=East e=East west=West w=West",
    "status": "completed=Completed complete=Completed closed=Completed pending=Pending in_progress=Pending "
              "cancelled=Cancelled canceled=Cancelled refunded=Refunded refund=Refunded",
}
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKENS = "('', 'na', 'n/a', 'null', 'none', 'nan', '-')"
THRESHOLD = 40000


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR lower({strip(x)}) IN {TOKENS})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def norm(x: str) -> str:
    return f"CASE WHEN NOT {blank(x)} THEN {collapse(x)} END"


def number(x: str) -> str:
    digits = f"try_cast(regexp_replace({x}, '[^0-9.\\-]', '', 'g') AS decimal(38,10))"
    bare = strip(x)
    return f"CASE WHEN starts_with({bare}, '(') AND ends_with({bare}, ')') THEN -{digits} ELSE {digits} END"


def integer(x: str) -> str:
    return f"CASE WHEN ({number(x)}) = floor({number(x)}) THEN try_cast(({number(x)}) AS bigint) END"


def date(x: str) -> str:
    formats = "['%Y-%m-%d', '%Y/%m/%d', '%d-%b-%Y', '%d %b %Y', '%d.%m.%Y', '%Y-%m-%dT%H:%M:%S']"
    return f"try_strptime({collapse(x)}, {formats})"


def canonical(x: str, column: str) -> str:
    pairs = [entry.replace("_", " ").split("=") for entry in SPELLED[column].split()]
    cases = " ".join(f"WHEN '{spelling}' THEN '{value}'" for spelling, value in pairs)
    return f"CASE lower({x}) {cases} END"


def quoted(x: str) -> str:
    escaped = x
    for plain, text in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        source = f"chr({ord(plain)})"
        escaped = f"replace({escaped}, {source}, '{text}')"
    return f"""CASE WHEN contains({x}, '''') AND NOT contains({x}, '"') THEN '"' || {escaped} || '"'
        ELSE '''' || replace({escaped}, '''', '\\''') || '''' END"""


def money(x: str) -> str:
    return f"cast(round({x}, 2) AS decimal(38,2))::varchar"


def half_up(numerator: str, denominator: str) -> str:
    """Integer quotient, half away from zero; the denominator is positive."""
    n, d = f"({numerator})::hugeint", f"({denominator})::hugeint"
    return f"(sign({n})::hugeint * ((2 * abs({n}) + {d}) // nullif(2 * {d}, 0)))"


def average(cents: str, count: str) -> str:
    return f"coalesce(cast({half_up(cents, count)} AS double) / 100, 0.0)"


def percent(part: str, whole: str) -> str:
    return f"cast({half_up(f'({part}) * 1000', whole)} AS double) / 10"


def share(part: str, whole: str) -> str:
    return f"coalesce({percent(part, whole)}, 0.0)"


def amount(cents: str) -> str:
    return f"cast({cents} AS double) / 100"


def float_text(cents: str) -> str:
    """Cents as a JSON number of the amount."""
    c = f"({cents})::hugeint"
    return f"""(CASE WHEN {c} < 0 THEN '-' ELSE '' END || (abs({c}) // 100)::varchar || '.' ||
        CASE WHEN abs({c}) % 10 = 0 THEN ((abs({c}) % 100) // 10)::varchar
             ELSE lpad((abs({c}) % 100)::varchar, 2, '0') END)"""


# ---------------------------------------------------------------------------
# The order export
# ---------------------------------------------------------------------------
LINES = "lines AS (SELECT row_number() OVER () + 1 AS source_row, * FROM lineitem)"
RAW = f"""
{LINES},
dated AS (SELECT *, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS mm,
                 strftime(o_orderdate, '%d') AS dd,
                 substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(o_orderdate)::int - 2, 3) AS mon
          FROM orders),
raw AS (
SELECT l.source_row,
  CASE WHEN l.l_orderkey % 97 = 5 THEN '31/02/2025'
       WHEN l.l_orderkey % 97 = 6 THEN ''
       WHEN l.l_orderkey % 5 = 0 THEN y || '/' || mm || '/' || dd
       WHEN l.l_orderkey % 5 = 1 THEN dd || '-' || mon || '-' || y
       WHEN l.l_orderkey % 5 = 2 THEN dd || ' ' || mon || ' ' || y
       WHEN l.l_orderkey % 5 = 3 THEN dd || '.' || mm || '.' || y
       ELSE y || '-' || mm || '-' || dd END AS date,
  CASE WHEN l.l_partkey % 11 = 0 THEN '  SO-' || l.l_orderkey || '-' || l.l_linenumber || '  '
       ELSE 'SO-' || l.l_orderkey || '-' || l.l_linenumber END AS order_id,
  CASE WHEN l.l_suppkey % 23 = 1 THEN 'N/A' ELSE c.c_name END AS customer,
  CASE WHEN l.l_partkey % 211 = 3 THEN '' ELSE p.p_name END AS product,
  CASE p.p_type WHEN 'ECONOMY' THEN 'electronic' WHEN 'SMALL' THEN ' home and  kitchen '
       WHEN 'MEDIUM' THEN 'Office-Supplies' WHEN 'PROMO' THEN 'OUTDOOR'
       WHEN 'STANDARD' THEN 'Apparel' ELSE 'clothing' END AS category,
  CASE WHEN l.l_orderkey % 101 = 7 THEN '0' WHEN l.l_orderkey % 101 = 8 THEN '1.5'
       WHEN l.l_orderkey % 101 = 9 THEN 'null' ELSE l.l_quantity::int::varchar END AS quantity,
  CASE WHEN l.l_partkey % 103 = 4 THEN 'abc'
       WHEN l.l_partkey % 7 = 0 THEN '$' || p.p_retailprice::decimal(12,2)::varchar
       ELSE p.p_retailprice::decimal(12,2)::varchar END AS unit_price,
  CASE WHEN l.l_suppkey % 13 = 2 THEN '' WHEN l.l_suppkey % 17 = 3 THEN '100.00'
       WHEN l.l_orderkey % 107 = 10 THEN '(50)'
       ELSE (l.l_quantity::decimal(12,2) * p.p_retailprice::decimal(12,2))::varchar END AS revenue,
  CASE WHEN l.l_orderkey % 109 = 11 THEN 'Central' WHEN n.n_regionkey % 4 = 0 THEN 'north'
       WHEN n.n_regionkey % 4 = 1 THEN 'S' WHEN n.n_regionkey % 4 = 2 THEN ' East ' ELSE 'WEST' END AS region,
  CASE WHEN l.l_orderkey % 113 = 12 THEN 'Archived'
       WHEN l.l_returnflag = 'R' AND l.l_linenumber = 1 THEN 'refund'
       WHEN o.o_orderstatus = 'P' THEN 'in progress'
       WHEN o.o_orderstatus = 'O' AND l.l_linestatus = 'O' AND l.l_linenumber = 2 THEN 'Canceled'
       ELSE 'closed' END AS status,
  d.text AS feedback
FROM lines l JOIN dated o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN part p ON p.p_partkey = l.l_partkey
LEFT JOIN documents d ON d.doc_id = l.l_orderkey)"""
EXPORT = RAW + """,
export AS (
SELECT * FROM raw UNION ALL
SELECT -o_orderkey - 1, '', '', '', '', '', '', '', '', '', '', '' FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))"""


def checked(source: str = "raw") -> str:
    cells = ", ".join(
        f"{norm(name)} AS {name}" if name in TEXTS else
        f"CASE WHEN NOT {blank(name)} THEN {name} END AS {name}_text"
        for name in COLUMNS
    )
    some = " OR ".join(f"NOT {blank(name)}" for name in COLUMNS)
    return f"""
prepared AS (SELECT source_row, {cells} FROM {source} WHERE {some}),
typed AS (SELECT *, {date('date_text')} AS date, {integer('quantity_text')} AS quantity,
                 {number('unit_price_text')} AS unit_price, {number('revenue_text')} AS revenue,
                 {canonical('category', 'category')} AS category_value,
                 {canonical('region', 'region')} AS region_value,
                 {canonical('status', 'status')} AS status_value
          FROM prepared),
checked AS (SELECT *, round(quantity * unit_price, 2)::decimal(38,2) AS computed,
  (date IS NULL OR order_id IS NULL OR product IS NULL OR category_value IS NULL
   OR region_value IS NULL OR status_value IS NULL OR quantity IS NULL OR quantity < 1
   OR unit_price IS NULL OR unit_price < 0 OR coalesce(revenue < 0, false)) AS is_rejected
  FROM typed),
valid AS (SELECT * FROM checked WHERE NOT is_rejected),
kept AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY source_row) = 1),
later AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY source_row) > 1),
clean AS (SELECT source_row, date, order_id, coalesce(customer, 'Unknown Customer') AS customer, product,
                 category_value AS category, quantity, round(unit_price, 2) AS unit_price,
                 computed AS revenue, (computed * 100)::bigint AS cents, region_value AS region,
                 status_value AS status, strftime(date, '%Y-%m') AS order_month, feedback,
                 status_value NOT IN ('Cancelled', 'Refunded') AS realised
          FROM kept)"""


BASE = f"WITH {RAW}, {checked()}"
FULL = f"WITH {EXPORT}, {checked('export')}"
ROW = "'row ' || source_row"


def issue(when: str, code: str, severity: str, column: str, message: str, example: str = ROW,
          source: str = "checked") -> str:
    return (f"SELECT source_row, '{code}' AS code, '{severity}' AS severity, '{column}' AS \"column\", "
            f"{message} AS message, {example} AS example FROM {source} WHERE {when}")


def _issues() -> str:
    rules = []
    unparsed = {"date": ("INVALID_DATE", "is not an accepted date format"),
                "quantity": ("INVALID_INTEGER", "is not a whole number"),
                "unit_price": ("INVALID_NUMBER", "is not numeric")}
    for name, (code, wording) in unparsed.items():
        rules.append(issue(f"{name} IS NULL AND {name}_text IS NOT NULL", code, "error", name,
                           f"'{name}: ' || {quoted(name + '_text')} || ' {wording}'"))
        rules.append(issue(f"{name}_text IS NULL", "MISSING_VALUE", "error", name,
                           f"'{name}: value is missing'"))
    rules.append(issue("revenue IS NULL AND revenue_text IS NOT NULL", "INVALID_NUMBER", "warning",
                       "revenue", "'revenue: not numeric - the value is recalculated during cleaning'",
                       f"{ROW} || ': ' || {quoted('revenue_text')}"))
    for name in ("order_id", "product", "category", "region", "status"):
        rules.append(issue(f"{name} IS NULL", "MISSING_VALUE", "error", name,
                           f"'{name}: value is missing'"))
    rules.append(issue("customer IS NULL", "MISSING_VALUE", "warning", "customer",
                       "'customer: missing value replaced by the documented default ''Unknown Customer'''"))
    for name, least in (("quantity", 1), ("unit_price", 0), ("revenue", 0)):
        rules.append(issue(f"{name} < {least}", "OUT_OF_RANGE", "error", name,
                           f"format('{name}: {{:g}} is below the documented minimum of {least}', {name}::double)"))
    for name, values in ALLOWED.items():
        rules.append(issue(f"{name} IS NOT NULL AND {name}_value IS NULL", "INVALID_CATEGORY", "error", name,
                           f"'{name}: ' || {quoted(name)} || ' is not a recognised value (allowed: {', '.join(values)})'"))
    rules.append(issue(f"revenue > {THRESHOLD}", "REVENUE_OUTLIER", "warning", "revenue",
                       f"'revenue exceeds the configured outlier threshold ({THRESHOLD}) - kept, "
                       "but worth a manual review'",
                       f"{ROW} || ': ' || {money('revenue')}", "valid"))
    rules.append(issue("revenue IS NULL", "MISSING_VALUE", "warning", "revenue",
                       "'revenue is blank - derived from quantity * unit_price'", ROW, "valid"))
    rules.append(issue("round(revenue, 2) <> computed", "REVENUE_MISMATCH", "warning", "revenue",
                       "'revenue does not match quantity * unit_price - recalculated during cleaning'",
                       f"{ROW} || ': given ' || {money('revenue')} || ' -> ' || {money('computed')}",
                       "valid"))
    rules.append(issue("true", "DUPLICATE_ORDER_ID", "warning", "order_id",
                       "'duplicate order id - only the first occurrence is used for analytics'",
                       f"{ROW} || ': ' || {quoted('order_id')}", "later"))
    return "issues AS (" + "\nUNION ALL ".join(rules) + ")"


ISSUES = _issues()
FINDINGS = """findings AS (
SELECT code, severity, "column", count(*)::bigint AS records, arg_min(message, source_row) AS message,
       array_to_string(list(example ORDER BY source_row)[1:3], '; ') AS examples
FROM issues GROUP BY code, severity, "column")"""

REASON_ORDER = ["INVALID_DATE", "INVALID_INTEGER", "INVALID_NUMBER"]
SUMMARY = """summary AS (SELECT
  (SELECT count(*) FROM checked) AS total_rows, (SELECT count(*) FROM valid) AS valid_rows,
  (SELECT count(*) FROM checked WHERE is_rejected) AS rejected_rows,
  (SELECT count(*) FROM issues WHERE severity = 'error') AS errors,
  (SELECT count(*) FROM issues WHERE severity = 'warning') AS warnings,
  (SELECT count(DISTINCT order_id) FROM later) AS duplicate_ids,
  (SELECT count(*) FROM later) AS duplicate_rows,
  (SELECT count(*) FROM valid WHERE revenue > 40000) AS outlier_rows)"""

SUMS = """count(*)::bigint AS order_count, count_if(realised)::bigint AS revenue_orders,
  sum(quantity)::bigint AS total_quantity, sum(cents)::hugeint AS gross,
  coalesce(sum(cents) FILTER (realised), 0)::hugeint AS net"""


def snapshot(by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}{SUMS},
  coalesce(sum(quantity) FILTER (realised), 0)::bigint AS revenue_quantity,
  count(DISTINCT customer)::bigint AS distinct_customers,
  strftime(min(date), '%Y-%m-%d') AS period_start, strftime(max(date), '%Y-%m-%d') AS period_end
  FROM clean {group}"""


FIGURES = f"""period_start, period_end, order_count, revenue_orders, distinct_customers, total_quantity,
  revenue_quantity, {amount('gross')} AS gross_revenue, {amount('net')} AS net_revenue,
  {amount('gross - net')} AS excluded_revenue, {average('net', 'revenue_orders')} AS average_order_value,
  {average('net', 'revenue_quantity')} AS average_unit_price,
  {share('order_count - revenue_orders', 'order_count')} AS cancellation_rate_pct"""


def dimension(name: str) -> str:
    return f"""sums AS (SELECT {name} AS key, {SUMS} FROM clean GROUP BY {name}),
metrics AS (SELECT key, order_count, total_quantity, {amount('gross')} AS gross_revenue,
  {amount('net')} AS net_revenue, {share('net', '(SELECT sum(net) FROM sums)')} AS revenue_share_pct,
  {average('net', 'revenue_orders')} AS average_order_value FROM sums)"""


MONTHS = f"months AS ({snapshot('order_month')})"
COMPARED = [
    ("net revenue", "net"),
    ("gross revenue", "gross"),
    ("orders", "order_count * 100"),
    ("average order value", half_up("net", "revenue_orders")),
    ("units sold", "total_quantity * 100"),
    ("distinct customers", "distinct_customers * 100"),
]


def compared(source: str, keys: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, {position} AS position, '{label}' AS metric, ({value})::hugeint AS v FROM {source}"
        for position, (label, value) in enumerate(COMPARED, start=1)
    )


CHANGE = f"""{amount('v')} AS current, {amount('before')} AS previous, {amount('v - before')} AS change,
  {percent('v - before', 'before')} AS change_pct"""
TREND_VALUES = f"""figures AS (
SELECT sum(cents) FILTER (realised) / 100 AS value FROM clean GROUP BY order_month
UNION ALL SELECT count(*) FROM clean GROUP BY order_month)"""

MARK = "chr(2)"
NUMBERS = rf"""marked AS (SELECT doc_id, regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_.])(-?\p{{Nd}})',
    '\1' || chr(2) || '\2', 'g') AS text FROM documents),
found AS (SELECT doc_id, regexp_extract_all(text,
    chr(2) || '(-?\p{{Nd}}(?:' || chr(2) || '?[\p{{Nd}},])*(?:\.\p{{Nd}}+)?%?)', 1) AS tokens FROM marked),
numbers AS (SELECT doc_id, unnest(range(1, len(tokens) + 1))::int AS position,
    replace(unnest(tokens), chr(2), '') AS token FROM found),
valued AS (SELECT *, try_cast(replace(rtrim(token, '%'), ',', '') AS double) AS value FROM numbers)"""

# Digest entries per region
_CHANGE_VALUES = compared("latest", "region, rn")
DIGEST = f"""
overall AS ({snapshot('region')}),
monthly AS ({snapshot('region, order_month')}),
latest AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY order_month DESC) AS rn
           FROM monthly QUALIFY rn <= 2),
labels AS (SELECT region, coalesce(max(order_month) FILTER (rn = 2) || ' to ', '')
                  || max(order_month) FILTER (rn = 1) AS period FROM latest GROUP BY region),
values_ AS ({_CHANGE_VALUES}),
pairs AS (SELECT region, position, metric, max(v) FILTER (rn = 1) AS v, max(v) FILTER (rn = 2) AS before
          FROM values_ GROUP BY ALL HAVING before IS NOT NULL),
entries AS (
SELECT region, 1 AS section, position AS rank, metric AS key, v - before AS net,
  CASE WHEN before <> 0 THEN {float_text(half_up('(v - before) * 1000', 'before') + ' * 10')} END AS pct,
  '{{"change": ' || {float_text('v - before')} || ', "change_pct": ' || coalesce(pct, 'null')
  || ', "current": ' || {float_text('v')} || ', "metric": "' || metric || '", "previous": '
  || {float_text('before')} || '}}' AS json FROM pairs
UNION ALL
SELECT region, 2, row_number() OVER (PARTITION BY region ORDER BY order_month), order_month, net, NULL,
  '{{"net_revenue": ' || {float_text('net')} || ', "orders": ' || order_count || ', "period": "'
  || order_month || '"}}' FROM monthly
UNION ALL
SELECT region, 3, row_number() OVER (PARTITION BY region ORDER BY net DESC, product), product, net, NULL,
  '{{"net_revenue": ' || {float_text('net')} || ', "product": "' || product || '"}}'
FROM (SELECT region, product, coalesce(sum(cents) FILTER (realised), 0) AS net FROM clean GROUP BY ALL)
UNION ALL
SELECT region, 4, row_number() OVER (PARTITION BY region ORDER BY n DESC, status), status, n, NULL,
  '{{"orders": ' || n || ', "status": "' || status || '"}}'
FROM (SELECT region, status, count(*) AS n FROM clean GROUP BY ALL)),
sized AS (SELECT *, sum(length(json) + 2) OVER (PARTITION BY region, section ORDER BY rank) - 2 AS used,
  sum(length(json) + 2) OVER (PARTITION BY region, section) - 2 AS section_size FROM entries),
scalars AS (SELECT o.region, l.period, {float_text('net')} AS net_revenue, {float_text('gross')} AS gross_revenue,
  order_count::varchar AS order_count, revenue_orders::varchar AS revenue_orders,
  distinct_customers::varchar AS distinct_customers, total_quantity::varchar AS total_quantity,
  {float_text(half_up('net', 'revenue_orders'))} AS average_order_value,
  {float_text(half_up('net', 'revenue_quantity'))} AS average_unit_price,
  {float_text(half_up('(order_count - revenue_orders) * 1000', 'order_count') + ' * 10')} AS cancellation_rate_pct
  FROM overall o JOIN labels l USING (region)),
frame AS (SELECT *, '{{"average_order_value": ' || average_order_value || ', "average_unit_price": '
  || average_unit_price || ', "cancellation_rate_pct": ' || cancellation_rate_pct
  || ', "distinct_customers": ' || distinct_customers || ', "gross_revenue": ' || gross_revenue
  || ', "monthly_trend": [<2>], "net_revenue": ' || net_revenue || ', "order_count": ' || order_count
  || ', "period": "' || period || '", "period_change": [<1>], "revenue_orders": ' || revenue_orders
  || ', "status_distribution": [<4>], "top_products": [<3>], "total_quantity": ' || total_quantity || '}}' AS text
  FROM scalars),
sizes AS (SELECT region, coalesce(max(section_size) FILTER (section = 1), 0) AS s1,
  coalesce(max(section_size) FILTER (section = 2), 0) AS s2,
  coalesce(max(section_size) FILTER (section = 3), 0) AS s3,
  coalesce(max(section_size) FILTER (section = 4), 0) AS s4 FROM sized GROUP BY region),
room AS (SELECT region, s1, s2, s3, s4, 12000 - (length(text) - 12) AS free FROM frame JOIN sizes USING (region)),
kept1 AS (SELECT e.* FROM sized e JOIN room r USING (region) WHERE section = 1 AND used <= free - s2 - s3 - s4),
left1 AS (SELECT r.region, free - coalesce(max(used), 0) AS free FROM room r LEFT JOIN kept1 k USING (region) GROUP BY r.region, free),
kept2 AS (SELECT e.* FROM sized e JOIN room r USING (region) JOIN left1 l USING (region)
          WHERE section = 2 AND used <= l.free - s3 - s4),
left2 AS (SELECT r.region, r.free - coalesce(max(used), 0) AS free FROM left1 r LEFT JOIN kept2 k USING (region) GROUP BY r.region, r.free),
kept3 AS (SELECT e.* FROM sized e JOIN room r USING (region) JOIN left2 l USING (region)
          WHERE section = 3 AND used <= l.free - s4),
left3 AS (SELECT r.region, r.free - coalesce(max(used), 0) AS free FROM left2 r LEFT JOIN kept3 k USING (region) GROUP BY r.region, r.free),
kept4 AS (SELECT e.* FROM sized e JOIN left3 l USING (region) WHERE section = 4 AND used <= l.free),
shown AS (SELECT * FROM kept1 UNION ALL SELECT * FROM kept2 UNION ALL SELECT * FROM kept3 UNION ALL SELECT * FROM kept4),
lists AS (SELECT region, coalesce(string_agg(json, ', ' ORDER BY rank) FILTER (section = 1), '') AS t1,
  coalesce(string_agg(json, ', ' ORDER BY rank) FILTER (section = 2), '') AS t2,
  coalesce(string_agg(json, ', ' ORDER BY rank) FILTER (section = 3), '') AS t3,
  coalesce(string_agg(json, ', ' ORDER BY rank) FILTER (section = 4), '') AS t4 FROM shown GROUP BY region)"""
NARRATIVES = f"""
tops AS (SELECT region, count(*) AS n, arg_min(key, rank) AS first_key, arg_min(net, rank) AS first_net,
  arg_max(key, rank) AS last_key FROM entries WHERE section = 3 GROUP BY region),
points AS (SELECT region, count(*) AS n, arg_min(key, rank) AS first_key, arg_min(net, rank) AS first_net,
  arg_max(key, rank) AS last_key, arg_max(net, rank) AS last_net FROM entries WHERE section = 2 GROUP BY region),
downs AS (SELECT region, list(key || ' was ' || CASE WHEN net >= 0 THEN 'up ' ELSE 'down ' END
  || ltrim(pct, '-') || '% versus the previous period' ORDER BY rank) AS items
  FROM entries WHERE section = 1 AND pct IS NOT NULL GROUP BY region),
told AS (SELECT s.region AS scope, 'Over ' || s.period || ' the business recorded a net revenue of ' || net_revenue
  || ' across ' || order_count || ' orders (average order value ' || average_order_value || ').' AS executive_summary,
  list_filter([t.first_key || ' led net revenue with ' || {float_text('t.first_net')},
   CASE WHEN p.n >= 2 THEN 'net revenue moved from ' || {float_text('p.first_net')} || ' in ' || p.first_key
     || ' to ' || {float_text('p.last_net')} || ' in ' || p.last_key END], lambda x: x IS NOT NULL) AS positive_trends,
  coalesce(d.items, []) AS negative_trends,
  CASE WHEN cancellation_rate_pct <> '0.0' THEN ['cancelled or refunded orders accounted for '
    || cancellation_rate_pct || '% of all orders'] ELSE [] END AS watch_items,
  CASE WHEN t.n >= 2 THEN 'protect momentum in ' || t.first_key || ' while reviewing ' || t.last_key
    || ' performance' ELSE 'keep focusing on the strongest product lines' END AS management_summary
  FROM scalars s LEFT JOIN tops t USING (region) LEFT JOIN points p USING (region) LEFT JOIN downs d USING (region))"""
SUPPLIED = ["net_revenue", "gross_revenue", "order_count", "revenue_orders", "distinct_customers",
            "total_quantity", "average_order_value", "average_unit_price", "cancellation_rate_pct"]
SUPPLIED_LINES = " UNION ALL ".join(
    f"SELECT region AS scope, {i}::int AS position, '{name}: ' || {name} AS line FROM scalars"
    for i, name in enumerate(SUPPLIED)
)

LABEL = """CASE WHEN length(text) < 500 THEN 'neutral' WHEN length(text) < 5000 THEN 'complaint' END"""
LABELLED = f"""labelled AS (SELECT doc_id, {LABEL} AS category,
  CASE WHEN length(text) < 5000 THEN 'classified' ELSE 'unclassified' END AS classification
  FROM documents WHERE NOT {blank('text')})"""
INDEXED = f"""indexed AS (SELECT doc_id, CASE WHEN length(text) % 7 > 0 THEN {LABEL} END AS category,
  CASE WHEN length(text) % 7 > 0 AND length(text) < 5000 THEN 'classified' ELSE 'unclassified' END AS classification
  FROM documents WHERE NOT {blank('text')})"""


def block(label: str, source: str, labels: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {label} AS block, {i}::int AS position, '{name}' AS metric, ({value})::double AS value FROM {source}"
        for i, (name, value) in enumerate(labels.items(), start=1)
    )


OVERALL_LABELS = {
    "Records analysed": "order_count", "Distinct customers": "distinct_customers",
    "Units sold": "total_quantity", "Gross revenue": "gross_revenue",
    "Net revenue (excludes cancelled/refunded)": "net_revenue",
    "Cancelled/refunded revenue": "excluded_revenue",
    "Average order value (net)": "average_order_value",
    "Average unit price (net)": "average_unit_price",
    "Cancelled/refunded share of orders": "cancellation_rate_pct",
}
PERIOD_LABELS = {
    "Orders": "order_count", "Revenue bearing orders": "revenue_orders", "Units sold": "total_quantity",
    "Distinct customers": "distinct_customers", "Gross revenue": "gross_revenue",
    "Net revenue": "net_revenue", "Average order value (net)": "average_order_value",
}

# ---------------------------------------------------------------------------
# Audit log
# ---------------------------------------------------------------------------
SPACED = " UNION ALL ".join(
    f"SELECT source_row, {i} AS place, '{name}' AS \"column\", {name} AS before, {norm(name)} AS after FROM export"
    f" WHERE {norm(name)} <> {name}"
    for i, name in enumerate(TEXTS)
)
ARROW = f"'row ' || source_row || ': ' || {quoted('before')} || ' -> ' || {quoted('after')}"
CATEGORY_CHANGES = " UNION ALL ".join(
    f"SELECT source_row, {i} AS place, '{name}' AS \"column\", {name} AS before, {name}_value AS after FROM kept"
    f" WHERE {name} <> {name}_value"
    for i, name in enumerate(("category", "region", "status"))
)
ACTIONS = f"""spaced AS ({SPACED}), recoded AS ({CATEGORY_CHANGES}),
repriced AS (SELECT source_row, {money('revenue')} AS before, {money('computed')} AS after FROM kept
             WHERE revenue IS NULL OR round(revenue, 2) <> computed),
dropped AS (SELECT source_row FROM export WHERE {' AND '.join(blank(name) for name in COLUMNS)})
SELECT 'prepare' AS stage, 1 AS position, 'blank_rows_dropped' AS action, count(*)::bigint AS records,
  'rows where every cell is blank carry no information' AS detail,
  'row ' || array_to_string(list(source_row ORDER BY source_row)[1:3], ', ') AS examples FROM dropped HAVING count(*) > 0
UNION ALL SELECT 'prepare', 2, 'headers_normalised', 10,
  'accepted header spellings mapped to canonical column names',
  '''Order Date'' -> ''date''; ''Order ID'' -> ''order_id''; ''Customer'' -> ''customer'''
UNION ALL SELECT 'prepare', 4, 'whitespace_normalised', count(*),
  'leading/trailing/duplicated whitespace collapsed in text values',
  array_to_string(list({ARROW} ORDER BY place, source_row)[1:3], '; ') FROM spaced WHERE "column" <> 'feedback' HAVING count(*) > 0
UNION ALL SELECT 'clean', 1, 'rejected_rows_removed', count(*),
  'records that failed validation are excluded from analytics (details in Data_Quality)',
  'rows ' || array_to_string(list(source_row ORDER BY source_row)[1:3], ', ') FROM checked WHERE is_rejected HAVING count(*) > 0
UNION ALL SELECT 'clean', 2, 'duplicate_orders_removed', count(*),
  'duplicate order ids removed; the first occurrence (by source row) is kept',
  'rows ' || array_to_string(list(source_row ORDER BY source_row)[1:3], ', ') FROM later HAVING count(*) > 0
UNION ALL SELECT 'clean', 3, 'categorical_values_normalised', count(*),
  'categorical values mapped onto canonical business values',
  array_to_string(list({ARROW} ORDER BY place, source_row)[1:3], '; ') FROM recoded HAVING count(*) > 0
UNION ALL SELECT 'clean', 4, 'default_values_filled', count(*),
  'missing ''customer'' values replaced by the documented default', 'customer = ''Unknown Customer'''
  FROM kept WHERE customer IS NULL HAVING count(*) > 0
UNION ALL SELECT 'clean', 5, 'revenue_recalculated', count(*),
  'revenue recomputed as quantity * unit_price (single source of truth for money metrics)',
  array_to_string(list({ARROW} ORDER BY source_row) FILTER (before IS NOT NULL)[1:3], '; ') FROM repriced HAVING count(*) > 0
UNION ALL SELECT 'clean', 6, 'derived_columns_added', 1,
  'order_month derived from date for period-over-period analysis', ''"""

LOG = f"""read AS (SELECT (SELECT count(*) FROM export) AS rows_read, (SELECT count(*) FROM valid) AS rows_valid,
  (SELECT count(*) FROM checked WHERE is_rejected) AS rows_rejected, (SELECT count(*) FROM kept) AS rows_cleaned,
  (SELECT sum(cents) FILTER (realised) FROM clean)::double / 100 AS net_revenue)"""
def shown(name: str) -> str:
    """Dates and numbers as they were written, other cells normalised; whole texts."""
    return f"coalesce({name if name in TEXTS else name + '_text'}, '')"


_REASON_RANK = """CASE code WHEN 'INVALID_DATE' THEN 1 WHEN 'INVALID_INTEGER' THEN 2 WHEN 'INVALID_NUMBER' THEN 3
  ELSE 10 + list_position([%s], "column") END""" % ", ".join(f"'{n}'" for n in COLUMNS)
REJECTED = f"""reasons AS (SELECT source_row, list(message ORDER BY {_REASON_RANK}) AS reasons,
  list_sort(list_distinct(list(code))) AS codes FROM issues WHERE severity = 'error' GROUP BY source_row)
SELECT source_row, order_id, array_to_string(codes, ', ') AS codes, array_to_string(reasons, '; ') AS reasons,
  {" || ' | ' || ".join(shown(n) for n in COLUMNS if n != 'feedback')} AS cells
FROM checked JOIN reasons USING (source_row)"""
METRICS = [
    ("Rows read from the source", "(SELECT count(*) FROM export)"),
    ("Blank rows dropped before validation", "(SELECT count(*) FROM export) - total_rows"),
    ("Rows validated", "total_rows"), ("Rows valid", "valid_rows"), ("Rows rejected", "rejected_rows"),
    ("Errors", "errors"), ("Warnings", "warnings"), ("Duplicate order ids found", "duplicate_ids"),
    ("Revenue outliers flagged for review", "outlier_rows"),
    ("Rows written to Clean_Data", "(SELECT count(*) FROM kept)"),
    ("Rows removed by cleaning", "total_rows - (SELECT count(*) FROM kept)"),
]
RAGGED = [("Order", "l_orderkey"), ("unnamed_column_2", "l_partkey"), ("Supplier", "l_suppkey"),
          ("unnamed_column_4", "l_linenumber"), ("extra_column_5", "l_returnflag"),
          ("extra_column_6", "l_linestatus"), ("extra_column_7", "'end'")]


def sheet_number(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN {x}::bigint::varchar ELSE round({x}, 2)::varchar END"


CLEAN_TEXT = """SELECT source_row{cast}, strftime(date, '%Y-%m-%d') AS date, order_id, customer, product, category,
  quantity{cast}, {price} AS unit_price, {revenue} AS revenue, region, status, order_month, {feedback} AS feedback
FROM clean"""
SECTION_ROWS = f"""paragraphs AS (SELECT scope, 0 AS section_position, 'Status' AS section,
  ['generated', 'interpretation generated from the deterministic KPI output'] AS items FROM told UNION ALL
SELECT scope, 1, 'Executive summary', [executive_summary] FROM told UNION ALL
SELECT scope, 2, 'Positive trends', list_transform(positive_trends, lambda x: '- ' || x) FROM told UNION ALL
SELECT scope, 3, 'Negative trends', list_transform(negative_trends[1:5], lambda x: '- ' || x) FROM told UNION ALL
SELECT scope, 4, 'Items requiring attention', list_transform(watch_items, lambda x: '- ' || x) FROM told UNION ALL
SELECT scope, 5, 'Management summary', [management_summary] FROM told UNION ALL
SELECT scope, 6, 'Number check', ['no unverified figures detected in the AI narrative'] FROM told),
supplied AS ({SUPPLIED_LINES})
SELECT scope, section_position, section, unnest(range(0, len(items)))::int AS line, unnest(items) AS text FROM paragraphs
UNION ALL SELECT scope, 7, 'Metrics supplied to the model', position, line FROM supplied"""

TOTAL_NET = "(SELECT net FROM sets WHERE dimension = 'overall')"
ORACLE: dict[str, str] = {
    "grid_ragged_pad": f"WITH {LINES} SELECT source_row, " + ", ".join(
        f'CASE WHEN l_linenumber >= {i} THEN {value}::varchar END AS "{name}"'
        for i, (name, value) in enumerate(RAGGED, start=1)) + " FROM lines",
    "source_row_assign": f"WITH {LINES} SELECT source_row, l_orderkey, l_linenumber, l_partkey FROM lines",
    "source_row_staged": "SELECT row_number() OVER () + 1 AS source_row, event_id, user_id FROM events",
    "sink_cell_format": f"""SELECT l_orderkey::varchar AS l_orderkey, l_linenumber::varchar AS l_linenumber,
      {', '.join(f'{sheet_number(n)} AS {n}' for n in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))},
      l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem""",
    "sink_roundtrip": f"{BASE} " + CLEAN_TEXT.format(
        cast="::varchar", price=sheet_number("unit_price::double"),
        revenue=sheet_number("revenue::double"), feedback="coalesce(feedback, '')"
    ).replace("quantity::varchar", "quantity::varchar AS quantity").replace(
        "source_row::varchar", "source_row::varchar AS source_row"),
    "run_log_trim": """SELECT event_id, user_id, event_type, value FROM events
      ORDER BY ts DESC, event_id DESC LIMIT 499""",
    "run_log_row": f"""{FULL}, {LOG} SELECT 'run-1' AS run_id, '2025-01-01T00:00:00Z' AS started_at,
      '2025-01-01T00:00:01Z' AS finished_at, 1.0::double AS duration_seconds, 'success' AS outcome,
      'export' AS data_source, rows_read, rows_valid, rows_rejected, rows_cleaned, net_revenue,
      'skipped' AS ai_status, 'ok' AS message FROM read""",
    "run_summary": f"""{FULL}, {LOG} SELECT 'success' AS outcome, 'csv' AS mode, rows_read, rows_valid,
      rows_rejected, rows_cleaned, net_revenue FROM read""",
    "blank_cells_by_column": f"WITH {EXPORT} " + " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count_if({blank(n)})::bigint AS blank_cells FROM export" for n in COLUMNS),
    "normalise_text": f"SELECT doc_id, {norm('text')} AS text FROM documents",
    "map_headers": f"WITH {RAW} " + " UNION ALL ".join(
        f"SELECT {i}::int AS position, '{name}' AS name, count_if({value} <> '')::bigint AS filled FROM raw"
        for i, (name, value) in enumerate(
            [(n, n) for n in COLUMNS if n != "feedback"] + [("cost_centre", "region"), ("units_sold", "quantity")],
            start=1)),
    "drop_blank_rows": f"WITH {EXPORT} SELECT source_row, order_id FROM export WHERE "
        + " OR ".join(f"NOT {blank(n)}" for n in COLUMNS),
    "whitespace_changes": f"""WITH {EXPORT}, spaced AS ({SPACED})
      SELECT "column", count(*)::bigint AS changed_cells FROM spaced GROUP BY "column\"""",
    "parse_number": f"""WITH {RAW} SELECT source_row, ({number('unit_price')})::double AS unit_price,
      ({number('revenue')})::double AS revenue FROM raw""",
    "parse_integer": f"WITH {RAW} SELECT source_row, {integer('quantity')} AS quantity FROM raw",
    "parse_date": f"WITH {RAW} SELECT source_row, strftime({date('date')}, '%Y-%m-%d') AS date FROM raw",
    **{f"canonical_{n}": f"""WITH {RAW} SELECT {n} AS spelling, {canonical(norm(n), n)} AS canonical,
      count(*)::bigint AS cells FROM raw GROUP BY ALL""" for n in ("category", "region", "status")},
    "canonical_join": f"""WITH {RAW} SELECT source_row, {canonical(norm('category'), 'category')} AS category FROM raw""",
    "coercion_failures": f"{BASE} " + " UNION ALL ".join(
        f"SELECT source_row, '{n}' AS \"column\", '{kind}' AS kind, {n}_text AS raw FROM checked"
        f" WHERE {n} IS NULL AND {n}_text IS NOT NULL"
        for n, kind in (("date", "date"), ("quantity", "integer"), ("unit_price", "numeric"), ("revenue", "numeric"))),
    "fill_defaults": f"WITH {RAW} SELECT source_row, coalesce({norm('customer')}, 'Unknown Customer') AS customer FROM raw",
    "recompute_revenue": f"{BASE} SELECT source_row, revenue::double AS given, computed::double AS revenue FROM valid",
    "schema_gate": f"""WITH {RAW}, counted AS (SELECT 'complete' AS input, count(*) AS n, '' AS missing FROM raw
      UNION ALL SELECT 'no quantity', count(*), 'quantity, status' FROM raw
      UNION ALL SELECT 'no rows', count(*), '' FROM raw WHERE source_row < 0)
      SELECT input, CASE WHEN n = 0 THEN 'the source range contains no data rows (only a header row was found)'
        WHEN missing <> '' THEN 'required column(s) missing from the source data: ' || missing ELSE 'ok' END AS outcome
      FROM counted""",
    "issues_long": f"{BASE}, {ISSUES} SELECT * FROM issues",
    "findings": f"{BASE}, {ISSUES}, {FINDINGS} SELECT * FROM findings",
    "rows_with_code": f"{BASE}, {ISSUES} SELECT code, count(*)::bigint AS records FROM issues GROUP BY code",
    "revenue_outliers": f"""{BASE}, {ISSUES} SELECT source_row, message, example FROM issues
      WHERE code = 'REVENUE_OUTLIER'""",
    "revenue_mismatch": f"""{BASE}, {ISSUES} SELECT source_row, message, example FROM issues
      WHERE code = 'REVENUE_MISMATCH'""",
    "duplicate_orders": f"""{BASE}, {ISSUES} SELECT source_row, message, example FROM issues
      WHERE code = 'DUPLICATE_ORDER_ID'""",
    "duplicate_ids": f"{BASE} SELECT order_id, count(*)::bigint AS records FROM valid GROUP BY 1 HAVING count(*) > 1",
    "duplicate_order_rows": f"""{BASE} SELECT source_row, order_id FROM valid
      QUALIFY count(*) OVER (PARTITION BY order_id) > 1""",
    "rejected_records": f"{BASE}, {ISSUES}, {REJECTED}",
    "valid_rows": f"{BASE} SELECT source_row, order_id, product FROM valid",
    "valid_rows_antijoin": f"{BASE} SELECT source_row, order_id, product FROM valid",
    "partition_invariant": f"""{FULL} SELECT source_row FROM checked EXCEPT ALL (SELECT source_row FROM valid
      UNION ALL SELECT source_row FROM checked WHERE is_rejected)""",
    "validation_summary": f"{FULL}, {ISSUES}, {SUMMARY} SELECT * FROM summary",
    "summary_lines": f"""{FULL}, {ISSUES}, {SUMMARY}
      SELECT 0::int AS position, 'rows read: ' || total_rows AS line FROM summary UNION ALL
      SELECT 1, 'rows valid: ' || valid_rows FROM summary UNION ALL
      SELECT 2, 'rows rejected: ' || rejected_rows FROM summary UNION ALL
      SELECT 3, 'errors: ' || errors || ' | warnings: ' || warnings FROM summary UNION ALL
      SELECT 4, 'duplicate order ids: ' || duplicate_ids FROM summary WHERE duplicate_ids > 0 UNION ALL
      SELECT 5, 'revenue outlier rows flagged for review: ' || outlier_rows FROM summary WHERE outlier_rows > 0""",
    "quality_metrics": f"{FULL}, {ISSUES}, {SUMMARY} " + " UNION ALL ".join(
        f"SELECT {i}::int AS position, '{label}' AS metric, ({value})::bigint AS value FROM summary"
        for i, (label, value) in enumerate(METRICS, start=1)),
    "dedup_keep_first": f"{BASE} SELECT source_row, order_id, product FROM kept",
    "categorical_changes": f"""{BASE}, recoded AS ({CATEGORY_CHANGES})
      SELECT "column", before, after, count(*)::bigint AS cells FROM recoded GROUP BY ALL""",
    "cleaning_actions": f"{FULL}, {ACTIONS}",
    "clean_orders": f"{BASE} " + CLEAN_TEXT.format(
        cast="", price="unit_price::double", revenue="revenue::double", feedback="feedback"),
    "kpi_overall": f"{BASE}, snap AS ({snapshot()}) SELECT 'All periods' AS label, {FIGURES} FROM snap",
    "analytics_guard": f"""{BASE}, counted AS (SELECT 'complete' AS input, count(*) AS n, '' AS missing FROM clean
      UNION ALL SELECT 'no region', count(*), 'region' FROM clean
      UNION ALL SELECT 'nothing valid', count(*), '' FROM clean WHERE source_row < 0
      UNION ALL SELECT 'nothing valid, no region', count(*), 'region' FROM clean WHERE source_row < 0)
      SELECT input, n > 0 AND missing = '' AS available, CASE WHEN n = 0 THEN 'no cleaned rows are available'
        WHEN missing <> '' THEN 'missing column(s): ' || missing ELSE 'ok' END AS reason FROM counted""",
    "status_distribution": f"""{BASE}, counts AS (SELECT status, count(*)::bigint AS orders FROM clean GROUP BY status)
      SELECT status, orders, {share('orders', '(SELECT sum(orders) FROM counts)')} AS share_pct FROM counts""",
    **{f"by_{n}": f"{BASE}, {dimension(n)} SELECT * FROM metrics" for n in ("product", "category", "region")},
    "kpi_grouping_sets": f"{BASE}, sets AS (SELECT 'overall' AS dimension, NULL::varchar AS key, * FROM ({snapshot()})"
        + "".join(f" UNION ALL SELECT '{n}', * FROM ({snapshot(n)})"
                  for n in ("product", "category", "region", "order_month", "status"))
        + f") SELECT dimension, key, {FIGURES},"
          f" {share('net', TOTAL_NET)} AS revenue_share_pct FROM sets",
    "trend": f"""{BASE}, months AS (SELECT order_month, {SUMS} FROM clean GROUP BY order_month)
      SELECT order_month, order_count, {amount('net')} AS net_revenue FROM months""",
    "dimension_focus": f"{BASE}, sums AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS dimension, {n} AS key, {SUMS} FROM clean GROUP BY {n}"
        for n in ("product", "category", "region")) + f"""),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY net DESC, key) AS up,
        row_number() OVER (PARTITION BY dimension ORDER BY net, key DESC) AS down FROM sums)
      SELECT dimension, max(key) FILTER (up = 1) AS best_key, {amount('max(net) FILTER (up = 1)')} AS best_net_revenue,
        max(key) FILTER (down = 1) AS worst_key, {amount('max(net) FILTER (down = 1)')} AS worst_net_revenue,
        {amount('sum(net)')} AS total_net_revenue FROM ranked GROUP BY dimension""",
    "top_products": f"""{BASE}, {dimension('product')} SELECT *, row_number() OVER (ORDER BY net_revenue DESC, key)::int
      AS rank FROM metrics QUALIFY rank <= 5""",
    "bottom_products": f"""{BASE}, {dimension('product')} SELECT *, row_number() OVER (ORDER BY net_revenue, key DESC)::int
      AS rank FROM metrics QUALIFY rank <= 5""",
    "latest_periods": f"""{BASE}, m AS (SELECT DISTINCT order_month FROM clean ORDER BY 1 DESC LIMIT 2)
      SELECT max(order_month) AS current_period, min(order_month) AS previous_period,
        min(order_month) || ' to ' || max(order_month) AS period_label,
        max(order_month) || ' vs ' || min(order_month) AS comparison_label FROM m""",
    "period_snapshots": f"""{BASE}, {MONTHS} SELECT order_month AS label, {FIGURES} FROM months
      ORDER BY order_month DESC LIMIT 2""",
    "period_comparison": f"""{BASE}, {MONTHS}, two AS (SELECT * FROM months ORDER BY order_month DESC LIMIT 2),
      long AS ({compared('two', 'order_month')}),
      pairs AS (SELECT position::int AS position, metric, arg_max(v, order_month) AS v, arg_min(v, order_month) AS before,
        max(order_month) || ' vs ' || min(order_month) AS comparison_label FROM long GROUP BY position, metric
        HAVING count(*) = 2)
      SELECT position, metric, {CHANGE}, comparison_label FROM pairs""",
    "trend_change": f"""{BASE}, {MONTHS}, long AS ({compared('months', 'order_month')}),
      lagged AS (SELECT order_month, metric, v, lag(v) OVER (PARTITION BY metric ORDER BY order_month) AS before FROM long)
      SELECT order_month, metric, {CHANGE} FROM lagged WHERE before IS NOT NULL""",
    "kpi_summary_long": f"""{BASE}, snap AS ({snapshot()}), one AS (SELECT {FIGURES} FROM snap), {MONTHS},
      two AS (SELECT row_number() OVER (ORDER BY order_month DESC) AS rn, {FIGURES} FROM months QUALIFY rn <= 2)
      {block("'Overall'", 'one', OVERALL_LABELS)} UNION ALL
      {block("CASE rn WHEN 1 THEN 'Current period' ELSE 'Previous period' END", 'two', PERIOD_LABELS)}""",
    "classify_default": f"""SELECT doc_id, 'positive' AS category, 'classified' AS classification
      FROM documents WHERE NOT {blank('text')}""",
    "classify_function": f"WITH {LABELLED} SELECT * FROM labelled",
    "classify_indexed": f"WITH {INDEXED} SELECT * FROM indexed",
    "classification_outcomes": f"""WITH {INDEXED} SELECT 'whole' AS input, 'generated' AS status, NULL::varchar AS reason,
      count(*) AS texts, count(*) FILTER (classification = 'classified') AS classified,
      count(*) FILTER (classification = 'unclassified') AS unclassified, 0::bigint AS failed FROM indexed
      UNION ALL VALUES ('switched off', 'skipped', 'classification is switched off', 0, 0, 0, 0),
        ('no column', 'skipped', 'text column ''review'' is not among the cleaned columns', 0, 0, 0, 0),
        ('nothing to classify', 'skipped', 'no value of ''text'' to classify', 0, 0, 0, 0)""",
    "classification_summary": f"""WITH {LABELLED}, counts AS (SELECT classification, category,
      count(*)::bigint AS records FROM labelled GROUP BY ALL)
      SELECT *, CASE WHEN classification = 'classified' THEN {share('records',
      "(SELECT sum(records) FROM counts WHERE classification = 'classified')")} END AS share_pct FROM counts""",
    "feedback_table": f"""{BASE} SELECT source_row, order_id, 'positive' AS category, feedback FROM clean
      WHERE feedback IS NOT NULL""",
    "extract_numbers": f"WITH {NUMBERS} SELECT * FROM valued",
    "verify_numbers": f"""{BASE}, {NUMBERS}, {TREND_VALUES},
      loose AS (SELECT * FROM valued v WHERE (abs(value) >= 1000 OR value <> floor(value))
        AND NOT (value = floor(value) AND value BETWEEN 1900 AND 2100)
        AND NOT EXISTS (SELECT 1 FROM figures f WHERE abs(v.value - f.value) <= greatest(0.01, 0.005 * abs(f.value)))),
      firsts AS (SELECT doc_id, coalesce(round(try_cast(replace(rtrim(token, '%'), ',', '') AS decimal(38,10)), 2)::double,
        value) AS cut, min(position) AS position FROM loose GROUP BY 1, 2)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY position)::int AS rank, cut AS value
      FROM firsts""",
    "redact_documents": rf"""WITH known AS (SELECT doc_id, replace(text, 'secret', '***') AS text FROM documents),
      bearer AS (SELECT doc_id, regexp_replace(text, '(?i)bearer{SPACE}+[A-Za-z0-9._\-]{{4,}}', 'Bearer ***', 'g') AS text FROM known)
      SELECT doc_id, regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])sk-(?:[A-Za-z0-9._\-]{{5,}}[A-Za-z0-9_])', '\1***', 'g') AS text FROM bearer""",
    "chunk_documents": rf"""WITH t AS (SELECT doc_id, {strip('text')} AS whole, {collapse('text')} AS words FROM documents),
      c AS (SELECT doc_id, CASE WHEN length(whole) <= 500 THEN [whole]
        ELSE regexp_extract_all(words, '(\S.{{0,499}}|\S+)(?: |$)', 1) END AS chunks FROM t WHERE length(whole) > 0)
      SELECT doc_id, unnest(range(0, len(chunks)))::int AS chunk, unnest(chunks) AS text FROM c""",
    "facts_digest": f"""{BASE}, {DIGEST} SELECT region AS scope, replace(replace(replace(replace(text,
      '<1>', t1), '<2>', t2), '<3>', t3), '<4>', t4) AS digest FROM frame JOIN lists USING (region)""",
    "metrics_supplied": f"{BASE}, {DIGEST} {SUPPLIED_LINES}",
    "narrate_regions": f"""{BASE}, {DIGEST}, {NARRATIVES} SELECT scope, executive_summary,
      array_to_string(positive_trends, '; ') AS positive_trends,
      array_to_string(negative_trends, '; ') AS negative_trends,
      array_to_string(watch_items, '; ') AS watch_items, management_summary FROM told""",
    "insights_rows": f"{BASE}, {DIGEST}, {NARRATIVES}, {SECTION_ROWS}",
    "parse_model_json": """WITH shaped AS (SELECT *, (conv_id + turn) % 11 AS shape FROM conversations),
      failed AS (SELECT conv_id, turn, CASE shape
        WHEN 4 THEN length(trim('Sorry, ' || regexp_replace(text, '[\\{\\}\\[\\]]', '', 'g'),
                                ' ' || chr(10) || chr(13) || chr(9))) || ' char(s) starting with letter'
        WHEN 5 THEN (3000 + turn) || ' char(s) starting with ' || chr(39) || '[' || chr(39)
        WHEN 7 THEN length('x {"a": NaN} y') || ' char(s) starting with letter'
        WHEN 8 THEN length('1] junk') || ' char(s) starting with digit' END AS kind FROM shaped)
      SELECT s.conv_id, s.turn, CASE WHEN f.kind IS NOT NULL THEN 'failed' WHEN shape IN (3, 6, 9, 10) THEN 'embedded'
        ELSE 'json' END AS parse_status,
        CASE WHEN shape IN (0, 1, 2, 3, 6, 10) THEN text END AS text,
        'the AI response is not valid JSON (' || f.kind || ')' AS parse_detail
      FROM shaped s JOIN failed f USING (conv_id, turn)""",
    "extract_chat_text": """WITH shaped AS (SELECT *, (conv_id + turn) % 8 AS shape FROM conversations)
      SELECT conv_id, turn, CASE WHEN shape IN (0, 1, 6, 7) THEN 'ok' WHEN shape = 2 THEN 'empty'
        WHEN shape = 3 THEN 'provider_error' WHEN shape = 4 THEN 'no_choices' ELSE 'not_json' END AS outcome,
      CASE shape WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'end' WHEN 7 THEN text
        WHEN 6 THEN text || chr(10) || array_to_string(list_transform(range(5), lambda x: 'level ' || x), chr(10)) END AS reply,
      CASE shape WHEN 2 THEN 'the output budget was used up before an answer was written'
        WHEN 3 THEN 'model not found | code=404' END AS detail,
      CASE WHEN shape IN (0, 1, 6, 7) THEN 'stop' WHEN shape = 2 THEN 'length' END AS finish_reason,
      CASE WHEN shape IN (0, 1, 2, 6, 7) THEN turn END AS prompt_tokens,
      CASE WHEN shape IN (0, 1, 2, 6, 7) THEN turn + 1 END AS reasoning_tokens FROM shaped""",
    "incremental_quality": f"""{BASE}, {ISSUES}, arrived AS (SELECT * FROM valid
        QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY source_row % 3, source_row) = 1)
      SELECT 'clean' AS kind, source_row::varchar AS item, 1::bigint AS records FROM arrived
      UNION ALL SELECT 'rejected', source_row::varchar, 1 FROM checked WHERE is_rejected
      UNION ALL SELECT 'findings', code || ' ' || severity || ' ' || "column", count(*) FROM issues
        GROUP BY code, severity, "column"
      UNION ALL SELECT 'actions', 'duplicate_orders_removed', (SELECT count(*) FROM valid) - (SELECT count(*) FROM arrived)
      UNION ALL SELECT 'run_log', 'rows_read', count(*) FROM raw""",
    "csv_grid": """WITH a AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) + count(*) FILTER (s_suppkey % 5 = 0)
          OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place FROM supplier),
      size AS (SELECT (SELECT count(*) + count(*) FILTER (s_suppkey % 5 = 0) FROM supplier) AS a,
        (SELECT count(*) FROM customer) AS b)
      SELECT 1 + place AS source_row, s_suppkey::varchar AS "Supplier", s_nationkey::varchar AS "Nation",
        s_name || chr(10) || s_suppkey AS "Note", NULL::varchar AS extra_column_4, NULL::varchar AS "Buyer",
        NULL::varchar AS extra_column_3 FROM a
      UNION ALL SELECT 2 + place, NULL, NULL, NULL, NULL, NULL, NULL FROM a WHERE s_suppkey % 5 = 0
      UNION ALL SELECT 1 + size.a + row_number() OVER (ORDER BY c_custkey), (c_custkey % 100)::varchar, NULL,
        'say "' || c_name || '", ok', CASE WHEN c_custkey % 7 = 0 THEN 'over' END, c_custkey::varchar, NULL
        FROM customer, size
      UNION ALL SELECT 1 + size.a + size.b + row_number() OVER (ORDER BY n_nationkey), n_nationkey::varchar, n_name,
        NULL, NULL, NULL, NULL FROM nation, size""",
    "classify_keywords": f"""WITH rules(rule, category, keyword) AS (VALUES (1, 'complaint', 'idiot'),
        (2, 'complaint', 'worthless'), (3, 'complaint', 'pathetic'), (4, 'delivery_feedback', 'license'),
        (4, 'delivery_feedback', 'rights'), (5, 'product_feedback', 'und'), (6, 'neutral', 'the'),
        (7, 'positive', 'la'), (7, 'negative', 'la')),
      said AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS word
        FROM documents WHERE NOT {blank('text')}),
      hits AS (SELECT doc_id, rule, category FROM said JOIN rules ON word = keyword
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rule, category) = 1)
      SELECT doc_id, category, CASE WHEN rule IS NULL THEN 'unclassified' ELSE 'classified' END AS classification
      FROM documents LEFT JOIN hits USING (doc_id) WHERE NOT {blank('text')}""",
    "interpret_function": f"""{BASE} SELECT DISTINCT region AS scope, 'generated' AS status,
      'interpretation generated from the deterministic KPI output' AS status_detail,
      'The digest is complete.' AS executive_summary, 'a; b' AS watch_items, 0::int AS positive_trends FROM clean""",
    "feedback_report": f"""{BASE}, lab AS (SELECT CASE WHEN length(feedback) < 500 THEN 'neutral'
        WHEN length(feedback) < 5000 THEN 'complaint' END AS category FROM clean WHERE feedback IS NOT NULL)
      SELECT 'status' AS part, CASE WHEN count(*) = 0 THEN 'skipped' ELSE 'generated' END AS category,
        count(*)::bigint AS records FROM lab
      UNION ALL SELECT 'summary', category, count(*) FROM lab GROUP BY category
      UNION ALL SELECT 'records', category, count(*) FROM lab WHERE category IS NOT NULL GROUP BY category""",
    "action_records": f"""{FULL} SELECT 'blank_rows_dropped' AS action, count(*)::bigint AS records FROM export
        WHERE {' AND '.join(blank(name) for name in COLUMNS)}
      UNION ALL SELECT 'duplicate_orders_removed', count(*) FROM later UNION ALL SELECT 'no_such_action', 0""",
    "report_placeholder": f"""{BASE} SELECT NULL::bigint AS source_row, 'no records were rejected' AS reason
      UNION ALL SELECT count(*), 'rows with a reason' FROM checked WHERE is_rejected""",
}
