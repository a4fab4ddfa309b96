"""Readers for the driver tables and the order export derived from them.

``raw_orders`` joins the star schema into the kind of export the quality run
expects: every cell is a string and keys decide which documented defect a row
carries.  No row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.schema import SOURCE_ROW
from tidyledger.session import CLEANUP, SPREAD, setting
from tidyledger.sources.grid import read_numbered_parquet

EXPORT_HEADERS = (
    "Order Date",
    "Order ID",
    "Customer",
    "Product",
    "Category",
    "Qty",
    "Unit Price",
    "Revenue",
    "Region",
    "Order Status",
    "Feedback",
)

# Which keys carry which defect, and how clean cells are written.
CELLS = {
    "Order Date": """
        CASE WHEN l_orderkey % 97 = 5 THEN '31/02/2025'
             WHEN l_orderkey % 97 = 6 THEN ''
             WHEN l_orderkey % 5 = 0 THEN date_format(o_orderdate, 'yyyy/MM/dd')
             WHEN l_orderkey % 5 = 1 THEN date_format(o_orderdate, 'dd-MMM-yyyy')
             WHEN l_orderkey % 5 = 2 THEN date_format(o_orderdate, 'dd MMM yyyy')
             WHEN l_orderkey % 5 = 3 THEN date_format(o_orderdate, 'dd.MM.yyyy')
             ELSE date_format(o_orderdate, 'yyyy-MM-dd') END""",
    "Order ID": """
        CASE WHEN l_partkey % 11 = 0 THEN concat('  SO-', l_orderkey, '-', l_linenumber, '  ')
             ELSE concat('SO-', l_orderkey, '-', l_linenumber) END""",
    "Customer": "CASE WHEN l_suppkey % 23 = 1 THEN 'N/A' ELSE c_name END",
    "Product": "CASE WHEN l_partkey % 211 = 3 THEN '' ELSE p_name END",
    "Category": """
        CASE p_type WHEN 'ECONOMY' THEN 'electronic' WHEN 'SMALL' THEN ' home and  kitchen '
                    WHEN 'MEDIUM' THEN 'Office-Supplies' WHEN 'PROMO' THEN 'OUTDOOR'
                    WHEN 'STANDARD' THEN 'Apparel' ELSE 'clothing' END""",
    "Qty": """
        CASE WHEN l_orderkey % 101 = 7 THEN '0' WHEN l_orderkey % 101 = 8 THEN '1.5'
             WHEN l_orderkey % 101 = 9 THEN 'null'
             ELSE cast(cast(l_quantity AS int) AS string) END""",
    "Unit Price": """
        CASE WHEN l_partkey % 103 = 4 THEN 'abc'
             WHEN l_partkey % 7 = 0 THEN concat('$', cast(p_retailprice AS decimal(12,2)))
             ELSE cast(cast(p_retailprice AS decimal(12,2)) AS string) END""",
    "Revenue": """
        CASE WHEN l_suppkey % 13 = 2 THEN '' WHEN l_suppkey % 17 = 3 THEN '100.00'
             WHEN l_orderkey % 107 = 10 THEN '(50)'
             ELSE cast(cast(l_quantity AS decimal(12,2)) * cast(p_retailprice AS decimal(12,2))
                       AS string) END""",
    "Region": """
        CASE WHEN l_orderkey % 109 = 11 THEN 'Central' WHEN n_regionkey % 4 = 0 THEN 'north'
             WHEN n_regionkey % 4 = 1 THEN 'S' WHEN n_regionkey % 4 = 2 THEN ' East '
             ELSE 'WEST' END""",
    "Order Status": """
        CASE WHEN l_orderkey % 113 = 12 THEN 'Archived'
             WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'refund'
             WHEN o_orderstatus = 'P' THEN 'in progress'
             WHEN o_orderstatus = 'O' AND l_linestatus = 'O' AND l_linenumber = 2 THEN 'Canceled'
             ELSE 'closed' END""",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows over the cores if the session asks for it (see ``session.SPREAD``).

    Only for tables that are a single row group, as on a developer's machine; a cluster
    leaves the setting off, and nothing is shuffled.
    """
    if df.sparkSession.conf.get(SPREAD, "false") != "true":
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def raw_orders(spark: SparkSession, sf_dir: str, feedback: bool = True) -> DataFrame:
    """One string row per order line, numbered by its place in the line table.

    Queries that never look at the free text leave ``feedback`` out and save the
    join with the documents.  The joins carry no hint: customers, parts and
    documents grow with the data, so Spark chooses by their measured size.
    """
    lines = spread(read_numbered_parquet(spark, f"{sf_dir}/lineitem.parquet"), SOURCE_ROW)
    table = {
        name: read_table(spark, sf_dir, name) for name in ("orders", "customer", "nation", "part")
    }
    # Orders get their customers before they meet the lines, and the lines their parts: so the many
    # lines are dealt out twice, and the second time by the key that the documents need.
    placed = (
        table["orders"]
        .join(table["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(table["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    )
    wide = lines.join(table["part"], F.col("l_partkey") == F.col("p_partkey")).join(
        placed, F.col("l_orderkey") == F.col("o_orderkey")
    )
    cells = [F.expr(sql).alias(header) for header, sql in CELLS.items()]
    if feedback:
        documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
        wide = wide.join(documents, F.col("doc_id") == F.col("l_orderkey"), "left")
        cells.append(F.col("text").alias("Feedback"))
    return wide.select(SOURCE_ROW, *cells)


def raw_export(spark: SparkSession, sf_dir: str, feedback: bool = True) -> DataFrame:
    """:func:`raw_orders` plus one blank row for every order without any line."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey")
    empty = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    rows = raw_orders(spark, sf_dir, feedback)
    blank = empty.select(
        (-F.col("o_orderkey") - 1).alias(SOURCE_ROW),
        *[F.lit("").alias(header) for header in rows.columns[1:]],
    )
    return rows.unionByName(blank)


def staged_parts(rows: DataFrame, folder: str, parts: int) -> list[str]:
    """Rows written once, by the remainder of their row number; returns a folder for each part."""
    named = rows.withColumn("_part", F.pmod(SOURCE_ROW, F.lit(parts)))
    with setting(rows.sparkSession, CLEANUP, "true"):
        named.write.partitionBy("_part").parquet(folder)
    return [f"{folder}/_part={part}" for part in range(parts)]
