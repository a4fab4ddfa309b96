"""Declarative column rules: what a business table must look like.

A schema is a tuple of :class:`ColumnSpec`.  It lives on the driver only; the
operators compile it into Spark ``Column`` expressions, so a rule never runs as
Python code over rows.  Every operator takes the schema as an argument, and
:data:`ORDER_SCHEMA` is the default.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

SOURCE_ROW = "source_row"
ORDER_MONTH = "order_month"

# Numbers parse into a wide decimal; money is kept exact to the cent.
NUMBER_TYPE = T.DecimalType(38, 10)
MONEY_TYPE = T.DecimalType(38, 2)

SPARK_TYPES = {
    "date": T.TimestampNTZType(),
    "integer": T.LongType(),
    "numeric": NUMBER_TYPE,
    "text": T.StringType(),
    "category": T.StringType(),
}
PARSED_KINDS = ("date", "integer", "numeric")
TEXT_KINDS = ("text", "category")


@dataclass(frozen=True)
class ColumnSpec:
    """Rules of one column.

    ``allowed`` lists the canonical values of a category; ``spellings`` maps
    further lower-case spellings onto them.  ``default`` fills missing values,
    ``derived`` marks a value the cleaning stage recomputes anyway.
    """

    name: str
    kind: str
    required: bool = True
    headers: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    spellings: dict[str, str] = field(default_factory=dict, hash=False)
    minimum: float | None = None
    maximum: float | None = None
    default: str | None = None
    derived: bool = False

    def __post_init__(self) -> None:
        if self.kind not in SPARK_TYPES:
            raise ValueError(f"unknown column kind {self.kind!r}")

    def lookup(self) -> dict[str, str]:
        """Lower-case spelling -> canonical value; declared spellings win."""
        return {value.lower(): value for value in self.allowed} | self.spellings


Schema = tuple[ColumnSpec, ...]


# ---------------------------------------------------------------------------
# The business schema (headers, canonical values, spellings and
# limits have to be these for the results to be right).
# ---------------------------------------------------------------------------
NON_REVENUE_STATUSES = ("Cancelled", "Refunded")

CATEGORY_SPELLINGS = {
    "electronics": "Electronics",
    "electronic": "Electronics",
    "home and kitchen": "Home & Kitchen",
    "home & kitchen": "Home & Kitchen",
    "home-kitchen": "Home & Kitchen",
    "kitchen": "Home & Kitchen",
    "office supplies": "Office Supplies",
    "office-supplies": "Office Supplies",
    "officesupplies": "Office Supplies",
    "outdoor": "Outdoors",
    "outdoors": "Outdoors",
    "apparel": "Apparel",
    "clothing": "Apparel",
}
REGION_SPELLINGS = {
    "north": "North",
    "n": "North",
    "south": "South",
    "s": "South",
    "east": "East",
    "e": "East",
    "west": "West",
    "w": "West",
}
STATUS_SPELLINGS = {
    "completed": "Completed",
    "complete": "Completed",
    "closed": "Completed",
    "pending": "Pending",
    "in progress": "Pending",
    "cancelled": "Cancelled",
    "canceled": "Cancelled",
    "refunded": "Refunded",
    "refund": "Refunded",
}

ORDER_SCHEMA: Schema = (
    ColumnSpec("date", "date", headers=("order_date", "date_of_order", "order date")),
    ColumnSpec("order_id", "text", headers=("order", "order_no", "order_number", "order id")),
    ColumnSpec(
        "customer",
        "text",
        headers=("customer_name", "client", "customer name"),
        default="Unknown Customer",
    ),
    ColumnSpec("product", "text", headers=("product_name", "item", "sku_name")),
    ColumnSpec(
        "category",
        "category",
        headers=("product_category", "segment"),
        allowed=("Electronics", "Home & Kitchen", "Office Supplies", "Outdoors", "Apparel"),
        spellings=CATEGORY_SPELLINGS,
    ),
    ColumnSpec("quantity", "integer", headers=("qty", "units", "units_sold"), minimum=1),
    ColumnSpec("unit_price", "numeric", headers=("price", "price_per_unit", "unit cost"), minimum=0),
    ColumnSpec(
        "revenue",
        "numeric",
        required=False,
        headers=("sales", "total", "amount"),
        minimum=0,
        derived=True,
    ),
    ColumnSpec(
        "region",
        "category",
        headers=("sales_region", "territory", "area"),
        allowed=("North", "South", "East", "West"),
        spellings=REGION_SPELLINGS,
    ),
    ColumnSpec(
        "status",
        "category",
        headers=("order_status", "state"),
        allowed=("Completed", "Pending", "Cancelled", "Refunded"),
        spellings=STATUS_SPELLINGS,
    ),
    ColumnSpec(
        "feedback",
        "text",
        required=False,
        headers=("comment", "comments", "customer_feedback", "notes"),
    ),
)


@dataclass(frozen=True)
class QualityPolicy:
    """Thresholds of a quality run."""

    outlier_threshold: float = 10_000.0
    duplicate_column: str = "order_id"


class DataQualityError(ValueError):
    """The input cannot produce a meaningful result (empty, or columns missing)."""


def header_key(header: object) -> str:
    """Spelling-independent form of a header: ``"Order ID"`` -> ``"order_id"``."""
    words = re.findall("[a-z0-9]+", str(header).lower())
    return "_".join(words)


def required_columns(schema: Schema) -> list[str]:
    return [spec.name for spec in schema if spec.required]
