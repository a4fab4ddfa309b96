from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidyledger.functions import cells, numbers
from tidyledger.schema import ORDER_SCHEMA

SPEC = {spec.name: spec for spec in ORDER_SCHEMA}


def apply(spark, values, function):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = frame.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()
    return [row.out for row in rows]


def test_parse_number(spark):
    cases = {
        "1,299.00": 1299, "$1,299.00": 1299, "(50)": -50, "24.90": Decimal("24.9"), "12": 12,
        "abc": None, "": None, "N/A": None, "-": None, " 7 ": 7, "50%": 50, "1e5": 15,
        "1.2.3": None, "5-": None, ".5": Decimal("0.5"), "5.": 5, "(-50)": 50, "-3.25": Decimal("-3.25"),
        " (1,000.5)\n": Decimal("-1000.5"), "()": None,
    }
    assert apply(spark, list(cases), cells.parse_number) == [
        None if v is None else Decimal(v) for v in cases.values()
    ]
    assert apply(spark, [None], cells.parse_number) == [None]


def test_parse_integer(spark):
    cases = {"3": 3, "5.0": 5, "1.5": None, "abc": None, "": None, "(4)": -4, "1,000": 1000,
             "99999999999999999999": None}
    assert apply(spark, list(cases), cells.parse_integer) == list(cases.values())


def test_parse_date(spark):
    day = datetime(2025, 2, 3)
    cases = {
        "2025-02-03": day, "2025/2/3": day, "03-Feb-2025": day, "3 feb  2025": day,
        "3.2.2025": day, "2025-02-03T04:05:06": datetime(2025, 2, 3, 4, 5, 6),
        "  2025-02-03\t": day, "03 FEB 2025": day,
        "31/02/2025": None, "03/02/2025": None, "": None, "2025-02-30": None, "03-Foo-2025": None,
        "2025-02": None, "0000-01-01": None, "2025-02-03 04:05:06": None, "25-02-03": None,
        "29-Feb-2023": None, "2025-13-01": None,
    }
    assert apply(spark, list(cases), cells.parse_date) == list(cases.values())


@pytest.mark.parametrize(
    ("column", "cases"),
    [
        ("category", {" home and kitchen ": "Home & Kitchen", "ELECTRONICS": "Electronics",
                      "Outdoors": "Outdoors", "toys": None, "Home & Kitchen": "Home & Kitchen"}),
        ("region", {"north": "North", "w": "West", "Central": None}),
        ("status", {"completed": "Completed", "in  progress": "Pending", "Archived": None, "": None}),
    ],
)
def test_canonical_value(spark, column, cases):
    found = apply(spark, list(cases), lambda c: cells.canonical_value(c, SPEC[column]))
    assert found == list(cases.values())


def test_normalise_text_matches_python(spark):
    texts = ["  Desk   Lamp  ", "   ", "a b\x1cc", "n/a", "NaN", "tidy text here", "ends \n",
             "é  è", "-", "none", "abcd", "abc\n", " x", "two  blanks inside"]
    tokens = {"", "na", "n/a", "null", "none", "nan", "-"}
    want = [None if t.strip().lower() in tokens else " ".join(t.split()) for t in texts]
    assert apply(spark, texts, cells.normalise_text) == want
    blank = [t.strip().lower() in tokens for t in texts]
    assert apply(spark, texts, cells.is_blank) == blank


def test_texts_for_messages(spark):
    values = ["plain", "it's", "a\"b'c", "back\\slash", "line\nbreak\t"]
    assert apply(spark, values, cells.quoted) == [repr(v) for v in values]
    assert apply(spark, ["x" * 81, "y" * 80, None], cells.display_value) == ["x" * 77 + "...", "y" * 80, ""]
    numbers_in = ["0", "-50", "0.5", "1234567", "123456", "0.00001234", "40000", "12.3456789"]
    shown = apply(spark, numbers_in, lambda c: cells.short_number(c.cast("decimal(38,10)")))
    assert shown == [f"{float(v):g}" for v in numbers_in]
    moneys = ["1299.50", "100.00", "0.00", "-0.05", "12.34"]
    assert apply(spark, moneys, lambda c: cells.float_text(c)) == [str(float(v)) for v in moneys]


def test_half_up_division(spark):
    rows = [(7, 2), (-7, 2), (5, 3), (1, 0), (0, 5), (1, 8)]
    frame = spark.createDataFrame(rows, "a bigint, b bigint")
    found = [r[0] for r in frame.select(numbers.divide_half_up(F.col("a"), F.col("b"))).collect()]
    assert found == [4, -4, 2, None, 0, 0]
