import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidyledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


HEADERS = [
    "Order Date", "Order ID", "Customer", "Product", "Category", "Qty", "Unit Price",
    "Revenue", "Region", "Order Status", "Feedback",
]
GOOD = ["2025-01-10", "A-1", "Ann", "Lamp", "Electronics", "2", "10.00", "20.00", "North",
        "Completed", "fine"]


def order(**changes):
    """One export row; keywords replace cells by header (spaces as underscores)."""
    row = dict(zip(HEADERS, GOOD)) | {k.replace("_", " "): v for k, v in changes.items()}
    return [row[header] for header in HEADERS]


@pytest.fixture(scope="session")
def dirty():
    """Header plus rows 2.. of an export with one row per documented defect."""
    rows = [
        order(Order_ID="A-1"),  # 2
        order(Order_ID="A-2", Order_Date="03-Feb-2025", Category=" home and  kitchen ", Region="s"),  # 3
        order(Order_ID="A-1"),  # 4 exact duplicate
        order(Order_ID="A-2", Qty="3", Revenue="30"),  # 5 same id, other quantity
        order(Order_ID="  A-3  ", Product="Desk   Lamp", Order_Status="CLOSED"),  # 6 white space
        order(Order_ID="A-4", Unit_Price="$1,299.00", Qty="1", Revenue="1299"),  # 7
        order(Order_ID="A-5", Qty="5", Unit_Price="40", Revenue="100"),  # 8 mismatch
        order(Order_ID="A-6", Order_Date="31/02/2025"),  # 9 rejected
        order(Order_ID="A-7", Order_Date=""),  # 10 rejected
        order(Order_ID="A-8", Qty="0"),  # 11 rejected
        order(Order_ID="A-9", Qty="N/A"),  # 12 rejected
        order(Order_ID="A-10", Unit_Price="abc"),  # 13 rejected
        order(Order_ID="A-11", Product=" "),  # 14 rejected
        order(Order_ID="A-12", Customer="-", Order_Date="2025/02/04"),  # 15 default
        order(Order_ID="A-13", Region="Central"),  # 16 rejected
        order(Order_ID="A-14", Order_Status="Archived"),  # 17 rejected
        order(Order_ID="A-15", Qty="6", Unit_Price="10000", Revenue="60000"),  # 18 outlier
        ["", " ", None, "N/A", "null", "", "", "-", "", "", ""],  # 19 blank
        order(Order_ID="A-16", Revenue="", Order_Status="refund"),  # 20 blank revenue
        order(Order_ID="A-17", Revenue="n.a.x", Order_Date="5.2.2025"),  # 21 broken revenue
        order(Order_ID="A-6", Order_Date="1 Mar 2025"),  # 22 valid: the first A-6 was rejected
    ]
    return [HEADERS, *rows]
