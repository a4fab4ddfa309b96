import random
import tempfile

from pyspark.sql import functions as F

from tidyledger.schema import ORDER_SCHEMA, SOURCE_ROW
from tidyledger.sources import grid, sinks


def test_ragged_grid(spark):
    values = [["Order Date", "", "Qty"], ["a"], None, ["b", "c", "d", "e"], []]
    frame = grid.grid_from_values(spark, values)
    assert frame.columns == [SOURCE_ROW, "Order Date", "unnamed_column_2", "Qty", "extra_column_4"]
    rows = [tuple(row) for row in frame.orderBy(SOURCE_ROW).collect()]
    assert rows == [(2, "a", None, None, None), (3, "b", "c", "d", "e"), (4, None, None, None, None)]


def test_map_headers_first_match_wins(spark):
    frame = spark.createDataFrame([(2, "1", "2", "3", "4")], "source_row bigint, `Order Date` string, Qty string, Units string, `Cost Centre` string")
    mapped, mapping = grid.map_headers(frame, ORDER_SCHEMA)
    assert mapped.columns == [SOURCE_ROW, "date", "quantity", "units", "cost_centre"]
    assert mapping.recognised == (("Order Date", "date"), ("Qty", "quantity"))
    assert mapping.retained == ("Units", "Cost Centre")
    plan = grid.plan_headers(["x", "X", "--"], ORDER_SCHEMA)
    assert [name for _, name in plan.names] == ["x", "x_2", "unnamed_column_3"]


def test_equal_headers_stay_two_columns(spark):
    frame = spark.createDataFrame([(2, "1", "2")], "source_row bigint, a string, b string").toDF(SOURCE_ROW, "Qty", "Qty")
    mapped, _ = grid.map_headers(frame, ORDER_SCHEMA)
    assert mapped.columns == [SOURCE_ROW, "quantity", "qty"]


def test_numbers_run_over_files(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/parts"
    for start in (0, 10, 25):
        size = {0: 10, 10: 15, 25: 5}[start]
        spark.range(start, start + size, 1, 1).write.mode("append").parquet(folder)
    numbered = grid.read_numbered_parquet(spark, folder)
    rows = sorted(r[0] for r in numbered.collect())
    assert rows == list(range(2, 32))
    again = {(r[0], r[1]) for r in grid.read_numbered_parquet(spark, folder).collect()}
    assert again == {(r[0], r[1]) for r in numbered.collect()}
    in_file = numbered.groupBy(F.floor(F.col("id") / 100)).agg(F.count_distinct(SOURCE_ROW)).first()[1]
    assert in_file == 30


def test_with_source_row_is_dense_and_ordered(spark):
    frame = spark.range(0, 1000, 1, 7)
    numbered = grid.with_source_row(frame)
    rows = [(r[0], r.id) for r in numbered.orderBy("id").collect()]
    assert rows == [(i + 2, i) for i in range(1000)]


def test_csv_grid_keeps_long_rows(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{folder}/a.csv", "w") as handle:
        handle.write('Order Date,"Cost, Centre"\n2025-01-01,"x,y"\n2025-01-02\n2025-01-03,p,q\n')
    frame = grid.read_csv_grid(spark, folder)
    assert frame.columns == [SOURCE_ROW, "Order Date", "Cost, Centre", "extra_column_3"]
    rows = [tuple(r) for r in frame.orderBy(SOURCE_ROW).collect()]
    assert rows == [(2, "2025-01-01", "x,y", None), (3, "2025-01-02", None, None), (4, "2025-01-03", "p", "q")]


def test_csv_grid_over_files(spark):
    """Own header, column order and line breaks in each file; the numbers do not depend on the splits."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{folder}/b.csv", "w") as handle:
        handle.write("Qty,Order ID,Comment\n" + "".join(f'{i},B{i},"two\n{"x" * i}\n""lines"""\n' for i in range(60)))
    with open(f"{folder}/a.csv", "w") as handle:
        handle.write("\nOrder ID,Units\nA1,1\n\nA2,2,more\n")
    with open(f"{folder}/c.csv", "w") as handle:
        handle.write("Order ID,Qty\nC1,5\n")
    want = [(2, "A1", "1", None, None), (3, None, None, None, None), (4, "A2", "2", "more", None)]
    want += [(5 + i, f"B{i}", str(i), None, f'two\n{"x" * i}\n"lines"') for i in range(60)] + [(65, "C1", "5", None, None)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "300", "97"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            frame = grid.read_csv_grid(spark, folder, schema=ORDER_SCHEMA)
            assert frame.columns == [SOURCE_ROW, "order_id", "quantity", "extra_column_3", "feedback"]
            assert sorted((tuple(r) for r in frame.collect()), key=lambda r: r[0]) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plain = grid.read_csv_grid(spark, folder)
    assert plain.columns == [SOURCE_ROW, "Order ID", "Units", "extra_column_3", "Qty", "Comment"]


def test_written_tables_are_read_back_as_a_grid(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    frame = spark.createDataFrame([("1", 'two\nlines "x", y'), ("2", "")], "id string, text string").coalesce(1)
    sinks.write_tables({"t": frame}, folder)
    rows = grid.read_csv_grid(spark, f"{folder}/t").orderBy(SOURCE_ROW).collect()
    assert [(r[0], r.id, r.text or "") for r in rows] == [(2, "1", 'two\nlines "x", y'), (3, "2", "")]


def test_run_log_trim(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/log"
    log = spark.range(30).select(F.col("id").alias("run_id"), F.format_string("2025-01-%02d", "id").alias("started_at"))
    sinks.append_run_log(log, folder)
    for most in (40, 1):
        sinks.trim_run_log(spark, folder, most)
        assert sinks.run_log_folder(spark, folder).endswith("/v1")
    sinks.trim_run_log(spark, folder, 12)
    assert sorted(r.run_id for r in sinks.read_run_log(spark, folder).collect()) == list(range(19, 30))
    sinks.append_run_log(log.limit(1), folder)  # the caller's path stays the same
    assert sinks.read_run_log(spark, folder).count() == 12
    sinks.trim_run_log(spark, folder, 3)  # never below the documented minimum
    assert sorted(r.run_id for r in sinks.read_run_log(spark, folder).collect()) == list(range(21, 30))
    assert sinks.run_log_folder(spark, folder).endswith("/v3")


def test_sink_cells(spark):
    frame = spark.sql("SELECT 5.0D a, 2.5D b, cast(NULL AS string) c, timestamp_ntz'2025-01-02 03:04:05' d, 7 e, double('nan') f, 1234.567D g, array('x','y') h")
    assert list(sinks.format_cells(frame).first()) == ["5", "2.5", "", "2025-01-02", "7", "", "1234.57", "x; y"]


def test_unclosed_quotes_end_at_a_bound(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    inside = [f"{n},z" for n in range(3, 40)]
    lines = ["a,b", '1,"x', 'y"', '2,"open', *inside, '40,"shut"', '41,end"', '42,"two', 'lines"', "43,w", '44,"rest', *inside]
    with open(f"{folder}/a.csv", "w") as handle:
        handle.write("\n".join(lines))
    records = grid.csv_records(spark, folder, most_lines=5).orderBy("_ordinal").collect()
    # Both open quotes go on for too long, the second one to the end of the file.
    want = [("a,b", False), ('1,"x\ny"', False), *[(x, True) for x in lines[3:43]], ('42,"two\nlines"', False), ("43,w", False)]
    want += [(x, True) for x in lines[46:]]
    assert [(r["value"], r["_given_up"]) for r in records] == want
    assert [r["_ordinal"] for r in records] == list(range(len(want)))
    found = grid.unclosed_lines(spark, folder, most_lines=5).orderBy("line").collect()
    assert [(r["line"], r["value"]) for r in found] == [(4, '2,"open'), (43, '41,end"'), (47, '44,"rest')]
    rows = grid.read_csv_grid(spark, folder, most_lines=5).orderBy(SOURCE_ROW).collect()
    cells = [(r["a"], r["b"]) for r in rows]
    assert cells[0] == ("1", "x\ny") and cells[2] == ("3", "z") and cells[-1] == ("39", "z")
    assert [r[SOURCE_ROW] for r in rows] == list(range(2, len(want) + 1))
    assert not grid.csv_records(spark, folder).where("_given_up").take(1)


def test_rows_of_one_file_are_not_dealt_by_file(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/one"
    spark.range(1000).coalesce(1).write.parquet(folder)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = grid.read_numbered_parquet(spark, folder)
        assert "SortMergeJoin" not in numbered._jdf.queryExecution().executedPlan().toString()
        assert {(r[0], r[1]) for r in numbered.collect()} == {(k + 2, k) for k in range(1000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def csv_wanted(lines, most):
    """Records of one file with their first line, as csv_records defines them."""
    records, opened = [], 0
    for number, line in enumerate(lines):
        if opened % 2 == 0:
            records.append([])
        records[-1].append((number, line))
        opened += line.count('"')
    found = []
    for record in records:
        if len(record) > most:
            found += [(number, line, True) for number, line in record]
        else:
            found.append((record[0][0], "\n".join(line for _, line in record), False))
    return [(place, *x) for place, x in enumerate(found)]


def test_many_records_that_are_given_up(spark):
    draw = random.Random(5)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    want = []
    for name, share in (("a", 0.1), ("b", 0.3), ("c", 0)):
        lines = [f'{k},"x{k}' + ("" if draw.random() < share else '"') for k in range(4000)]
        with open(f"{folder}/{name}.csv", "w") as handle:
            handle.write("\n".join(lines) + "\n")
        want += [(name, *x) for x in csv_wanted(lines, 5)]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several splits of each file
    try:
        records = grid.csv_records(spark, folder, most_lines=5)
        # No row carries all given-up records of its file.
        assert "collect_list(struct(_ordinal" not in records._jdf.queryExecution().optimizedPlan().toString()
        found = [(r["_file"][-5], r["_ordinal"], r["_line"], r["value"], r["_given_up"]) for r in records.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(found) == sorted(want)
    assert sum(x[-1] for x in want) > 2000
