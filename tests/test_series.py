"""Time joins, sessions, frames, cubes, quantiles and differences against plain versions."""

import bisect
import math
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tidyledger.operators import difference, lattice, quantiles, timeline
from tidyledger.plans import series

SMALL = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = [tuple(None if isinstance(row[i], float) and math.isnan(row[i]) else row[i] for i in order) for row in rows]
    return sorted(clean, key=repr)


def moment(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def times(pick, count, days=12):
    """(key, seconds): one key has 90 % of all rows; some keys and times are null or equal."""
    out = []
    for _ in range(count):
        key = "hot" if pick.random() < 0.9 else pick.choice(["a", "b", None])
        out.append((key, pick.choice([None, 0, 86_400, *(pick.randrange(days * 86_400) for _ in range(60))])))
    return out


@pytest.mark.parametrize("name", sorted(series.QUERIES))
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for table in ("orders", "lineitem", "customer", "nation", "part", "events", "documents"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    frame, cursor = series.QUERIES[name](spark, SMALL), connection.execute(series.ORACLE[name])
    columns = [entry[0] for entry in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    rows = comparable([tuple(r) for r in frame.collect()], frame.columns)
    assert rows and comparable(cursor.fetchall(), columns) == rows


@pytest.mark.parametrize("tolerance", [None, 3600])
def test_asof_join(spark, tolerance):
    pick = random.Random(1)
    left = [(k, *x) for k, x in enumerate(times(pick, 900))]
    right = [(k, *x, pick.choice([None, 1, 2])) for k, x in enumerate(times(pick, 700))]
    a = spark.createDataFrame([(k, key, moment(t)) for k, key, t in left], "n long, key string, at timestamp")
    b = spark.createDataFrame([(k, key, moment(t), v) for k, key, t, v in right], "m long, key string, ts timestamp, v int")
    found = timeline.asof_join(a, b, ["key"], "at", "ts", ["m", "v"], order=["m"], tolerance=tolerance).collect()
    assert len(found) == len(left)
    known = {}
    for m, key, t, v in right:
        if key is not None and t is not None:
            known.setdefault(key, []).append((t, m, v))
    for rows in known.values():
        rows.sort(key=lambda x: x[:2])
    got = {x["n"]: (x["m"], x["v"]) for x in found}
    for n, key, t in left:
        rows = known.get(key, [])
        at = bisect.bisect_right(rows, (t, float("inf")), key=lambda x: x[:2]) if key is not None and t is not None else 0
        hit = rows[at - 1] if at else None
        if hit and tolerance is not None and t - hit[0] > tolerance:
            hit = None
        assert got[n] == (hit[1:] if hit else (None, None)), (n, key, t)


def test_asof_join_of_empty_sides(spark):
    a = spark.createDataFrame([(1, "x", START)], "n long, key string, at timestamp")
    none = spark.createDataFrame([], "m long, key string, ts timestamp")
    assert [tuple(x) for x in timeline.asof_join(a, none, ["key"], "at", "ts", ["m"]).collect()] == [(1, "x", START, None)]
    with pytest.raises(ValueError):
        timeline.asof_join(a.withColumnRenamed("n", "_at"), none, ["key"], "at", "ts", ["m"])


def test_a_hot_key_is_dealt_over_its_blocks(spark):
    rows = spark.range(20_000).select(
        F.lit("hot").alias("key"), "id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).alias("ts")
    )
    for frame in (
        timeline.asof_join(rows, rows.select("key", "ts", F.col("id").alias("m")), ["key"], "ts", "ts", ["m"]),
        timeline.sessions(rows, "key", "ts", 30),
        timeline.running_total(rows, ["key"], "ts", F.col("id"), "total"),
        timeline.trailing_total(rows, ["key"], "ts", F.col("id"), "total", 7200),
    ):
        text = plan(frame)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # Only one row for each key and block is ever ordered by the key alone: 14 days of 1440 rows.
    found = timeline.running_total(rows, ["key"], "ts", F.col("id"), "total")
    assert found.agg(F.max("total")).first()[0] == 20_000 * 19_999 // 2
    largest = rows.groupBy("key", timeline._block(timeline.micros("ts"), timeline.DAY)).count().agg(F.max("count")).first()[0]
    assert largest == 1440


def test_overlap_join(spark):
    pick = random.Random(4)

    def spans(count):
        out = []
        for k in range(count):
            start = pick.choice([None, 0, 3600, pick.randrange(40 * 86_400)])
            length = pick.choice([-5, 0, 60, 86_400, 30 * 86_400, 9_000 * 86_400])
            end = None if start is None or pick.random() < 0.05 else start + length
            out.append((k, pick.choice(["x", "x", "x", "y", None]), start, end))
        return out

    left, right = spans(220), spans(200)
    a = spark.createDataFrame([(k, key, moment(s), moment(e)) for k, key, s, e in left], "n long, key string, s timestamp, e timestamp")
    b = spark.createDataFrame([(k, key, moment(s), moment(e)) for k, key, s, e in right], "m long, key string, f timestamp, t timestamp")
    frame = timeline.overlap_join(a, b, ["key"], ("s", "e"), ("f", "t"), cell=600)
    found = sorted((x["n"], x["m"]) for x in frame.collect())
    whole = lambda x: x[1] is not None and x[2] is not None and x[3] is not None and x[2] <= x[3]
    true = sorted(
        (x[0], y[0])
        for x in left
        for y in right
        if whole(x) and whole(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]
    )
    assert found == true and len(true) > 500
    assert "NestedLoop" not in plan(frame) and "Cartesian" not in plan(frame)
    with pytest.raises(ValueError):
        timeline.overlap_join(a, a, ["key"], ("s", "e"), ("s", "e"))


@pytest.mark.parametrize("block", [600, 86_400])
def test_sessions(spark, block):
    pick = random.Random(5)
    rows = [(key, t, pick.randrange(9)) for key, t in times(pick, 1500, days=2)]
    df = spark.createDataFrame([(key, moment(t), v) for key, t, v in rows], "key string, ts timestamp, v long")
    found = timeline.sessions(df, "key", "ts", 120, {"total": F.col("v")}, block=block)
    true = []
    for key in {x[0] for x in rows}:
        mine = sorted((t, v) for k, t, v in rows if k == key and t is not None)
        start = 0
        for k in range(1, len(mine) + 1):
            if k == len(mine) or mine[k][0] - mine[k - 1][0] > 120:
                part = mine[start:k]
                true.append((key, part[0][0], part[-1][0], len(part), sum(x[1] for x in part)))
                start = k
    base = 1_704_067_200 * 1_000_000
    got = [(x[0], (x[1] - base) // 10**6, (x[2] - base) // 10**6, x[3], x[4]) for x in found.collect()]
    assert sorted(got, key=str) == sorted(true, key=str)


def test_frames(spark):
    pick = random.Random(6)
    rows = [(k, key, t, pick.choice([None, *range(9)])) for k, (key, t) in enumerate(times(pick, 800, days=3))]
    df = spark.createDataFrame([(k, key, moment(t), v) for k, key, t, v in rows], "n long, key string, ts timestamp, v long")
    total = timeline.running_total(df, ["key"], "ts", F.col("v"), "total", order=["n"], block=3600)
    both = timeline.trailing_total(total, ["key"], "ts", F.col("v"), "recent", 1800).collect()
    assert len(both) == len(rows)
    place = lambda t, n: (t is not None, t or 0, n)
    for x in both:
        n, key, t, _ = rows[x["n"]]
        mine = [r for r in rows if r[1] == key]
        assert x["total"] == sum(r[3] or 0 for r in mine if place(r[2], r[0]) <= place(t, n))
        recent = None if t is None else sum(r[3] or 0 for r in mine if r[2] is not None and t - 1800 < r[2] <= t)
        assert x["recent"] == recent


def test_cube_counts_members_once(spark):
    pick = random.Random(7)
    rows = [(pick.choice(["a", "b", None]), pick.choice([1, 2, None]), pick.choice([None, *map(str, range(70))]), pick.randrange(9)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "x string, y int, who string, v long")
    ids = lattice.dictionary(df, "who")
    parts = lattice.partial(df, ["x", "y"], {"n": "count(*)", "v": "sum(v)"}, "who", ids)
    found = {(r["x"], r["y"], r["grouping"]): (r["n"], r["v"], r["who"]) for r in lattice.cube(parts, ["x", "y"], ["n", "v"], "who").collect()}
    true = {}
    for grouping in range(4):
        for x, y, who, v in rows:
            key = (None if grouping & 2 else x, None if grouping & 1 else y, grouping)
            n, total, members = true.setdefault(key, (0, 0, set()))
            true[key] = (n + 1, total + v, members | ({who} - {None}))
    assert found == {k: (n, v, len(m)) for k, (n, v, m) in true.items()}
    text = plan(lattice.cube(parts, ["x", "y"], ["n", "v"], "who"))
    assert text.count("Expand") == 1


@pytest.mark.parametrize("spread", [3, 10_000_000_000])
def test_exact_quantiles(spark, spread):
    pick = random.Random(8)
    rows = [(pick.choice(["a", "a", "a", "b", None]), pick.choice([None, pick.randint(-spread, spread)])) for _ in range(3000)]
    df = spark.createDataFrame([*rows, ("lone", 5)], "g string, v long")
    found = {(x["g"], x["probability"]): (x["n"], x["quantile"]) for x in quantiles.exact_quantiles(df, ["g"], "v", [0, 0.5, 0.99, 1]).collect()}
    for g in ("a", "b", None, "lone"):
        mine = sorted(v for k, v in [*rows, ("lone", 5)] if k == g and v is not None)
        for p in (0, 0.5, 0.99, 1):
            at = (len(mine) - 1) * p
            low = int(at)
            high = min(low + 1, len(mine) - 1)
            n, value = found[g, p]
            assert n == len(mine) and value == pytest.approx(mine[low] + (mine[high] - mine[low]) * (at - low), rel=1e-12)
    assert quantiles.exact_quantiles(df.where("v IS NULL"), ["g"], "v", [0.5]).collect() == []


def test_only_changed_buckets_are_read(spark, tmp_path):
    rows = [(k, f"n{k}", None if k % 7 == 0 else k) for k in range(3000)] + [(None, "none", 1)]
    old = spark.createDataFrame(rows, "k long, name string, v long")
    new = old.where("k IS NULL OR k <> 11").withColumn("v", F.when(F.col("k") == 14, 1).when(F.col("k").isNull(), 2).otherwise(F.col("v")))
    new = new.unionByName(spark.createDataFrame([(9000, "new", None)], old.schema))
    for frame, name in ((old, "old"), (new, "new"), (old.repartition(7), "same")):
        difference.write_version(frame, f"{tmp_path}/{name}", ["k"], buckets=32)
    assert difference.changed_buckets(spark, f"{tmp_path}/old", f"{tmp_path}/same") == []
    assert difference.cell_changes(spark, f"{tmp_path}/old", f"{tmp_path}/same", ["k"]).collect() == []
    buckets = difference.changed_buckets(spark, f"{tmp_path}/old", f"{tmp_path}/new")
    assert 1 <= len(buckets) <= 4
    read = difference.read_changed(spark, f"{tmp_path}/old", buckets)
    read.collect()
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    files = scan.metrics().apply("numFiles").value()
    written = len(list((tmp_path / "old" / "rows").rglob("*.parquet")))
    assert 0 < files <= written / 4  # a few of 32 buckets
    found = {tuple(x) for x in difference.cell_changes(spark, f"{tmp_path}/old", f"{tmp_path}/new", ["k"]).collect()}
    assert found == {
        (11, "removed", "*", None, None),
        (14, "changed", "v", None, "1"),
        (None, "changed", "v", "1", "2"),
        (9000, "added", "*", None, None),
    }


def test_all_queries_are_registered():
    assert set(series.QUERIES) <= set(driver.queries())
    assert set(series.ORACLE) <= set(driver.oracle_sql())
