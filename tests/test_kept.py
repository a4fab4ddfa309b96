"""Kept figures and clustered tables against plain versions."""

import random
import re
from datetime import date, timedelta

import pytest

from tidyledger.session import shared_folder
from tidyledger.sources import clustered
from tidyledger.streaming import figures

PLAN = figures.FigurePlan("key", "n", ("shop", "month"), "who", {"cents": "cents", "big": "CASE WHEN cents > 50 THEN cents END"}, 8)
ROW = "key string, n bigint, shop string, month string, who string, cents bigint"


def batches(pick):
    """Batches of rows: one key has half of all rows, orders fall, so keys move; nulls anywhere."""
    out = []
    for number in range(5):
        rows = []
        for _ in range(0 if number == 2 else 60):
            key = "hot" if pick.random() < 0.5 else pick.choice([None, *"abcdefghij"])
            order = pick.choice([None] + [pick.randrange(1000 - 200 * number) for _ in range(30)])
            rows.append((key, order, pick.choice(["x", "y", None]), pick.choice(["1", "2"]),
                         pick.choice(["ann", "bob", None]), pick.choice([None, *range(0, 100, 7)])))
        out.append(rows)
    return out


def recomputed(rows):
    """Figures of the first row of each key; ties go to the least row, nulls before values."""
    def rank(row):
        cents = row[5] or 0
        entry = (row[1], row[2], row[3], row[4], cents, cents if cents > 50 else 0)
        return tuple((x is not None, x if x is not None else 0) for x in entry)

    first = {}
    for row in rows:
        if row[0] not in first or rank(row) < rank(first[row[0]]):
            first[row[0]] = row
    groups = {}
    for row in first.values():
        cents = row[5] or 0
        found = groups.setdefault(row[2], [0, 0, 0, set()])
        found[0] += 1
        found[1] += cents
        found[2] += cents if cents > 50 else 0
        found[3] |= {row[4]} - {None}
    return sorted(((shop, a, b, c, len(d)) for shop, (a, b, c, d) in groups.items()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_figures_after_every_batch(spark, seed):
    folder, seen = shared_folder(spark, "figures"), []
    for epoch, rows in enumerate(batches(random.Random(seed))):
        frame = spark.createDataFrame(rows, ROW)
        figures.apply_batch(frame, epoch, folder, PLAN)
        seen += rows
        found = figures.figures(spark, folder, PLAN, ["shop"]).collect()
        assert sorted((tuple(x) for x in found), key=repr) == recomputed(seen)
        if epoch == 1:  # a batch that is repeated after a failure
            figures.apply_batch(frame, epoch, folder, PLAN)
        if epoch == 3:
            before = {tuple(x) for x in figures.cells(spark, folder, PLAN).collect()}
            figures.compact(spark, folder, PLAN)
            figures.compact(spark, folder, PLAN)
            assert len(figures._directories(spark, folder, "winners")) == 1
            assert {tuple(x) for x in figures.cells(spark, folder, PLAN).collect()} == before
    total = figures.figures(spark, folder, PLAN, []).collect()
    assert total[0]["rows"] == sum(x[1] for x in recomputed(seen))


def test_a_batch_reads_its_own_buckets(spark):
    folder = shared_folder(spark, "figures")
    many = [(f"k{x}", 5, "x", "1", "ann", x) for x in range(200)]
    figures.apply_batch(spark.createDataFrame(many, ROW), 0, folder, PLAN)
    bucket = spark.createDataFrame(many[:1], ROW).selectExpr("int(pmod(xxhash64(key), 8L))").first()[0]
    looked_up = figures.present_rows(spark, folder, 1, [bucket])
    plan = looked_up._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan) and 0 < looked_up.count() < 60
    figures.apply_batch(spark.createDataFrame([("k0", 9, "y", "1", "bob", 1)], ROW), 1, folder, PLAN)
    assert spark.read.parquet(f"{folder}/deltas/epoch=1").count() == 0
    figures.apply_batch(spark.createDataFrame([("k0", 1, "y", "1", "bob", 1)], ROW), 2, folder, PLAN)
    assert {tuple(x) for x in figures.figures(spark, folder, PLAN, ["shop"]).collect()} == {
        ("x", 199, sum(range(1, 200)), sum(range(51, 200)), 1), ("y", 1, 1, 0, 1)
    }


def test_figures_without_a_batch(spark):
    with pytest.raises(ValueError, match="no batch"):
        figures.figures(spark, shared_folder(spark, "figures"), PLAN, [])


DAY = date(2024, 1, 1)


def placed_rows(pick, count):
    """(n, day, product, region): one product has 40 % of all rows; nulls in every column."""
    return [
        (n, pick.choice([None] + [DAY + timedelta(pick.randrange(720)) for _ in range(20)]),
         "hot" if pick.random() < 0.4 else pick.choice([None] + [f"product {pick.randrange(300):03}" for _ in range(20)]),
         pick.choice(["N", "S", "E", "W", None]))
        for n in range(count)
    ]


def test_clustered_reads(spark):
    rows = placed_rows(random.Random(3), 6000)
    folder = shared_folder(spark, "clustered")
    frame = spark.createDataFrame(rows, "n bigint, day date, product string, region string")
    clustered.write_clustered(frame, folder, ["day", "product", "region"], files=240)
    files = spark.read.parquet(f"{folder}/bounds").count()
    largest = spark.read.parquet(f"{folder}/bounds").agg({"rows": "max"}).first()[0]
    assert files > 160 and largest < 6000 / 240 * 4  # the frequent product is dealt out
    cases = [
        {"day": (DAY + timedelta(100), DAY + timedelta(110)), "product": ("product 100", "product 110")},
        {"day": (DAY + timedelta(700), None), "region": ("N", "N")},
        {"product": ("hot", "hot"), "day": (None, DAY + timedelta(5))},
        {"product": ("zzz", None)},
        {"region": (None, None)},
    ]
    at = {"day": 1, "product": 2, "region": 3}
    for ranges in cases:
        def fits(row):
            return all(
                pair == (None, None) or (row[at[x]] is not None and (pair[0] is None or row[at[x]] >= pair[0])
                                         and (pair[1] is None or row[at[x]] <= pair[1]))
                for x, pair in ranges.items()
            )

        found = clustered.read_clustered(spark, folder, ranges)
        assert sorted(tuple(x) for x in found.collect()) == sorted((x for x in rows if fits(x)))
    opened = clustered.files_for(spark, folder, cases[0])
    assert len(opened) < files / 10
    assert clustered.files_for(spark, folder, cases[3]) == []


def test_clustered_empty_table(spark):
    folder = shared_folder(spark, "clustered")
    frame = spark.createDataFrame([], "n bigint, day date")
    clustered.write_clustered(frame, folder, ["day"], files=4)
    assert clustered.read_clustered(spark, folder, {"day": (DAY, None)}).collect() == []
