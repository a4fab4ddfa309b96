"""Joins and windows over time whose keys may be hot.

A key's rows are cut into blocks of time, and every window runs within one block of one key,
so a key with most of all rows is dealt over its blocks.  What a block needs from the ones
before it (the last value, a total, the end of a session) is one row for each key and
block; only those rows are ordered by key alone.

Times are TIMESTAMP columns; widths are seconds.  Rows without a time take no part unless stated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def micros(time: str | Column) -> Column:
    column = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(column.cast("timestamp"))


def _block(at: Column, seconds: int) -> Column:
    return F.floor(at / F.lit(seconds * 1_000_000)).cast("bigint")


def _before(keys: Sequence[str], block: str = "_block"):
    """All earlier blocks of the key."""
    return Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)


# ---------------------------------------------------------------------------
# As-of join
# ---------------------------------------------------------------------------
def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    order: Sequence[str] = (),
    tolerance: int | None = None,
    block: int = DAY,
) -> DataFrame:
    """Every left row with ``values`` of the last right row of its keys at or before its time.

    Of right rows at one time the one with the greatest ``order`` columns counts (nulls
    least).  Without such a row, beyond ``tolerance`` seconds, or with a null key or time, the
    values are null.  Both sides meet in one window per key and block; the last value of
    the blocks before is carried over.
    """
    if clash := {"_at", "_block", "_side", "_left", "_right", "_order"} & {*left.columns, *right.columns}:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    names = [f"_key{k}" for k in range(len(keys))]
    named = [F.col(key).alias(name) for key, name in zip(keys, names, strict=True)]
    payload = F.struct(*[F.col(x) for x in values], micros(right_time).alias("_time"))
    known = " AND ".join(f"{x} IS NOT NULL" for x in [*names, "_at"])
    rights = right.select(
        *named,
        micros(right_time).alias("_at"),
        F.struct(*[F.col(x) for x in order], F.lit(0).alias("_last")).alias("_order"),
        payload.alias("_right"),
    ).where(known)
    types = {field.name: field.dataType for field in rights.schema}
    lefts = left.select(
        *named,
        micros(left_time).alias("_at"),
        F.lit(None).cast(types["_order"]).alias("_order"),
        F.lit(None).cast(types["_right"]).alias("_right"),
        F.struct(*left.columns).alias("_left"),
    )
    matched = lefts.where(known)
    rights, matched = (x.withColumn("_block", _block(F.col("_at"), block)) for x in (rights, matched))
    where = [*names, "_block"]

    both = matched.withColumn("_side", F.lit(1)).unionByName(
        rights.withColumn("_left", F.lit(None).cast(matched.schema["_left"].dataType)).withColumn("_side", F.lit(0))
    )
    inside = Window.partitionBy(*where).orderBy("_at", "_side", F.col("_order").asc_nulls_first())
    seen = F.last("_right", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    local = both.withColumn("_local", seen).where("_side = 1").drop("_right", "_order", "_side")

    last = rights.groupBy(*where).agg(F.max_by("_right", F.struct("_at", "_order")).alias("_tail"))
    asked = matched.select(*where).distinct()
    ends = asked.join(last, where, "full_outer")
    carried = F.last("_tail", ignorenulls=True).over(_before(names))
    carries = ends.withColumn("_carry", carried).select(*where, "_carry")

    found = local.join(carries, where, "left").withColumn("_hit", F.coalesce("_local", "_carry"))
    if tolerance is not None:
        near = F.col("_at") - F.col("_hit._time") <= tolerance * 1_000_000
        found = found.withColumn("_hit", F.when(near, F.col("_hit")))
    picked = found.select("_left.*", *[F.col(f"_hit.{x}").alias(x) for x in values])
    unknown = lefts.where(f"NOT ({known})").select(
        "_left.*", *[F.lit(None).cast(picked.schema[x].dataType).alias(x) for x in values]
    )
    return picked.unionByName(unknown)


# ---------------------------------------------------------------------------
# Interval join
# ---------------------------------------------------------------------------
CELLS = 64  # an interval lies in at most one more than so many cells of its level
LEVELS = 4  # cells of a level are as wide as CELLS of the level below


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    cell: int = DAY,
) -> DataFrame:
    """All pairs of rows with equal keys whose closed intervals share an instant.

    One grid of time cells for each level of length: an interval is copied to the cells it
    covers on the first level where these are few, and a start is looked for in one cell of
    each level.  A pair is found by the later of the two starts (the right one if they are
    equal), so once.  The join is an equality join on keys, level and cell.  Intervals with a
    null or reversed end, and null keys, meet nothing.  Other columns must have different names.
    """
    if clash := ({*left.columns} & {*right.columns}) - {*keys}:
        raise ValueError(f"columns of both sides: {sorted(clash)}")

    def spans(rows: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        start, end = micros(span[0]).alias(f"_{side}from"), micros(span[1]).alias(f"_{side}to")
        row = F.struct(*[x for x in rows.columns if x not in keys]).alias(f"_{side}row")
        return rows.select(*keys, start, end, row).where(f"_{side}from <= _{side}to")

    widths = [cell * CELLS**level for level in range(LEVELS)]

    def covering(rows: DataFrame, side: str) -> DataFrame:
        ends = F.col(f"_{side}from"), F.col(f"_{side}to")
        level = F.lit(LEVELS - 1)
        for k in reversed(range(LEVELS - 1)):
            few = _block(ends[1], widths[k]) - _block(ends[0], widths[k]) <= CELLS
            level = F.when(few, F.lit(k)).otherwise(level)
        width = F.element_at(F.array(*[F.lit(x) for x in widths]), level + 1).cast("double") * 1_000_000
        first, last = (F.floor(x / width).cast("bigint") for x in ends)
        return rows.select("*", level.alias("_level"), F.explode(F.sequence(first, last)).alias("_cell"))

    def starting(rows: DataFrame, side: str) -> DataFrame:
        at = F.col(f"_{side}from")
        places = [
            F.struct(F.lit(k).alias("_level"), F.floor(at / (F.lit(x).cast("double") * 1_000_000)).cast("bigint").alias("_cell"))
            for k, x in enumerate(widths)
        ]
        return rows.select("*", F.explode(F.array(*places)).alias("_place")).select("*", "_place.*").drop("_place")

    a, b = spans(left, left_span, "l"), spans(right, right_span, "r")
    where = [*keys, "_level", "_cell"]
    later_right = covering(a, "l").join(starting(b, "r"), where).where("_lfrom <= _rfrom AND _rfrom <= _lto")
    later_left = covering(b, "r").join(starting(a, "l"), where).where("_rfrom < _lfrom AND _lfrom <= _rto")
    pairs = later_right.select(*keys, "_lrow", "_rrow").unionByName(later_left.select(*keys, "_lrow", "_rrow"))
    return pairs.select(*keys, "_lrow.*", "_rrow.*")


# ---------------------------------------------------------------------------
# Sessions
# ---------------------------------------------------------------------------
def sessions(
    rows: DataFrame, key: str, time: str, gap: int, sums: dict[str, Column] | None = None, block: int = DAY
) -> DataFrame:
    """``(key, session_start, session_end, events, sums...)``: runs of events at most ``gap`` seconds apart.

    Sessions are made within blocks of time; only the first and the last of a block can go
    on in another one, so at most two rows for each key and block are stitched by key.
    Null keys are one key.  Times come out in microseconds since 1970.
    """
    sums, wide = sums or {}, gap * 1_000_000
    at = rows.select(
        F.col(key).alias("_key"), micros(time).alias("_at"), *[x.alias(name) for name, x in sums.items()]
    ).where("_at IS NOT NULL")
    at = at.withColumn("_block", _block(F.col("_at"), block))
    inside = Window.partitionBy("_key", "_block").orderBy("_at")
    opens = F.coalesce(F.col("_at") - F.lag("_at").over(inside) > wide, F.lit(True))
    at = at.withColumn("_opens", opens.cast("int"))
    at = at.withColumn("_number", F.sum("_opens").over(inside))
    merged = [F.sum(name).alias(name) for name in sums]
    local = at.groupBy("_key", "_block", "_number").agg(
        F.min("_at").alias("session_start"), F.max("_at").alias("session_end"), F.count("*").alias("events"), *merged
    )
    final = F.max("_number").over(Window.partitionBy("_key", "_block"))
    local = local.withColumn("_border", (F.col("_number") == 1) | (F.col("_number") == final))
    result = [F.col("_key").alias(key), "session_start", "session_end", "events", *sums]
    by_key = Window.partitionBy("_key").orderBy("session_start")
    border = local.where("_border")
    opens = F.coalesce(F.col("session_start") - F.lag("session_end").over(by_key) > wide, F.lit(True))
    border = border.withColumn("_opens", opens.cast("int")).withColumn("_chain", F.sum("_opens").over(by_key))
    stitched = border.groupBy("_key", "_chain").agg(
        F.min("session_start").alias("session_start"),
        F.max("session_end").alias("session_end"),
        F.sum("events").alias("events"),
        *merged,
    )
    return local.where("NOT _border").select(*result).unionByName(stitched.select(*result))


# ---------------------------------------------------------------------------
# Frames
# ---------------------------------------------------------------------------
def running_total(
    rows: DataFrame, keys: Sequence[str], time: str, value: Column, name: str, order: Sequence[str] = (), block: int = DAY
) -> DataFrame:
    """``rows`` with the total of ``value`` of the key up to the row, in order of time and ``order``.

    Sums within a block, plus the totals of the blocks before it.  Rows without a time come
    first, in a block of their own.  Give ``order`` columns that tell rows of one time apart.
    """
    where = ["_block"]
    named = {f"_key{k}": F.col(key) for k, key in enumerate(keys)}
    where = [*named, "_block"]
    at = rows.withColumns({**named, "_at": micros(time), "_value": value})
    at = at.withColumn("_block", F.coalesce(_block(F.col("_at"), block), F.lit(-(2**62))))
    inside = Window.partitionBy(*where).orderBy("_at", *order).rowsBetween(Window.unboundedPreceding, 0)
    local = at.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    totals = at.groupBy(*where).agg(F.sum("_value").alias("_total"))
    carries = totals.withColumn("_carry", F.coalesce(F.sum("_total").over(_before(list(named))), F.lit(0)))
    carries = carries.select(*[F.col(x).alias(f"c{x}") for x in where], "_carry")
    same = [F.col(x).eqNullSafe(F.col(f"c{x}")) for x in where]
    found = local.join(carries, same)
    return found.select(*rows.columns, (F.col("_local") + F.col("_carry")).alias(name))


def trailing_total(
    rows: DataFrame, keys: Sequence[str], time: str, value: Column, name: str, seconds: int
) -> DataFrame:
    """``rows`` with the total of ``value`` of the key over the last ``seconds``, the row's time included.

    A row at t sums the rows in ``(t - seconds, t]``.  Blocks are as long as the frame and get
    a copy of the block before, so a frame never needs a third one.  Rows without a time
    get null.
    """
    width = seconds * 1_000_000
    named = {f"_key{k}": F.col(key) for k, key in enumerate(keys)}
    at = rows.withColumns({**named, "_at": micros(time), "_value": value})
    at = at.withColumn("_own", _block(F.col("_at"), seconds))
    dealt = at.where("_at IS NOT NULL").withColumn("_block", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    # A frame that moves at both ends is summed anew for each row, which is quadratic in a block.  These
    # two only grow: the rows of the own block up to the row, and those of the block before from its end back.
    inside = Window.partitionBy(*named, "_block")
    own = inside.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    before = inside.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, width - 1)
    mine = F.col("_own") == F.col("_block")
    found = dealt.withColumn("_sum", F.sum(F.when(mine, F.col("_value"))).over(own))
    found = found.withColumn("_sum_before", F.sum(F.when(~mine, F.col("_value"))).over(before)).where(mine)
    kind = found.select(F.coalesce("_sum", F.lit(0))).schema[0].dataType
    both = F.coalesce("_sum", F.lit(0)) + F.coalesce("_sum_before", F.lit(0))
    found = found.withColumn(name, both.cast(kind))
    unknown = rows.where(micros(time).isNull()).withColumn(name, F.lit(None).cast(kind))
    return found.select(*rows.columns, name).unionByName(unknown)
