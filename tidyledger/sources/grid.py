"""Reading value grids: ragged rows, header names, source row numbers."""

from __future__ import annotations

import csv
import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidyledger.functions.cells import BLANK_TOKENS, WHITE_SPACE
from tidyledger.schema import SOURCE_ROW, Schema, header_key
from tidyledger.session import ensure_checkpoint_folder

FIRST_DATA_ROW = 2
MOST_LINES = 1000  # of a CSV record; a longer one has a quote that is never closed


# ---------------------------------------------------------------------------
# Source row numbers
# ---------------------------------------------------------------------------
def read_numbered_parquet(
    spark: SparkSession, path: str, first_row: int = FIRST_DATA_ROW
) -> DataFrame:
    """Read Parquet with a dense ``source_row`` in file order.

    The number is the row's index in its file plus the rows of the files before
    it.  Both come from file metadata, so a recomputed task gets the same
    numbers.  There is one count for each file, and these are broadcast: by a shuffle
    all rows of a file would meet in one task.
    """
    data = spark.read.parquet(path)
    place = data.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_index"),
    )
    files = place.groupBy("_file").agg((F.max("_index") + 1).alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    numbered = place.join(F.broadcast(offsets), "_file").withColumn(SOURCE_ROW, F.col("_index") + F.col("_before") + first_row)
    return numbered.select(SOURCE_ROW, *data.columns)


def with_source_row(df: DataFrame, first_row: int = FIRST_DATA_ROW) -> DataFrame:
    """Number the rows of any DataFrame densely in partition order.

    Without file positions the order of rows is only stable once written, so the
    rows are checkpointed first.  The offsets then need one count per partition;
    rows are never sorted or brought together.
    """
    ensure_checkpoint_folder(df.sparkSession)
    local_bits = 33  # monotonically_increasing_id keeps the place within a partition there
    staged = df.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    partition = F.shiftright("_id", local_bits)
    staged = staged.withColumn("_part", partition)
    counts = staged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    place = F.col("_id").bitwiseAND((1 << local_bits) - 1)
    numbered = staged.join(F.broadcast(offsets), "_part")  # one row for each partition
    return numbered.select(
        (place + F.col("_before") + first_row).alias(SOURCE_ROW), *df.columns
    )


# ---------------------------------------------------------------------------
# Ragged grids
# ---------------------------------------------------------------------------
def grid_headers(header: Sequence[object], width: int) -> list[str]:
    """Column names of a grid: blank header cells and cells past the header get numbers."""
    names = []
    for position in range(1, max(width, len(header)) + 1):
        if position > len(header):
            names.append(f"extra_column_{position}")
            continue
        cell = "" if header[position - 1] is None else str(header[position - 1]).strip(WHITE_SPACE)
        blank = cell.lower() in BLANK_TOKENS
        names.append(f"unnamed_column_{position}" if blank else cell)
    return names


def grid_frame(
    rows: DataFrame, header: Sequence[object], width: int | None = None, cells: str = "cells"
) -> DataFrame:
    """Turn ``(source_row, cells ARRAY<STRING>)`` into named columns.

    Short rows are padded with NULL.  The width is the widest row (one small
    aggregate) unless the caller knows it.
    """
    if width is None:
        width = rows.agg(F.max(F.size(cells))).first()[0] or 0
    names = grid_headers(header, width)
    columns = [F.get(cells, F.lit(i)).alias(name) for i, name in enumerate(names)]
    return rows.filter(F.col(cells).isNotNull()).select(SOURCE_ROW, *columns)


def grid_from_values(spark: SparkSession, values: Sequence[Sequence[object] | None]) -> DataFrame:
    """A grid held in memory (a range that an API returned): row 0 is the header."""
    kept = [row for row in values if row is not None]
    if not kept:
        raise ValueError("the grid has no header row")
    rows = [
        (number, [None if cell is None else str(cell) for cell in row])
        for number, row in enumerate(kept[1:], start=FIRST_DATA_ROW)
    ]
    frame = spark.createDataFrame(rows, f"{SOURCE_ROW} bigint, cells array<string>")
    width = max((len(row) for row in kept), default=0)
    return grid_frame(frame, kept[0], width)


def _numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines with their file, split and number in the file, and one row for each split.

    A split's lines are in order within its task, so a line's number follows from its
    place there and the lines of the splits before, however the file was split.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
        (F.length("value") - F.length(F.replace("value", F.lit('"')))).alias("_quotes"),
    )
    splits = lines.groupBy("_file", "_block").agg(
        F.count("*").alias("_n"),
        F.sum("_quotes").alias("_split_quotes"),
        F.count_if(F.col("_quotes") % 2 == 1).alias("_odd"),
        F.min("_place").alias("_first"),
    )
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "_file",
        "_block",
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_lines_before"),
        F.coalesce(F.sum("_split_quotes").over(earlier), F.lit(0)).alias("_quotes_before"),
        (F.sum("_odd").over(Window.partitionBy("_file")) > 0).alias("_broken"),
    )
    numbered = lines.join(F.broadcast(splits), ["_file", "_block"])
    return numbered.withColumn("_line", F.col("_lines_before") + F.col("_place") - F.col("_first")), splits


def csv_records(spark: SparkSession, path: str, most_lines: int = MOST_LINES) -> DataFrame:
    """``(_file, _ordinal, _line, value, _given_up)``: the records of CSV files, line breaks within quotes included.

    A file in which every line closes its quotes has one record for each line and is not
    shuffled.  In other files a line starts a record if the quotes before it are closed;
    the lines of a record are put together again, also across splits.  A record of more than
    ``most_lines`` lines has a quote that was never closed: it is given up, and each of its lines is
    a record of its own, so no line is lost and none gathers the rest of a file.
    """
    lines, _ = _numbered_lines(spark, path)
    whole = lines.where("NOT _broken").select(
        "_file", F.col("_line").alias("_ordinal"), "_line", "value", F.lit(False).alias("_given_up")
    )
    in_split = Window.partitionBy("_file", "_block").orderBy("_line")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def numbered(rows: DataFrame) -> DataFrame:
        """Rows with the number of their record, from ``_starts``: 1 in the first line of a record, 0 in others."""
        counts = rows.groupBy("_file", "_block").agg(F.sum("_starts").alias("_records"))
        counts = counts.select(
            "_file", "_block", F.coalesce(F.sum("_records").over(earlier), F.lit(0)).alias("_records_before")
        )
        ranked = rows.withColumn("_rank", F.sum("_starts").over(in_split))
        joined = ranked.join(F.broadcast(counts), ["_file", "_block"])
        return joined.withColumn("_ordinal", F.col("_records_before") + F.col("_rank") - 1).drop("_rank", "_records_before")

    opened = F.col("_quotes_before") + F.coalesce(F.sum("_quotes").over(before), F.lit(0))
    broken = lines.where("_broken").withColumn("_starts", (opened % 2 == 0).cast("long"))
    placed = numbered(broken.select("_file", "_block", "_line", "value", "_starts"))
    # Each line of a given-up record starts a record, which also moves the ones behind it.
    long = placed.groupBy("_file", "_ordinal").agg(F.count("*").alias("_n")).where(F.col("_n") > most_lines)
    marked = placed.join(long.select("_file", "_ordinal", F.lit(True).alias("_long")), ["_file", "_ordinal"], "left")
    given_up = F.coalesce("_long", F.lit(False))
    marked = marked.select(
        "_file",
        "_block",
        "_line",
        "value",
        given_up.alias("_given_up"),
        F.when(given_up, F.lit(1)).otherwise(F.col("_starts")).cast("long").alias("_starts"),
    )
    parts = numbered(marked).groupBy("_file", "_ordinal")
    joined = F.array_sort(F.collect_list(F.struct("_line", "value")))
    together = parts.agg(
        F.min("_line").alias("_line"),
        F.array_join(F.transform(joined, lambda x: x["value"]), "\n").alias("value"),
        F.bool_or("_given_up").alias("_given_up"),
    )
    return whole.unionByName(together)


def unclosed_lines(spark: SparkSession, path: str, most_lines: int = MOST_LINES) -> DataFrame:
    """``(file, line, value)``: the quarantine of a file's quotes, lines of given-up records with an odd number of them.

    Lines count from 1.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    found = csv_records(spark, path, most_lines).where(F.col("_given_up") & (quotes % 2 == 1))
    return found.select(F.col("_file").alias("file"), (F.col("_line") + 1).alias("line"), "value")


def read_csv_grid(
    spark: SparkSession,
    path: str,
    width: int | None = None,
    separator: str = ",",
    schema: Schema | None = None,
    most_lines: int = MOST_LINES,
) -> DataFrame:
    """Read ragged CSV exports, all cells as strings, numbered over all files by path.

    The first record of a file that is not blank is its header.  Columns are matched by
    header, not by place, so files may order them differently; with a ``schema`` also by
    its spellings, and the result has its names.  Cells past a header are kept.  Blank
    records stay (as empty rows) and count as rows.  The distinct headers are read by
    the driver, one for each layout of the files.  Records of more than ``most_lines`` lines
    are given up (see :func:`csv_records`).
    """
    records = csv_records(spark, path, most_lines).select("_file", "_ordinal", "value")
    first = F.min(F.when(F.trim("value") != "", F.struct("_ordinal", "value")))
    files = records.groupBy("_file").agg((F.max("_ordinal") + 1).alias("_records"), first.alias("_head"))
    files = files.where("_head IS NOT NULL").select(
        "_file", "_records", F.col("_head._ordinal").alias("_head_at"), F.col("_head.value").alias("_header")
    )
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn(
        "_before", F.coalesce(F.sum(F.col("_records") - F.col("_head_at") - 1).over(before), F.lit(0))
    )
    layouts = files.groupBy("_header").agg(F.min("_file").alias("_file")).orderBy("_file").collect()
    if not layouts:
        raise ValueError(f"{path} contains no data")
    if width is None:
        bare = F.regexp_replace("value", '"[^"]*"', "")
        cells = F.length(bare) - F.length(F.replace(bare, F.lit(separator))) + 1
        width = records.agg(F.max(cells)).first()[0]
    places: dict[tuple[str, int], dict[str, int]] = {}
    for layout in layouts:
        names = grid_headers(next(csv.reader([layout["_header"]], delimiter=separator)), width)
        if schema is not None:
            names = [name for _, name in plan_headers(names, schema).names]
        seen: dict[str, int] = {}
        for place, name in enumerate(names):
            seen[name] = seen.get(name, 0) + 1
            places.setdefault((name, seen[name]), {})[layout["_header"]] = place
    fields = ", ".join(f"c{i} string" for i in range(1, width + 1))
    row = F.from_csv("value", fields, {"sep": separator, "escape": '"'})
    data = records.join(F.broadcast(files), "_file").where("_ordinal > _head_at")
    data = data.select(
        (F.col("_ordinal") - F.col("_head_at") - 1 + F.col("_before") + FIRST_DATA_ROW).alias(SOURCE_ROW),
        "_header",
        row.alias("_row"),
    )
    array = F.array(*[F.col("_row")[f"c{i}"] for i in range(1, width + 1)])
    columns = []
    for found in places.values():
        of_layout = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])
        place = F.try_element_at(of_layout, F.col("_header"))
        columns.append(F.when(place.isNotNull(), F.get(array, place)))
    named = [column.alias(f"_{k}") for k, column in enumerate(columns)]
    return data.select(SOURCE_ROW, *named).toDF(SOURCE_ROW, *[name for name, _ in places])


# ---------------------------------------------------------------------------
# Header mapping
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class HeaderMapping:
    """How source headers became columns, in source order."""

    names: tuple[tuple[str, str], ...]
    recognised: tuple[tuple[str, str], ...]
    retained: tuple[str, ...]


def plan_headers(headers: Sequence[str], schema: Schema) -> HeaderMapping:
    """Give every schema column the first header that spells it; the other headers keep a plain name."""
    keys = [header_key(header) for header in headers]
    names: dict[int, str] = {}
    for spec in schema:
        spellings = {header_key(text) for text in (spec.name, *spec.headers)}
        matching = (place for place, key in enumerate(keys) if key in spellings and place not in names)
        place = next(matching, None)
        if place is not None:
            names[place] = spec.name
    others = [place for place in range(len(headers)) if place not in names]
    used = set(names.values())
    for place in others:
        plain = keys[place] or f"unnamed_column_{place + 1}"
        tries = itertools.accumulate(itertools.repeat("_2"), initial=plain)
        names[place] = next(name for name in tries if name not in used)
        used.add(names[place])
    return HeaderMapping(
        names=tuple((header, names[place]) for place, header in enumerate(headers)),
        recognised=tuple(
            (header, names[place])
            for place, header in enumerate(headers)
            if place not in others and header != names[place]
        ),
        retained=tuple(headers[place] for place in others),
    )


def map_headers(df: DataFrame, schema: Schema) -> tuple[DataFrame, HeaderMapping]:
    """Rename by position (two equal headers stay two columns); metadata work only."""
    headers = [name for name in df.columns if name != SOURCE_ROW]
    mapping = plan_headers(headers, schema)
    ordered = df if df.columns[0] == SOURCE_ROW else df.select(SOURCE_ROW, *headers)
    return ordered.toDF(SOURCE_ROW, *[name for _, name in mapping.names]), mapping
