"""Preparation and type coercion: strings in, typed columns out, nothing lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.functions.cells import blank_to_null, is_blank, normalise_text, parse_cell, quoted
from tidyledger.schema import PARSED_KINDS, SOURCE_ROW, TEXT_KINDS, ColumnSpec, Schema


# Columns of an audited table: is the row blank, and which texts did white space change?
BLANK = "is_blank_row"
SPACES = "space_changes"


def raw_name(name: str) -> str:
    """Column that keeps the source text of a parsed cell."""
    return f"{name}__raw"


def data_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name not in (SOURCE_ROW, BLANK, SPACES)]


def present(schema: Schema, columns: list[str]) -> list[ColumnSpec]:
    return [spec for spec in schema if spec.name in columns]


def text_columns(df: DataFrame, schema: Schema) -> list[str]:
    texts = {spec.name for spec in schema if spec.kind in TEXT_KINDS}
    return [name for name in df.columns if name in texts]


def rows_where(df: DataFrame, condition: Column, columns: list[str] | None = None) -> DataFrame:
    """Filter on computed cells without computing them a second time.

    A plain filter would be pushed below the projection that parses the cells,
    which copies every parser into the condition.  ``inline`` of a conditional
    one-element array keeps the rows and leaves the projection alone.  Name the
    ``columns`` that are needed: the scan then reads only what they depend on.
    """
    row = F.struct(*(columns or df.columns))
    return df.select(F.inline(F.when(condition, F.array(row))))


def any_cell(df: DataFrame) -> Column:
    """True when at least one cell (extra columns too) is not blank."""
    everything_blank = F.lit(True)
    for name in data_columns(df):
        everything_blank = everything_blank & is_blank(F.col(name))
    return ~everything_blank


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Remove rows whose every cell is blank."""
    return df.filter(any_cell(df))


def normalise_cells(df: DataFrame, schema: Schema) -> DataFrame:
    """Collapse white space in text columns, blank spellings to NULL everywhere."""
    texts = set(text_columns(df, schema))
    cells = [
        (normalise_text if name in texts else blank_to_null)(F.col(name)).alias(name)
        for name in data_columns(df)
    ]
    return df.select(SOURCE_ROW, *cells)


def prepare(df: DataFrame, schema: Schema) -> DataFrame:
    """Normalise cells and drop blank rows; expects canonical headers (see ``map_headers``)."""
    cells = normalise_cells(df, schema)
    return rows_where(cells, F.coalesce(*data_columns(cells)).isNotNull())


def audited(df: DataFrame, schema: Schema) -> DataFrame:
    """Normalised cells of all rows, with what preparation changes in each (``BLANK``, ``SPACES``).

    One pass over the rows as read serves the rows themselves and the audit log.
    """
    texts = text_columns(df, schema)
    changes = [
        F.when(
            normalise_text(F.col(name)) != F.col(name),
            F.struct(F.lit(place).alias("place"), F.col(name).alias("before")),
        )
        for place, name in enumerate(texts)
    ]
    kind = "array<struct<place:int,before:string>>"
    spaces = F.array_compact(F.array(*changes)) if changes else F.array()
    cells = [
        (normalise_text if name in texts else blank_to_null)(F.col(name)).alias(name) for name in data_columns(df)
    ]
    wide = df.select(SOURCE_ROW, *cells, spaces.cast(kind).alias(SPACES))
    return wide.withColumn(BLANK, F.coalesce(*data_columns(df)).isNull() if data_columns(df) else F.lit(True))


def coerce(prepared: DataFrame, schema: Schema) -> DataFrame:
    """Parse dates, integers and numbers; the source text stays in ``<name>__raw``."""
    specs = {spec.name: spec for spec in schema}
    columns = []
    for name in data_columns(prepared):
        spec = specs.get(name)
        if spec is not None and spec.kind in PARSED_KINDS:
            columns.append(parse_cell(F.col(name), spec).alias(name))
            columns.append(F.col(name).alias(raw_name(name)))
        else:
            columns.append(F.col(name))
    audit = [name for name in (BLANK, SPACES) if name in prepared.columns]
    return prepared.select(SOURCE_ROW, *columns, *audit)


def rejects_when_null(spec: ColumnSpec) -> bool:
    """A missing or unparsed value is an error either way."""
    return spec.required and not spec.default


def typed_cells(df: DataFrame, schema: Schema) -> DataFrame:
    """Normalise and parse in one projection, for results that need valid rows only.

    The source text is kept just for columns where a cell that did not parse
    counts differently from a missing one.
    """
    specs = {spec.name: spec for spec in schema}
    columns = []
    for name in data_columns(df):
        spec = specs.get(name)
        if spec is None:
            columns.append(blank_to_null(F.col(name)).alias(name))
            continue
        columns.append(parse_cell(F.col(name), spec).alias(name))
        if spec.kind in PARSED_KINDS and not rejects_when_null(spec) and not spec.derived:
            columns.append(blank_to_null(F.col(name)).alias(raw_name(name)))
    return df.select(SOURCE_ROW, *columns)


def parse_failed(spec: ColumnSpec) -> Column:
    return F.col(raw_name(spec.name)).isNotNull() & F.col(spec.name).isNull()


def coercion_failures(coerced: DataFrame, schema: Schema) -> DataFrame:
    """Long form of every cell that holds text but could not be parsed."""
    parsed = [spec for spec in present(schema, coerced.columns) if spec.kind in PARSED_KINDS]
    failures = [
        F.when(
            parse_failed(spec),
            F.array(
                F.struct(
                    F.lit(spec.name).alias("column"),
                    F.lit(spec.kind).alias("kind"),
                    F.col(raw_name(spec.name)).alias("raw"),
                )
            ),
        ).otherwise(F.array())
        for spec in parsed
    ]
    return coerced.select(SOURCE_ROW, F.inline(F.concat(*failures)))


def whitespace_changes(df: DataFrame, schema: Schema) -> DataFrame:
    """Every text cell that white-space normalisation changed, in long form.

    ``position`` is the column's place, so examples can follow column order.
    Blank cells that become NULL do not count as changed, so blank rows add nothing.
    """
    changes = []
    for position, name in enumerate(text_columns(df, schema)):
        before, after = F.col(name), normalise_text(F.col(name))
        changes.append(
            F.when(
                after != before,
                F.array(
                    F.struct(
                        F.lit(position).alias("position"),
                        F.lit(name).alias("column"),
                        before.alias("before"),
                        after.alias("after"),
                    )
                ),
            ).otherwise(F.array())
        )
    return df.select(SOURCE_ROW, F.inline(F.concat(*changes)))


def change_example(before: Column, after: Column) -> Column:
    return F.concat(
        F.lit("row "), F.col(SOURCE_ROW), F.lit(": "), quoted(before), F.lit(" -> "), quoted(after)
    )
