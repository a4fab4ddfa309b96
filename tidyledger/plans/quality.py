"""The quality run: raw rows in, clean rows, quarantine and audit log out."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.operators import clean, prepare, validate
from tidyledger.schema import ORDER_SCHEMA, SOURCE_ROW, QualityPolicy, Schema
from tidyledger.session import stored
from tidyledger.sources.grid import HeaderMapping, map_headers


@dataclass(frozen=True)
class QualityRun:
    """All outputs of a quality run as lazy DataFrames over one plan.

    Nothing is computed until an output is used, and an output only reads the
    columns it needs.  When several outputs are used, call :meth:`persist` or
    :meth:`written`, so the parsing happens once.
    """

    source: DataFrame
    mapping: HeaderMapping
    schema: Schema
    policy: QualityPolicy
    kept: DataFrame | None = None  # audited rows that were persisted or written

    @cached_property
    def audit(self) -> DataFrame:
        """All rows, blank ones included: typed and checked, and what preparation changed in them."""
        if self.kept is not None:
            return self.kept
        cells = prepare.audited(self.source, self.schema)
        return validate.check_rows(prepare.coerce(cells, self.schema), self.schema)

    @cached_property
    def checked(self) -> DataFrame:
        """Typed rows without the blank ones, with source texts and ``is_rejected``."""
        if self.kept is not None:
            return self.kept.where(~F.col(prepare.BLANK)).drop(prepare.BLANK, prepare.SPACES)
        prepared = prepare.prepare(self.source, self.schema)
        return validate.check_rows(prepare.coerce(prepared, self.schema), self.schema)

    @cached_property
    def complete(self) -> DataFrame:
        """Typed rows with ``is_rejected``, enough for results on valid rows.

        Blank rows lack required values and are rejected, so they need no test.
        """
        if self.kept is not None or not any(map(prepare.rejects_when_null, self.schema)):
            return self.checked
        return validate.check_rows(prepare.typed_cells(self.source, self.schema), self.schema)

    @cached_property
    def valid(self) -> DataFrame:
        return validate.valid_rows(self.checked)

    @cached_property
    def clean(self) -> DataFrame:
        return self.clean_columns(None)

    def clean_columns(self, columns: list[str] | None) -> DataFrame:
        """Clean rows with the named columns only; no other column is read."""
        return clean.clean_rows(self.complete, self.schema, self.policy, columns)

    @cached_property
    def issues(self) -> DataFrame:
        return validate.all_issues(self.checked, self.schema, self.policy)

    @cached_property
    def findings(self) -> DataFrame:
        return validate.findings(self.checked, self.schema, self.policy)

    @cached_property
    def rejected(self) -> DataFrame:
        return validate.rejected_records(self.checked, self.schema, self.policy)

    @cached_property
    def summary(self) -> DataFrame:
        return validate.validation_summary(self.checked, self.schema, self.policy)

    @cached_property
    def actions(self) -> DataFrame:
        return clean.preparation_actions(self.audit, self.schema, self.mapping).unionByName(
            clean.cleaning_actions(self.checked, self.schema, self.policy)
        )

    def persist(self) -> QualityRun:
        """Keep the audited rows on the executors (lost blocks are recomputed)."""
        return replace(self, kept=self.audit.persist(StorageLevel.MEMORY_AND_DISK))

    def written(self, folder: str) -> QualityRun:
        """Write the audited rows to a shared folder and go on from that table.

        For large inputs: parsing is done once, later outputs scan only their
        columns, and a lost executor re-reads files instead of the raw export.
        """
        self.audit.write.mode("overwrite").parquet(folder)
        return replace(self, kept=self.audit.sparkSession.read.parquet(folder))


def run_quality(
    raw: DataFrame,
    schema: Schema = ORDER_SCHEMA,
    policy: QualityPolicy | None = None,
    gate: bool = True,
) -> QualityRun:
    """Prepare, coerce and validate raw rows (``source_row`` plus string cells).

    The rules depend on each other in this order: bad values are reported before
    anything is rewritten.  ``gate=False`` skips the check for emptiness, the
    only part that reads data here.
    """
    policy = policy or QualityPolicy()
    source, mapping = map_headers(raw, schema)
    validate.schema_gate(source, schema, rows_known=not gate)
    return QualityRun(source, mapping, schema, policy)


def quality_metrics(run: QualityRun) -> DataFrame:
    """The eleven labelled counts of the quality report, in order."""
    blank = run.audit.agg(F.count("*").alias("rows_read"), F.count_if(prepare.BLANK).alias("blank_rows"))
    names = run.summary.columns + blank.columns
    both = run.summary.unionByName(blank, allowMissingColumns=True)
    totals = both.agg(*[F.max(name).alias(name) for name in names])
    labelled = [
        ("Rows read from the source", F.col("rows_read")),
        ("Blank rows dropped before validation", F.col("blank_rows")),
        ("Rows validated", F.col("total_rows")),
        ("Rows valid", F.col("valid_rows")),
        ("Rows rejected", F.col("rejected_rows")),
        ("Errors", F.col("errors")),
        ("Warnings", F.col("warnings")),
        ("Duplicate order ids found", F.col("duplicate_ids")),
        ("Revenue outliers flagged for review", F.col("outlier_rows")),
        ("Rows written to Clean_Data", F.col("valid_rows") - F.col("duplicate_rows")),
        ("Rows removed by cleaning", F.col("rejected_rows") + F.col("duplicate_rows")),
    ]
    entries = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(label).alias("metric"),
            value.cast("bigint").alias("value"),
        )
        for position, (label, value) in enumerate(labelled, start=1)
    ]
    return totals.select(F.inline(F.array(*entries)))


def partition_difference(run: QualityRun) -> DataFrame:
    """Rows that break ``valid + rejected = all``; always empty.

    All three read one written table of row numbers and flags; each row number is counted
    up for all rows and down for the parts.
    """
    if run.kept is None:
        flags = run.audit.select(SOURCE_ROW, prepare.BLANK, validate.REJECTED)
        run = replace(run, kept=stored(flags, "flags"))
    signed = [(run.checked, 1), (run.valid, -1), (run.rejected, -1)]
    rows = [part.select(SOURCE_ROW, F.lit(sign).alias("_sign")) for part, sign in signed]
    counted = reduce(DataFrame.unionByName, rows).groupBy(SOURCE_ROW).agg(F.sum("_sign").alias("_left"))
    broken = counted.where("_left <> 0")
    return broken.select(SOURCE_ROW, F.explode(F.sequence(F.lit(1), F.abs("_left"))).alias("_")).select(SOURCE_ROW)
