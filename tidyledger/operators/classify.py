"""Classification of free text by an injected function, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.functions.cells import is_blank
from tidyledger.functions.json_scan import first_json
from tidyledger.functions.numbers import share
from tidyledger.session import stored

# Default categories and batch size.
CATEGORIES = (
    "positive",
    "negative",
    "neutral",
    "complaint",
    "product_feedback",
    "delivery_feedback",
)
BATCH_SIZE = 20
CLASSIFIED, UNCLASSIFIED, FAILED = "classified", "unclassified", "failed"
SKIPPED, GENERATED = "skipped", "generated"

#: Gets a batch of texts; replies with a label for each, in order, or with entries
#: ``{"index": place, "category": label}`` (or pairs), or with such a list as JSON text.
Labeller = Callable[[list[str]], Any]


def read_reply(reply: Any, count: int) -> list[str | None]:
    """One label (or None) for each of ``count`` texts.

    Entries with an index may come in any order; of several for one index the last counts,
    missing, foreign and broken ones leave their text without a label.  Labels without an
    index are taken in order.  A reply that is no list is an error.
    """
    if isinstance(reply, (str, bytes)):
        found = first_json(reply if isinstance(reply, str) else reply.decode())
        reply = json.loads(found) if found is not None else None
    if not isinstance(reply, (list, tuple)):
        raise TypeError("a classification reply must be a list")
    labels: list[str | None] = [None] * count
    indexed = any(isinstance(entry, (dict, list, tuple)) for entry in reply)
    for place, entry in enumerate(reply):
        if isinstance(entry, dict):
            place, entry = entry.get("index"), entry.get("category")
        elif isinstance(entry, (list, tuple)):
            place, entry = entry if len(entry) == 2 else (None, None)
        elif indexed:
            continue
        try:
            place = int(place)
        except (TypeError, ValueError, OverflowError):
            continue
        if 0 <= place < count and entry is not None:
            labels[place] = str(entry)
    return labels


def skip_reason(df: DataFrame, column: str, enabled: bool = True) -> str | None:
    """Why there is nothing to classify, or None; reads at most one row."""
    if not enabled:
        return "classification is switched off"
    if column not in df.columns:
        return f"text column {column!r} is not among the cleaned columns"
    if df.filter(~is_blank(F.col(column))).select(column).isEmpty():
        return f"no value of {column!r} to classify"
    return None


def classify_or_skip(
    df: DataFrame, column: str, fn: Labeller | None = None, enabled: bool = True, **options: Any
) -> tuple[DataFrame | None, str | None]:
    """``(classified rows, None)`` or ``(None, reason)``; ``options`` as for :func:`classify_text`."""
    reason = skip_reason(df, column, enabled)
    return (None, reason) if reason else (classify_text(df, column, fn, **options), None)


def classify_text(
    df: DataFrame,
    column: str,
    fn: Labeller | None = None,
    categories: tuple[str, ...] = CATEGORIES,
    batch_size: int = BATCH_SIZE,
    max_chars: int | None = None,
) -> DataFrame:
    """Add ``category`` and ``classification`` to every row with a non-blank text.

    ``fn`` gets up to ``batch_size`` texts and replies as in :func:`read_reply`; only the
    text travels to Python, the other columns stay in the JVM.  Labels outside
    ``categories`` are ``unclassified``; when ``fn`` raises, the rows of that
    batch are ``failed`` and all others keep their result.  ``max_chars`` limits
    what ``fn`` sees (a model's input budget); by default it sees whole texts.
    Without ``fn`` every text gets the first category.
    """
    texts = df.filter(~is_blank(F.col(column)))
    if fn is None:
        label = F.lit(categories[0] if categories else None).cast("string")
        return texts.withColumn("category", label).withColumn(
            "classification", F.when(label.isNotNull(), CLASSIFIED).otherwise(UNCLASSIFIED)
        )

    @F.pandas_udf("label string, error string")
    def label_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labels: list[str | None] = []
            errors: list[str | None] = []
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size].tolist()
                try:
                    found, failure = read_reply(fn(part), len(part)), None
                except Exception as error:  # noqa: BLE001 - a failed batch is a result
                    found, failure = [None] * len(part), f"{type(error).__name__}: {error}"
                labels += found
                errors += [failure] * len(part)
            yield pd.DataFrame({"label": labels, "error": errors}, dtype=object)

    # A labeller may be remote or random: Spark must not repeat a call to evaluate a filter.
    label_batches = label_batches.asNondeterministic()
    text = F.col(column) if max_chars is None else F.left(F.col(column), F.lit(max_chars))
    labelled = texts.withColumn("_label", label_batches(text))
    allowed = F.col("_label.label").isin(*categories)
    return (
        labelled.withColumn("category", F.when(allowed, F.col("_label.label")))
        .withColumn(
            "classification",
            F.when(F.col("_label.error").isNotNull(), FAILED)
            .when(allowed, CLASSIFIED)
            .otherwise(UNCLASSIFIED),
        )
        .withColumn("error", F.col("_label.error"))
        .drop("_label")
    )


WORD = r"[\p{L}\p{N}_]+"


def classify_keywords(texts: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """Category of every non-blank text by a table of rules ``(rule, category, keyword)``.

    The distinct words of a text (lower case) are joined with the keywords by equality; of
    all rules that apply the one with the smallest number counts.  Texts without any
    keyword are ``unclassified``.  A category belongs to the text, whatever ids its rows have.
    Words carry a digest of their text instead of the text, and the rules are written first,
    so that Spark knows their size: it broadcasts few of them and splits frequent words otherwise.
    """
    rows = texts.filter(~is_blank(F.col(column))).withColumn(
        "__digest", F.unhex(F.sha2(F.col(column).cast("string"), 256))
    )
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(column)), F.lit(WORD), F.lit(0)))
    said = rows.select("__digest", F.explode(words).alias("_word"))
    table = rules.groupBy(F.lower("keyword").alias("_word")).agg(F.min(F.struct("rule", "category")).alias("_rule"))
    table = stored(table, "rules")
    first = said.join(table, "_word").groupBy("__digest").agg(F.min("_rule").alias("_first"))
    return rows.join(first, "__digest", "left").select(
        *texts.columns,
        F.col("_first.category").alias("category"),
        F.when(F.col("_first").isNotNull(), CLASSIFIED).otherwise(UNCLASSIFIED).alias("classification"),
    )


def classification_summary(classified: DataFrame) -> DataFrame:
    """Rows per category with their share; unusable labels and failures as own lines."""
    counts = classified.groupBy("classification", "category").agg(F.count("*").alias("records"))
    total = counts.agg(
        F.sum(F.when(F.col("classification") == CLASSIFIED, F.col("records"))).alias("total"),
    ).scalar()
    done = F.col("classification") == CLASSIFIED
    return counts.select(
        "classification",
        "category",
        "records",
        F.when(done, share(F.col("records"), total)).alias("share_pct"),
    ).orderBy("classification", F.desc("records"), "category")


def classification_status(classified: DataFrame) -> DataFrame:
    """One row: did the run succeed, fail somewhere, or have nothing to do?"""
    return classified.agg(
        F.count("*").alias("texts"),
        F.count_if(F.col("classification") == CLASSIFIED).alias("classified"),
        F.count_if(F.col("classification") == UNCLASSIFIED).alias("unclassified"),
        F.count_if(F.col("classification") == FAILED).alias("failed"),
    ).select(
        F.when(F.col("texts") == 0, SKIPPED)
        .when(F.col("failed") > 0, FAILED)
        .otherwise(GENERATED)
        .alias("status"),
        "texts",
        "classified",
        "unclassified",
        "failed",
    )
