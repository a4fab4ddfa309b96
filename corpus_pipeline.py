"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all
but the last return the columns of ``documents``.  ``run`` writes every stage's result as
Parquet in the shared folder and reads it again for the next one.

* language: texts whose language cannot be told (null, or without a letter) go.
* line_dedup: fuzzy repeats of lines go from the texts; a text that had lines and lost all
  but blank ones goes.  ``n_chars`` follows the text.
* near_duplicates: of texts that are linked by similar word shingles, the one with the
  smallest id stays; rows that repeat id and text become one.
* decontaminate: texts that hold a benchmark item go.
* pack: the texts' token sequences, one row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.llm import decontaminate, jaccard_join, langid, line_dedup, packing
from tidyledger.llm.common import table
from tidyledger.llm.queries import tokenizer_files
from tidyledger.session import stored

KEY = "__key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = langid.identify(docs, langid.fit(docs, ~held_out))
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(docs)
    kept = kept.where("lines_dropped = 0 OR trim(BOTH ' \t\n\r' FROM text) <> ''")
    kept = kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    groups = stored(jaccard_join.jaccard_components(rows, id_column=KEY), "pipeline-groups")
    # The group's representative is the row with the smallest id, nulls last.
    ids = rows.select(F.col("doc_id").alias("id"), F.col(KEY).alias("doc_id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")
    firsts = groups.join(ids, "doc_id").groupBy("component_id").agg(F.min(order).alias("first"))
    kept = firsts.select(F.col("first.doc_id").alias(KEY))
    return rows.join(kept, KEY, "left_semi").dropDuplicates([KEY]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = stored(decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")), "pipeline-leaks")
    return _keyed(docs).join(found.select(F.col("key").alias(KEY)), KEY, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, *tokenizer_files())


STAGES = [
    ("language", language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: SQL cannot express these stages; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
