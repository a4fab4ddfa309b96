"""The stages of the corpus pipeline on a small corpus, each against what it has to do."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "line_dedup", "near_duplicates", "decontaminate", "pack"]
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in driver.queries()}
    assert driver.queries()["pipeline"] is corpus_pipeline.run


def documents(spark):
    words = [f"w{k}" for k in range(4000)]
    say = lambda a, n: " ".join(words[a : a + n])
    rows = [
        (1, say(0, 60), "en", "s", 0),
        (2, say(0, 60), "en", "s", 0),  # an exact copy
        (3, say(100, 50) + "\n" + say(200, 50), "en", "s", 0),
        (4, say(100, 50).replace("w120", "other") + "\n" + say(300, 50), "en", "s", 0),  # shares a fuzzy line
        (5, say(400, 30) + "\n" + say(440, 4), "en", "s", 0),
        (6, "12 34", "en", "s", 0),
        (7, None, "en", "s", 0),
        (8, "", None, None, None),
        (9, "Short line\nShort line", "en", "s", 0),
        (None, say(500, 40), None, "s", 0),
        (10, say(600, 70), "en", "s", 0),
        (10, say(600, 70), "en", "s", 0),  # a repeated row
        (11, " ".join(f"{a} {b}" for a, b in zip(words[700:730], words[800:830])), "en", "s", 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def benchmark_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bench"))
    item = " ".join(f"w{k}" for k in range(405, 425))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, benchmark_folder):
    docs = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    one = stages["language"](spark, docs, benchmark_folder)
    assert one.columns == docs.columns
    assert ids(one) == sorted(["1", "2", "3", "4", "5", "9", "None", "10", "10", "11"])
    two = stages["line_dedup"](spark, one, benchmark_folder)
    assert two.columns == docs.columns
    texts = {str(r["doc_id"]): r for r in two.collect()}
    assert "2" not in texts and texts["4"]["text"].startswith("w300") and "\n" not in texts["4"]["text"]
    assert texts["4"]["n_chars"] == len(texts["4"]["text"]) and texts["9"]["text"] == "Short line\nShort line"
    assert two.filter("doc_id = 10").count() == 2  # equal rows count as one here
    three = stages["near_duplicates"](spark, two, benchmark_folder)
    assert three.columns == docs.columns
    assert ids(three) == sorted(["1", "3", "4", "5", "9", "None", "10", "11"])
    four = stages["decontaminate"](spark, three, benchmark_folder)
    assert four.columns == docs.columns
    assert ids(four) == sorted(["1", "3", "4", "9", "None", "10", "11"])
    pieces = stages["pack"](spark, four, benchmark_folder)
    assert ids(pieces) == ids(four)
    near = stages["near_duplicates"](spark, one, benchmark_folder)
    assert ids(near) == sorted(["1", "3", "4", "5", "9", "None", "10", "11"])


def test_stages_of_an_empty_table(spark, benchmark_folder):
    docs = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, benchmark_folder)
    assert docs.count() == 0


def test_run_on_documents(spark):
    found = corpus_pipeline.run(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert 0 < found.select("doc_id").distinct().count() < docs.count()
    filled = found.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert filled.filter("n > 2048").isEmpty()


@pytest.mark.parametrize("name,table", [("op6_warc", "pages"), ("op10_exact_dedup", "documents")])
def test_queries_equal_sql(spark, name, table):
    frame = driver.queries()[name](spark, SMALL)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    cursor = connection.execute(driver.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(cursor.fetchall(), key=str) == sorted((tuple(r) for r in frame.select(columns).collect()), key=str)
