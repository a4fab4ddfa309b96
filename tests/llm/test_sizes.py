"""What steps send, hold and start, so that none of it grows faster than the input."""

from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidyledger.llm import jaccard_join, katz, line_dedup, packing
from tidyledger.llm.filters import membership
from tidyledger.session import stored


def test_segments_are_small(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 400)) for _ in range(40)]
    docs = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1)
    # Nearly every n-gram is a segment of its own.
    rows = jaccard_join._fragments(docs, 1 << 13, 5).collect()
    grams = sum(len(x["grams"]) for x in rows) // 6
    assert grams > 40 * 390
    assert sum(len(x["segments"]) for x in rows) < 14 * grams


def test_segments_are_read_back():
    segments = np.zeros(3, jaccard_join._SEGMENT)
    segments["class"], segments["n"], segments["size"] = [5, -7, 2**62], [9, 0, 70000], [1, 255, 3]
    large = segments.copy()
    large["size"][1] = 70000
    sent = pa.chunked_array([[jaccard_join._packed(x) for x in (segments, segments[:0], large)]], pa.binary())
    assert jaccard_join._segments(sent).tolist() == [*segments.tolist(), *large.tolist()]


def test_membership_is_fetched_in_one_job(spark):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {name: spark.conf.get(name) for name in settings}
    context = spark.sparkContext
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        context.setJobGroup("membership", "membership")
        known = membership(spark.range(1000).select("id"))
        jobs = context.statusTracker().getJobIdsForGroup("membership")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for name, value in before.items():
            spark.conf.set(name, value)
    assert known.match(np.arange(1000, dtype=np.uint64)).all()
    assert 0 < len(jobs) < 20


def test_candidates_come_with_the_least_of_their_key(spark):
    rows = [(7, 3, 1, 1, 100), (7, 2, 1, 1, 100), (7, 1, 2**62, 2**61 + 7, 10), (8, 9, 4, 4, 50), (9, 5, 6, 6, 70), (9, 6, 6, 6, 70)]
    met = spark.createDataFrame(rows, "meet long, node long, low long, high long, size int")
    found = line_dedup._with_candidate(met, 0.85)
    assert sorted(map(tuple, found.select("node", "root").collect())) == [(2, 2), (3, 2), (5, 5), (6, 5)]


def test_links_of_a_part_are_merged_early(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in np.random.default_rng(7).integers(0, 100, 20_000))
    docs = spark.createDataFrame([(1, text)], "id long, text string").withColumn("learn", F.lit(True))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    batches = katz._pairs(docs, 1, none[0], none[1]).toArrow().to_batches()
    words = katz.Words(20_001, 101, [1, 0, 0, 0, 0, 0], 1, none)
    held, merged = [], katz._merged

    def watched(links):
        held.append(len(links))
        return merged(links)

    monkeypatch.setattr(katz, "_merged", watched)
    rows = [x for batch in katz._count_pairs(words, 1, 1, 200)(iter(batches)) for x in batch.to_pylist()]
    links = np.concatenate([katz._unpacked(pa.py_buffer(x["records"]), katz._LINK) for x in rows if x["kind"] in ("link", "hot")])
    assert len(links) == 101
    assert links["large"].sum() + (links["types"] * np.arange(1, 6)).sum() == 20_001
    # A context comes with nearly every step; it is not held once for each.
    assert max(held) < 1500


def test_records_go_in_bounded_rows():
    links = np.zeros(50_000, katz._LINK)
    links["context"] = np.arange(50_000)
    rows = katz._bucketed("link", links, np.zeros(50_000, np.uint64), 3)
    assert max(len(x) for _, _, x in rows) <= katz.ROW_BYTES
    back = np.concatenate([katz._unpacked(pa.py_buffer(x), katz._LINK) for _, _, x in rows])
    assert (back == links).all()


def test_unseen_pairs_wait_for_links_in_any_order():
    rng = np.random.default_rng(11)
    links, opened = np.zeros(400, katz._LINK), np.zeros(900, katz._OPEN)
    links["context"], links["lower"] = rng.integers(0, 90, 400), rng.random(400) / 1000
    links["types"] = rng.integers(0, 3, (400, katz.DISCOUNTED)) + 1
    opened["key"], opened["context"] = rng.integers(-20, 20, 900), rng.integers(0, 120, 900)
    discount = np.array([1, 0.4, 0.6, 0.7, 0.8, 0.9])
    merged = katz._merged(links)
    weight = dict(zip(merged["context"].tolist(), katz.backoff(merged, discount).tolist(), strict=True))
    want = {}
    for key, context in opened.tolist():
        want[key] = want.get(key, 0.0) + weight.get(context, 0.0)
    rows = [("open", opened[k : k + 90]) for k in range(0, 900, 90)] + [("link", links[k : k + 40]) for k in range(0, 400, 40)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([0]), pa.array([katz._packed(x)])], names=["kind", "bucket", "records"])
        for kind, x in (rows[k] for k in rng.permutation(len(rows)))
    ]
    for step in (1, 100, 10**6):
        run = katz._back_off(discount, np.zeros(0, katz._LINK), 4, step)
        sent = [x for batch in run(iter(batches)) for x in batch.to_pylist()]
        found = np.concatenate([katz._unpacked(pa.py_buffer(x["records"]), katz._ADD) for x in sent])
        assert len(found) == len(want) and {x["bucket"] for x in sent} <= set(range(4))
        for key, total in found.tolist():
            assert abs(total - want[key]) < 1e-9


def test_row_groups_are_bounded(spark):
    rows = spark.range(0, 600, 1, 1).selectExpr("id", "repeat(sha2(string(id), 512), 500) AS records")
    table = stored(rows, "row-groups", row_group=1 << 20)
    footers = [pq.ParquetFile(unquote(urlparse(x).path)) for x in table.inputFiles()]
    # 64 kB a row: the writer looks at its buffer now and then, after 100 rows at the earliest.
    assert max(x.metadata.row_group(k).num_rows for x in footers for k in range(x.num_row_groups)) < 300
    assert table.count() == 600 and table.selectExpr("sum(length(records)) AS n").first()["n"] == 600 * 64000


def test_chunks_of_texts_count_bytes():
    texts = ["\u4e16" * 40, None, "", "a" * 90, "b" * 500, "\u4e16" * 20, None, "c"]
    part = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["id", "text"])
    chunks = list(packing._chunks(part.slice(1), 150)) + list(packing._chunks(part, 150))
    assert all(sum(len(x.encode()) for x in found) <= 150 or len(found) == 1 for _, found in chunks)
    assert [x for docs, _ in chunks for x in docs] == [*range(1, 8), *range(8)]
    assert [x for _, found in chunks for x in found] == [x or "" for x in texts[1:] + texts]
    assert len(list(packing._chunks(part.slice(0, 0)))) == 0
