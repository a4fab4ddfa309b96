import collections
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidyledger.operators import classify, facts, kpi, numbercheck, replies
from tidyledger.functions import texts
from tidyledger.schema import DataQualityError

random.seed(7)
STATUS = ["Completed", "Pending", "Cancelled", "Refunded"]
ROWS = [
    (f"2025-0{1 + i % 3}-0{1 + i % 9}", f"c{i % 7}", f"p{i % 11}", ["Electronics", "Apparel"][i % 2],
     1 + i % 5, (137 * i) % 1000 / 4, ["North", "South", "East"][i % 3], STATUS[(i * i) % 4])
    for i in range(200)
]


@pytest.fixture(scope="module")
def clean(spark):
    frame = spark.createDataFrame(
        ROWS, "d string, customer string, product string, category string, quantity bigint,"
        " price double, region string, status string")
    return frame.select(
        F.col("d").cast("timestamp_ntz").alias("date"), F.col("d").alias("order_id"), "customer",
        "product", "category", "quantity", F.col("price").cast("decimal(38,2)").alias("unit_price"),
        F.round(F.col("quantity") * F.col("price").cast("decimal(38,2)"), 2).cast("decimal(38,2)").alias("revenue"),
        "region", "status", F.left("d", F.lit(7)).alias("order_month")).persist()


def net(rows):
    return sum(r[4] * r[5] for r in rows if r[7] not in ("Cancelled", "Refunded"))


def test_overall(clean):
    row = kpi.kpi_overall(clean).first()
    assert row.order_count == 200 and row.distinct_customers == 7
    assert row.net_revenue == pytest.approx(net(ROWS))
    assert row.gross_revenue == pytest.approx(sum(r[4] * r[5] for r in ROWS))
    bearing = [r for r in ROWS if r[7] not in ("Cancelled", "Refunded")]
    assert row.revenue_orders == len(bearing)
    assert row.average_order_value == pytest.approx(net(ROWS) / len(bearing), abs=0.006)
    assert row.cancellation_rate_pct == pytest.approx(100 * (200 - len(bearing)) / 200, abs=0.06)


def test_empty_and_null_status(clean):
    empty = kpi.kpi_overall(clean.filter("false")).first()
    assert (empty.order_count, empty.net_revenue, empty.average_order_value) == (0, 0.0, 0.0)
    assert empty.period_start == ""
    unknown = kpi.kpi_overall(clean.withColumn("status", F.lit(None).cast("string"))).first()
    assert unknown.revenue_orders == 200


@pytest.mark.parametrize("name,position", [("product", 2), ("category", 3), ("region", 6)])
def test_dimensions(clean, name, position):
    rows = kpi.dimension_metrics(clean, name).collect()
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[r[position]].append(r)
    want = sorted(((-net(g), key) for key, g in groups.items()))
    assert [r.key for r in rows] == [key for _, key in want]
    assert sum(r.net_revenue for r in rows) == pytest.approx(net(ROWS))
    assert sum(r.revenue_share_pct for r in rows) == pytest.approx(100, abs=1)
    focus = kpi.dimension_focus(clean, name).first()
    assert (focus.best_key, focus.worst_key) == (rows[0].key, rows[-1].key)


def test_top_and_bottom(clean):
    ranked = [r.key for r in kpi.dimension_metrics(clean, "product").collect()]
    assert [r.key for r in kpi.top_products(clean, 3).orderBy("rank").collect()] == ranked[:3]
    assert [r.key for r in kpi.bottom_products(clean, 3).orderBy("rank").collect()] == ranked[:-4:-1]
    with pytest.raises(DataQualityError):
        kpi.top_products(clean, 0)


def test_periods(clean):
    latest = kpi.latest_periods(clean).first()
    assert (latest.current_period, latest.previous_period) == ("2025-03", "2025-02")
    assert latest.period_label == "2025-02 to 2025-03"
    change = {r.metric: r for r in kpi.compare_periods(clean).collect()}
    now, before = (net([r for r in ROWS if r[0].startswith(m)]) for m in ("2025-03", "2025-02"))
    assert change["net revenue"].change == pytest.approx(now - before, abs=0.01)
    assert change["net revenue"].change_pct == pytest.approx(100 * (now - before) / before, abs=0.06)
    one = clean.filter("order_month = '2025-01'")
    assert kpi.compare_periods(one).isEmpty()
    assert kpi.latest_periods(one).first().period_label == "2025-01"
    assert kpi.trend_change(clean).count() == 12
    assert sum(r.net_revenue for r in kpi.trend(clean).collect()) == pytest.approx(net(ROWS))


def test_zero_previous_value_has_no_percentage(clean):
    changed = clean.withColumn("revenue", F.when(F.col("order_month") == "2025-02", 0).otherwise(F.col("revenue")).cast("decimal(38,2)"))
    rows = {r.metric: r for r in kpi.compare_periods(changed).collect()}
    assert rows["net revenue"].change_pct is None


def test_guard(clean):
    assert kpi.analytics_available(clean) == (True, "ok")
    assert kpi.analytics_available(clean.drop("region"))[1] == "missing column(s): region"
    assert kpi.analytics_available(clean.drop("region").filter("false"))[1] == "no cleaned rows are available"
    assert kpi.analytics_available(clean, clean.filter("false")) == (False, "no cleaned rows are available")
    with pytest.raises(DataQualityError):
        kpi.analytics_guard(clean.filter("false"), 5)


def test_grouping_sets_equal_one_by_one(clean):
    rows = kpi.multi_dimension(clean, ["product", "region"]).collect()
    overall = kpi.kpi_overall(clean).first()
    found = {(r.dimension, r.key): r for r in rows}
    assert len(rows) == 1 + 11 + 3
    names = [name for name in kpi.kpi_overall(clean).columns if name != "label"]
    assert [found["overall", None][n] for n in names] == [overall[n] for n in names]
    for r in kpi.dimension_metrics(clean, "product").collect():
        one = found["product", r.key]
        assert (one.revenue_share_pct, one.average_order_value, one.net_revenue) == (
            r.revenue_share_pct, r.average_order_value, r.net_revenue)
        assert one.distinct_customers == clean.filter(F.col("product") == r.key).select("customer").distinct().count()


def test_sections_have_one_plan_for_every_budget(clean):
    def limits(budget):
        return facts.fact_sections(clean, "region", budget)._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number")

    assert limits(12_000) == limits(100_000)
    whole = facts.narrate(facts.facts_digest(clean, "region", 12_000)).orderBy("scope").collect()
    assert facts.narrate(facts.facts_digest(clean, "region", 700)).orderBy("scope").collect() == whole


HOSTILE = ["[" * 200_000, "see [" + "1" * 6000 + "] ok", 'x {"a": NaN} y', 'note: {"a": 1e400}', "1] junk",
           '{"a":1}] tail ["', '1, "end": 1} {"value": 2', '{"a": "\\ud800"}', None, "", "{}", 'say {"a": [1, {"b": 2}]} now', "[1,2,]"]


def test_hostile_replies(spark):
    frame = spark.createDataFrame(list(enumerate(HOSTILE)), "id int, reply string")
    rows = {r.id: r for r in replies.parse_model_json(frame, "reply").select("id", "parse_status", F.to_json("parsed").alias("v")).collect()}
    assert all((r.parse_status == "failed") == (r.v is None) for r in rows.values())
    status = [rows[k].parse_status for k in range(len(HOSTILE))]
    assert [status[k] for k in (0, 2, 4, 5, 8, 9, 10, 11, 12)] == [
        "failed", "failed", "failed", "embedded", "failed", "failed", "json", "embedded", "json"]
    assert rows[5].v == '{"a":1}' and rows[11].v == '{"a":[1,{"b":2}]}' and rows[6].parse_status == "failed"


def test_nested_content(spark):
    content = "bottom"
    for level in range(40):
        content = [{"content": content if level else [content]}, f"level {level}", {"type": "image"}, 5, ["ignored"]]
    payload = json.dumps({"choices": [{"message": {"content": content}}],
                          "usage": {"completion_tokens_details": {"reasoning_tokens": 7}}})
    row = replies.extract_chat_text(spark.createDataFrame([(payload,)], "p string"), "p").first()
    assert row.reply == "\n".join(["bottom", *[f"level {k}" for k in range(40)]])
    assert (row.outcome, row.reasoning_tokens) == ("ok", 7)


def test_keywords_take_the_first_rule(spark):
    texts_frame = spark.createDataFrame([(1, "The Cat, the dog"), (2, "dog"), (3, "nothing"), (4, " "), (5, None)], "id int, t string")
    rules = spark.createDataFrame([(2, "b", "cat"), (1, "a", "DOG"), (1, "c", "dog"), (3, "d", "one")], "rule int, category string, keyword string")
    rows = classify.classify_keywords(texts_frame, "t", rules).orderBy("id").collect()
    assert [(r.id, r.category, r.classification) for r in rows] == [
        (1, "a", "classified"), (2, "a", "classified"), (3, None, "unclassified")]


def test_keywords_do_not_take_texts_along_with_words(spark):
    texts_frame = spark.createDataFrame([(k, f"word{k % 3} " * 50) for k in range(9)], "id int, t string")
    rules = spark.createDataFrame([(2, "b", "WORD1"), (1, "a", "word1"), (3, "c", "word2")], "rule int, category string, keyword string")
    found = classify.classify_keywords(texts_frame, "t", rules).select("id", "category")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_word" in plan
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and all("hashpartitioning(__digest" in line for line in dealt)
    assert {r.id: r.category for r in found.collect()} == {k: (None, "a", "c")[k % 3] for k in range(9)}


def shrunk(digest, budget):
    """Pop entries one by one until the text fits, the slow way."""
    found = json.loads(digest)
    for section in facts.SECTIONS:
        while len(json.dumps(found, sort_keys=True)) > budget and found[section]:
            found[section].pop()
    return json.dumps(found, sort_keys=True)


@pytest.mark.parametrize("budget", [12000, 1900, 1500, 1100, 700, 100])
def test_digest_shrinks_like_one_by_one(clean, budget):
    whole = facts.facts_digest(clean, None, 12000).first().digest
    parsed = json.loads(whole)
    assert json.dumps(parsed, sort_keys=True) == whole
    assert parsed["order_count"] == 200 and len(parsed["top_products"]) == 11
    assert facts.facts_digest(clean, None, budget).first().digest == shrunk(whole, budget)


def test_digest_per_group_and_sentences(clean):
    digests = facts.facts_digest(clean, "region").persist()
    assert {r.scope for r in digests.collect()} == {"North", "South", "East"}
    told = {r.scope: r for r in facts.narrate(digests).collect()}
    assert told["North"].executive_summary.startswith("Over 2025-01 the business")  # one month each
    assert facts.metrics_supplied(digests).count() == 27
    insights = facts.interpret(digests).collect()
    assert {r.status for r in insights} == {"generated"}


def test_interpret_failures(clean):
    digests = facts.facts_digest(clean)
    prose = facts.interpret(digests, lambda text: "no json at all").first()
    assert prose.status == "failed" and "not valid JSON" in prose.status_detail
    wrong = facts.interpret(digests, lambda text: "[1]").first()
    assert wrong.status_detail == "the interpretation response must be a JSON object"

    def broken(text):
        raise RuntimeError("unreachable")

    assert facts.interpret(digests, broken).first().status_detail == "RuntimeError: unreachable"
    assert facts.interpret(digests, enabled=False).first().status == "skipped"


PROSE = ["Revenue hit 999999.99, up 12.5% from 1,234.50 in 2025.", "none", "v1.2 a5 -3.75 50%20 1,2,3",
         "５５.5 x_9 é7 (1000) 5,-3.5 $2,000,000", "5%-3.25 1999 2101 1e5"]


def test_numbers_match_python(spark):
    frame = spark.createDataFrame(list(enumerate(PROSE)), "id int, text string")
    rows = numbercheck.numbers_in(frame, "id", "text").orderBy("id", "position").collect()
    pattern = re.compile(r"(?<![\w.])-?\d[\d,]*(?:\.\d+)?%?")
    want = [(i, m) for i, text in enumerate(PROSE) for m in pattern.findall(text)]
    assert [(r.id, r.token) for r in rows] == want


def test_unmatched_numbers_against_brute_force(spark):
    rng = random.Random(3)
    known = [rng.uniform(-5, 5) for _ in range(40)] + [rng.uniform(1, 1e7) for _ in range(40)] + [0.0]
    values = [v * (1 + rng.uniform(-0.01, 0.01)) + rng.uniform(-0.02, 0.02) for v in known for _ in range(20)]
    values += [1950.0, 5.0, -12.0, 2500.0]
    def loose(v):
        if v == int(v) and (1900 <= v <= 2100 or abs(v) < 1000):
            return False
        return not any(abs(v - c) <= max(0.01, 0.005 * abs(c)) for k in known for c in (k, abs(k)))
    numbers = spark.createDataFrame([(i, 1, str(v), v) for i, v in enumerate(values)], "id int, position int, token string, value double")
    facts_frame = spark.createDataFrame([(v,) for v in known], "value double")
    found = numbercheck.unmatched_numbers(numbers, facts_frame, "value")
    assert sorted(r.id for r in found.collect()) == [i for i, v in enumerate(values) if loose(v)]


def packed(text, size):
    text = text.strip()
    if not text:
        return []
    if len(text) <= size:
        return [text]
    chunks, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > size:
            chunks.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return chunks + [line]


def test_chunks_against_brute_force(spark):
    rng = random.Random(5)
    samples = ["", "  ", "short  text ", "x" * 30, "a " + "b" * 25 + " c"]
    samples += [" ".join("é" * rng.randint(1, 14) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(samples)), "id int, text string")
    rows = frame.select("id", texts.chunk_text(F.col("text"), 20).alias("c")).orderBy("id").collect()
    assert [r.c for r in rows] == [packed(text, 20) for text in samples]


def test_redaction(spark):
    samples = ["Authorization: Bearer abc.def-123 end", "bearer   xyz", "key sk-abcdef123. next", "task-sk-1", "asksk-abcdefgh", "my-token and sk-aaaaaa-"]
    def masked(text):
        text = text.replace("my-token", "***")
        text = re.sub(r"(?i)bearer\s+[A-Za-z0-9._\-]{4,}", "Bearer ***", text)
        return re.sub(r"\bsk-[A-Za-z0-9._\-]{6,}\b", "***", text)
    frame = spark.createDataFrame(list(enumerate(samples)), "id int, text string")
    rows = frame.select("id", texts.redact_credentials(F.col("text"), ("my-token",)).alias("t")).orderBy("id").collect()
    assert [r.t for r in rows] == [masked(text) for text in samples]


def test_classification(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(["good", "bad", " ", None, "boom", "odd"])], "id int, text string")

    def label(batch):
        if "boom" in batch:
            raise ValueError("no answer")
        return [{"good": "positive", "bad": "negative"}.get(text, "???") for text in batch]

    rows = {r.id: r for r in classify.classify_text(frame, "text", label, batch_size=1).collect()}
    assert sorted(rows) == [0, 1, 4, 5]
    assert (rows[0].category, rows[1].category, rows[4].category, rows[5].category) == ("positive", "negative", None, None)
    assert rows[4].classification == "failed" and rows[4].error == "ValueError: no answer"
    done = classify.classify_text(frame, "text", label, batch_size=1)
    assert classify.classification_status(done).first().status == "failed"
    counts = {r.category: r for r in classify.classification_summary(done).collect()}
    assert counts["positive"].share_pct == 50.0


def test_model_json(spark):
    samples = ['{"a": 1}', '```json\n{"a": 1}\n```', 'Sure!\n```json\n{"a": "up"}\n```\n', '[{"i": 0},]', 'result: {"a": [1, 2,],}',
               "null", "5 apples", "", '{"a": 1} {"b": 2}', "42", "The text is private 12345", "1], [2"]
    frame = spark.createDataFrame(list(enumerate(samples)), "id int, reply string")
    rows = replies.parse_model_json(frame, "reply").withColumn("parsed", F.to_json("parsed")).orderBy("id").collect()
    assert [None if r.parsed is None else json.loads(r.parsed) for r in rows] == [
        {"a": 1}, {"a": 1}, {"a": "up"}, [{"i": 0}], {"a": [1, 2]}, None, None, None, {"a": 1}, 42, None, rows[11].parsed and json.loads(rows[11].parsed)]
    assert rows[10].parse_detail == "the AI response is not valid JSON (25 char(s) starting with letter)"
    assert rows[7].parse_detail == "the AI response is not valid JSON (empty response)"


def test_chat_payloads(spark):
    samples = ['{"choices":[{"message":{"content":"hi"},"finish_reason":"stop"}],"usage":{"prompt_tokens":5}}',
               '{"choices":[{"message":{"content":[{"type":"text","text":"a"},"b",{"content":["c",{"value":"d"}]},{"type":"image"}]}}]}',
               '{"error":{"message":"bad","code":404}}', '{"choices":[]}', '{"choices":[5]}', '{"choices":[{"index":0}]}',
               '{"choices":[{"message":{"content":null,"reasoning":"x"},"finish_reason":"stop"}]}', "[1]", "<html>", '{"choices":[{"message":{"content":"  "},"finish_reason":"length"}]}']
    frame = spark.createDataFrame(list(enumerate(samples)), "id int, body string")
    rows = replies.extract_chat_text(frame, "body").orderBy("id").collect()
    assert [r.outcome for r in rows] == ["ok", "ok", "provider_error", "no_choices", "malformed_choice", "no_message", "empty", "not_object", "not_json", "empty"]
    assert rows[0].reply == "hi" and rows[0].prompt_tokens == 5
    assert rows[1].reply == "a\nb\nc\nd"
    assert rows[2].detail == "bad | code=404"
    assert rows[6].detail == "the model returned only reasoning tokens"


def test_replies_by_index():
    read = classify.read_reply
    assert read(["a", None, "c", "d"], 3) == ["a", None, "c"]
    assert read([], 2) == [None, None]
    assert read([{"index": 1, "category": "b"}, {"index": 0, "category": "a"}], 3) == ["a", "b", None]
    assert read([(2, "c"), (2, "d"), (7, "x"), (-1, "y"), ("0", "a")], 3) == ["a", None, "d"]
    assert read([{"index": 0}, {"category": "a"}, {"index": "x", "category": "a"}, "loose", 5, None, ()], 2) == [None, None]
    assert read('Here: [{"index": 1, "category": "b"}] done', 2) == [None, "b"]
    assert read([{"index": float("inf"), "category": "a"}, {"index": 1.0, "category": 3}], 2) == [None, "3"]
    for broken in ("no list", {"index": 0}, None, 5):
        with pytest.raises(TypeError):
            read(broken, 2)


def test_broken_replies_fail_their_batch(spark):
    frame = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "empty")], "id int, text string").coalesce(1)
    replies = {"good": [{"index": 0, "category": "positive"}], "bad": {"index": 0}, "empty": "[]"}
    found = classify.classify_text(frame, "text", lambda batch: replies[batch[0]], batch_size=1).collect()
    assert {r.id: (r.category, r.classification) for r in found} == {
        1: ("positive", "classified"), 2: (None, "failed"), 3: (None, "unclassified")
    }
    assert "TypeError" in next(r.error for r in found if r.id == 2)


def test_skipped_classification(spark):
    frame = spark.createDataFrame([(1, " "), (2, None)], "id int, text string")
    for column, enabled, word in (("text", False, "switched off"), ("review", True, "review"), ("text", True, "text")):
        found, reason = classify.classify_or_skip(frame, column, None, enabled)
        assert found is None and word in reason
    found, reason = classify.classify_or_skip(spark.createDataFrame([(1, "x")], "id int, text string"), "text")
    assert reason is None and found.count() == 1


def test_rows_that_share_an_id_keep_their_own_results(spark):
    rows = [(1, "good thing"), (1, "an idiot"), (None, "an idiot"), (None, "fine"), (1, "good thing")]
    frame = spark.createDataFrame(rows, "id int, t string")
    rules = spark.createDataFrame([(1, "complaint", "idiot")], "rule int, category string, keyword string")
    found = sorted(((r.id or 0, r.t, r.category or "") for r in classify.classify_keywords(frame, "t", rules).collect()))
    assert found == [(0, "an idiot", "complaint"), (0, "fine", ""), (1, "an idiot", "complaint"),
                     (1, "good thing", ""), (1, "good thing", "")]
    texts = spark.createDataFrame([(1, "made 5,000.25 and 7,000.5"), (1, "made 7,000.5"), (None, "made 9,000.75")], "id int, t string")
    facts = spark.createDataFrame([(5000.25,)], "value double")
    found = numbercheck.verify_numbers(texts, "id", "t", facts, "value").collect()
    assert sorted((r.id or 0, r.rank, r.value) for r in found) == [(0, 1, 9000.75), (1, 1, 7000.5), (1, 1, 7000.5)]


def test_grouping_sets_expand_once(spark):
    from tidyledger.plans.queries import QUERIES

    frame = QUERIES["kpi_grouping_sets"](spark, "/root/testdata/sf0.001")
    assert "Expand" not in frame._jdf.queryExecution().executedPlan().toString()  # the sets are written once
