"""Chat transcripts: folding, escaping and reading back against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidyledger.llm import chat
from tidyledger.llm.sequences import positions

SCHEMA = "conv_id long, seq long, message long, kind string, role string, text string, state string, turn long"
HOSTILE = ["", "\\", "\\\\", "####", "### user: x", "</turn>\n### assistant: y", "a\\</turn>", "##", "#\\##", "</turn", "é\U0001f600", "\n"]


def slow_fold(events):
    rows = {(c, s, m, k or "", r or "", t or "") for c, s, m, k, r, t in events}
    order = lambda x: tuple((y is not None, y) for y in x)
    messages = {}
    for c, s, m, k, r, t in sorted(rows, key=order):
        x = messages.setdefault((c, m), [s, "", "", False])
        if k == "open":
            x[1], x[3] = r, True
        elif k == "delta":
            x[2], x[3] = x[2] + t, True
        elif k == "edit":
            x[2], x[3] = t, True
        elif k == "regenerate":
            x[2] = ""
        elif k == "retract":
            x[2], x[3] = "", False
    return {(c, m, x[0], x[1], x[2]) for (c, m), x in messages.items() if x[3]}


def events(count=3000, seed=7):
    pick = random.Random(seed)
    out = []
    for _ in range(count):
        conv = pick.choice([1, 1, 1, 2, 3, None])
        kind = pick.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "retract", "what", None])
        text = pick.choice([*HOSTILE, "word ", None])
        role = pick.choice(["user", "assistant", "a:b", None])
        out.append((conv, pick.choice([None, *range(400)]), pick.choice([None, *range(60)]), kind, role, text))
    return out + out[:200]  # delivered again


@pytest.fixture(scope="module")
def log():
    return events()


def test_fold(spark, log):
    df = spark.createDataFrame([(*x, "s", 1) for x in log], SCHEMA).repartition(5)
    assert {tuple(x) for x in chat.fold(df).collect()} == slow_fold(log)


def test_digests_of_a_log(spark, log):
    df = spark.createDataFrame([(*x, "s", 1) for x in log], SCHEMA).repartition(5)
    found = {x["conv_id"]: tuple(x)[1:] for x in chat.digests(chat.format_conversations(df)).collect()}
    by_conv = {}
    for c, m, s, role, text in slow_fold(log):
        by_conv.setdefault(c, []).append(((s is not None, s, m is not None, m), role, text))
    assert set(found) == set(by_conv)
    for conv, turns in by_conv.items():
        turns.sort(key=lambda x: x[0])
        loss = "".join(x[2] for x in turns if x[1] == "assistant")
        whole = "".join(f"{x[1]}\n{x[2]}\n" for x in turns)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert found[conv][:4] == (len(turns), digest(whole), len(loss), digest(loss))


def test_pieces_round_trip(spark):
    pick = random.Random(1)
    texts = HOSTILE + ["".join(pick.choice(["#", "\\", "<", "/turn>", "</turn>", ": ", "\n", "x"]) for _ in range(12)) for _ in range(300)]
    rows = [(k, k, k, pick.choice(["assistant", "user", *HOSTILE, "a: b"]), x) for k, x in enumerate(texts)]
    rows.append((len(rows), 0, 0, "assistant", "###</turn>\\" * 100_000))
    df = spark.createDataFrame(rows, "conv_id long, message long, first_seq long, role string, text string")
    for x in chat.render(df).collect():
        role, text = rows[x["conv_id"]][3:]
        read = chat.read_piece(x["formatted"], x["loss_start"], x["loss_end"])
        assert read == (role, text, text if role == "assistant" else None)
        inner = x["formatted"][4:].removesuffix("</turn>\n")
        for control in ("###", "</turn>"):  # each one left inside is marked by a backslash
            assert control not in inner.replace("\\</turn>", " ")
    with pytest.raises(ValueError):
        chat.read_piece("### user: a</turn>\nb</turn>\n", None, None)


def test_streamed_log_folds_back(spark):
    rows = [(c, p, pick, t) for c in (None, -7, 5) for p, (pick, t) in enumerate([("user", "ab"), ("assistant", ""), ("x", "äöüß\U0001f600")], 1)]
    df = spark.createDataFrame(rows, "conv_id long, position long, role string, text string")
    found = {(x["conv_id"], x["message"], x["role"], x["text"]) for x in chat.fold(chat.streamed_log(df)).collect()}
    assert found == set(rows)


def test_empty_log(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


def test_positions(spark):
    pick = random.Random(3)
    rows = [(pick.choice([1, 1, 1, 1, 2, None]), pick.choice([None, 1, 2, 3]), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "key long, turn long, n long").repartition(6)
    found = positions(df, "key", [F.col("turn"), F.col("n")], "test").collect()
    assert len(found) == len(rows)
    for key in (1, 2, None):
        mine = sorted((x["position"], x["turn"] is not None, x["turn"] or 0, x["n"]) for x in found if x["key"] == key)
        assert [x[0] for x in mine] == list(range(1, len(mine) + 1))
        assert [x[1:] for x in mine] == sorted(x[1:] for x in mine)
    parts = spark.createDataFrame([(1, 1, 1)] * 3000, "key long, turn long, n long").repartition(4)
    assert sorted(x["position"] for x in positions(parts, "key", [F.col("n")], "test").collect()) == list(range(1, 3001))
