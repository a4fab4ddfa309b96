"""Chat transcripts from event logs: fold, render with a loss mask, read back.

A log has one row per event ``(conv_id, seq, message, kind, role, text)``:

* ``open`` gives the message its role (the last one counts);
* ``delta`` adds text to it;
* ``edit`` replaces its text;
* ``regenerate`` empties it, what follows is written anew;
* ``retract`` takes it back, a later ``open``, ``delta`` or ``edit`` brings it back empty.

Events of a message are folded in the order of ``seq`` (null first, then kind, role, text).  Logs are
delivered at least once, so events equal in all columns count once.  Other kinds do nothing
but name the message.  A message stands where its first event stands.  Null texts and
roles are empty, a null conversation id is a conversation, a null message is a message;
further columns are not looked at; an empty log has no conversation.

The log is dealt out by conversation and message, so a conversation with a third of all
events is folded in many tasks; a task holds the text of one message.  Rendering goes
message by message.  A message becomes ``### role: text</turn>`` and a line break; runs of
three or more ``#``, ``</turn>`` and backslashes inside texts (in roles colons as well) get
backslashes before their characters, which reading takes away.  The loss mask is a span of
code points over an assistant's escaped text.

Digests over a whole conversation are sequential: its pieces stream through one task, in
order, which keeps the two hash states and one Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import thrifty
from tidyledger.session import stored

EVENT = ["conv_id", "seq", "message", "kind", "role", "text"]
ASSISTANT = "assistant"

# In Java's notation: characters of control strings, each of which gets a backslash.
_CONTROL = r"\\|#(?=##)|(?<=#)#(?=#)|(?<=##)#|<(?=/turn>)"
_PIECE = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def fold(events: DataFrame) -> DataFrame:
    """``(conv_id, message, first_seq, role, text)`` of every message that is not taken back."""
    log = events.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("seq").cast("long").alias("seq"),
        F.col("message").cast("long").alias("message"),
        F.coalesce(F.col("kind").cast("string"), F.lit("")).alias("kind"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    log = log.repartition(tasks, "conv_id", "message").sortWithinPartitions(
        "conv_id", "message", "seq", "kind", "role", "text"
    )
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("message", pa.int64()),
            ("first_seq", pa.int64()),
            ("role", pa.large_string()),
            ("text", pa.large_string()),
        ]
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, first, role, pieces, there = None, None, None, "", [], False
        for part in parts:
            out: list[tuple] = []
            for event in zip(*(part.column(x).to_pylist() for x in EVENT), strict=True):
                conv, seq, message, kind, new_role, text = event
                if (conv, message) != at or last is None:
                    if there:
                        out.append((*at, first, role, "".join(pieces)))
                    at, first, role, pieces, there = (conv, message), seq, "", [], False
                elif event == last:
                    continue
                last = event
                if kind == "open":
                    role, there = new_role, True
                elif kind == "delta":
                    pieces.append(text)
                    there = True
                elif kind == "edit":
                    pieces, there = [text], True
                elif kind == "regenerate":
                    pieces = []
                elif kind == "retract":
                    pieces, there = [], False
            if out:
                yield _batch(out, schema)
        if there:
            yield _batch([(*at, first, role, "".join(pieces))], schema)

    return log.mapInArrow(thrifty(run), "conv_id long, message long, first_seq long, role string, text string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _escaped(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, F.lit(_CONTROL + more), F.lit(r"\\$0"))


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, message, first_seq, formatted, loss_start, loss_end)``: one piece for each message.

    A conversation's output is its pieces in the order of ``first_seq`` and ``message``.
    The mask counts code points of the piece and is null for other roles.
    """
    head = F.concat(F.lit("### "), _escaped(F.col("role"), "|:"), F.lit(": "))
    parts = messages.select(
        "conv_id", "message", "first_seq", "role", head.alias("head"), _escaped(F.col("text")).alias("body")
    )
    masked, start = F.col("role") == ASSISTANT, F.length("head").cast("long")
    return parts.select(
        "conv_id",
        "message",
        "first_seq",
        F.concat("head", "body", F.lit("</turn>\n")).alias("formatted"),
        F.when(masked, start).alias("loss_start"),
        F.when(masked, start + F.length("body")).alias("loss_end"),
    )


def read_piece(formatted: str, start: int | None, end: int | None) -> tuple[str, str, str | None]:
    """(role, text, text under the loss mask) of one piece."""
    found = _PIECE.fullmatch(formatted)
    if not found:
        raise ValueError("not a rendered message")
    masked = None if start is None else _ESCAPED.sub(r"\1", formatted[start:end])
    return _ESCAPED.sub(r"\1", found[1]), _ESCAPED.sub(r"\1", found[2]), masked


def digests(pieces: DataFrame) -> DataFrame:
    """Read rendered pieces back: turns, loss text and sizes of every conversation.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``; the
    digests are of role, line break, text, line break of each turn, and of all text under
    the mask.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            formatted = part.column("formatted").to_pylist()
            spans = zip(part.column("loss_start").to_pylist(), part.column("loss_end").to_pylist(), strict=True)
            found = [read_piece(x, *span) for x, span in zip(formatted, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("conv_id"),
                    part.column("message"),
                    part.column("first_seq"),
                    pa.array([f"{role}\n{text}\n" for role, text, _ in found], pa.large_string()),
                    pa.array([x[2] for x in found], pa.large_string()),
                    pa.array([len(x) for x in formatted], pa.int64()),
                ],
                names=["conv_id", "message", "first_seq", "turn", "loss", "chars"],
            )

    turns = pieces.mapInArrow(
        thrifty(read), "conv_id long, message long, first_seq long, turn string, loss string, chars long"
    )
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turns.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "first_seq", "message")
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None  # conversation, turns, their hash, loss characters, their hash, characters

        def line(x: list) -> tuple:
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

        for part in parts:
            out = []
            for conv, turn, loss, chars in zip(
                *(part.column(x).to_pylist() for x in ("conv_id", "turn", "loss", "chars")), strict=True
            ):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(line(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(turn.encode())
                if loss is not None:
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += chars
            if out:
                yield _batch(out, schema)
        if state is not None:
            yield _batch([line(state)], schema)

    return turns.mapInArrow(
        thrifty(digest),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def streamed_log(messages: DataFrame) -> DataFrame:
    """An event log that folds to ``messages`` ``(conv_id, position, role, text)``, as a chat service would write it.

    By turns a message is streamed in three deltas, regenerated after a first attempt, or edited after a draft.
    """
    size, text = F.length("text"), F.col("text")
    cut = [F.floor(size * k / 3).cast("int") for k in range(4)]
    deltas = [("delta", F.substring(text, cut[k] + 1, cut[k + 1] - cut[k])) for k in range(3)]
    draft = F.reverse(text)
    ways = [
        deltas,
        [("delta", draft), ("regenerate", F.lit("")), *deltas],
        [("delta", F.lit("...")), ("edit", text)],
    ]
    way = F.pmod(F.coalesce("conv_id", F.lit(0)) + F.col("position"), F.lit(len(ways)))

    def listed(events: list[tuple[str, Column]]) -> Column:
        rows = [("open", F.lit("")), *events]
        return F.array(*(F.struct(F.lit(kind).alias("kind"), x.alias("text")) for kind, x in rows))

    events = F.when(way == 0, listed(ways[0])).when(way == 1, listed(ways[1])).otherwise(listed(ways[2]))
    rows = messages.select("conv_id", "position", "role", F.posexplode(events).alias("place", "event"))
    return rows.select(
        "conv_id",
        (F.col("position") * 16 + F.col("place")).alias("seq"),
        F.col("position").alias("message"),
        "event.kind",
        F.when(F.col("event.kind") == "open", F.col("role")).alias("role"),
        "event.text",
    )


def format_conversations(events: DataFrame) -> DataFrame:
    """Fold and render a log; the pieces are written to the shared folder and read from there."""
    return stored(render(fold(events)), "chat-formatted")
