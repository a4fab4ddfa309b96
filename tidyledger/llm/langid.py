"""Language identification by cross-parsing against labelled text.

For each language a suffix automaton holds all substrings of a sample of its text.
A text is cut greedily into the longest phrases found in that sample; the language
that needs the fewest phrases, normalised by the bits of a pointer into its sample,
wins.  Letters are lower-cased, everything between letters is one separator.

The model is fitted on a bounded sample: ``SAMPLE_ROWS`` labelled rows of each
language (those with the least hash of their id, whatever ids repeat), together ``SAMPLE_CHARS``
characters; of more than ``MOST_LANGUAGES`` labels those with most rows are learned.  Prediction reads every whole text, in windows that are parsed side by
side; a phrase ends where a window ends.

Null texts and texts without a letter are ``und`` with score 0.  Ties go to the
language first in the alphabet.  Without any labelled row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidyledger.llm.common import blocks, text_bytes, thrifty

UNDETERMINED = "und"
SAMPLE_ROWS = 64
SAMPLE_CHARS = 20_000
MOST_LANGUAGES = 250  # learned, those with most rows
WINDOW = 256  # characters
BLOCK = 1 << 20
SEPARATOR = 1  # symbol; 0 is a letter that no sample has


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000)


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lower-cased texts and the offset of each text."""
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    data, _ = text_bytes(lower)
    ends = np.cumsum(pc.utf8_length(lower).to_numpy(zero_copy_only=False))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    return points, np.concatenate(([0], ends)).astype(np.int64)


def _symbols(points: np.ndarray, offsets: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with runs of separators as one, and the offsets that remain."""
    found = symbol[points]
    gap = found == SEPARATOR
    keep = np.ones(len(found), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    firsts = offsets[:-1]
    keep[firsts[firsts < len(found)]] = True
    ends = np.concatenate(([0], np.cumsum(keep)))
    return found[keep], ends[offsets]


@dataclass(frozen=True)
class Automaton:
    """Suffix automaton of a sample, edges of all states in one row of cells.

    The edge of ``state`` by ``symbol`` is in cell ``base[state] + symbol``, if that cell names the state
    (upper half); its lower half is the next state.  Without an edge a phrase starts: ``fresh[symbol]``
    is the state it is in.  The last state has no edges: texts begin there, and a letter that the
    sample has not (symbol 0, a phrase of its own) leads there.
    """

    base: np.ndarray
    cells: np.ndarray
    fresh: np.ndarray

    @property
    def begin(self) -> int:
        return len(self.base) - 1


def suffix_automaton(text: np.ndarray, size: int) -> Automaton:
    """The automaton of a sample whose symbols are below ``size``; its size follows the edges, not the letters."""
    link, length, moves = [-1], [0], [{}]
    last = 0
    for c in text.tolist():
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        moves.append({})
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                twin = len(link)
                link.append(link[to])
                length.append(length[at] + 1)
                moves.append(dict(moves[to]))
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return _placed(moves, size)


def _placed(moves: list[dict[int, int]], size: int) -> Automaton:
    """States with many edges take the first cells that are free for all of them, then the others any free cell."""
    begin = len(moves)
    fresh = np.full(size, begin, np.int64)
    for c, to in moves[0].items():
        fresh[c] = to
    edges = sum(map(len, moves))
    # Cells before and after keep every ``base + symbol`` within the row.
    cells = np.full(2 * edges + 3 * size + 1, -1, np.int64)
    base = np.zeros(begin + 1, np.int32)
    taken = np.zeros(len(cells), bool)
    ahead = np.arange(64)
    order = sorted((k for k in range(begin) if len(moves[k]) > 1), key=lambda k: -len(moves[k]))
    at, width = size, 0
    for state in order:
        symbols = np.array(sorted(moves[state]))
        if len(symbols) != width:
            at, width = size, len(symbols)  # smaller states fill what larger ones left
        offsets = symbols - symbols[0]
        while True:
            if at + len(ahead) + size >= len(taken):
                taken = np.concatenate((taken, np.zeros(len(taken), bool)))
                cells = np.concatenate((cells, np.full(len(cells), -1, np.int64)))
            free = np.flatnonzero(~taken[at + ahead[:, None] + offsets].any(1))
            if len(free):
                at += int(free[0])
                break
            at += len(ahead)
        base[state] = at - symbols[0]
        taken[at + offsets] = True
        cells[at + offsets] = (state << 32) | np.array([moves[state][c] for c in symbols.tolist()])
    single = [(k, *next(iter(x.items()))) for k, x in enumerate(moves) if len(x) == 1]
    if single:
        state, symbol, to = np.array(single, np.int64).T
        room = size + np.flatnonzero(~taken[size:])[: len(single)]
        if len(room) < len(single):
            more = len(taken) + np.arange(len(single) - len(room))
            room = np.concatenate((room, more))
            cells = np.concatenate((cells, np.full(len(more), -1, np.int64)))
        base[state] = room - symbol
        cells[room] = (state << 32) | to
    used = int(np.flatnonzero(cells >= 0).max(initial=0)) + 1
    return Automaton(base, np.concatenate((cells[:used], np.full(size, -1, np.int64))), fresh)


@cache
def _model(samples: tuple[tuple[str, str], ...]):
    """(symbol of each code point, automata, bits of a pointer) for ``(language, sample text)``."""
    points, offsets = _points(pa.array([text for _, text in samples], pa.string()))
    known = np.unique(points[_letters()[points]])
    symbol = np.where(_letters(), 0, SEPARATOR).astype(np.int32)
    symbol[known] = np.arange(len(known)) + SEPARATOR + 1
    found, ends = _symbols(points, offsets, symbol)
    size = len(known) + SEPARATOR + 1
    tables = [suffix_automaton(found[a:b], size) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return symbol, tables, np.log2(np.maximum(np.diff(ends), 2))


def phrases(
    found: np.ndarray, offsets: np.ndarray, tables: list[Automaton], window: int = WINDOW
) -> np.ndarray:
    """Phrases of each text for each language, ``[text, language]``."""
    sizes = np.diff(offsets)
    counts = -(-sizes // window)
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[owner] + number * window
    lengths = np.minimum(window, offsets[owner + 1] - starts)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, owner = starts[order], lengths[order], owner[order]
    active = np.searchsorted(-lengths, -np.arange(window), "left") if len(lengths) else []
    states = [np.full(len(starts), x.begin, np.int64) for x in tables]
    begun = [np.zeros(len(starts), np.int32) for _ in tables]
    for step in range(int(lengths[0]) if len(lengths) else 0):
        n = active[step]
        symbol = found[starts[:n] + step]
        for table, state, count in zip(tables, states, begun, strict=True):
            cell = table.cells.take(table.base.take(state[:n]) + symbol)
            new = cell >> 32 != state[:n]
            state[:n] = np.where(new, table.fresh.take(symbol), cell & 0xFFFFFFFF)
            count[:n] += new
    out = np.zeros((len(sizes), len(tables)))
    for k, count in enumerate(begun):
        out[:, k] = np.bincount(owner, weights=count, minlength=len(sizes))
    return out


def fit(
    docs: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
    most_languages: int = MOST_LANGUAGES,
) -> tuple[tuple[str, str], ...]:
    """``(language, sample text)`` from labelled rows with ``learn``.

    At most ``sample_rows`` rows and ``sample_chars`` characters of each of ``most_languages``
    languages reach the driver: those with most rows, of equal ones the first in the alphabet.
    """
    share = -(-sample_chars // sample_rows)
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(label_column).alias("label"), learn.alias("ok")
    ).where("ok AND label IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    counts = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_languages)
    labels = [row["label"] for row in counts.collect()]
    rows = rows.where(F.col("label").isin(labels) & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("text", F.substring("text", 1, 4 * share))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", "text"))
    texts = rows.withColumn("rank", rank).where(F.col("rank") <= sample_rows)
    found: dict[str, list[str]] = {}
    for row in sorted(texts.select("id", "label", "text").collect(), key=lambda x: (x["label"], x["id"], x["text"])):
        found.setdefault(row["label"], []).append(row["text"])
    samples = []
    for label in sorted(found):
        # Short rows leave room for others: all take turns up to the common bound.
        part, room, left = [], sample_chars, sorted(found[label], key=len)
        for k, text in enumerate(left):
            part.append(text[: room // (len(left) - k)])
            room -= len(part[-1])
        samples.append((label, "\n".join(part)))
    return tuple(samples)


def identify(
    docs: DataFrame, samples: tuple[tuple[str, str], ...], id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (which replace columns of these names).

    The score is one minus the winner's phrases over those of the next language.
    """
    languages = np.array([label for label, _ in samples] + [UNDETERMINED], object)
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    place = docs.columns.index(text_column)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        symbol, tables, bits = _model(samples) if samples else (None, [], np.zeros(0))
        for part in parts:
            winner = np.full(part.num_rows, len(samples))
            score = np.zeros(part.num_rows)
            texts = part.column(place)
            _, offsets = text_bytes(texts)
            for a, b in blocks(offsets, BLOCK):
                points, ends = _points(texts.slice(a, b - a))
                seen = np.concatenate(([0], np.cumsum(letters[points])))[ends]
                real = np.flatnonzero(np.diff(seen) > 0)
                if not len(real) or not tables:
                    continue
                found, ends = _symbols(points, ends, symbol)
                cost = phrases(found, ends, tables)[real] * bits
                best = cost.argmin(1)
                ranked = np.sort(cost, axis=1)
                winner[a + real] = best
                score[a + real] = 1 - ranked[:, 0] / ranked[:, 1] if len(tables) > 1 else 1.0
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(languages[winner], pa.string()), pa.array(score)],
                names=[*part.schema.names, "lang_pred", "score"],
            )
        _model.cache_clear()  # an idle worker keeps no tables

    return docs.mapInArrow(thrifty(run), schema)
