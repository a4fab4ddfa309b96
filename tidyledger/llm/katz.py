"""Katz backoff scores of whole texts.

Words are lower-cased in A-Z; every text starts after a start mark and ends with an
end token.  A seen pair has its Good-Turing discounted share of its context; what the
discounts free goes to the words never seen there, in proportion to their unigram
probability, with a weight that makes each context add up to one.  Unigrams are
discounted alike; what they free is the probability of an unknown word.

    P(w | v) = d(c(v, w)) c(v, w) / c(v)            if the pair was seen
             = a(v) P(w)                            otherwise; a(v) = 1 for a new v
    P(w)     = d1(c(w)) c(w) / N, or what is left for an unknown word

Logarithms of the factors add up, so each is found where its count lives:

* all pairs with the same last word meet in one part: pair counts, word counts,
  plain and base scores are added up per text there;
* contexts meet in parts of their own: they get their backoff weight, which is added
  for the unseen pairs of each text;
* counts of counts and the discounts follow from sums over all parts.

Tokens move once, packed by last word.  Words with a large share of all tokens are
dealt out by context; there are at most ``2 ** 20`` of them, whatever the corpus.

Words are told apart by 64 bits of a hash, contexts by 48.  Null text counts as
empty (its one token is the end).  Rows with equal id and text share one sum, which
is divided by their number.  Without any training row every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import blocks, mix, settled, text_bytes, thrifty, word_hashes
from tidyledger.session import stored

DISCOUNTED = 5  # counts up to this one are discounted by Good-Turing
LARGE = 0.999  # share that larger counts keep, so that every context can back off
PART_BYTES = 20 << 20  # of text, for one part
STEP_TOKENS = 150_000  # tokens of a part that are counted at a time
SEND_TOKENS = 500_000  # tokens that a task gathers before it sends them
HOT_WORDS = 1 << 20
ROW_BYTES = 1 << 17  # of records in one row: Parquet pages hold 100 rows or more, and a page is (un)packed whole
ROW_GROUP_BYTES = 8 << 20  # of the table of these rows
END = np.uint64(0xE0D0E0D0E0D0E0D0)  # fixed values: the marks' places among the hashes
START = np.uint64(0x57A57A57A57A57A5)
_CONTEXT = np.uint64(16)
_DOC = np.dtype([("key", "<i8"), ("sum", "<f8"), ("base", "<f8"), ("known", "<u4"), ("seen", "<u4", (DISCOUNTED + 1,))])
_LINK = np.dtype([("context", "<u8"), ("lower", "<f8"), ("large", "<u4"), ("types", "<u4", (DISCOUNTED,))])
_OPEN = np.dtype([("key", "<i8"), ("context", "<u8")])
_ADD = np.dtype([("key", "<i8"), ("sum", "<f8")])


# ---------------------------------------------------------------------------
# Tokens
# ---------------------------------------------------------------------------
def _tokens(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(row key, whether it is learned, tokens of the row, words, contexts)`` for blocks of ``(id, text, learn)``."""
    data, offsets = text_bytes(part.column(1))
    ids = part.column(0).fill_null(-(2**62)).to_numpy().view(np.uint64)
    learn = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
    for a, b in blocks(offsets, rows=1 << 15):
        text, _, _, found = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        sizes = np.bincount(text, minlength=b - a) + 1
        ends = np.cumsum(sizes)
        words = np.full(ends[-1], END)
        place = np.ones(ends[-1], bool)
        place[ends - 1] = False
        words[place] = found
        contexts = np.concatenate(([START], words[:-1]))
        contexts[ends - sizes] = START
        number = np.arange(len(words), dtype=np.uint64) - np.repeat((ends - sizes).astype(np.uint64), sizes)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(words + number * np.uint64(0x9FB21C651E98DF25)))))
        key = mix(sums[ends] - sums[ends - sizes] + mix(ids[a:b] + np.uint64(1))).view(np.int64)
        yield key, learn[a:b], sizes, words, contexts


def _facts(rows: DataFrame) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [(key, sizes) for key, _, sizes, _, _ in _tokens(part)]
            if found:
                keys, sizes = (pa.array(np.concatenate(x)) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), keys, sizes], names=["id", "learn", "key", "n_tokens"]
                )

    return rows.mapInArrow(thrifty(run), "id long, learn boolean, key long, n_tokens long")


def _range(words: np.ndarray, count: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


# ---------------------------------------------------------------------------
# Unigrams
# ---------------------------------------------------------------------------
def _word_counts(rows: DataFrame, parts_of: int) -> DataFrame:
    """``(part, words, counts)`` of each task's training tokens."""

    def counted(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        words, of = np.unique(np.concatenate([x for x, _ in kept]), return_inverse=True)
        return words, np.bincount(of, np.concatenate([n for _, n in kept]), len(words)).astype(np.int64)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for part in parts:
            for _, learn, sizes, words, _ in _tokens(part):
                kept.append(np.unique(words[np.repeat(learn, sizes)], return_counts=True))
                size += len(kept[-1][0])
                if size >= SEND_TOKENS:
                    kept = [counted(kept)]
                    size = len(kept[0][0])
                if size >= SEND_TOKENS // 2 and len(kept) == 1:
                    yield from send(*kept.pop())
                    size = 0
        if kept:
            yield from send(*counted(kept))

    def send(words: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = _range(words, parts_of)
        for k in np.unique(part):
            a, b = np.searchsorted(part, [k, k + 1])
            columns = [[int(k)], [words[a:b].tobytes()], [counts[a:b].astype("<u4").tobytes()]]
            kinds = [pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["part", "words", "counts"]
            )

    return rows.mapInArrow(thrifty(run), "part int, words binary, counts binary")


def _unigrams(least: int):
    """Types, counts of counts, and the words that occur ``least`` times or more."""

    def run(group: pa.Table) -> pa.Table:
        words = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in group.column("words")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in group.column("counts")])
        order = np.argsort(words)
        words, counts = words[order], counts[order].astype(np.int64)
        runs = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        counts = np.add.reduceat(counts, runs)
        hot = counts >= least
        some = np.bincount(counts[counts <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:]
        return pa.table(
            [
                pa.array([len(counts)], pa.int64()),
                pa.array([some.tolist()], pa.list_(pa.int64())),
                pa.array([words[runs][hot].view(np.int64).tolist()], pa.list_(pa.int64())),
                pa.array([counts[hot].tolist()], pa.list_(pa.int64())),
            ],
            names=["types", "some", "hot_words", "hot_counts"],
        )

    return run


def discounts(some: list[int]) -> np.ndarray:
    """Good-Turing discounts of counts 0 (unused) to ``DISCOUNTED``, from the numbers of types with counts 1, 2, ...

    Katz's form, which leaves larger counts alone.  Copies in a corpus can bend the numbers so that a discount is
    not between 0 and 1; then the numbers are replaced by the power of the count that fits them best.
    """
    k = len(some) - 1
    r = np.arange(1, k + 1)
    types = np.array(some, float)
    with np.errstate(all="ignore"):
        common = (k + 1) * types[k] / types[0]
        kept = ((r + 1) * types[1:] / types[:-1] / r - common) / (1 - common)
    if not (np.isfinite(kept).all() and (kept > 0).all() and (kept < 1).all()):
        real = np.flatnonzero(types)
        slope = np.polyfit(np.log(real + 1), np.log(types[real]), 1)[0] if len(real) > 1 else -2.0
        power = min(slope, -1.05) + 1
        common = (k + 1.0) ** power
        kept = ((1 + 1 / r) ** power - common) / (1 - common)
    return np.concatenate(([1.0], kept))


class Words:
    """What every task knows of the unigrams: sums, discounts and the hot words."""

    def __init__(self, tokens: int, types: int, some: list[int], texts: int, hot: tuple[np.ndarray, np.ndarray]):
        self.tokens, self.types, self.texts, self.hot = tokens, types, texts, hot
        self.contexts = np.append(hot[0], START) >> _CONTEXT
        self.discount = discounts(some)
        kept = sum(self.discount[r] * r * some[r - 1] for r in range(1, DISCOUNTED + 1))
        large = tokens - sum(r * some[r - 1] for r in range(1, DISCOUNTED + 1))
        self.unknown = 1 - (kept + LARGE * large) / tokens if tokens else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        factor = np.where(counts > DISCOUNTED, LARGE, self.discount[np.minimum(counts, DISCOUNTED)])
        return np.where(counts > 0, factor * counts / max(self.tokens, 1), self.unknown)


# ---------------------------------------------------------------------------
# Pairs, by last word
# ---------------------------------------------------------------------------
_PAIRS = ["part", "keys", "learn", "words", "pairs", "contexts", "runs", "rows"]


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _eight(raw: pa.Buffer) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, np.uint64)
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination starts."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(starts, total))


def _pairs(rows: DataFrame, parts_of: int, hot: np.ndarray, shares: np.ndarray) -> DataFrame:
    """All tokens, packed by last word: for each task and part its words, their contexts and the rows they stand in.

    A hot word has ``shares`` parts of its own after the first ``parts_of``.
    """
    firsts = parts_of + np.cumsum(shares) - shares

    def send(kept: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, learn = (np.concatenate([x[k] for x in kept]) for k in (0, 1))
        words, contexts = (np.concatenate([x[k] for x in kept]) for k in (3, 4))
        row = np.repeat(np.arange(len(keys), dtype=np.uint32), np.concatenate([x[2] for x in kept]))
        kept.clear()
        contexts >>= _CONTEXT
        part = _range(words, parts_of).astype(np.uint32)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
            mine = hot[at] == words
            part[mine] = firsts[at[mine]] + (mix(contexts[mine]) % shares[at[mine]].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((contexts, words, part))
        part, words = part[order], words[order]
        contexts, row = contexts[order], row[order]
        del order
        for k in np.unique(part):
            a, b = np.searchsorted(part, [k, k + 1])
            word, context, own = words[a:b], contexts[a:b], row[a:b]
            used, own = np.unique(own, return_inverse=True)
            pairs = _heads(word, context)
            of = _heads(word[pairs])
            columns = [
                [int(k)],
                [keys[used].tobytes()],
                [learn[used].astype(np.uint8).tobytes()],
                [word[pairs][of].tobytes()],
                [_lengths(of, len(pairs)).astype("<u4").tobytes()],
                [_six(context[pairs])],
                [_lengths(pairs, b - a).astype("<u4").tobytes()],
                [own.astype("<u2" if len(used) < 2**16 else "<u4").tobytes()],
            ]
            kinds = [pa.int32()] + [pa.binary()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=_PAIRS
            )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for part in parts:
            for block in _tokens(part):
                kept.append(block)
                size += len(block[3])
                if size >= SEND_TOKENS:
                    yield from send(kept)
                    kept, size = [], 0
        if size:
            yield from send(kept)

    return rows.mapInArrow(thrifty(run), "part int, " + ", ".join(f"{x} binary" for x in _PAIRS[1:]))


class _Sent:
    """One task's tokens of a part; rows are numbered from ``first``."""

    def __init__(self, columns: list[pa.Scalar], first: int):
        raw = [x.as_buffer() for x in columns]
        self.keys, self.learn = np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[1], np.uint8)
        self.words, pairs = np.frombuffer(raw[2], "<u8"), np.frombuffer(raw[3], "<u4")
        self.contexts, runs = raw[4], np.frombuffer(raw[5], "<u4")
        self.rows = np.frombuffer(raw[6], "<u2" if len(self.keys) < 2**16 else "<u4")
        self.pairs = np.concatenate(([0], np.cumsum(pairs.astype(np.int64))))
        self.runs = np.concatenate(([0], np.cumsum(runs.astype(np.int64))))
        self.first = first

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (word, context, tokens) and their tokens (row, learned) with words from ``low`` up to ``high``."""
        a = int(np.searchsorted(self.words, np.uint64(low)))
        b = len(self.words) if high >= 2**64 else int(np.searchsorted(self.words, np.uint64(high)))
        word = np.repeat(self.words[a:b], np.diff(self.pairs[a : b + 1]))
        return word, *self._slice(self.pairs[a], self.pairs[b])

    def of_contexts(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for the contexts from ``low`` up to ``high`` of the only word."""
        p, q = np.searchsorted(_eight(self.contexts), [np.uint64(low), np.uint64(high)])
        return np.full(q - p, self.words[0]), *self._slice(p, q)

    def _slice(self, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = self.rows[self.runs[p] : self.runs[q]].astype(np.int64)
        contexts = _eight(self.contexts.slice(6 * int(p), 6 * int(q - p)))
        return contexts, np.diff(self.runs[p : q + 1]), rows + self.first, self.learn[rows]


def _count_pairs(words: Words, buckets: int, parts_of: int, step_tokens: int):
    """Counts the pairs of a part; sends sums to rows, links to contexts, unseen pairs to their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, total, part = [], 0, 0
        for batch in batches:
            part = batch.column("part")[0].as_py()
            for columns in zip(*(batch.column(x) for x in _PAIRS[1:]), strict=True):
                sent.append(_Sent(list(columns), total))
                total += len(sent[-1].keys)
        keys = np.concatenate([x.keys for x in sent])
        docs = np.zeros(total, _DOC)
        docs["key"] = keys
        some = np.zeros(DISCOUNTED + 1, np.int64)
        tokens = sum(len(x.rows) for x in sent)
        # The words of a part lie in one range of hashes, cut into steps of bounded size; so do
        # the contexts of a hot word.
        alone = part >= parts_of
        low, high = -(-(part << 64) // parts_of), -(-((part + 1) << 64) // parts_of)
        if alone:
            low, high = 0, 1 << 48
        steps = tokens // step_tokens + 1
        cuts = [low + (high - low) * k // steps for k in range(steps + 1)]
        cuts[0], cuts[-1] = 0, 1 << (48 if alone else 64)
        links: list[np.ndarray] = []
        room = step_tokens  # records that may wait until the contexts of several steps are merged
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            step = [x.of_contexts(a, b) if alone else x.between(a, b) for x in sent]
            word, context, runs, row, learn = (np.concatenate(x) for x in zip(*step, strict=True))
            if not len(word):
                continue
            order = np.lexsort((context, word))
            word, context = word[order], context[order]
            heads = np.cumsum(runs) - runs
            learned = np.add.reduceat(learn.astype(np.int64), heads)[order]
            pair_heads, word_heads = _heads(word, context), _heads(word)
            pair_count = np.add.reduceat(learned, pair_heads)
            word_count = np.add.reduceat(learned, word_heads)
            if alone:
                word_count[:] = words.hot[1][np.searchsorted(words.hot[0], word[:1])]
            lower = words.probability(word_count)
            of_pair = np.repeat(np.arange(len(pair_heads)), _lengths(pair_heads, len(word)))
            of_word = np.repeat(np.arange(len(word_heads)), _lengths(word_heads, len(word)))
            # Back to the order in which the tokens came.
            c12, c2, p2 = (np.empty(len(word), x.dtype) for x in (pair_count, word_count, lower))
            c12[order], c2[order], p2[order] = pair_count[of_pair], word_count[of_word], lower[of_word]
            came_context = np.empty_like(context)
            came_context[order] = context
            came_word = np.empty_like(word)
            came_word[order] = word
            value = np.where(c12 > 0, np.log10(np.maximum(c12, 1)), np.log10(p2))
            value -= np.where((came_word != END) & (c2 > 0), np.log10(np.maximum(c2, 1)), 0.0)
            c12t = np.repeat(c12, runs)
            docs["sum"] += np.bincount(row, np.repeat(value, runs), total)
            docs["base"] += np.bincount(row, np.repeat(np.log10(c2 + 1.0), runs), total)
            docs["known"] += np.bincount(row, np.repeat(c2 > 0, runs), total).astype(np.uint32)
            kind = np.where(c12t > DISCOUNTED, 0, c12t)
            for r in range(DISCOUNTED + 1):
                hit = (kind == r) & (c12t > 0)
                docs["seen"][:, r] += np.bincount(row[hit], minlength=total).astype(np.uint32)
            new = c12t == 0
            opened = np.zeros(int(new.sum()), _OPEN)
            opened["key"], opened["context"] = keys[row[new]], np.repeat(came_context, runs)[new]
            frequent = np.isin(opened["context"], words.contexts)
            spread = np.where(frequent, opened["key"].view(np.uint64), mix(opened["context"]))
            yield from _emitted(_bucketed("open", opened, spread, buckets), some)
            real = pair_count > 0
            some += np.bincount(pair_count[real & (pair_count <= DISCOUNTED + 1)], minlength=DISCOUNTED + 2)[1:]
            link = np.zeros(int(real.sum()), _LINK)
            link["context"], counts = context[pair_heads][real], pair_count[real]
            link["lower"] = lower[of_word[pair_heads]][real]
            link["large"] = np.where(counts > DISCOUNTED, counts, 0)
            for r in range(1, DISCOUNTED + 1):
                link["types"][:, r - 1] = counts == r
            links.append(_merged(link))
            if sum(map(len, links)) > room:
                links = [_merged(np.concatenate(links))]
                room = len(links[0]) + max(step_tokens, len(links[0]) // 2)
        step = word = context = row = learn = came_word = came_context = value = c12t = kind = None  # noqa: F841
        merged = _merged(np.concatenate(links)) if links else np.zeros(0, _LINK)
        links.clear()
        frequent = np.isin(merged["context"], words.contexts)
        yield from _emitted(_bucketed("link", merged[~frequent], mix(merged["context"][~frequent]), buckets), some)
        yield from _emitted(_bucketed("hot", merged[frequent], mix(merged["context"][frequent]), buckets), some)
        yield from _emitted(_bucketed("doc", docs, docs["key"].view(np.uint64), buckets), some)
        yield from _emitted([("some", 0, b"")], some)

    return run


def _emitted(rows: list[tuple[str, int, bytes]], some: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with the counts of counts so far (those of the row of kind ``some`` are complete), a few at a time."""
    kinds = [pa.string(), pa.int32(), pa.binary()]
    for at in range(0, len(rows), 16):
        columns = list(zip(*rows[at : at + 16], strict=True))
        arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
        counts = pa.array([some.tolist()] * len(columns[0]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*arrays, counts], names=["kind", "bucket", "records", "some"])


def _merged(links: np.ndarray) -> np.ndarray:
    """One record for each context; field by field, to save memory."""
    order = np.argsort(links["context"], kind="stable")
    context = links["context"][order]
    heads = _heads(context)
    out = np.zeros(len(heads), _LINK)
    if len(heads):
        out["context"] = context[heads]
        for name in ("lower", "large", "types"):
            out[name] = np.add.reduceat(links[name][order], heads, axis=0)
    return out


def _packed(records: np.ndarray) -> bytes:
    """Records field by field, which compresses well."""
    return b"".join(np.ascontiguousarray(records[name]).tobytes() for name in records.dtype.names)


def _unpacked(raw: pa.Buffer, dtype: np.dtype) -> np.ndarray:
    out, at = np.empty(len(raw) // dtype.itemsize, dtype), 0
    for name in dtype.names:
        kind = dtype[name]
        size = kind.itemsize * len(out)
        out[name] = np.frombuffer(raw.slice(at, size), kind.base).reshape(len(out), *kind.shape)
        at += size
    return out


def _bucketed(kind: str, records: np.ndarray, spread: np.ndarray, buckets: int) -> list[tuple[str, int, bytes]]:
    bucket = (spread % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    found, most = [], ROW_BYTES // records.dtype.itemsize
    for k in np.unique(bucket):
        first, last = np.searchsorted(bucket, [k, k + 1])
        for a in range(int(first), int(last), most):
            found.append((kind, int(k), _packed(records[a : min(a + most, last)])))
    return found


# ---------------------------------------------------------------------------
# Contexts and sums
# ---------------------------------------------------------------------------
def _gather(group: pa.Table, kind: str, dtype: np.dtype) -> np.ndarray:
    found = [
        _unpacked(x.as_buffer(), dtype)
        for x, k in zip(group.column("records"), group.column("kind").to_pylist(), strict=True)
        if k == kind
    ]
    return np.concatenate(found) if found else np.zeros(0, dtype)


def backoff(links: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """log10 of ``a(v) c(v)`` of each context: what an unseen pair has besides the unigram's probability."""
    r = np.arange(1, DISCOUNTED + 1)
    count = links["large"] + (links["types"] * r).sum(1)
    kept = LARGE * links["large"] + (links["types"] * (r * discount[1:])).sum(1)
    return np.log10((count - kept) / np.maximum(1 - links["lower"], 1e-300))


def _hot_links(group: pa.Table) -> pa.Table:
    return pa.table([pa.array([_packed(_merged(_gather(group, "hot", _LINK)))], pa.binary())], names=["records"])


def _back_off(discount: np.ndarray, hot: np.ndarray, buckets: int, step_tokens: int):
    """Adds the backoff weight for the unseen pairs of each row; those of hot contexts come by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Links are merged as they come; unseen pairs wait packed until all links are there.
        links, waiting, room = [hot], [], step_tokens
        for batch in batches:
            for raw, kind in zip(batch.column("records"), batch.column("kind").to_pylist(), strict=True):
                if kind == "open":
                    waiting.append(raw.as_buffer().to_pybytes())
                    continue
                links.append(_unpacked(raw.as_buffer(), _LINK))
                if sum(map(len, links)) > room:
                    links = [_merged(np.concatenate(links))]
                    room = len(links[0]) + max(step_tokens, len(links[0]) // 2)
        merged = _merged(np.concatenate(links))
        links.clear()
        contexts, weight = merged["context"].copy(), backoff(merged, discount)
        del merged
        adds, step, size, room = [], [], 0, step_tokens
        waiting.reverse()
        while waiting:
            step.append(_unpacked(pa.py_buffer(waiting.pop()), _OPEN))
            size += len(step[-1])
            if waiting and size < step_tokens:
                continue
            opened = np.concatenate(step)
            step, size = [], 0
            add = np.zeros(len(opened), _ADD)
            add["key"] = opened["key"]
            if len(contexts) and len(opened):
                at = np.minimum(np.searchsorted(contexts, opened["context"]), len(contexts) - 1)
                add["sum"] = np.where(contexts[at] == opened["context"], weight[at], 0.0)
            adds.append(_added(add))
            if sum(map(len, adds)) > room:
                adds = [_added(np.concatenate(adds))]
                room = len(adds[0]) + max(step_tokens, len(adds[0]) // 2)
        add = _added(np.concatenate(adds)) if adds else np.zeros(0, _ADD)
        adds.clear()
        rows = _bucketed("add", add, add["key"].view(np.uint64), buckets)
        kinds = [pa.string(), pa.int32(), pa.binary()]
        for at in range(0, len(rows), 16):
            columns = zip(*rows[at : at + 16], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["kind", "bucket", "records"]
            )

    return run


def _added(add: np.ndarray) -> np.ndarray:
    keys, of = np.unique(add["key"], return_inverse=True)
    out = np.zeros(len(keys), _ADD)
    out["key"], out["sum"] = keys, np.bincount(of, add["sum"], len(keys))
    return out


def _sum_rows(discount: np.ndarray):
    """``(key, sum, base, known)`` of each row key."""

    def run(group: pa.Table) -> pa.Table:
        docs, add = _gather(group, "doc", _DOC), _gather(group, "add", _ADD)
        keys, of = np.unique(np.concatenate((docs["key"], add["key"])), return_inverse=True)
        mine = of[: len(docs)]
        factor = np.log10(np.concatenate(([LARGE], discount[1:])))
        value = docs["sum"] + docs["seen"] @ factor
        total = np.bincount(of, np.concatenate((value, add["sum"])), len(keys))
        return pa.table(
            [
                pa.array(keys),
                pa.array(total),
                pa.array(np.bincount(mine, docs["base"], len(keys))),
                pa.array(np.bincount(mine, docs["known"], len(keys)).round().astype(np.int64)),
            ],
            names=["key", "sum", "base", "known"],
        )

    return run


def katz_scores(
    docs: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_bytes: int = PART_BYTES,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """``(id, learn, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    ``learn`` tells the rows the model is counted on; null does not count.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    facts = stored(_facts(rows), "katz-facts")
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    learned = facts.where("learn").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens")).first()
    every = facts.agg(F.sum("n_tokens").alias("tokens")).first()["tokens"] or 0
    texts, tokens = learned["texts"], learned["tokens"] or 0
    parts_of = size // part_bytes + 1
    part_tokens = max(1, every // parts_of)
    least = max(part_tokens // 2, tokens // HOT_WORDS, 1)
    counted = settled(
        _word_counts(rows, parts_of).groupBy("part").applyInArrow(
            thrifty(_unigrams(least)), "types long, some array<long>, hot_words array<long>, hot_counts array<long>"
        ),
        "katz-words",
    )
    sums = counted.agg(
        F.sum("types").alias("types"), *[F.sum(F.col("some")[r]).alias(f"n{r}") for r in range(DISCOUNTED + 1)]
    ).first()
    listed = counted.select(F.explode(F.arrays_zip("hot_words", "hot_counts")).alias("x"))
    # At most HOT_WORDS of them: each has that share of all tokens at least.
    found = sorted((x[0] % 2**64, x[1]) for (x,) in listed.collect())
    hot = np.array([x for x, _ in found], np.uint64), np.array([x for _, x in found], np.int64)
    shares = -(-2 * hot[1] // part_tokens)
    some = [sums[f"n{r}"] or 0 for r in range(DISCOUNTED + 1)]
    words = Words(tokens, sums["types"] or 0, some, texts, hot)
    schema = "kind string, bucket int, records binary, some array<long>"
    pairs = settled(
        _pairs(rows, parts_of, hot[0], shares).groupBy("part").applyInArrow(
            thrifty(_count_pairs(words, parts_of, parts_of, step_tokens)), schema
        ),
        "katz-pairs",
        ROW_GROUP_BYTES,
    )
    twos = pairs.where("kind = 'some'").agg(*[F.sum(F.col("some")[r]).alias(f"n{r}") for r in range(DISCOUNTED + 1)])
    discount = discounts([x or 0 for x in twos.first()])
    plain = ["kind", "bucket", "records"]
    schema = "kind string, bucket int, records binary"
    frequent = pairs.where("kind = 'hot'").select(plain).groupBy("bucket").applyInArrow(thrifty(_hot_links), "records binary")
    frequent = [_unpacked(pa.py_buffer(x["records"]), _LINK) for x in frequent.collect()]
    frequent = np.concatenate([np.zeros(0, _LINK), *frequent])
    back = pairs.where("kind IN ('link', 'open')").select(plain).groupBy("bucket").applyInArrow(
        thrifty(_back_off(discount, frequent, parts_of, step_tokens)), schema
    )
    total = pairs.where("kind = 'doc'").select(plain).unionByName(back).groupBy("bucket").applyInArrow(
        thrifty(_sum_rows(discount)), "key long, sum double, base double, known long"
    )
    same = facts.groupBy("key").agg(F.count("*").alias("rows"))
    scores = total.join(same, "key")
    start = float(np.log10(texts)) if texts else 0.0
    divisor = float(np.log10(tokens + words.types + 1))
    return facts.join(scores, "key").select(
        "id",
        "learn",
        "n_tokens",
        (F.col("known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows") - F.col("n_tokens") * F.lit(divisor)).alias("base_score"),
        (F.col("sum") / F.col("rows") - F.lit(start)).alias("score"),
    )
