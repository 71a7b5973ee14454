"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping windows of `WINDOW` characters (a shorter item is one
window). A window of w characters that occurs with at most e edits shares at least
w + 1 - q (e + 1) of its q-grams with the text, on diagonals no more than e apart. So the q-grams
of a text are looked up in the windows' index, hits are counted in diagonal bands of 2 (e + 1)
that overlap by half, and bands that reach the bound are verified by an alignment banded to the
diagonals that e edits can reach. A text is contaminated if any window is found.

Texts and items are compared in lower case with every run of other characters than letters and
digits as one blank. A passage of an item of WINDOW + STEP or more such characters always holds a
whole window. The index is made from blocks of the benchmark of bounded size; a larger benchmark
takes one pass over the texts for each block. Texts are never moved: a pass adds a column to the
rows it reads, in pieces of bounded length that overlap by more than a window.

Defined cases: a null or empty text holds nothing; a null or empty item, or one of fewer than q
characters, is not searched for; equal items are all reported; repeated rows are judged alike; a
column named like a result is replaced. Spans are character offsets into the text as given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codes import GAP, folded
from .common import ready

Q, WINDOW, STEP, RATE = 12, 96, 48, 16
#: Characters of the benchmark in one index, of a text in one piece, and of pieces seen at once.
INDEX_CHARS, PIECE_CHARS, PASS_CHARS = 1 << 20, 1 << 19, 1 << 20
BITS = 22
MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("begin", T.LongType()),
                                  T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())]), False)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q codes from every position; doubles the width, so it takes log q passes."""
    base = 0x9E3779B97F4A7C15
    have, width = codes.astype(np.uint64), 1
    total, done = None, 0
    while True:
        if q & width:
            if total is None:
                total, done = have, width
            else:
                n = max(0, len(codes) - done - width + 1)
                total = total[:n] * np.uint64(pow(base, width, 1 << 64)) + have[done:done + n]
                done += width
        if done == q:
            return total
        n = max(0, len(have) - width)
        have = have[:n] * np.uint64(pow(base, width, 1 << 64)) + have[width:width + n]
        width *= 2


def _slots(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


class Index:
    """q-grams of the windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, window: int = WINDOW, step: int = STEP, rate: int = RATE):
        self.q = q
        self.item, self.window = [], []
        for item, text in items:
            codes, _ = folded(text or "")
            starts = list(range(0, max(1, len(codes) - window + 1), step))
            if len(codes) > window and starts[-1] != len(codes) - window:
                starts.append(len(codes) - window)
            if len(codes) >= q:
                self.item += [item] * len(starts)
                self.window += [codes[a:a + window] for a in starts]
        self.size = np.array([len(w) for w in self.window], np.int64)
        # The most edits that the rate allows and at which the lemma still asks for a shared q-gram.
        self.edits = np.minimum(self.size // rate, self.size // q - 1)
        self.least = self.size + 1 - q * (self.edits + 1)
        hashes = [grams(w, q) for w in self.window]
        every = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes] or [np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.hash, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order], place[order]
        self.filter = np.zeros(1 << BITS, bool)
        self.filter[_slots(self.hash)] = True

    def bands(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal) of bands with enough shared q-grams."""
        found = np.zeros(0, np.int64)
        if not len(self.hash) or len(codes) < self.q:
            return found, found
        hashes = grams(codes, self.q)
        at = np.flatnonzero(self.filter[_slots(hashes)])
        slot = np.minimum(np.searchsorted(self.hash, hashes[at]), len(self.hash) - 1)
        real = self.hash[slot] == hashes[at]
        at, slot = at[real], slot[real]
        times = self.count[slot]
        posting = np.repeat(self.first[slot] - np.cumsum(times) + times, times) + np.arange(times.sum())
        window = self.owner[posting]
        stride = self.edits[window] + 1
        band = (np.repeat(at, times) - self.place[posting] + WINDOW_REACH) // stride
        span = len(codes) + 2 * WINDOW_REACH
        keys, hits = np.unique(np.concatenate((window * span + band, window * span + band - 1)), return_counts=True)
        window, band = keys // span, keys % span
        enough = hits >= self.least[window]
        window, band = window[enough], band[enough]
        return window, band * (self.edits[window] + 1) - WINDOW_REACH

    def aligned(self, codes: np.ndarray, window: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end) of the best alignment of each window to the text within its band."""
        edits, end = np.full(len(window), 1 << 20), np.zeros(len(window), np.int64)
        for size, most in set(zip(self.size[window].tolist(), self.edits[window].tolist())):
            every = np.flatnonzero((self.size[window] == size) & (self.edits[window] == most))
            for some in np.array_split(every, -(-len(every) // 4096)):
                edits[some], end[some] = self._banded(codes, np.array([self.window[w] for w in window[some]]),
                                                      diagonal[some] - most, 4 * most + 2)
        return edits, end

    @staticmethod
    def _banded(codes: np.ndarray, patterns: np.ndarray, diagonal: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        shift = np.arange(width)
        cost = np.zeros((len(patterns), width), np.int64)
        for row in range(patterns.shape[1]):
            place = diagonal[:, None] + row + shift
            inside = (place >= 0) & (place < len(codes))
            letter = np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], GAP)
            step = cost + (letter != patterns[:, row, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - shift, axis=1) + shift
        best = cost.argmin(axis=1)
        return cost[np.arange(len(cost)), best], diagonal + patterns.shape[1] + best

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """(item, begin, end, edits) of every window found in each text."""
        found: list[dict] = [{} for _ in texts]
        pieces: list[tuple[int, np.ndarray, np.ndarray]] = []
        held = 0

        def look() -> None:
            if not pieces:
                return
            gap = np.zeros(WINDOW_REACH, np.uint32)
            codes = np.concatenate([x for _, c, _ in pieces for x in (c, gap)])
            starts = np.cumsum([0] + [len(c) + len(gap) for _, c, _ in pieces])
            window, diagonal = self.bands(codes)
            edits, end = self.aligned(codes, window, diagonal)
            for w, n, e in zip(*(x[edits <= self.edits[window]].tolist() for x in (window, edits, end))):
                k = int(np.searchsorted(starts, e - 1, "right")) - 1
                text, _, offsets = pieces[k]
                last = min(max(e - int(starts[k]), 1), len(offsets)) - 1
                first = max(0, last + 1 - int(self.size[w]))
                key = (self.item[w], w, int(offsets[last]) // WINDOW_REACH)
                row = (self.item[w], int(offsets[first]), int(offsets[last]) + 1, n)
                if n < found[text].get(key, (0, 0, 0, 1 << 20))[3]:
                    found[text][key] = row
            pieces.clear()

        for i, text in enumerate(texts):
            codes, offsets = folded(text or "")
            for a in range(0, max(1, len(codes) - 2 * WINDOW_REACH), PIECE_CHARS):
                b = a + PIECE_CHARS + 2 * WINDOW_REACH
                pieces.append((i, codes[a:b], offsets[a:b]))
                held += len(codes[a:b])
                if held >= PASS_CHARS:
                    look()
                    held = 0
        look()
        return [sorted(set(f.values())) for f in found]


#: More than a window and the edits around it.
WINDOW_REACH = 2 * WINDOW


def blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).toLocalIterator():
        for a in range(0, len(row[1] or ""), INDEX_CHARS):
            block.append((row[0], row[1][a:a + INDEX_CHARS + WINDOW_REACH]))
            size += len(block[-1][1])
            if size >= INDEX_CHARS:
                yield block
                block, size = [], 0
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", name: str = "matches") -> DataFrame:
    """The rows with `name`: an array of (item_id, begin, end, edits) of the windows found."""
    ready(docs.sparkSession)
    names = [c for c in docs.columns if c != name]
    out = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn(name, F.array().cast(MATCH))
    schema = out.schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    for block in blocks(benchmark):
        index = Index(block)

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = index.search(batch.column(names.index(text_column)).to_pylist())
                before = batch.column(len(names)).to_pylist()
                merged = [[tuple(m.values()) for m in old] + new for old, new in zip(before, found)]
                merged = [[dict(zip(("item_id", "begin", "end", "edits"), m)) for m in row] for row in merged]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(merged, kind)], schema=None,
                                                 names=[*names, name])

        out = out.mapInArrow(search, schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows with `contaminated`, `item_ids` (ascending, each once) and `matches`."""
    own = ("contaminated", "item_ids", "matches")
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own])
    found = matches(rest, benchmark, text_column)
    return found.withColumns({"contaminated": F.size("matches") > 0,
                              "item_ids": F.array_sort(F.array_distinct("matches.item_id"))})


def clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows without any benchmark passage, with the columns they came with."""
    mark = "contamination"
    while mark in docs.columns:
        mark += "_"
    return matches(docs, benchmark, text_column, mark).where(F.size(mark) == 0).drop(mark)
