"""Removal of word passages that repeat across documents, by recompression.

A text is rewritten in rounds: every run of one symbol becomes a symbol (in the first rounds; later
ones hold hardly any), then every pair of a left and a right symbol does, where the side follows
from a round's bit of the symbol. A new symbol's name is a hash of what it replaces, so all tasks
give equal strings equal names without asking each other, and two copies of a passage agree on all
symbols but a few at its ends. Each symbol carries the span of words that its making looked at; any
copy of that span holds the same symbol.

`ROUNDS` rounds leave symbols of some eight words. Spark folds them over the corpus: a symbol that
only one text holds shows that no window around its span repeats. What is left of a text are windows
whose high-level symbols are all shared. Only texts with such windows are read again, to have them
verified over all their words by a fold of 128-bit hashes, which also finds the smallest document
that holds a window. Windows without any such symbol, as in long runs of a word, are verified as
well, so nothing is missed.

Texts of equal words are one class, named by its SHA-256 and judged once, with the smallest id as
its own: of longer copies than a window every word goes. All folds combine before their shuffle, and
joins back on symbols and windows are split by adaptive execution, so hot passages are no burden.

Defined cases: words are runs of other bytes than blank and \\t to \\r; a null text has none; texts
shorter than a window lose nothing; a null id comes after all others; rows of one id never take words
from each other; repeated rows are judged alike; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ready, store

WINDOW = 50
#: Nearly every window holds a whole symbol of seven rounds; symbols of more often look beyond it.
ROUNDS = 7
#: Rounds that name runs as well: later symbols hardly ever repeat side by side.
RUN_ROUNDS = (0, 1)
#: Texts are rewritten together until so many bytes are reached.
PASS_BYTES = 1 << 20
MULTIPLIER, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
LAST = (1 << 63) - 1


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection that scatters 64-bit numbers."""
    x = values ^ np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """The first powers of an odd number; kept for the next call."""
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n, PASS_BYTES), base, np.uint64))))
    return _POWERS[base][:n]


def stretches(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[begin:end] as polynomials, from one running sum."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers(len(values), base))))
    return mixed((sums[end] - sums[begin]) * powers(len(values) + 1, pow(base, -1, 1 << 64))[begin], base)


class Words:
    """The words of several texts in one row of numbers, with a mark before each text and at the end."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edges = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
        begin, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        #: Place of every text's first word, marks counted; text i holds `first[i]` to `first[i + 1] - 1`.
        owned = np.searchsorted(begin, starts)
        self.counts = np.diff(owned)
        self.first = owned[:-1] + np.arange(1, len(texts) + 1)
        self.size = len(begin) + len(texts) + 1
        self.is_word = np.ones(self.size, bool)
        self.is_word[np.append(self.first - 1, self.size - 1)] = False
        self.raw, self.begin, self.end = raw, begin, end

    def hashes(self, base: int) -> np.ndarray:
        out = np.zeros(self.size, np.uint64)
        out[self.is_word] = stretches(self.raw.astype(np.uint64) + np.uint64(1), self.begin, self.end, base)
        return out

    def windows(self, places: np.ndarray, base: int) -> np.ndarray:
        """Hashes of the windows that start at these places."""
        return stretches(self.hashes(base), places, places + WINDOW, base)


class Symbols:
    """Symbols of a round: names, and the spans [low, high) of words that their making looked at."""

    def __init__(self, words: Words):
        self.name = words.hashes(MULTIPLIER)
        self.low = np.arange(words.size)
        self.high = self.low + 1
        #: Marks take part in nothing.
        self.mark = ~words.is_word

    def _keep(self, at: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.low, self.high, self.mark = name, low, high, self.mark[at]

    def name_runs(self, salt: int) -> None:
        """Every run of one symbol becomes one; all of them looked at both neighbours."""
        new = np.append(True, (self.name[1:] != self.name[:-1]) | self.mark[1:] | self.mark[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(new)))
        name = np.where(size > 1, mixed(self.name[at] + size.astype(np.uint64) * np.uint64(MULTIPLIER), salt), self.name[at])
        low, high = np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at)
        self._keep(at, name, *_widened(low, high, True, True))

    def name_pairs(self, salt: int) -> None:
        """Every left symbol before a right one becomes a pair with it; a symbol that stays alone
        looked at the neighbour on its open side."""
        left = (mixed(self.name, salt) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(left), bool)
        pair[:-1] = left[:-1] & ~left[1:] & ~self.mark[:-1] & ~self.mark[1:]
        second = np.append(False, pair[:-1])
        low, high = _widened(self.low, self.high, ~left & ~second, left & ~pair)
        low[:-1] = np.where(pair[:-1], np.minimum(self.low[:-1], self.low[1:]), low[:-1])
        high[:-1] = np.where(pair[:-1], np.maximum(self.high[:-1], self.high[1:]), high[:-1])
        name = self.name.copy()
        name[:-1] = np.where(pair[:-1], mixed(self.name[:-1] * np.uint64(MULTIPLIER) + self.name[1:], salt), self.name[:-1])
        at = np.flatnonzero(~second)
        self._keep(at, name[at], low[at], high[at])


def _widened(low: np.ndarray, high: np.ndarray, left, right) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined with the whole span of the neighbour to the left and to the right, where asked."""
    lows, highs = low.copy(), high.copy()
    for ask, mine, its in ((left, slice(1, None), slice(None, -1)), (right, slice(None, -1), slice(1, None))):
        asked = np.broadcast_to(ask, low.shape)[mine]
        lows[mine] = np.where(asked, np.minimum(lows[mine], low[its]), lows[mine])
        highs[mine] = np.where(asked, np.maximum(highs[mine], high[its]), highs[mine])
    return lows, highs


def rewritten(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, low, high) of the symbols after the last round that a window can hold with all they looked at."""
    symbols = Symbols(words)
    for r in range(ROUNDS):
        if r in RUN_ROUNDS:
            symbols.name_runs(2 * r + 1)
        symbols.name_pairs(2 * r + 2)
    marks = np.append(0, np.cumsum(~words.is_word))
    fits = (marks[symbols.high] == marks[symbols.low]) & (symbols.high - symbols.low <= WINDOW)
    return symbols.name[fits], symbols.low[fits], symbols.high[fits]


def free_windows(first: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, owners) of the windows that hold none of these spans, in texts of so many words from these places on."""
    size = int(first[-1] + counts[-1]) + 2 if len(first) else 1
    closed = np.zeros(size, np.int64)
    np.add.at(closed, np.maximum(high - WINDOW, 0), 1)
    np.add.at(closed, low + 1, -1)
    fits = np.maximum(counts - WINDOW + 1, 0)
    place = np.repeat(first - np.cumsum(fits) + fits, fits) + np.arange(fits.sum())
    free = np.cumsum(closed)[place] == 0
    return place[free], np.repeat(np.arange(len(fits)), fits)[free]


def _passes(texts: list[bytes]) -> Iterator[slice]:
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= PASS_BYTES:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]), kind))


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row, text) to (id, row, body, n_words, names, low, width): a text's symbols by place, with
    first word and number of words of what they looked at."""
    for batch in batches:
        texts = _texts(batch.column("text"))
        names, lows, widths, counts = [], [], [], [np.zeros(0, np.int64)]
        for some in _passes(texts):
            words = Words(texts[some])
            name, low, high = rewritten(words)
            ends = np.searchsorted(low, np.append(words.first, words.size))
            for first, a, b in zip(words.first, ends, ends[1:]):
                names.append(name[a:b].view(np.int64))
                lows.append(low[a:b] - first)
                widths.append(high[a:b] - low[a:b])
            counts.append(words.counts)
        bodies = [hashlib.sha256(b" ".join(t.split())).digest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("row"), pa.array(bodies, pa.binary()), pa.array(np.concatenate(counts)),
             _lists(names, pa.int64()), _lists(lows, pa.int32()), _lists(widths, pa.int16())],
            ["id", "row", "body", "n_words", "names", "low", "width"])


def _alone(sizes: np.ndarray, shared: list[np.ndarray]) -> np.ndarray:
    """Which symbols of texts of so many are not among the shared ones, given by their places."""
    alone = np.ones(sizes.sum(), bool)
    for begin, places in zip(np.cumsum(sizes) - sizes, shared):
        alone[begin + places] = False
    return alone


def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, as symbols, that have a window without any symbol of theirs alone."""
    for batch in batches:
        counts = batch.column("n_words").to_numpy()
        first = np.cumsum(counts + 1) - counts
        low, width, shared = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "width", "shared"))
        sizes = np.fromiter(map(len, low), np.int64, len(low))
        alone = _alone(sizes, list(shared))
        begin = (np.repeat(first, sizes) + np.concatenate([*low, np.zeros(0, np.int32)]))[alone]
        owners = free_windows(first, counts, begin, begin + np.concatenate([*width, np.zeros(0, np.int16)])[alone])[1]
        keep = pa.array(np.bincount(owners, minlength=len(counts)) > 0)
        yield batch.select(["row", "body", "class", "id", "shared"]).filter(keep)


def open_windows(texts: list[bytes], shared: list[np.ndarray]) -> Iterator[tuple[slice, Words, np.ndarray, np.ndarray]]:
    """(texts of a pass, their words, window places, owners): the windows that hold no symbol of one text only."""
    for some in _passes(texts):
        words = Words(texts[some])
        _, low, high = rewritten(words)
        alone = _alone(np.diff(np.searchsorted(low, np.append(words.first, words.size))), shared[some])
        yield some, words, *free_windows(words.first, words.counts, low[alone], high[alone])


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, id, text, shared) to a row (w1, w2, id, class) for each window of a text that may repeat, once each."""
    for batch in batches:
        texts, ids, kinds = _texts(batch.column("text")), batch.column("id").to_numpy(), batch.column("class").to_numpy()
        for some, words, place, owner in open_windows(texts, list(batch.column("shared").to_numpy(zero_copy_only=False))):
            w1, w2 = words.windows(place, MULTIPLIER), words.windows(place, SECOND)
            order = np.lexsort((w2, w1, owner))
            w1, w2, owner = w1[order], w2[order], owner[order]
            new = np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (owner[1:] != owner[:-1]))[:len(w1)]
            arrays = w1[new].view(np.int64), w2[new].view(np.int64), ids[some][owner[new]], kinds[some][owner[new]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["w1", "w2", "id", "class"])


def removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body, text, repeated windows) to (body, n_removed, kept_sha256, spans of words removed)."""
    for batch in batches:
        out = []
        for body, text, repeated in zip(batch.column("body").to_pylist(), _texts(batch.column("text")), batch.column("repeated").to_pylist()):
            words = Words([text])
            count = int(words.counts[0])
            hashes = words.windows(1 + np.arange(count - WINDOW + 1), MULTIPLIER).view(np.int64)
            places = np.flatnonzero(np.isin(hashes, np.array(repeated, np.int64)))
            edge = np.zeros(count + 1, np.int64)
            np.add.at(edge, places, 1)
            np.add.at(edge, places + WINDOW, -1)
            gone = np.cumsum(edge)[:-1] > 0
            turns = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))).reshape(-1, 2)
            kept = b" ".join(w for w, g in zip(text.split(), gone) if not g)
            out.append((body, int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"begin": a, "end": b} for a, b in turns.tolist()]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*out) if out else [()] * 4, (
                pa.binary(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))))],
            ["body", "n_removed", "kept_sha256", "spans"])


SPANS = "array<struct<begin: bigint, end: bigint>>"


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, row) of every row; spans are ranges of words
    that go, ends exclusive, and `row` is `row_key` of id and text."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(F.col(id_column), F.col(text_column)).alias("row"),
                       F.col(text_column).alias("text"))
    symbols = store(rows.mapInArrow(parsed, "id long, row long, body binary, n_words long, names array<long>, low array<int>, width array<short>"))
    texts = store(symbols.select("id", "row", "body", "n_words"))
    # A null id lies behind all others.
    own = F.coalesce("id", F.lit(LAST))
    ranked = symbols.where(F.col("n_words") >= WINDOW).withColumns({"id": own, "class": F.xxhash64("body")})
    # The class is a second hash of the body: two texts can only be taken for one if they share a symbol too.
    seen = ranked.select("class", F.posexplode("names").alias("at", "name"))
    names = seen.groupBy("name").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("name")
    known = seen.join(names, "name").groupBy("class").agg(F.collect_set("at").alias("shared"))
    classes = store(ranked.groupBy("body").agg(F.min(F.struct("id", "row")).alias("first")))
    asked = (classes.select("body", F.xxhash64("body").alias("class"), "first.*").join(known, "class", "left")
             .withColumn("shared", F.coalesce("shared", F.array().cast("array<int>"))))
    # Copies of a row fold before they move; a shorter text has no window.
    spans = ranked.groupBy("row").agg(*[F.any_value(c).alias(c) for c in ("n_words", "low", "width")])
    left = asked.join(spans, "row").mapInArrow(survivors, "row long, body binary, class long, id long, shared array<int>")
    whole = rows.where(F.octet_length("text") >= 2 * WINDOW - 1).groupBy("row").agg(F.any_value("text").alias("text"))
    held = store(whole.join(left, "row").drop("row"))
    discard(symbols)
    every = store(held.select("class", "id", "text", "shared").mapInArrow(windows, "w1 long, w2 long, id long, class long"))
    # A table of its own, so that adaptive execution can split the join of a hot window.
    least = store(every.groupBy("w1", "w2").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("w1", "w2", "a"))
    gone = every.join(least, ["w1", "w2"]).where("id > a").groupBy("class").agg(F.collect_list("w1").alias("repeated"))
    cut = store(held.select("body", "class", "text").join(gone, "class").select("body", "text", "repeated")
                .mapInArrow(removals, f"body binary, n_removed long, kept_sha256 string, spans {SPANS}"))
    for done in (every, least, held):
        discard(done)
    first = classes.select("body", F.col("first.id").alias("least")).join(cut, "body", "left")
    copy = F.coalesce(own > F.col("least"), F.lit(False))
    all_gone = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end"))).cast(SPANS)
    return texts.join(first, "body", "left").select(
        F.col("id").alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("body")))).alias("kept_sha256"),
        F.when(copy, all_gone).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"), "row")


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with the words that stay, joined by one blank; texts that lose nothing stay as they are."""
    key, spans = "repeat_row", "repeat_spans"
    while {key, spans} & set(docs.columns):
        key, spans = key + "_", spans + "_"
    cut = (repeats(docs, id_column, text_column).where("n_removed > 0")
           .groupBy(F.col("row").alias(key)).agg(F.any_value("spans").alias(spans)))
    words = F.filter(F.split(F.col(f"`{text_column}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: ~F.exists(spans, lambda s: (s["begin"] <= i) & (i < s["end"])))
    text = F.when(F.col(spans).isNull(), F.col(f"`{text_column}`")).otherwise(F.concat_ws(" ", kept))
    return (docs.withColumn(key, F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))).join(cut, key, "left")
            .select(*[text.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns]))
