"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words before every blank, for a BPE model between any two characters that no
piece has side by side, since no merge can join these. Words are counted, and only distinct ones are encoded: their
substrings up to the longest piece are exploded, equi-joined to the piece table, grouped by
word, and folded with Spark's higher-order aggregate. For a unigram model the fold is Viterbi's:
per end position the best path. For a BPE model the best path is not what the model means (its
scores order merges), so the fold takes the lattice's edges in the model's merge order instead:
boundaries are the bits of one number, and each step drops the inner boundary of the best edge
that joins two neighbours. Both give the ids the model's own encoder gives.

Encoded words are then looked up in the texts. The most frequent `DICTIONARY` words are broadcast
as sorted arrays, about 20 bytes each, whatever the corpus; the other words of a text, if
there are any, are joined by their hash and filled in.

Defined cases: a null text gives null ids and decodes to null; an empty text gives none. A
character that no piece has is spelled in bytes. Words of more than `FOLDED` characters, which a
number can't hold, are merged by the same rule in a Python function. Repeated rows are encoded
alike; columns named like a result are replaced. Decoding drops the blank that encoding puts
before a text and reads the sign for blanks in a text as a blank, as the model does.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from .common import ready, store

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words broadcast at most, longest word of the fold.
DICTIONARY, FOLDED = 6_000_000, 62
#: Bytes of a batch of texts, next to which a worker holds the dictionary.
BATCH_BYTES = 4 << 20
#: Words dealt to a task on average, and words whose edges it groups in memory; beyond them it sorts.
TASK_WORDS, GROUPED = 1 << 13, ("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", 1 << 14)
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    """Pieces of a model: (piece, id, score) of the normal ones, ids of bytes, kind and unknown's id."""
    pieces: list[tuple[str, int, float]]
    bytes: list[int]
    kind: int
    unknown: int = 0

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    def ranks(self) -> dict[str, int]:
        """Place of each piece's score, best first; equal scores share a place."""
        place = {s: i for i, s in enumerate(sorted({s for _, _, s in self.pieces}, reverse=True))}
        return {p: place[s] for p, _, s in self.pieces}


def load(path: str = MODEL) -> Model:
    """Reads a model without text normalisation, which byte-fallback models have."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("the model normalises texts, which is not supported")
    pieces = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
    spelled = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
    return Model(pieces, [spelled.get(b, unknown) for b in range(256)], proto.trainer_spec.model_type, unknown)


def words_of(text: str) -> list[str]:
    return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Cutter:
    """Cuts texts into words that are encoded on their own."""

    def __init__(self, model: Model):
        # Neighbours that no word parts; a character's number is its place in the alphabet, 0 for others.
        pairs = {p[i:i + 2] for p, _, _ in model.pieces for i in range(len(p) - 1)} if model.kind == BPE else set()
        letters = {c: i + 1 for i, c in enumerate(sorted({SPACE}.union(*pairs)))}
        self.number = np.zeros(max(map(ord, letters)) + 2, np.uint16)
        self.number[[ord(c) for c in letters]] = list(letters.values())
        self.joined = np.zeros((len(letters) + 1,) * 2, bool)
        if model.kind == BPE:
            for a, b in pairs:
                self.joined[letters[a], letters[b]] = True
        else:
            self.joined[:] = True
            self.joined[0, letters[SPACE]] = False

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts one after the other, and where each text's begin and the last one's end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        blank = pa.scalar(SPACE, pa.large_string())
        marked = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(
            blank, pc.replace_substring(texts, " ", SPACE), pa.scalar("", pa.large_string())))
        begins = np.concatenate(([0], np.cumsum(pc.binary_length(marked).to_numpy(zero_copy_only=False)))).astype(np.int64)
        data = b"".join(marked.cast(pa.large_binary()).to_pylist())
        chars = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        number = self.number[np.minimum(chars, len(self.number) - 1)]
        starts = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
        cut = np.ones(len(chars), bool)
        cut[1:] = ~self.joined[number[:-1], number[1:]]
        cut[np.searchsorted(starts, begins[:-1][np.diff(begins) > 0])] = True
        at = starts[cut]
        ends = np.append(at, len(data)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data)), np.searchsorted(at, begins)


def count_words(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """(word, n) of all texts."""
    cutter = Cutter(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = cutter.words(batch.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], ["word", "n"])

    texts = docs.where(F.length(text_column) > 0).select(F.col(text_column).cast("string"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """(hash, word, n, edges) with all pieces in each word: for a BPE model as numbers of `packed`, which
    sort in merge order, with their ends and the places between them as bits, for a unigram model as (begin, end, id, score)."""
    spark = words.sparkSession
    ranks = model.ranks()
    # The piece table is as large as the model file, and no larger.
    pieces = spark.createDataFrame([(p, i, float(s), ranks[p]) for p, i, s in model.pieces], "piece string, id int, score double, rank int")
    # Words are dealt out once, so that grouping their edges moves nothing; only the first edge of
    # a word carries it, so that the rows to be grouped stay small.
    first = F.col("end") == 1
    tasks = max(1, -(-words.count() // TASK_WORDS))
    dealt = words.select(F.xxhash64("word").alias("hash"), "word", "n", F.char_length("word").alias("size")).repartition(tasks, "hash")
    begun = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("begin"))
    ended = begun.select("*", F.explode(F.sequence(F.col("begin") + 1, F.least(F.col("size"), F.col("begin") + model.longest))).alias("end"))
    spread = ended.select("hash", "word", "n", "begin", "end", F.substring("word", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("piece"))
    inner = (bit(F.col("end")) - 1).bitwiseAND(F.bitwise_not(bit(F.col("begin") + 1) - 1))
    edge = F.struct("begin", "end", "id", "score") if model.kind != BPE else F.struct(
        packed().alias("order"), bit(F.col("begin")).bitwiseOR(bit(F.col("end"))).alias("ends"), inner.alias("inner"))
    rows = spread.join(F.broadcast(pieces), "piece", "left").where(F.col("id").isNotNull() | first).select(
        "hash", F.when(first, F.col("word")).alias("word"), F.when(first, F.col("n")).alias("n"),
        F.when(F.col("id").isNotNull(), edge).alias("edge"))
    return rows.groupBy("hash").agg(F.max("word").alias("word"), F.max("n").alias("n"), F.collect_list("edge").alias("edges"))


def packed() -> Column:
    """An edge as one number: rank, begin and end (6 bits each), id (20 bits)."""
    parts = (("rank", 32), ("begin", 26), ("end", 20), ("id", 0))
    return sum((F.col(c).cast("long") * (1 << shift) for c, shift in parts), F.lit(0).cast("long"))


def begin_of(edge: Column) -> Column:
    return F.shiftright(edge, 26).bitwiseAND(F.lit(63))


def end_of(edge: Column) -> Column:
    return F.shiftright(edge, 20).bitwiseAND(F.lit(63))


def bound(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def merged(edges: Column, size: Column) -> Column:
    """Boundaries, as bits, of a word of up to 62 characters after all merges of a BPE model.

    An edge is dropped once one of its ends is no boundary or nothing between them is one: it can't fit any more.
    """
    joins = F.filter(edges, lambda x: x["inner"] != 0)

    def step(state: Column, _: Column) -> Column:
        mask = state["mask"]
        fit = F.filter(state["joins"], lambda x: F.bit_count(mask.bitwiseAND(x["inner"])) == 1)

        def after(best: Column) -> Column:
            return bound(mask.bitwiseAND(F.bitwise_not(best["inner"])), lambda m: F.struct(m.alias("mask"), F.filter(
                state["joins"], lambda x: (m.bitwiseAND(x["ends"]) == x["ends"]) & (m.bitwiseAND(x["inner"]) != 0)).alias("joins")))

        return F.when(F.size(state["joins"]) == 0, state).otherwise(
            bound(F.array_min(fit), lambda best: F.when(best.isNull(), state).otherwise(after(best))))

    start = F.struct((bit(size + 1) - 1).alias("mask"), joins.alias("joins"))
    # Every turn takes an inner boundary and an edge away.
    most = F.least(size - 1, F.size(joins))
    turns = F.when(most <= 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), most)))
    return F.aggregate(turns, start, step, lambda s: s["mask"])


def spelled(char: Column, model: Model) -> Column:
    """Ids of a character's bytes."""
    table = F.array(*map(F.lit, model.bytes))
    pairs = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.octet_length(char)), lambda i: F.element_at(
        table, F.conv(F.substring(pairs, 2 * i - 1, F.lit(2)), 16, 10).cast("int") + 1))


def ids_of_bounds(edges: Column, mask: Column, word: Column, size: Column, model: Model) -> Column:
    """Ids of the edges from each boundary to the next one; characters without an edge are spelled."""
    id_of = F.lit((1 << 20) - 1)

    def placed(m: Column) -> Column:
        """Begin and id, as one number, of the edges from one boundary to the next."""
        taken = F.filter(edges, lambda x: (m.bitwiseAND(x["ends"]) == x["ends"]) & (m.bitwiseAND(x["inner"]) == 0))
        return F.array_sort(F.transform(taken, lambda x: begin_of(x["order"]) * (1 << 20) + x["order"].bitwiseAND(id_of)))

    def spelling(m: Column, found: Column) -> Column:
        """Where edges are missing the boundaries are single characters."""
        starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: m.bitwiseAND(bit(i)) != 0)

        def of(begin: Column) -> Column:
            here = F.filter(found, lambda x: F.shiftright(x, 20) == begin)
            return bound(here, lambda e: F.when(F.size(e) > 0, F.array(F.get(e, F.lit(0)).bitwiseAND(id_of).cast("int"))).otherwise(
                spelled(F.substring(word, begin + 1, F.lit(1)), model)))

        return F.flatten(F.transform(starts, of))

    def ids(m: Column) -> Column:
        return bound(placed(m), lambda found: F.when(
            F.size(found) == F.bit_count(m) - 1, F.transform(found, lambda x: x.bitwiseAND(id_of).cast("int"))).otherwise(spelling(m, found)))

    return bound(mask, ids)


def viterbi(edges: Column, word: Column, size: Column, model: Model) -> Column:
    """Ids of the path with the largest sum of scores; of equal ones the one whose last piece is longest."""
    low = min(s for _, _, s in model.pieces) - 10.0
    kind = "struct<score:double,ids:array<int>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids")).cast(kind))

    def step(best: Column, end: Column) -> Column:
        here = F.filter(edges, lambda x: x["end"] == end)

        def path(x: Column) -> Column:
            before = F.element_at(best, x["begin"] + 1)
            return F.struct((before["score"] + x["score"]).alias("score"), (-x["begin"]).alias("turn"), F.concat(before["ids"], F.array(x["id"])).alias("ids"))

        last = F.element_at(best, -1)
        bytes_path = F.struct((last["score"] + low).alias("score"), (-(end - 1)).alias("turn"),
                              F.concat(last["ids"], spelled(F.substring(word, end, F.lit(1)), model)).alias("ids"))
        single = F.exists(here, lambda x: x["begin"] == end - 1)
        paths = F.concat(F.transform(here, path), F.when(single, F.array().cast("array<struct<score:double,turn:int,ids:array<int>>>")).otherwise(F.array(bytes_path)))
        top = F.array_max(paths)
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), top["ids"].alias("ids"))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), size), start, step), -1)["ids"]


def merge_long(word: str, ranks: dict[str, int]) -> list[str]:
    """Merge order of a BPE model for a word of any length, with a heap of neighbours."""
    left, right = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    part: list[str | None] = list(word)
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        j = right[i]
        if i >= 0 and j < len(word) and (pair := part[i] + part[j]) in ranks:
            heapq.heappush(heap, (ranks[pair], i, pair))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i]
        if part[i] is None or j >= len(word) or part[i] + part[j] != pair:
            continue
        part[i], part[j] = pair, None
        right[i] = right[j]
        if right[i] < len(word):
            left[right[i]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [p for p in part if p is not None]


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """(hash, n, ids) of distinct words (word, n)."""
    size, short = F.char_length("word"), F.char_length("word") <= FOLDED
    edged = lattice(words.where(short) if model.kind == BPE else words, model)
    if model.kind == BPE:
        folded, ids = edged, ids_of_bounds(F.col("edges"), merged(F.col("edges"), size), F.col("word"), size, model)
    else:
        folded, ids = edged, viterbi(F.col("edges"), F.col("word"), size, model)
    out = folded.select("hash", "n", ids.alias("ids"))
    if model.kind != BPE:
        return out
    ranks, known = model.ranks(), {p: i for p, i, _ in model.pieces}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[i for p in merge_long(w, ranks) for i in ([known[p]] if p in known else [model.bytes[b] for b in p.encode()])]
                   for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int32()))], ["hash", "n", "ids"])

    return out.union(words.where(~short).select(F.xxhash64("word"), "word", "n").mapInArrow(run, "hash long, n long, ids array<int>"))


def spelled_out(ids: Column, width: int) -> Column:
    """Ids as bytes, `width` of them each, the larger ones first."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 2 * width, "0")), ""))


class Dictionary:
    """Ids of words by their hash, in sorted arrays; made of rows (hash, spelled-out ids)."""

    def __init__(self, table: pa.Table, width: int):
        hashes = table.column("hash").to_numpy()
        order = np.argsort(hashes)
        self.hash = hashes[order]
        spelled = pa.concat_arrays([*table.column("spelled").chunks, pa.array([], pa.binary())]).take(pa.array(order))
        _, offsets, data = spelled.buffers()
        start = np.frombuffer(offsets, np.int32)[:len(order) + 1] if len(order) else np.zeros(1, np.int32)
        self.start = (start // width).astype(np.uint32)
        self.ids = np.frombuffer(data or b"", f">u{width}")[:int(self.start[-1])].astype(f"u{width}")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)

    def sizes(self, places: np.ndarray) -> np.ndarray:
        """How many ids the words at these places have; a word without a place has one."""
        if not len(self.hash):
            return np.ones(len(places), np.int64)
        known = np.maximum(places, 0)
        return np.where(places < 0, 1, self.start[known + 1].astype(np.int64) - self.start[known])

    def joined(self, places: np.ndarray) -> np.ndarray:
        """Ids of the words at these places one after the other; a word without a place is a -1."""
        if not len(self.hash):
            return np.full(len(places), -1, np.int32)
        begin = np.where(places < 0, 0, self.start[np.maximum(places, 0)].astype(np.int64))
        size = self.sizes(places)
        shift = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(shift - begin, size)
        out = self.ids[np.minimum(at, len(self.ids) - 1)].astype(np.int32)
        out[shift[places < 0]] = -1
        return out


def dictionary(encoded: DataFrame, most: int, width: int) -> tuple[Dictionary, bool]:
    """(the words of largest counts, at most so many; whether these are all)."""
    shares = encoded.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    total = encoded.count()
    hot = encoded
    if total > most:
        # Counts down to which all words fit; one row for each distinct count is looked at.
        least, words = None, 0
        for row in shares.orderBy(F.desc("n")).toLocalIterator():
            words += row.words
            if words > most:
                break
            least = row.n
        hot = encoded.where(F.lit(False) if least is None else F.col("n") >= least)
    return Dictionary(hot.select("hash", spelled_out(F.col("ids"), width).alias("spelled")).toArrow(), width), total <= most


def encode(docs: DataFrame, model: Model, text_column: str = "text", most: int = DICTIONARY) -> DataFrame:
    """The rows with `ids`."""
    spark = ready(docs.sparkSession)
    names = [c for c in docs.columns if c != "ids"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_column}`").cast("string").alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    counted = store(count_words(rows, model))
    before = spark.conf.get(GROUPED[0])
    spark.conf.set(*GROUPED)
    try:
        encoded = store(encode_words(counted, model))
    finally:
        spark.conf.set(GROUPED[0], before)
    largest = max([i for _, i, _ in model.pieces] + model.bytes)
    hot, whole = dictionary(encoded, most, 2 if largest < 1 << 16 else 4)
    known = spark.sparkContext.broadcast(hot)

    cutter = Cutter(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = known.value
        for batch in batches:
            texts = batch.column(1)
            words, begins = cutter.words(texts)
            told = words.dictionary_encode()
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in told.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64).view(np.int64)
            at = told.indices.to_numpy()
            spots = hot.find(hashes)[at]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(hot.sizes(spots))))[begins], pa.int32()), hot.joined(spots),
                                           mask=texts.is_null())
            lost = np.concatenate(([0], np.cumsum(spots < 0)))[begins]
            missing = pa.ListArray.from_arrays(pa.array(lost, pa.int32()), hashes[at[spots < 0]])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, missing], ["row", "ids", "missing"])

    kind = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())),
                         T.StructField("missing", T.ArrayType(T.LongType()))])
    looked = rows.mapInArrow(run, kind)
    if whole:
        return looked.select("row.*", "ids")
    held = store(looked.withColumn("key", F.xxhash64(F.hash("row"), "ids", "missing")))
    asked = held.where(F.size("missing") > 0).select("key", F.posexplode("missing").alias("place", "hash")).distinct()
    answers = (asked.join(encoded.select("hash", F.col("ids").alias("word")), "hash").groupBy("key")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("words")))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rest = iter(words or [])
                out.append(None if ids is None else [x for i in ids for x in ([i] if i >= 0 else next(rest))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["row", "ids"])

    filled = held.join(answers, "key", "left").select("row", "ids", "words")
    return filled.mapInArrow(fill, T.StructType(kind.fields[:2])).select("row.*", "ids")


def decode(encoded: DataFrame, model: Model, name: str = "decoded") -> DataFrame:
    """The rows with the text of their `ids`; bytes that are no UTF-8 become replacement characters."""
    names = [c for c in encoded.columns if c != name]
    table: dict[int, bytes] = {i: p.replace(SPACE, " ").encode() for p, i, _ in model.pieces}
    table |= {i: bytes([b]) for b, i in enumerate(model.bytes) if i != model.unknown}
    # One constant array of all pieces' bytes in hex, as large as the model.
    spelling = F.from_json(F.lit(json.dumps([table.get(i, b"").hex() for i in range(max(table) + 1)])), "array<string>")
    joined = F.array_join(F.transform("ids", lambda i: F.element_at(spelling, i + 1)), "")
    text = F.make_valid_utf8(F.unhex(joined).cast("string"))
    return encoded.select(*[F.col(f"`{c}`") for c in names], F.regexp_replace(text, "^ ", "").alias(name))
