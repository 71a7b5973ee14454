"""Language identification: averaged hashed subword embeddings and a linear softmax.

Every character n-gram of the folded text picks a row of a hashed embedding table; the mean row
times a weight matrix gives the languages' logits. Both matrices are trained by stochastic
gradient descent in numpy on pieces of all labelled texts, by shards whose weights are averaged after
every round; texts kept out of the training set the temperature that calibrates the softmax. A text is rejected if its calibrated
confidence stays below `reject_below`, that is if the answer is clearly more likely wrong than right, or
if it has no letter.

Since the mean is linear, embeddings and weights fold into one table of logits for each bucket
before texts are scored, so a text costs one lookup per n-gram. All of every text is read.

Defined cases: a text that is null or has no letter gets `und` with score 0 and is rejected; so
does every text if nothing could be learned; rows without a label or a letter teach nothing; ties of logits go to the
first language in alphabetical order; repeated rows are judged alike. Columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codes import GAP, folded
from .common import ready

ORDERS, BITS, WIDTH = (1, 2, 3, 4), 16, 12
#: Folded characters of the pieces that are learned from, and pieces that a shard holds and shuffles.
PIECE, HELD = 512, 1024
#: Passes, or rounds that part the texts if these are more than `SMALL`.
EPOCHS, BATCH, RATE, SMALL = 3, 32, 4.0, 4000
#: Texts of a shard at least, and shards at most; each shard's way is as large as the model.
SHARD_ROWS, SHARDS = 1024, 48
#: One row in `APART` sets the temperature, if there are enough.
APART, LEAST_APART = 5, 50
GRID = np.geomspace(0.02, 50, 60)
#: One in fixed point, largest weight of a way, and names of its components.
FIXED, MOST_MET = 1 << 20, 1 << 24
WAYS = [f"w{i}" for i in range(WIDTH)]
REJECT_BELOW = 0.4
#: Characters of a text that are looked at together.
PART = 1 << 18
UNKNOWN = "und"


def gram_ids(codes: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram from every position; the text is followed by gaps."""
    codes = np.concatenate((codes, np.full(max(ORDERS), GAP, np.uint32)))
    n = len(codes) - max(ORDERS)
    ids, hashed = [], np.zeros(n, np.uint32)
    for order in range(1, max(ORDERS) + 1):
        hashed = hashed * np.uint32(0x01000193) + codes[order - 1:order - 1 + n] + np.uint32(order)
        if order in ORDERS:
            mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            ids.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
    return ids


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray
    temperature: float

    def scores(self, text: str) -> np.ndarray | None:
        """Calibrated probabilities; None if there is nothing to judge."""
        codes, _ = folded(text, digits=False)
        if not len(codes) or not self.languages:
            return None
        total = np.zeros(len(self.languages))
        for a in range(0, len(codes), PART):
            for ids in gram_ids(codes[a:a + PART + max(ORDERS)]):
                total += self.logits[ids[:PART]].sum(axis=0, dtype=np.float64)
        return softmax(total / (len(codes) * len(ORDERS)) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bags(text: str | None, size: int) -> list[np.ndarray]:
    """Buckets of all n-grams of a text, in pieces of so many folded characters."""
    codes = folded(text or "", digits=False)[0]
    found = []
    for begin in range(0, len(codes), PART):
        ids = [i[:PART] for i in gram_ids(codes[begin:begin + PART + max(ORDERS)])]
        end = min(PART, len(codes) - begin)
        found += [np.concatenate([i[at:min(at + size, end)] for i in ids]) for at in range(0, end, size)]
    return found


def means(table: np.ndarray, some: list[np.ndarray]) -> np.ndarray:
    """Mean row of each bag."""
    ones = np.ones(max(map(len, some), default=0), table.dtype)
    return np.array([ones[:len(b)] @ table.take(b, axis=0) / len(b) for b in some])


class Weights:
    """Embeddings of all buckets and, transposed, the languages' weights below them, in one table of rows."""

    def __init__(self, languages: int, seed: int = 7):
        table = np.random.default_rng(seed).normal(0, 0.1, (1 << BITS, WIDTH))
        self.rows = np.concatenate((table, np.zeros((languages, WIDTH)))).astype(np.float32)

    def descend(self, some: list[np.ndarray], target: np.ndarray, weight: np.ndarray, pace: float) -> None:
        """One step for a batch of bags."""
        table, out = self.rows[:1 << BITS], self.rows[1 << BITS:]
        sizes = np.array([len(b) for b in some])
        ids = np.concatenate(some)
        mean = means(table, some)
        error = softmax(mean @ out.T)
        error[np.arange(len(some)), target] -= 1
        error *= weight[target, None]
        pull = np.repeat(error / sizes[:, None], sizes, axis=0)
        gradient = np.stack([np.bincount(ids, p, 1 << BITS) for p in pull.T]).astype(np.float32)
        table -= np.float32(pace) * (gradient.T @ out)
        out -= (pace / len(some) * error.T @ mean).astype(np.float32)

    def logits(self) -> np.ndarray:
        return self.rows[:1 << BITS] @ self.rows[1 << BITS:].T


def losses(raw: np.ndarray, target: np.ndarray | int) -> np.ndarray:
    """Loss of rows of logits for each temperature of the grid, summed."""
    chances = softmax(raw[None].astype(np.float64) / GRID[:, None, None])
    return -np.log(chances[:, np.arange(len(raw)), target] + 1e-12).sum(axis=1)


def evened(counts: np.ndarray) -> np.ndarray:
    """Weights of languages by their counts, so that a rare one counts for more."""
    return 1 / np.sqrt(np.maximum(counts, 1) / counts.sum() * len(counts))


def train(pieces: list[tuple[str, str]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Fits a model to a few (text, language) pieces."""
    some = [(np.concatenate(found), lang) for text, lang in pieces for found in [bags(text, PART)] if found]
    languages = sorted({lang for _, lang in some})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), 1.0)
    target = np.array([languages.index(lang) for _, lang in some])
    weight, weights = evened(np.bincount(target)), Weights(len(languages), seed)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(some))
    apart = len(some) // APART if len(some) >= LEAST_APART else 0
    held, taught = order[:apart], order[apart:]
    for epoch in range(epochs):
        rng.shuffle(taught)
        for at in range(0, len(taught), BATCH):
            batch = taught[at:at + BATCH]
            weights.descend([some[i][0] for i in batch], target[batch], weight, rate * (1 - (epoch + at / len(taught)) / epochs))
    check = held if len(held) else taught
    loss = losses(means(weights.logits(), [some[i][0] for i in check]), target[check])
    return Model(languages, weights.logits(), float(GRID[int(np.argmin(loss))]))


def _taught(start: Weights, languages: list[str], weight: np.ndarray, due: float, begin: float, end: float):
    """Function for mapInArrow: rows (shard, text, lang), all of a shard one after the other, to a row
    for each row of the weights that a shard has moved: how often it was met, and its way in fixed point."""
    place = {lang: i for i, lang in enumerate(languages)}

    def learned(rows: Iterator[tuple[str, str]]) -> pa.RecordBatch:
        own = Weights(0)
        own.rows = start.rows.copy()
        met, rng = np.zeros(len(own.rows), np.int64), np.random.default_rng(7)
        seen, ids, target = 0, [], []

        def step() -> None:
            done = min(1.0, seen / due)
            order, kind = rng.permutation(len(ids)), np.array(target)
            for at in range(0, len(ids), BATCH):
                batch = order[at:at + BATCH]
                own.descend([ids[i] for i in batch], kind[batch], weight, RATE * (1 - begin - (end - begin) * done))
            met[:1 << BITS] += np.bincount(np.concatenate(ids), minlength=1 << BITS)
            met[1 << BITS:] += len(ids)
            ids.clear()
            target.clear()

        for text, lang in rows:
            for bag in bags(text, PIECE):
                ids.append(bag)
                target.append(place[lang])
                if len(ids) == HELD:
                    step()
            seen += 1
        if ids:
            step()
        at = np.flatnonzero(met)
        times = np.minimum(met[at], MOST_MET)
        way = np.rint((own.rows[at] - start.rows[at]).astype(np.float64) * FIXED).astype(np.int64) * times[:, None]
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(times), *map(pa.array, way.T.copy())],
                                          ["at", "times", *WAYS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for _, shard in groupby(rows, key=lambda row: row[0]):
            yield learned((text, lang) for _, text, lang in shard)

    return run


def _calibration(rows: DataFrame, languages: list[str], logits: np.ndarray) -> float:
    """The temperature of least loss over all pieces of the rows (text, lang)."""
    place = {lang: i for i, lang in enumerate(languages)}
    known = rows.sparkSession.sparkContext.broadcast(logits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(GRID), np.int64)
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                raw = means(known.value, bags(text, PIECE))
                if len(raw):
                    total += np.rint(losses(raw, place[lang]) * FIXED).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(GRID))), pa.array(total)], ["t", "loss"])

    loss = rows.select("text", "lang").mapInArrow(run, "t long, loss long").groupBy("t").agg(F.sum("loss").alias("loss"))
    best = loss.orderBy("loss", "t").first()
    return float(GRID[best.t]) if best else 1.0


def learn(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "lang",
          shard_rows: int = SHARD_ROWS) -> Model:
    """Model from all of all labelled texts that have a letter.

    Texts are dealt into shards by hash. In each round every shard goes on from the same weights over
    its own texts of the round, and the ways that the shards moved each row of the weights are averaged
    by how often they met it. Many texts are parted among the rounds, few are gone through in each. Sums are
    of whole numbers, so the model depends on the rows only, not on how tasks hold them.
    """
    spark = ready(labelled.sparkSession)
    turn = F.xxhash64(F.col(id_column), F.col(text_column))
    usable = labelled.where(F.col(label).isNotNull() & F.col(text_column).rlike(r"\p{L}")).select(
        turn.alias("turn"), F.col(text_column).alias("text"), F.col(label).alias("lang"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.ceil(F.length("text") / PIECE)).alias("pieces")).orderBy("lang").collect()
    languages, total = sorted(r.lang for r in counts), sum(r.n for r in counts)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), 1.0)
    pieces = {r.lang: r.pieces for r in counts}
    weight, weights = evened(np.array([pieces[lang] for lang in languages])), Weights(len(languages))
    held = F.pmod("turn", F.lit(APART)) == 0 if total >= LEAST_APART else F.lit(False)
    shards = max(1, min(SHARDS, total // shard_rows))
    # Other bits of the hash deal out shards and rounds.
    mixed = F.xxhash64("turn", F.lit("shard"))
    dealt = usable.where(~held).withColumns({"shard": F.pmod(mixed, F.lit(shards)), "round": F.pmod(F.shiftright(mixed, 32), F.lit(EPOCHS))})
    parted = total > SMALL
    for epoch in range(EPOCHS):
        due = max(1.0, total / shards / (EPOCHS if parted else 1) * (1 - 1 / APART))
        rows = (dealt.where(F.col("round") == epoch) if parted else dealt).repartition(shards, "shard").sortWithinPartitions("shard", "turn", "text", "lang")
        run = _taught(weights, languages, weight, due, epoch / EPOCHS, (epoch + 1) / EPOCHS)
        moved = rows.select("shard", "text", "lang").mapInArrow(run, "at long, times long, " + ", ".join(f"{w} long" for w in WAYS))
        sums = moved.groupBy("at").agg(F.sum("times").alias("times"), *[F.sum(w).alias(w) for w in WAYS]).toArrow()
        at, times, *way = (sums.column(c).to_numpy() for c in ("at", "times", *WAYS))
        if len(at):
            weights.rows[at] += (np.stack(way, axis=1) / times[:, None] / FIXED).astype(np.float32)
    logits = weights.logits()
    apart = usable.where(held) if total >= LEAST_APART else usable
    return Model(languages, logits, _calibration(apart, languages, logits))


def identify(docs: DataFrame, model: Model, text_column: str = "text", reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows with `lang_pred`, `score` and `rejected`."""
    ready(docs.sparkSession)
    own = ("lang_pred", "score", "rejected")
    names = [c for c in docs.columns if c not in own]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(model.scores(t.as_py()) if t.is_valid else None) for t in batch.column(at)]
            best = [None if p is None else int(p.argmax()) for p in found]
            scores = [0.0 if p is None else float(p[b]) for p, b in zip(found, best)]
            langs = [UNKNOWN if b is None else model.languages[b] for b in best]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array([b is None or s < reject_below for b, s in zip(best, scores)])], names=[*names, *own])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return kept.mapInArrow(run, schema)


def held_out(id_column: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id's text leaves the remainder that learning must not see; a row
    without an id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == part, F.lit(True))


def keep_known(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows whose language is known with confidence, with the columns they came with."""
    names = docs.columns
    spare = "identified"
    while spare in names:
        spare += "_"
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(spare), F.col(f"`{text_column}`").alias("text"))
    return identify(whole, model).where("NOT rejected").select(f"`{spare}`.*")
