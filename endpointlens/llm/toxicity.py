"""Toxicity by maximum-scoring segments.

A word's score is its log-odds between toxic and other labelled texts under a Dirichlet prior that
follows the words of both, shrunk by its own standard error, less a constant that makes ordinary text
lose. One linear scan of a text's word scores finds every maximal segment of positive total; the
extreme-value law of local scores turns each into the number of such segments expected by chance
in a text of that length, exp(ln K + ln n - lambda * S). Segments below a significance level are
the text's toxic passages; how unlikely the best one is, and all of them together, is mapped to the
probability of the label by a logistic regression. Words count once in a text, since a text repeats its words.

Words are hashed into a table of fixed size, so what is broadcast doesn't grow with the
vocabulary. Labels come from a bounded sample, all other figures from all labelled rows; the
calibration is fitted on scores that each half of the sample gets from the other half's counts.

Defined cases: a null or empty text, or one without words, scores as a text without segments;
labels that are null teach nothing; of several labels of an id the larger counts; with labels of
one kind only, or none, the score is the share of toxic labels. Repeated rows are judged alike.
Columns named like a result are replaced. Passages are character offsets into the text as given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codes import folded, words
from .common import ready

#: Buckets of words, as a power of two.
BITS = 20
#: Labelled rows to learn from, of either label.
SAMPLE = 25_000
#: Words that the prior is worth, the least of any word, standard errors a score is shrunk by, cost
#: of an ordinary word.
PRIOR, FLOOR, SHRINK, COST = 500.0, 0.5, 1.5, 0.7
SIGNIFICANT, PREDICT = 0.01, 0.3
PASSAGE = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()),
                                    T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))


def buckets(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, begin, end) of every word of a text."""
    codes, at = folded(text or "")
    hashed, begin, end = words(codes)
    if not len(hashed):
        return begin, begin, begin
    return (hashed >> np.uint64(64 - BITS)).astype(np.int64), at[begin], at[end - 1] + 1


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(begin, end, score) of all maximal scoring segments, in order of place.

    Only positive words can begin or end a segment, so the scan runs over these; each candidate
    remembers the nearest earlier one with a lower sum before it, which keeps the scan linear.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []
    for i in np.flatnonzero(scores > 0).tolist():
        begin, low, high = i, total[i], total[i + 1]
        back = len(found) - 1
        while True:
            while back >= 0 and found[back][2] >= low:
                back = found[back][4]
            if back < 0 or found[back][3] >= high:
                del found[len(found):]
                found.append([begin, i + 1, low, high, back])
                break
            begin, low = found[back][0], found[back][2]
            after = found[back][4]
            del found[back:]
            back = after
    return [(a, b, high - low) for a, b, low, high, _ in found]


@dataclass
class Model:
    score: np.ndarray
    rate: float
    log_k: float
    base: float
    weights: np.ndarray | None = None

    def expected(self, score: float, n: int) -> float:
        """Segments of at least this score that chance puts into n words."""
        return float(np.exp(min(50.0, self.log_k + np.log(max(n, 1)) - self.rate * score)))

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """(score of the text, its significant passages)."""
        bucket, begin, end = buckets(text)
        chance, passages = [], []
        for a, b, s in segments(self.score[bucket]):
            expected = self.expected(s, len(bucket))
            chance.append(expected)
            if expected <= SIGNIFICANT:
                passages.append((int(begin[a]), int(end[b - 1]), float(s), expected))
        if self.weights is None:
            return self.base, passages
        return float(1 / (1 + np.exp(-features(chance) @ self.weights))), passages


def features(expected: list[float]) -> np.ndarray:
    """Of a text's segments: how unlikely the best one is, and all of them that are unlikely."""
    unlikely = np.sort(np.maximum(0.0, -np.log(np.array([1.0, *expected]) + 1e-18)))
    return np.array([1.0, unlikely[-1] / 10, np.log1p(unlikely.sum())])


def word_scores(toxic: np.ndarray, other: np.ndarray, base: float) -> Model:
    """Word scores of two arrays of counts of texts with the word, with the law of their local maxima."""
    both = toxic + other
    prior = np.maximum(FLOOR, PRIOR * both / max(1, both.sum()))
    t, o = toxic + prior, other + prior
    n_t, n_o = toxic.sum() + PRIOR, other.sum() + PRIOR
    odds = np.log(t / (n_t - t)) - np.log(o / (n_o - o))
    error = np.sqrt(1 / t + 1 / o)
    score = np.sign(odds) * np.maximum(0, np.abs(odds) - SHRINK * error) - COST
    share = np.where(both > 0, o, 0)
    share = share / max(share.sum(), 1e-9)
    # The rate of the law is the positive root of E[exp(rate * score)] = 1.
    if not (score > 0).any():
        return Model(score, 1.0, 0.0, base)
    low, high = 1e-6, 1.0
    while share @ np.exp(np.minimum(700, high * score)) < 1:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if share @ np.exp(np.minimum(700, middle * score)) < 1 else (low, middle)
    return Model(score, high, 0.0, base)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-3] * (x.shape[1] - 1)) * weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)),
                               x.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from `docs` (doc_id, text) and `labels` (doc_id, toxic): counts of a bounded sample
    of labelled rows, the share of toxic labels from all of them."""
    spark = ready(docs.sparkSession)
    truth = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("toxic"))
    totals = {r.toxic: r.n for r in truth.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = totals.get(1, 0) / max(1, sum(totals.values()))
    drawn = [r for y in (0, 1) for r in truth.where(F.col("toxic") == y).orderBy(
        F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(sample).collect()]
    if not totals.get(1) or not totals.get(0):
        return Model(np.full(1 << BITS, -COST), 1.0, 0.0, base)
    chosen = spark.createDataFrame(drawn, truth.schema)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    used = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", half.alias("half"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((4, 1 << BITS), np.int64)
        for batch in batches:
            for toxic, half, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts[2 * half + toxic][np.unique(buckets(text)[0])] += 1
        for kind, row in enumerate(counts):
            at = np.flatnonzero(row)
            for part in np.array_split(at, -(-len(at) // 100_000) or 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind), pa.int32()), pa.array(part, pa.int32()),
                                                  pa.array(row[part], pa.int64())], ["kind", "bucket", "n"])

    counts = np.zeros((4, 1 << BITS))
    summed = used.mapInArrow(count, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toArrow()
    np.add.at(counts, (found.column(0).to_numpy(), found.column(1).to_numpy()), found.column(2).to_numpy())
    halves = [word_scores(counts[2 * h + 1], counts[2 * h], base) for h in (0, 1)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for toxic, half, text in zip(*(c.to_pylist() for c in batch.columns)):
                model = halves[1 - half]
                bucket, _, _ = buckets(text)
                found = sorted((s for _, _, s in segments(model.score[bucket])), reverse=True)
                rows.append((toxic, half, len(bucket), found))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())))],
                ["toxic", "half", "n", "scores"])

    # A row for each sampled text, with its segments' scores only.
    table = used.mapInArrow(measure, "toxic int, half int, n long, scores array<double>").toArrow().to_pylist()
    if not table:
        return Model(np.full(1 << BITS, -COST), 1.0, 0.0, base)
    whole = word_scores(counts[1] + counts[3], counts[0] + counts[2], base)
    for h in (0, 1):
        halves[h].log_k = location(halves[h], [r for r in table if r["half"] == 1 - h])
    whole.log_k = location(halves[0], table) if len(table) < 2 else (halves[0].log_k + halves[1].log_k) / 2
    x, y = [], []
    for r in table:
        model = halves[1 - r["half"]]
        expected = [model.expected(s, r["n"]) for s in r["scores"]]
        x.append(features(expected))
        y.append(r["toxic"])
    y = np.array(y)
    if 0 < y.mean() < 1:
        # The sample may hold one label more than its share; weights undo that.
        weight = np.where(y == 1, base / y.mean(), (1 - base) / (1 - y.mean()))
        whole.weights = logistic(np.array(x), y, weight)
    return whole


def location(model: Model, rows: list[dict]) -> float:
    """ln K: from the mean of the best scores of texts that are not toxic, which under the
    extreme-value law is (ln K + ln n + Euler's constant) / rate; never so low that less than the usual is expected."""
    best = [model.rate * r["scores"][0] - np.log(max(r["n"], 1)) for r in rows if not r["toxic"] and r["scores"]]
    share = len(best) / max(1, sum(not r["toxic"] for r in rows))
    if not best:
        return -3.0
    # Texts without any segment stand for the law's lower part.
    return float(np.clip(np.mean(best) - 0.5772 + np.log(max(share, 1e-3)), -8, 2))


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows with `score`, `predicted` and `passages` (begin, end, score, expected by chance)."""
    ready(docs.sparkSession)
    own = ("score", "predicted", "passages")
    names = [c for c in docs.columns if c not in own]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text_column)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            found = [model.judge(t.as_py()) for t in batch.column(at)]
            scores = [s for s, _ in found]
            passages = [[dict(zip(("begin", "end", "score", "expected"), p)) for p in ps] for _, ps in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= PREDICT) for s in scores], pa.int32()),
                 pa.array(passages, kind)], names=[*names, *own])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType()), T.StructField("passages", PASSAGE)])
    return kept.mapInArrow(run, schema)
