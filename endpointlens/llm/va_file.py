"""Exact top-k inner products by a vector-approximation file.

Every component is quantised to one of 2**bits cells of equal width, so a vector's approximation is
one byte a dimension. A first pass scans only approximations: a query's inner product with the cell
centres is off by at most the smaller of sum |q_d| * half width and |q| * |x - centre|, which gives
a lower and an upper bound for every vector. The k-th largest lower bound over all blocks is a
floor that the k-th score can't miss. A second pass over the blocks reads exact vectors in the order of their
upper bounds until the next bound is below the floor or the k-th exact score seen; then the
block's answer is certain. The best k of the blocks' answers are the result.

Queries and vectors meet in blocks of fixed size, so a task holds one block of each.

Defined cases: a vector that is null, has no id, or holds a null, NaN or infinite component takes
no part; shorter vectors count as padded with zeros; equal rows are taken once; a row never is a
candidate of a query with its own id; scores tie to the smaller id. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, store

BITS = 5
#: Vectors and queries of a block, and queries whose bounds a task holds at once.
VECTORS, QUERIES, SLICE = 16384, 8192, 128
#: Exact vectors read at a time while the answer is still open.
READ = 256
#: Answers of so many blocks are merged at a time.
MERGE = 256


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows of one matrix, padded with zeros."""
    rows = column.to_numpy()
    if not len(rows):
        return np.zeros((0, width), np.int64)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.zeros((len(rows), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.concatenate(rows)
    return out


class Cells:
    """Integer cells of equal width between each dimension's least and largest value."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        self.low = low
        self.width = np.maximum(1, -(-(high - low + 1) // (1 << bits)))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def centres(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes * self.width + (self.width - 1) / 2

    def bounds(self, queries: np.ndarray, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores: a row for each query, a column for each vector."""
        about = queries @ self.centres(codes).T
        by_cell = (np.abs(queries) @ ((self.width - 1) / 2))[:, None]
        by_norm = np.linalg.norm(queries, axis=1)[:, None] * off[None, :]
        slack = np.minimum(by_cell, by_norm * (1 + 1e-6)) + np.abs(about) * 1e-9
        return about - slack, about + slack


def _codes_of(block: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(-1, width)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, bits: int = BITS,
          block: int = VECTORS, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of every query row.

    `vectors` has `vec_id` and the integer array `vector`; `is_query` is a condition on vec_id.
    """
    spark = ready(vectors.sparkSession)
    rows = vectors.where("vec_id IS NOT NULL AND vector IS NOT NULL").select("vec_id", "vector").distinct()
    # Of equal vectors only the k + 1 smallest ids can be among the best of any query.
    copies = Window.partitionBy("vector").orderBy("vec_id")
    kept = store(rows.withColumn("copy", F.row_number().over(copies)).withColumn("asks", is_query)
                 .where((F.col("copy") <= k + 1) | F.col("asks"))
                 .withColumn("answers", F.col("copy") <= k + 1))
    extent = kept.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(
        F.min("x").alias("low"), F.max("x").alias("high")).orderBy("d").collect()
    width = len(extent)
    # A vector that stops short is padded with zeros, so zero is within every cell's reach.
    low = np.array([min(r.low, 0) for r in extent], np.int64)
    cells = Cells(low, np.array([max(r.high, 0) for r in extent], np.int64), bits)
    counts = kept.agg(F.count_if("answers"), F.count_if("asks")).first()
    blocks, query_blocks = (max(1, -(-n // size)) for n, size in zip(counts, (block, query_block)))

    def approximate(batches):
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            exact = _matrix(whole.column("vector"), width)
            codes = cells.codes(exact)
            off = np.linalg.norm(exact - cells.centres(codes), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)],
                ["vec_id", "code", "off"])

    def spread(ids: str, own: int, other: int, names: list[str]):
        """Rows of a side with their own block and one copy for each block of the other side."""
        mine, its = names
        return [F.pmod(F.xxhash64(ids), F.lit(own)).cast("int").alias(mine),
                F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(its)]

    answers = kept.where("answers")
    file = store(answers.select("vec_id", "vector").mapInArrow(approximate, "vec_id long, code binary, off double"))
    asks = store(kept.where("asks").select(F.xxhash64("vec_id", "vector").alias("ask"), F.col("vec_id").alias("query_id"), "vector"))

    def floors(queries: pa.Table, part: pa.Table) -> pa.Table:
        ask, theirs = _matrix(queries.column("vector"), width), queries.column("query_id").to_numpy()
        codes, ids, off = _codes_of(part, width), part.column("vec_id").to_numpy(), part.column("off").to_numpy()
        found = []
        for at in range(0, len(ask), SLICE):
            lower, _ = cells.bounds(ask[at:at + SLICE], codes, off)
            lower[theirs[at:at + SLICE, None] == ids[None, :]] = -np.inf
            if lower.shape[1] > k:
                lower = np.partition(lower, lower.shape[1] - k, axis=1)[:, -k:]
            found += [row[np.isfinite(row)].tolist() for row in lower]
        return pa.table({"ask": queries.column("ask"), "part": pa.array(
            np.full(len(ask), part.column("v")[0].as_py() if len(ids) else 0), pa.int32()),
            "lower": pa.array(found, pa.list_(pa.float64()))})

    parted = asks.select("*", *spread("ask", query_blocks, blocks, ["q", "v"]))
    merged = (parted.groupBy("q", "v").cogroup(file.select("*", *spread("vec_id", blocks, query_blocks, ["v", "q"])).groupBy("q", "v"))
              .applyInArrow(floors, "ask long, part int, lower array<double>"))
    left = blocks
    while True:
        left = -(-left // MERGE)
        merged = merged.groupBy("ask", F.floor(F.col("part") / MERGE).cast("int").alias("part")).agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("lower")), asc=False), 1, k).alias("lower"))
        if left == 1:
            break
    floor = store(merged.select("ask", F.when(F.size("lower") >= k, F.element_at("lower", -1)).alias("floor")))

    def search(queries: pa.Table, part: pa.Table) -> pa.Table:
        ask, theirs = _matrix(queries.column("vector"), width), queries.column("query_id").to_numpy()
        least = queries.column("floor").to_numpy(zero_copy_only=False).astype(float)
        exact, ids = _matrix(part.column("vector"), width), part.column("vec_id").to_numpy()
        codes, off = _codes_of(part, width), part.column("off").to_numpy()
        out = []
        for at in range(0, len(ask), SLICE):
            _, upper = cells.bounds(ask[at:at + SLICE], codes, off)
            upper[theirs[at:at + SLICE, None] == ids[None, :]] = -np.inf
            for i, bound in enumerate(upper):
                out.append(_best(ask[at + i], bound, least[at + i], exact, ids, k))
        asked = np.repeat(np.arange(len(ask)), [len(a) for a, _ in out]) if out else np.zeros(0, int)
        return pa.table({"ask": queries.column("ask").take(pa.array(asked)),
                         "query_id": pa.array(theirs[asked], pa.int64()),
                         "vec_id": pa.array(np.concatenate([a for a, _ in out] or [[]]).astype(np.int64)),
                         "score": pa.array(np.concatenate([s for _, s in out] or [[]]).astype(np.int64))})

    exact = file.join(answers.select("vec_id", "vector"), "vec_id").select(
        "*", *spread("vec_id", blocks, query_blocks, ["v", "q"]))
    asked = asks.join(floor, "ask", "left").select("*", *spread("ask", query_blocks, blocks, ["q", "v"]))
    found = (asked.groupBy("q", "v").cogroup(exact.groupBy("q", "v"))
             .applyInArrow(search, "ask long, query_id long, vec_id long, score long"))
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _best(query, upper, floor, exact, ids, k) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of a block's best k, reading exact vectors by falling upper bound."""
    least = -np.inf if np.isnan(floor) else floor
    at = np.flatnonzero((upper >= least) & (upper > -np.inf))
    at = at[np.argsort(-upper[at], kind="stable")]
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(at), READ):
        if len(best) >= k and upper[at[i]] < best[-1]:
            break
        read = at[i:i + READ]
        best_ids, best = np.concatenate((best_ids, ids[read])), np.concatenate((best, exact[read] @ query))
        order = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[order], best[order]
    return best_ids, best
