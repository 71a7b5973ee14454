"""Centroid clustering with heap-ordered bounds, exact over integers.

Vectors lie in blocks, each with one heap for every cluster. When a vector is scanned against all
centroids, the gap between its distances to the second nearest and the nearest one enters the heap
of its cluster, raised by that cluster's accumulated drift. A round adds to a cluster's drift how far
its own centroid moved plus the farthest that any other did. As long as a key is above the drift, no
other centroid can have come as near as the vector's own, so only keys that the drift has reached
are popped and their vectors scanned exactly. Distances of a scan are integers; bounds leave room for
rounding, so the assignment equals that of a full scan at every round.

Blocks are written once, bucketed by their number. The heaps, some twelve bytes a vector, are
bucketed alike and rewritten every round, so blocks meet their heaps without a shuffle. A round
sends the driver nothing but sums of moved vectors: one number for each cluster and component.

Defined cases: vectors must share one width; a null vector takes no part; components are held
within +-2**26, so that distances fit a long; a null id is kept and never is a first centroid;
repeated rows count each; of equal distances the smaller cluster number wins; of ids that repeat
the smaller vector is the earlier first centroid; with fewer vectors than clusters there are fewer
clusters; an empty table gives no rows; an inertia beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_folder
from .common import new_folder, ready, store

#: Vectors of a block, and the largest component.
BLOCK, REACH = 4096, 1 << 26
#: Relative room for rounding in distances and drifts.
SLACK = 1e-11
HEAPS = "block long, sizes array<int>, keys binary, members binary, moved array<long>"


def _rows(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.clip(flat, -REACH, REACH).astype(np.int32).reshape(-1, width)


def packed(batches: Iterator[pa.RecordBatch], width: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, vector) as rows of whole blocks."""
    ids, vectors, held = [], [], 0

    def out():
        whole = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole),
             pa.array([np.concatenate(vectors).tobytes()], pa.binary())], ["ids", "matrix"])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, block - held)
            ids.append(part.column(0))
            vectors.append(_rows(part.column(1), width))
            held, at = held + part.num_rows, at + part.num_rows
            if held == block:
                yield out()
                ids, vectors, held = [], [], 0
    if held:
        yield out()


class Centroids:
    """Centroids of a round and the drift that each cluster's heap has to reach."""

    def __init__(self, places: np.ndarray, drift: np.ndarray):
        self.places, self.drift = places, drift

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """Exact squared distances: a row for each vector, a column for each centroid."""
        rows = rows.astype(np.int64)
        return np.stack([np.square(rows - c).sum(axis=1) for c in self.places], axis=1)

    def scan(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids and the keys of the vectors in their heaps."""
        squared = self.distances(rows)
        nearest = squared.argmin(axis=1)
        at = np.arange(len(rows))
        near = np.sqrt(squared[at, nearest].astype(float))
        if len(self.places) == 1:
            return nearest, np.full(len(rows), np.inf)
        squared[at, nearest] = np.iinfo(np.int64).max
        second, base = np.sqrt(squared.min(axis=1).astype(float)), self.drift[nearest]
        return nearest, base + (second - near) - SLACK * (base + second + near)

    def moved(self, totals: np.ndarray, counts: np.ndarray) -> "Centroids":
        """Means rounded down and the drift after the move; an empty cluster stays."""
        places = np.array([[int(s) // int(n) for s in row] if n else old.tolist()
                           for row, n, old in zip(totals, counts, self.places)], np.int64)
        steps = [math.sqrt(sum(int(x) ** 2 for x in a - b)) * (1 + SLACK) for a, b in zip(places, self.places)]
        others = [max(steps[:j] + steps[j + 1:], default=0.0) for j in range(len(steps))]
        return Centroids(places, self.drift + np.array(steps) + np.array(others))


class Heaps:
    """A block's heaps of (key, vector), one for each cluster."""

    def __init__(self, heaps: list[list[tuple[float, int]]]):
        self.heaps = heaps

    @classmethod
    def read(cls, sizes: list[int], keys: bytes, members: bytes) -> "Heaps":
        every = list(zip(np.frombuffer(keys).tolist(), np.frombuffer(members, np.int32).tolist()))
        ends = np.cumsum([0, *sizes]).tolist()
        return cls([every[a:b] for a, b in zip(ends, ends[1:])])

    def write(self) -> tuple[list[int], bytes, bytes]:
        every = [entry for heap in self.heaps for entry in heap]
        return ([len(h) for h in self.heaps], np.array([k for k, _ in every], float).tobytes(),
                np.array([i for _, i in every], np.int32).tobytes())

    def expired(self, drift: np.ndarray) -> tuple[list[int], list[int]]:
        """Pops the vectors whose key the drift has reached: (vectors, their clusters)."""
        popped, owner = [], []
        for j, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[j]:
                popped.append(heapq.heappop(heap)[1])
                owner.append(j)
        return popped, owner

    def push(self, vectors: list[int], clusters: np.ndarray, keys: np.ndarray) -> None:
        for i, j, key in zip(vectors, clusters.tolist(), keys.tolist()):
            heapq.heappush(self.heaps[j], (key, i))

    def clusters(self) -> np.ndarray:
        out = np.zeros(sum(map(len, self.heaps)), np.int32)
        for j, heap in enumerate(self.heaps):
            out[[i for _, i in heap]] = j
        return out


def assign(heaps: Heaps | None, rows: np.ndarray, centroids: Centroids) -> tuple[Heaps, np.ndarray]:
    """Heaps after a round, and what it adds to each cluster's sums, with the count as last column."""
    k, width = centroids.places.shape
    moved = np.zeros((k, width + 1), np.int64)
    if heaps is None:
        heaps, popped, owner = Heaps([[] for _ in range(k)]), list(range(len(rows))), None
    else:
        popped, owner = heaps.expired(centroids.drift)
    if popped:
        seen = rows[popped]
        nearest, keys = centroids.scan(seen)
        heaps.push(popped, nearest, keys)
        whole = np.concatenate((seen, np.ones((len(seen), 1), np.int32)), axis=1).astype(np.int64)
        before = np.full(len(seen), -1) if owner is None else np.array(owner)
        for j in range(k):
            moved[j] = whole[(nearest == j) & (before != j)].sum(axis=0) - whole[(before == j) & (nearest != j)].sum(axis=0)
    return heaps, moved


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors whose salted ids have the smallest hashes."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").select(order.alias("at"), "vector").orderBy("at", "vector").limit(k).collect()
    return np.clip(np.array([r.vector for r in rows], np.int64), -REACH, REACH)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3", block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector.

    `vectors` has `vec_id` and the integer array `vector`.
    """
    spark = ready(vectors.sparkSession)
    rows = vectors.where("vector IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    places = first_centroids(rows, k, salt)
    if not len(places):
        # Without any id there is no first centroid.
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    width = places.shape[1]
    tables = _Bucketed(spark, -(-rows.count() // block))
    blocks = tables.write(rows.mapInArrow(lambda batches: packed(batches, width, block), "ids array<long>, matrix binary")
                          .withColumn("block", F.monotonically_increasing_id()), spread=True)
    centroids, totals, heaps = Centroids(places, np.zeros(len(places))), np.zeros((len(places), width + 1), object), None
    for _ in range(rounds):
        after = tables.write(_meet(blocks.select("block", "matrix"), heaps).mapInArrow(_round(centroids), HEAPS))
        tables.drop(heaps)
        heaps = after
        totals = totals + _moved(heaps, totals.shape)
        centroids = centroids.moved(totals[:, :-1], totals[:, -1])
    found = store(_meet(blocks, heaps).mapInArrow(_last(centroids), "vec_id long, cluster int, distance long"))
    tables.drop(heaps)
    tables.drop(blocks)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.places.tolist()]
    # One row for each cluster.
    about = spark.createDataFrame([(j, fits(sums.get(j, 0)), fits(sum(sums.values())), d) for j, d in enumerate(digests)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


class _Bucketed:
    """Tables of one run, bucketed by block so that their joins need no shuffle."""

    def __init__(self, spark: SparkSession, blocks: int):
        self.spark = spark
        self.buckets = max(1, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self.paths: dict[int, tuple[str, str]] = {}

    def write(self, df: DataFrame, spread: bool = False) -> DataFrame:
        name, path = f"endpointlens_{uuid4().hex}", new_folder(self.spark)
        dealt = df.repartition(self.buckets, "block") if spread else df
        dealt.write.bucketBy(self.buckets, "block").option("path", path).format("parquet").saveAsTable(name)
        table = self.spark.table(name)
        self.paths[id(table)] = name, path
        return table

    def drop(self, table: DataFrame | None) -> None:
        if table is not None:
            name, path = self.paths.pop(id(table))
            self.spark.sql(f"DROP TABLE {name}")
            remove_folder(self.spark, path)


def _meet(blocks: DataFrame, heaps: DataFrame | None) -> DataFrame:
    """Blocks with their heaps, which are the side held in memory: a bucket's share of them."""
    return blocks if heaps is None else blocks.join(heaps.drop("moved").hint("shuffle_hash"), "block")


def _held(batch: pa.RecordBatch, i: int, centroids: Centroids) -> tuple[Heaps | None, np.ndarray]:
    get = lambda name: batch.column(name)[i].as_py()
    rows = np.frombuffer(get("matrix"), np.int32).reshape(-1, centroids.places.shape[1])
    known = "keys" in batch.schema.names
    return Heaps.read(get("sizes"), get("keys"), get("members")) if known else None, rows


def _round(centroids: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                heaps, moved = assign(*_held(batch, i, centroids), centroids)
                row = (batch.column("block")[i].as_py(), *heaps.write(), moved.ravel().tolist())
                kinds = pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)],
                                                 ["block", "sizes", "keys", "members", "moved"])
    return run


def _last(centroids: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                heaps, rows = _held(batch, i, centroids)
                nearest = assign(heaps, rows, centroids)[0].clusters()
                squared = np.square(rows - centroids.places[nearest]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(nearest), pa.array(squared)],
                                                 ["vec_id", "cluster", "distance"])
    return run


def _moved(heaps: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sums over all blocks of what a round moved, exact."""
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1], np.int64)
        for batch in batches:
            total += batch.column(0).flatten().to_numpy().reshape(-1, len(total)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "s"])

    sums = (heaps.select("moved").mapInArrow(folded, "at int, s long")
            .groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    out = np.zeros(shape[0] * shape[1], object)
    for r in sums:
        out[r["at"]] = int(r["s"])
    return out.reshape(shape)
