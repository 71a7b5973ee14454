"""Helpers shared by the training-data operators."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Bytes and rows of one Arrow batch, so that a worker's memory does not follow the length of the texts.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 2000
#: Whether a query's shuffle files are deleted when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Links from which on the minima of a round of `components` are stored before they are joined.
STORED_LINKS = 1_000_000


def ready(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes as well as rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A fresh path below the folder that all executors share."""
    return f"{shared_folder(spark)}/endpointlens-llm/{spark.sparkContext.applicationId}/{uuid4().hex}"


def store(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: lineage ends there, and an
    executor that is lost costs nothing but the tasks it was running. What the job shuffled goes with
    its end, not with some later collection of garbage, so disks hold the shuffles of one job only."""
    spark = df.sparkSession
    path = new_folder(spark)
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    again = spark.read.schema(df.schema).parquet(path)
    again._stored_at = path
    return again


def discard(df: DataFrame) -> None:
    """Deletes a table of `store` that nothing reads any more."""
    if not hasattr(df, "_stored_at"):
        return
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def row_key(id_column: str, text_column: str) -> Column:
    """Names a row by its id and its text, so that null or repeated ids do no harm."""
    return F.xxhash64(F.col(id_column), F.col(text_column))


def components(links: DataFrame) -> DataFrame:
    """Connected components of the undirected links (a, b): one row (node, root) for every node
    but the roots, where the root is the smallest node of its component.

    Alternates large-star and small-star rounds, so the number of rows never exceeds the number
    of links and rounds grow with the logarithm of the size. Folds combine before their shuffle;
    the minima are stored before they are joined, so that adaptive execution can split the rows
    of a hub.
    """
    edges = store(links.where("a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select("lo", "hi"))
        # Only large folds are worth a table of their own.
        keep = store if mark[0] > STORED_LINKS else lambda folded: folded
        least = keep(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = store(both.where("v > u").join(least, "u")
                      .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        lowest = keep(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = (large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .union(lowest.select("hi", "m")).distinct())
        after = store(small)
        for done in (edges, least, large, lowest):
            discard(done)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Size and an order-free digest, to see that a round has changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("hi", "lo").cast("long")),
                           F.bit_xor(F.xxhash64("lo", "hi"))).first())
