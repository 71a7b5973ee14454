"""Operational views: ingestion lag, consumer lag, lateness, dependencies."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import running_max

RECENT_MS = 300_000


def ingestion_lag(rows: DataFrame, now: int, arrival: str = "ingested_at") -> DataFrame:
    """Age of the newest row and rows of the last five minutes; no row, no lag."""
    last = F.max(arrival)
    return rows.agg(F.count("*").alias("rows"), (F.lit(now).cast("long") - last).alias("lag_ms"),
                    F.count_if(F.col(arrival) >= now - RECENT_MS).alias("recent"))


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Summed lag per (topic, group); unknown as soon as one partition is unknown."""
    behind = F.greatest(F.lit(0).cast("long"), F.col("end_offset") - F.col("committed"))
    known = F.count_if(F.col("end_offset").isNotNull() & F.col("committed").isNotNull())
    return offsets.groupBy("topic", "group").agg(
        F.when(F.count("*") == known, F.sum(behind)).alias("lag"))


def with_lateness(events: DataFrame) -> DataFrame:
    """How far each event lags behind the newest event seen on its host, in arrival order."""
    seen = running_max(events.select("host", "type", "seq", "ts"), ["host"], "seq", "ts", "seen")
    return seen.withColumn("lateness", F.col("seen") - F.col("ts"))


def lateness_percentiles(late: DataFrame) -> DataFrame:
    """Exact percentiles per type: rows fold to one count for each type and lateness, and only
    these counts are summed up in order."""
    counts = late.groupBy("type", "lateness").agg(F.count(F.lit(1)).alias("n"))
    by_type = Window.partitionBy("type")
    below = F.sum("n").over(by_type.orderBy("lateness").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"below": below, "events": F.sum("n").over(by_type)})

    def percentile(share: float) -> Column:
        return F.min(F.when(F.col("below") >= share * F.col("events"), F.col("lateness")))

    return ranked.groupBy("type").agg(
        F.sum("n").alias("events"), F.sum(F.when(F.col("lateness") > 1500, F.col("n")).otherwise(0)).alias("late"),
        *[percentile(p / 100).alias(f"p{p}") for p in (50, 95, 99)])


def dependency_status(checks: DataFrame) -> DataFrame:
    """Up when any check has no error, otherwise down with the first error."""
    up = F.bool_or(F.col("error").isNull())
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq")))
    return checks.groupBy("dependency").agg(
        F.when(up, "UP").otherwise("DOWN").alias("status"),
        F.when(~up, first).alias("error"))
