"""Nearest-in-time joins built from equi joins and bounded windows.

The right side is first folded to one row per (keys, millisecond). Both sides are then cut into
time buckets as wide as the look-back, so a window group holds at most two buckets' worth of
milliseconds however many rows one key has. The result is joined back by (keys, ts), a join
whose right side is unique, which adaptive execution can split when one key is hot.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CARRY_BUCKET_MS = 3_600_000


def _fold_right(right: DataFrame, on: list[str], ts: str, order: list[str],
                payload: list[str], prefer_last: bool) -> DataFrame:
    """One candidate per (keys, ms); `order` breaks ties between rows of the same millisecond."""
    cand = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                    F.struct(F.col(ts).alias("ts"), *payload).alias("row"))
    pick = F.max(cand) if prefer_last else F.min(cand)
    return right.groupBy(*on, F.col(ts).alias("_ts")).agg(pick["row"].alias("_match"))


def _probes(left: DataFrame, on: list[str], ts: str) -> DataFrame:
    return (left.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on]))
            .select(*on, F.col(ts).alias("_ts")).distinct())


def _carried(evidence: DataFrame, probes: DataFrame, on: list[str]) -> DataFrame:
    """Last evidence before each probed bucket, for look-backs without a bound."""
    def bucket(df):
        return df.withColumn("_b", F.floor(F.col("_ts") / CARRY_BUCKET_MS))

    ends = bucket(evidence).groupBy(*on, "_b").agg(F.max_by("_match", "_ts").alias("_match"))
    asked = bucket(probes).select(*on, "_b").distinct()
    w = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    marks = (asked.join(ends, [*on, "_b"], "full_outer")
             .withColumn("_match", F.last("_match", ignorenulls=True).over(w)))
    return (marks.where(F.col("_match").isNotNull())
            .select(*on, (F.col("_b") * CARRY_BUCKET_MS - 1).alias("_at"), "_b", "_match"))


def asof_lookup(left: DataFrame, right: DataFrame, on: list[str], *, left_ts: str = "ts",
                right_ts: str = "ts", back: int | None = 0, ahead: int = 0,
                order: list[str] = ("seq",), payload: list[str] = (),
                prefer_last: bool = True, prune: bool = False) -> DataFrame:
    """One row per distinct (keys, ts) of `left` that has a match within the bounds.

    `back` / `ahead` are inclusive look-back and look-ahead in ms (`back=None`: no bound).
    The closest row wins; at equal distance the earlier one. `match.ts` is its time.
    `prune` drops right rows far from every probe before anything is shuffled by time; worth it
    where the right side is a whole fact table and probes are rare.
    """
    probes = _probes(left, on, left_ts)
    width = CARRY_BUCKET_MS if back is None else max(back, ahead, 1)
    b = F.floor(F.col("_ts") / width)
    if prune:
        asked = probes.select(*on, F.explode(F.array(b - 1, b, b + 1)).alias("_b")).distinct()
        right = right.withColumn("_b", F.floor(F.col(right_ts) / width)).join(
            asked, [*on, "_b"], "left_semi")
    evidence = _fold_right(right, on, right_ts, list(order), list(payload), prefer_last)
    reach = [b]
    if back:
        reach.append(b + 1)
    if ahead:
        reach.append(b - 1)
    ev = evidence.select(*on, F.explode(F.array(*reach)).alias("_b"),
                         F.col("_ts").alias("_at"), "_match")
    if back is None:
        ev = evidence.select(*on, F.col("_ts").alias("_at"), b.alias("_b"), "_match").unionByName(
            _carried(evidence, probes, on))
    both = (ev.withColumn("_probe", F.lit(False))
            .unionByName(probes.select(*on, F.col("_ts").alias("_at"), b.alias("_b"),
                                       F.lit(True).alias("_probe")), allowMissingColumns=True))
    base = Window.partitionBy(*on, "_b")
    frame = (Window.unboundedPreceding, Window.currentRow)
    before = base.orderBy("_at", "_probe").rowsBetween(*frame)
    both = both.withColumn("_before", F.last("_match", ignorenulls=True).over(before))
    if back is not None:
        near = F.col("_at") - F.col("_before.ts") <= back
        both = both.withColumn("_before", F.when(near, F.col("_before")))
    best: Column = F.col("_before")
    if ahead:
        after = base.orderBy(F.desc("_at"), "_probe").rowsBetween(*frame)
        both = both.withColumn("_after", F.last("_match", ignorenulls=True).over(after))
        far = F.col("_after.ts") - F.col("_at")
        closer = F.col("_before").isNull() | (far < F.col("_at") - F.col("_before.ts"))
        best = F.when((far <= ahead) & closer, F.col("_after")).otherwise(F.col("_before"))
    return (both.where("_probe").select(*on, F.col("_at").alias(left_ts), best.alias("match"))
            .where(F.col("match").isNotNull()))


def asof_join(left: DataFrame, right: DataFrame, on: list[str], *, left_ts: str = "ts",
              how: str = "left", **bounds) -> DataFrame:
    """`left` with a `match` struct (null where nothing lies within the bounds)."""
    found = asof_lookup(left, right, on, left_ts=left_ts, **bounds)
    return left.join(found, [*on, left_ts], how)
