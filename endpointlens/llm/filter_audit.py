"""Audit of how an ordered chain of filters interacts, by Lehmer-rank difference arrays.

A document's outcome under every order of the filters depends on its mask alone, the set of
filters it fails: it is removed at the first step whose filter is in the mask. The orders that
begin with the same letters are neighbours in lexicographic order; their Lehmer ranks form one
interval. So all orders that remove a mask at a step by a filter are a few intervals of ranks, one
for each beginning of passed filters. The documents are folded to counts by part and mask; each
count is added where an interval begins and taken away where it ends, and a prefix sum along the
ranks gives what every order removes at every step. Work after the fold does not depend on the
number of documents.

Equal texts are told by their SHA-256. The fold by text carries one row for a task and text, so a
text that a third of the table shares is no burden.

Defined cases: a null text is an empty one, a null part the empty string; a row without id is never
a copy and nothing is a copy of it; repeated rows count each, and rows of one id are no copies of
each other; a document with several label rows has a mark if any of them has it; an empty table has
no parts and gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store

BLANKS = r"[\x20\x09-\x0D]+"
MEASURES = ("n", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """Conditions of the filters that look at a text alone, by their letter."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": count < 200, "B": distinct * 100 < count * 50,
            "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * 3, "D": text.rlike(r"[#$%&*|]")}


def intervals(letters: str) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders that remove a mask at a step.

    One interval for each beginning of passed filters that ends in a failed one: a number that the
    count of filters fixes, 840 for five.
    """
    n = len(letters)
    below = [1]
    for i in range(1, n + 1):
        below.append(below[-1] * i)
    rows = []
    for step in range(1, n + 1):
        for order in permutations(range(n), step):
            rank = sum(sum(later < at and later not in order[:i] for later in range(n)) * below[n - 1 - i]
                       for i, at in enumerate(order))
            passed = sum(1 << at for at in order[:-1])
            for mask in range(1 << n):
                if mask >> order[-1] & 1 and not mask & passed:
                    rows.append((mask, step, rank, rank + below[n - step]))
    return rows


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents of every part by the set of filters they fail. The
    last bit of a mask says that a smaller id has the same text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    fails = list(failures(whole).values())
    own = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(whole, 256)).alias("body"), own.cast("int").alias("mask"))
    # Rows without id are spread by their text, so they do not meet in one task.
    counted = rows.groupBy("id", "part", "body", "mask").agg(F.count(F.lit(1)).alias("rows"))
    marks = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                  F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    known = counted.join(marks, "id", "left").na.fill(0, ["good", "toxic"])
    named = F.col("id").isNotNull()
    same = known.groupBy("body", "part", "mask", "good", "toxic").agg(
        F.sum("rows").alias("rows"), F.sum(F.when(named, F.col("rows")).otherwise(0)).alias("named"),
        F.min(F.when(named, F.struct("id", "rows"))).alias("first"))
    kinds = F.struct("part", "mask", "good", "toxic", "rows", "named", "first")
    # At most parts x masks x marks rows meet here for a text.
    texts = same.groupBy("body").agg(F.min("first.id").alias("least"), F.collect_list(kinds).alias("kinds"))
    kind = texts.select("least", F.explode("kinds").alias("k")).select("least", "k.*")
    copies = F.col("named") - F.when(F.col("first.id") == F.col("least"), F.col("first.rows")).otherwise(0)
    copy_bit = 1 << len(fails)
    split = kind.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("rows") - copies).alias("rows")),
        F.struct((F.col("mask") + copy_bit).alias("mask"), copies.alias("rows")))).alias("s")).where("s.rows > 0")
    return split.groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.rows").alias("n"), F.sum(F.col("s.rows") * F.col("good")).alias("good"),
        F.sum(F.col("s.rows") * F.col("toxic")).alias("toxic"))


def audit(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """For every part, order of `letters` and step: what is kept, removed, redundant and lost.

    `counts` has a row for each part and mask with `n`, `good` and `toxic`.
    """
    spark = counts.sparkSession
    # A few rows for each part, read by two branches below.
    counts = store(counts)
    reach = F.broadcast(spark.createDataFrame(intervals(letters), "mask int, step int, lo int, hi int"))
    signed = [F.struct(F.col(at).alias("rank"), *[(F.col(m) * sign).alias(m) for m in MEASURES])
              for at, sign in (("lo", 1), ("hi", -1))]
    ends = (counts.join(reach, "mask").select("part", "step", F.explode(F.array(*signed)).alias("e"))
            .groupBy("part", "step", F.col("e.rank").alias("rank")).agg(*[F.sum(f"e.{m}").alias(m) for m in MEASURES]))
    grid = F.broadcast(_orders(spark, letters))
    bits = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i in range(len(letters))]
    only = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(len(letters))]
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*bits).alias("failing"), F.array(*only).alias("alone"))
    ranks = F.explode(F.sequence(F.lit(0), F.lit(prod(range(1, len(letters) + 1)) - 1)))
    cells = (parts.select("part", ranks.alias("rank")).join(grid, "rank")
             .join(ends, ["part", "step", "rank"], "left").na.fill(0, list(MEASURES)))
    along = Window.partitionBy("part", "step").orderBy("rank")
    summed = cells.select("part", "step", "rank", "filter_order", "filter",
                          *[F.sum(m).over(along).alias(m) for m in MEASURES])
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    per_filter = Window.partitionBy("part", "filter")
    removed = F.col("n")
    mine = lambda column: F.element_at(column, F.col("filter"))
    return (summed.withColumn("gone", F.sum(removed).over(so_far)).withColumn("shapley", F.sum(removed).over(per_filter))
            .join(parts, "part")
            .select("part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), removed.alias("removed"),
                    (mine("failing") - removed).alias("redundant"), mine("alone").alias("unique_fails"),
                    F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley"))


def _orders(spark: SparkSession, letters: str) -> DataFrame:
    """(rank, filter_order, step, filter): the orders in lexicographic order, filters by place from 1."""
    rows = [(rank, "".join(letters[at] for at in order), step, at + 1)
            for rank, order in enumerate(permutations(range(len(letters)))) for step, at in enumerate(order, 1)]
    return spark.createDataFrame(rows, "rank int, filter_order string, step int, filter int")
