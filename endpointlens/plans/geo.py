"""Destinations by country."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import centroids
from ..functions.net import ip_key, is_public_ip
from ..functions.text import jtrim
from ..session import cut_lineage


def countries_of(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """(dest_ip, code) for public addresses inside a supplied range (start_ip, end_ip, iso2).

    An address takes the nearest range start at or below it, if the range reaches that far. Ranges
    of one table don't overlap; of equal starts the narrower one counts.

    Starts and addresses are dealt out by ranges of their order, cut where the rows are, so a crowded
    network is as many partitions as it needs. Within a partition the last start is carried forward;
    the last start of each partition goes over to those behind it, one row a partition.
    """
    spark = addresses.sparkSession
    place = F.col("dest_ip")
    public = (addresses.select("dest_ip").distinct().where(is_public_ip(place))
              .select("dest_ip", ip_key(jtrim(place)).alias("at")).where("at IS NOT NULL"))
    spans = (ranges.select(ip_key(jtrim(F.col("start_ip"))).alias("at"), ip_key(jtrim(F.col("end_ip"))).alias("end"),
                           F.upper(F.trim("iso2")).alias("code")).where("at <= end")
             .groupBy("at").agg(F.min(F.struct("end", "code")).alias("span")))
    # The cuts are drawn once: the table of the dealt rows is what both readers below see.
    dealt = cut_lineage(spans.unionByName(public, allowMissingColumns=True).repartitionByRange("at")
                        .withColumn("part", F.spark_partition_id()))
    last = F.max(F.when(F.col("span").isNotNull(), F.struct("at", "span")))
    carried, held = [], None
    for row in dealt.groupBy("part").agg(last.alias("last")).orderBy("part").collect():
        if held is not None:
            carried.append((row["part"], held))
        held = row["last"]["span"] if row["last"] else held
    carry = spark.createDataFrame(carried, f"part int, carry {dealt.schema['span'].dataType.simpleString()}")
    order = Window.partitionBy("part").orderBy("at", F.col("span").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = dealt.join(F.broadcast(carry), "part", "left").withColumn(
        "held", F.coalesce(F.last("span", ignorenulls=True).over(order), "carry"))
    return held.where("dest_ip IS NOT NULL AND held.end >= at").select("dest_ip", F.col("held.code").alias("code"))


def by_country(per_ip: DataFrame, ranges: DataFrame) -> DataFrame:
    """Event counts per country; unresolved addresses and unknown codes drop out."""
    located = per_ip.join(countries_of(per_ip, ranges), "dest_ip")
    summed = located.groupBy("tenant_id", "code").agg(F.sum("events").alias("events"))
    # Fifty fixed rows.
    return summed.join(F.broadcast(centroids(per_ip.sparkSession)), "code")
