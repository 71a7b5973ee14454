"""Ownership lookups in time and snapshot differences."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import flow_ip
from ..functions.text import basename
from ..schema import FLOW_OWNER_TTL_MS
from .asof import asof_join


#: A host name is a host within its tenant.
PLACE = ["tenant_id", "host"]


def with_flow_key(df: DataFrame) -> DataFrame:
    """Rows with a usable key keep a normalised address; others get none and never match."""
    usable = F.col("local_port").between(1, 65535) & F.col("remote_port").between(1, 65535)
    return df.withColumn("flow_ip", F.when(usable, flow_ip(F.col("remote_ip"))))


def flow_owners(lookups: DataFrame, flows: DataFrame, ttl: int = FLOW_OWNER_TTL_MS) -> DataFrame:
    """Process that opened the same flow at most `ttl` ms before; no fallback to the port alone."""
    known = with_flow_key(flows).where((F.col("path") != "") & F.col("flow_ip").isNotNull())
    joined = asof_join(with_flow_key(lookups), known,
                       [*PLACE, "local_port", "flow_ip", "remote_port"], back=ttl,
                       order=["seq"], payload=["path"])
    return joined.select(*lookups.columns, F.col("match.path").alias("owner_path"),
                         F.coalesce(basename(F.col("match.path")), F.lit("")).alias("owner"),
                         F.col("match").isNotNull().alias("hit"))


def process_names(lookups: DataFrame, starts: DataFrame, pid: str = "pid") -> DataFrame:
    """Path of the process that held a pid at the time of each row."""
    begun = starts.where(F.col(pid).isNotNull() & (F.col("path") != ""))
    joined = asof_join(lookups, begun, [*PLACE, pid], back=None, order=["seq"], payload=["path"])
    return joined.select(*lookups.columns, F.col("match.path").alias("pid_path"))


def new_connections(snapshots: DataFrame) -> DataFrame:
    """Connections absent from the host's previous snapshot; the first one is the baseline."""
    key = ["pid", "path", "remote_ip", "remote_port"]
    conns = snapshots.select(*PLACE, "snapshot_seq", *key).distinct()
    polls = snapshots.select(*PLACE, "snapshot_seq").distinct()
    w = Window.partitionBy(*PLACE).orderBy("snapshot_seq")
    following = polls.select(*PLACE, "snapshot_seq", F.lead("snapshot_seq").over(w).alias("_next"))
    previous = polls.select(*PLACE, "snapshot_seq", F.lag("snapshot_seq").over(w).alias("_prev"))
    held = (conns.join(following, [*PLACE, "snapshot_seq"])
            .select(*PLACE, F.col("_next").alias("snapshot_seq"), *key))
    fresh = conns.join(held, [*PLACE, "snapshot_seq", *key], "left_anti")
    baseline = previous.where(F.col("_prev").isNull()).select(*PLACE, "snapshot_seq")
    return fresh.join(baseline, [*PLACE, "snapshot_seq"], "left_anti")
