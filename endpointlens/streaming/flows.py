"""Streaming flow ownership: each lookup gets the newest remembered flow of its key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.flows import PLACE, with_flow_key
from ..schema import FLOW_OWNER_TTL_MS, GRACE_MS
from .asof import asof_stream


def flow_owner_stream(lookups: DataFrame, flows: DataFrame, ttl: int = FLOW_OWNER_TTL_MS,
                      grace: int = GRACE_MS, quiet: int | None = None) -> DataFrame:
    """Lookups with an owner, once their host's clock is `grace` beyond them."""
    key = F.concat_ws("|", F.concat(F.lit("0:"), F.col("local_port")), "flow_ip", "remote_port")
    known = with_flow_key(flows).where("path <> ''").select(
        "tenant_id", "host", "ts", "seq", F.lit("").alias("ask"), key.alias("tell"), "path")
    asked = with_flow_key(lookups).where(F.col("flow_ip").isNotNull()).select(
        "tenant_id", "host", "ts", "seq", key.alias("ask"), F.lit("").alias("tell"), F.lit("").alias("path"))
    both = known.where(F.col("flow_ip").isNotNull()).unionByName(asked)
    found = asof_stream(both, PLACE, grace, ttl, quiet)
    return found.select("seq", *PLACE, "ts", F.col("prior_path").alias("owner_path"))
