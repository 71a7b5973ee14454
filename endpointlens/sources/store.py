"""Event and alert tables: row mapping, sinks, reads and retention."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import alert_id
from ..functions.text import is_blank
from ..operators.dedup import latest_alerts
from ..schema import ALERT_JSON, DAY_MS, EVENT, EVENT_COLUMNS
from ..scope import day_of

EVENT_RETENTION_DAYS = 7
ALERT_RETENTION_DAYS = 90

EVENT_TABLE = T.StructType(EVENT.fields + [T.StructField("event_date", T.DateType())])
ALERT_TABLE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("tenant_id", T.StringType()),
    T.StructField("host", T.StringType()), T.StructField("rule_id", T.StringType()),
    T.StructField("mitre", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("action", T.StringType()), T.StructField("ts", T.LongType()),
    T.StructField("matched", T.ArrayType(T.StringType())),
    T.StructField("target", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("dest_ip", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("created_at", T.LongType()), T.StructField("event_date", T.DateType()),
])


def event_rows(events: DataFrame) -> DataFrame:
    """Events in the column order of the stored table; `seq` is bookkeeping and stays out."""
    return events.select(*EVENT_COLUMNS)


def _write(df: DataFrame, path: str, mode: str, sort: list[str]) -> None:
    # REBALANCE lets adaptive execution split a hot (tenant, day) over several files.
    (df.withColumn("event_date", day_of(F.col("ts")))
     .hint("rebalance", "tenant_id", "event_date")
     .sortWithinPartitions("tenant_id", "event_date", *sort)
     .write.mode(mode).partitionBy("tenant_id", "event_date").parquet(path))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    _write(events, path, mode, ["host", "ts"])


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    _write(alerts, path, mode, ["host", "ts"])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events with their `event_date`, by which `scope.time_range` opens days only."""
    return spark.read.schema(EVENT_TABLE).parquet(path)


def read_alert_log(spark: SparkSession, path: str) -> DataFrame:
    """Every stored version; use `read_alerts` for anything an analyst sees."""
    return spark.read.schema(ALERT_TABLE).parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return latest_alerts(read_alert_log(spark, path))


def parse_alert_messages(messages: DataFrame) -> DataFrame:
    """Alert JSON to rows; malformed messages and those without tenant, host or rule drop out."""
    parsed = messages.withColumn("_a", F.from_json("value", ALERT_JSON))
    a = F.col("_a")
    usable = ~is_blank(a["tenantId"]) & a["host"].isNotNull() & a["ruleId"].isNotNull()
    return parsed.where(usable).select(
        alert_id(a["tenantId"], a["host"], a["ruleId"], a["ts"]).alias("id"),
        a["tenantId"].alias("tenant_id"), a["host"].alias("host"), a["ruleId"].alias("rule_id"),
        a["mitre"].alias("mitre"), a["severity"].alias("severity"), a["action"].alias("action"),
        a["ts"].alias("ts"), a["matched"].alias("matched"), a["target"].alias("target"),
        F.coalesce(a["domain"], F.lit("")).alias("domain"),
        F.coalesce(a["destIp"], F.lit("")).alias("dest_ip"), "seq",
        F.col("arrived_at").alias("created_at"))


def retained(df: DataFrame, arrival: str, days: int, now: int) -> DataFrame:
    """Rows that a retention run at `now` keeps."""
    return df.where(F.col(arrival) >= now - days * DAY_MS)


def expire_events(spark: SparkSession, source: str, target: str, now: int,
                  days: int = EVENT_RETENTION_DAYS) -> None:
    """Rewrites the table without expired rows."""
    write_events(retained(read_events(spark, source), "ingested_at", days, now), target,
                 mode="overwrite")


def expire_alerts(spark: SparkSession, source: str, target: str, now: int,
                  days: int = ALERT_RETENTION_DAYS) -> None:
    """Rewrites the alert table without versions that arrived before the retention period."""
    write_alerts(retained(read_alert_log(spark, source), "created_at", days, now), target,
                 mode="overwrite")
