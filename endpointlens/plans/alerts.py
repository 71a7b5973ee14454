"""Alert queries: overlay, filters, summaries, time series."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import with_catalog
from ..functions.text import bucket_floor, bucket_step
from ..scope import exact_filter, id_filter, text_filter, time_range, top_per

OPEN = "open"
TRIAGED = ("confirmed", "false_positive")


def triage_status(overlay_log: DataFrame) -> DataFrame:
    """Last valid decision per alert; other words than the two decisions are rejected."""
    valid = overlay_log.where(F.col("status").isin(*TRIAGED))
    return valid.groupBy("tenant_id", "id").agg(
        F.max_by("status", F.struct("updated_at", "status")).alias("status"),
        F.max("updated_at").alias("updated_at"))


def with_status(alerts: DataFrame, status: DataFrame) -> DataFrame:
    """No decision means open."""
    return (alerts.join(status.select("tenant_id", "id", "status"), ["tenant_id", "id"], "left")
            .withColumn("status", F.coalesce("status", F.lit(OPEN))))


def with_status_filter(alerts: DataFrame, status: DataFrame, wanted: str | None) -> DataFrame:
    """Open alerts have no decision at all; other states keep their ids only."""
    if wanted == OPEN:
        return id_filter(alerts, status, keep=False)
    if wanted and wanted.strip():
        return id_filter(alerts, status.where(F.col("status") == wanted), keep=True)
    return alerts


def filtered(alerts: DataFrame, host: str | None = None, severity: str | None = None,
             domain: str | None = None, dest_ip: str | None = None, start: int | None = None,
             end: int | None = None) -> DataFrame:
    rows = text_filter(alerts, "host", host)
    rows = text_filter(rows, "severity", severity)
    rows = exact_filter(rows, "domain", domain)
    rows = exact_filter(rows, "dest_ip", dest_ip)
    return time_range(rows, start, end, closed=False)


def responses(alerts: DataFrame, status: DataFrame) -> DataFrame:
    return with_catalog(with_status(alerts, status)).select(
        "tenant_id", "id", "host", "rule_id", "threat_name", "mitre", "severity", "action", "ts",
        "status", "matched", "domain", "dest_ip")


def by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("tenant_id").agg(
        *[F.count_if(F.col("severity") == s.upper()).alias(s)
          for s in ("critical", "high", "medium")],
        F.count("*").alias("total"))


def top_threats(alerts: DataFrame, top: int = 5) -> DataFrame:
    """Each tenant's most frequent categories."""
    per_rule = alerts.groupBy("tenant_id", "rule_id").agg(F.count("*").alias("n"))
    found = with_catalog(per_rule).groupBy("tenant_id", "category").agg(F.sum("n").alias("alerts"))
    return top_per(found, ["tenant_id"], [F.desc("alerts"), F.col("category")], top).drop("has_more")


def timeseries(alerts: DataFrame, start: int, end: int, bucket: str) -> DataFrame:
    step = bucket_step(bucket)
    rows = time_range(alerts, start, end, closed=False)
    return rows.groupBy("tenant_id", bucket_floor(F.col("ts"), step).alias("bucket_start")).agg(
        *[F.count_if(F.col("severity") == s.upper()).alias(s)
          for s in ("critical", "high", "medium")],
        F.count("*").alias("total"))


def zero_filled(series: DataFrame, tenants: DataFrame, start: int, end: int, bucket: str
                ) -> DataFrame:
    """A row for every tenant and bucket from the aligned start up to, but without, `end`."""
    step = bucket_step(bucket)
    first = start - start % step
    buckets = F.sequence(F.lit(first), F.lit(max(first, end - 1)), F.lit(step))
    grid = tenants.select("tenant_id").distinct().withColumn("bucket_start", F.explode(buckets))
    filled = grid.join(series, ["tenant_id", "bucket_start"], "left")
    return filled.select("tenant_id", "bucket_start", *[F.coalesce(c, F.lit(0)).alias(c)
                                           for c in ("critical", "high", "medium", "total")])


def open_per_host(alerts: DataFrame, status: DataFrame) -> DataFrame:
    return id_filter(alerts, status, keep=False).groupBy("tenant_id", "host").agg(
        F.count("*").alias("open_total"),
        F.count_if(F.col("severity") == "CRITICAL").alias("open_critical"),
        F.count_if(F.col("severity") == "HIGH").alias("open_high"))


def per_destination(alerts: DataFrame, start: int | None = None, end: int | None = None
                    ) -> DataFrame:
    """Alerts per (host, destination), triaged ones included."""
    rows = time_range(alerts, start, end, closed=False).where(
        (F.col("domain") != "") | (F.col("dest_ip") != ""))
    dest = F.when(F.col("domain") != "", F.col("domain")).otherwise(F.col("dest_ip"))
    return rows.groupBy("tenant_id", "host", dest.alias("dest")).agg(F.count("*").alias("alerts"))


def detections_by_rule(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("rule_id", "severity").agg(F.count("*").alias("detections"))


def detection_rate(alerts: DataFrame, width_ms: int = 30_000, slide_ms: int = 10_000) -> DataFrame:
    """Alerts per second and rule over sliding windows."""
    at = F.timestamp_millis("ts")
    win = F.window(at, f"{width_ms} milliseconds", f"{slide_ms} milliseconds")
    return alerts.groupBy("rule_id", win.alias("w")).agg(F.count("*").alias("alerts")).select(
        "rule_id", F.unix_millis("w.start").alias("window_start"), "alerts",
        F.round(F.col("alerts") / (width_ms / 1000), 6).alias("rate"))


def most_recent(alerts: DataFrame, top: int = 50) -> DataFrame:
    return alerts.orderBy(F.desc("created_at"), F.desc("seq"), "id").limit(top)


def arrivals(alert_log: DataFrame) -> DataFrame:
    """First arrival of every alert id."""
    return alert_log.groupBy("tenant_id", "id").agg(F.min("created_at").alias("arrived_at"))


def stage_latency(events: DataFrame, alert_log: DataFrame, alerts: DataFrame) -> DataFrame:
    """Published -> detected -> stored per alert, in ms."""
    trigger = events.select("tenant_id", "host", "seq", F.col("ingested_at").alias("published_at"))
    return (alerts.select("tenant_id", "host", "id", "rule_id", "seq",
                          F.col("created_at").alias("stored_at"))
            .join(arrivals(alert_log), ["tenant_id", "id"])
            .join(trigger, ["tenant_id", "host", "seq"])
            .select("id", "rule_id",
                    (F.col("arrived_at") - F.col("published_at")).alias("detect_ms"),
                    (F.col("stored_at") - F.col("arrived_at")).alias("store_ms")))
