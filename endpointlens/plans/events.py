"""Event queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detail import parse_detail
from ..functions.ids import event_id
from ..schema import DETAIL, EVENT_LOOKUP_MS
from ..scope import text_filter, time_range


def filtered(events: DataFrame, host: str | None = None, type_: str | None = None,
             sha256: str | None = None, start: int | None = None, end: int | None = None
             ) -> DataFrame:
    rows = text_filter(events, "host", host)
    rows = text_filter(rows, "type", type_)
    rows = text_filter(rows, "sha256", sha256, fold=True)
    return time_range(rows, start, end, closed=True)


def with_event_id(events: DataFrame) -> DataFrame:
    pid = parse_detail(F.col("detail"))["pid"]
    return events.withColumn("event_id", event_id(
        F.col("host"), F.col("ts"), F.col("type"), F.col("process"), pid, F.col("parent"),
        F.col("dest_ip"), F.col("dest_port")))


def responses(events: DataFrame) -> DataFrame:
    """Event columns, the detail fields side by side, and the id."""
    parsed = events.withColumn("_d", parse_detail(F.col("detail")))
    names = {"queryType": "dns_record_type", "answers": "dns_answers",
             "status": "dns_response_code", "tlsVersion": "tls_version",
             "l7Protocol": "l7_protocol", "httpMethod": "http_method", "httpPath": "http_path",
             "httpUserAgent": "http_user_agent", "httpStatusCode": "http_status_code"}
    fields = [F.col(f"_d.{f.name}").alias(names.get(f.name, f.name)) for f in DETAIL.fields]
    d = F.col("_d")
    id_ = event_id(F.col("host"), F.col("ts"), F.col("type"), F.col("process"), d["pid"],
                   F.col("parent"), F.col("dest_ip"), F.col("dest_port"))
    return parsed.select(id_.alias("id"), *events.columns, *fields)


def by_id(events: DataFrame, host: str, ts: int, id_: str) -> DataFrame:
    """One event: host and a second around its time reach the scan, the id decides."""
    near = filtered(events, host=host, start=max(0, ts - EVENT_LOOKUP_MS),
                    end=ts + EVENT_LOOKUP_MS)
    return with_event_id(near).where(F.col("event_id") == id_).limit(1)


def count_by_type(events: DataFrame) -> DataFrame:
    """Events per tenant and type, with each tenant's total as type null."""
    return (events.rollup("tenant_id", "type").agg(F.count("*").alias("events"))
            .where(F.col("tenant_id").isNotNull()))


def hosts_last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("tenant_id", "host").agg(F.max("ts").alias("last_seen"))


def per_destination(events: DataFrame, start: int | None = None, end: int | None = None
                    ) -> DataFrame:
    rows = time_range(events, start, end, closed=False).where(F.col("dest_ip") != "")
    return rows.groupBy("tenant_id", "dest_ip").agg(F.count("*").alias("events"))
