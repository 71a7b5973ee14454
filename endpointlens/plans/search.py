"""Unified search over hosts, alerts and events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import rule_ids_named, with_catalog
from ..functions.text import contains_any
from ..scope import clamp_limit, search_term, time_range, top_per
from .events import with_event_id

EVENT_FIELDS = ("host", "process", "parent", "cmdline", "domain", "dest_ip", "sha256")
ALERT_FIELDS = ("id", "host", "rule_id", "mitre", "domain", "dest_ip")


def event_matches(events: DataFrame, term: str, start: int | None, end: int | None) -> DataFrame:
    term = search_term(term)
    rows = time_range(events, start, end, closed=True)
    return rows.where(contains_any([F.col(c) for c in EVENT_FIELDS], term))


def alert_matches(alerts: DataFrame, term: str, start: int | None, end: int | None) -> DataFrame:
    """Also finds alerts by the display name of their rule."""
    term = search_term(term)
    rows = time_range(alerts, start, end, closed=True)
    hit = contains_any([F.col(c) for c in ALERT_FIELDS], term)
    named = rule_ids_named(term)
    return rows.where(hit | F.col("rule_id").isin(named) if named else hit)


def event_hits(matches: DataFrame) -> DataFrame:
    return with_event_id(matches).select(
        F.col("event_id").alias("id"), "tenant_id", "host", "ts", "type", "process", "cmdline",
        "domain", "dest_ip", "sha256")


def alert_hits(matches: DataFrame) -> DataFrame:
    return with_catalog(matches).select("id", "tenant_id", "host", "rule_id", "threat_name",
                                        "mitre", "severity", "ts")


def section(hits: DataFrame, name: str, order: list, limit: int | None, ts: str = "ts") -> DataFrame:
    """Each tenant's first hits of one section with `has_more`."""
    return top_per(hits, ["tenant_id"], order, clamp_limit("search", limit)).select(
        F.lit(name).alias("section"), "tenant_id", F.col("id"), "host", F.col(ts).alias("ts"),
        "has_more")


def unified(hosts: DataFrame, alerts: DataFrame, events: DataFrame, term: str, start: int,
            end: int, limit: int | None = None) -> DataFrame:
    """Three sections in one tagged table; the host section has no time bound."""
    found = hosts.where(contains_any([F.col("host")], search_term(term))).withColumn(
        "id", F.col("host"))
    newest = [F.desc("ts"), F.col("id")]
    parts = (
        section(found, "hosts", [F.desc("last_seen"), F.col("host")], limit,
                ts="last_seen"),
        section(alert_hits(alert_matches(alerts, term, start, end)), "alerts", newest, limit),
        section(event_hits(event_matches(events, term, start, end)), "events", newest, limit),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
