"""Incident lists: filters that count after grouping, pages, and the incident of an alert."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scope import clamp_limit, page, resolve_offset, text_filter, time_range
from .alerts import with_status


def incident_page(rolled: DataFrame, status: DataFrame, wanted: str | None = None, host: str | None = None,
                  limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of incidents, newest first, with `status` and `has_more`. Ids depend on the whole
    group, so host and status are looked at only now."""
    named = with_status(rolled.withColumnRenamed("incident_id", "id"), status)
    rows = text_filter(text_filter(named, "host", host), "status", wanted)
    order = [F.desc("last_ts"), F.col("id")]
    return page(rows, order, clamp_limit("incidents", limit), resolve_offset(offset)).withColumnRenamed("id", "incident_id")


def incidents_of_alerts(members: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(tenant_id, id, incident_id, anchor) of alerts within a time range; the grouping has seen all of them."""
    return time_range(members, start, end, closed=True).select("tenant_id", "id", "incident_id", "anchor")
