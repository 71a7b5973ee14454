"""Name-based identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nz


def uuid3(seed: Column) -> Column:
    """MD5 of the seed's UTF-8 bytes laid out as a version-3 UUID."""
    h = F.md5(seed.cast("binary"))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"),
        F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12))


def alert_id(tenant: Column, host: Column, rule: Column, ts: Column) -> Column:
    return uuid3(F.concat_ws("|", tenant, host, rule, ts.cast("string")))


def incident_id(tenant: Column, host: Column, first_alert: Column) -> Column:
    return uuid3(F.concat_ws("|", tenant, host, first_alert))


def event_id(host, ts, type_, process, pid, parent, dest_ip, dest_port) -> Column:
    return uuid3(F.concat_ws(
        "|", nz(host), ts.cast("string"), nz(type_), nz(process), nz(pid.cast("string")),
        nz(parent), nz(dest_ip), F.coalesce(dest_port, F.lit(0)).cast("string")))


def process_node(name: Column, pid: Column) -> Column:
    return F.concat_ws(":", F.lit("proc"), name, pid.cast("string"))
