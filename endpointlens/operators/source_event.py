"""Which event caused an alert: nearest event that satisfies the alert's own description."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detail import parse_detail
from ..functions.ids import event_id
from ..schema import SOURCE_WINDOW_MS
from .asof import asof_join

_SEP = "\x01"

# The event type that completes each rule.
TYPE_BY_RULE = {
    "SUSPICIOUS_PROCESS_CHAIN": "process",
    "DOWNLOAD_AND_EXECUTE": "process",
    "SCRIPT_FROM_TEMP_PATH": "script",
    "FILE_IN_AUTORUN_PATH": "file",
    "WEAK_TLS_HANDSHAKE": "l7",
}

SOURCE_FIELDS = ["seq", "type", "process", "parent", "cmdline", "dest_ip", "dest_port", "domain",
                 "detail", "sha256"]


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws(_SEP, F.lit(kind), *parts)


def _cut(line: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def summary_key(line: Column) -> Column:
    """Reads an evidence line back into the key of the event it describes; null if unreadable."""
    l7 = _cut(line, r"(?s)^l7 (?! \()(.+?) \(")
    script = _cut(line, r"(?s)^script (?! \()(.+?) \(")
    name = _cut(line, r"(?s)^process (?! \(parent )(.+?) \(parent ")
    parent = F.regexp_extract(line, r"(?s) \(parent (.+)\)", 1)
    with_parent = ~parent.isin("", "null")
    return (F.when(line.startswith("network "), _key("network", F.substr(line, F.lit(9))))
            .when(line.startswith("file "), _key("file", F.substr(line, F.lit(6))))
            .when(line.startswith("l7 ") & l7.isNotNull(), _key("l7", l7))
            .when(line.startswith("script ") & script.isNotNull(), _key("script", script))
            .when(line.startswith("process ") & name.isNotNull(),
                  F.when(with_parent, _key("child", name, parent))
                  .otherwise(_key("process", name))))


def _kind_of(key: str | Column) -> Column:
    """Kind of a key; the event type of a rule is part of it."""
    return F.substring_index(key, _SEP, 1)


def _event_keys() -> Column:
    t = F.col("type")
    own = (F.when(t == "network", F.array(_key("network", F.concat_ws(
               ":", "dest_ip", F.col("dest_port").cast("string")))))
           .when(t == "file", F.array(_key("file", F.col("cmdline"))))
           .when(t == "l7", F.array(_key("l7", F.col("domain"))))
           .when(t == "script", F.array(_key("script", F.col("process"))))
           .when(t == "process", F.array(
               _key("process", F.col("process")),
               _key("child", F.col("process"), F.col("parent"))))
           .otherwise(F.array().cast("array<string>")))
    return F.concat(own, F.array(_key("type", t)))


def with_source_event(alerts: DataFrame, events: DataFrame,
                      window: int = SOURCE_WINDOW_MS) -> DataFrame:
    """Alerts with `source` (null when nothing fits) and `matched_by`.

    A readable description that fits no event gives null; only an unreadable one falls back to
    the event type of the rule.
    """
    by_line = summary_key(F.try_element_at("matched", F.lit(-1)))
    types = F.create_map(*[F.lit(x) for kv in TYPE_BY_RULE.items() for x in kv])
    by_rule = F.concat(F.lit("type" + _SEP), F.try_element_at(types, F.col("rule_id")))
    asked = (alerts.withColumn("_line", by_line)
             .withColumn("_key", F.coalesce("_line", by_rule)))
    # Only events of a host and time that some alert asks about are spread over their keys, and only over
    # keys of the kinds that are asked for there.
    width = 2 * window
    slots = F.sequence(F.floor((F.col("ts") - window) / width), F.floor((F.col("ts") + window) / width))
    near = asked.select("tenant_id", "host", F.explode(slots).alias("_slot"), _kind_of("_key").alias("_kind")).groupBy(
        "tenant_id", "host", "_slot").agg(F.collect_set("_kind").alias("_kinds"))
    close = events.withColumn("_slot", F.floor(F.col("ts") / width)).join(near, ["tenant_id", "host", "_slot"])
    facts = close.select("tenant_id", "host", "ts", *SOURCE_FIELDS, F.explode(F.filter(
        _event_keys(), lambda key: F.array_contains("_kinds", _kind_of(key)))).alias("_key"))
    joined = asof_join(asked, facts, ["tenant_id", "host", "_key"], back=window, ahead=window,
                       order=["seq"], payload=SOURCE_FIELDS, prefer_last=False, prune=True)
    basis = F.when(F.col("match").isNotNull(),
                   F.when(F.col("_line").isNotNull(), "summary").otherwise("rule_type"))
    return joined.select(*alerts.columns, F.col("match").alias("source"),
                         basis.alias("matched_by"))


def source_event_id(host: Column, source: Column) -> Column:
    pid = parse_detail(source["detail"])["pid"]
    return F.when(source.isNotNull(), event_id(
        host, source["ts"], source["type"], source["process"], pid, source["parent"],
        source["dest_ip"], source["dest_port"]))
