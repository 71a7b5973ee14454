"""Egress topology: who talks to what."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detail import detail_text
from ..functions.net import is_ip
from ..functions.text import contains_any, jtrim
from ..scope import has_text, time_range, top_per


def with_destination(events: DataFrame, start: int | None = None, end: int | None = None,
                     search: str | None = None) -> DataFrame:
    rows = time_range(events, start, end, closed=False).where(
        (F.col("domain") != "") | (F.col("dest_ip") != ""))
    if has_text(search):
        rows = rows.where(contains_any([F.col("host"), F.col("domain"), F.col("dest_ip")], search.strip()))
    named = F.col("domain") != ""
    return (rows.withColumn("dest", F.when(named, F.col("domain")).otherwise(F.col("dest_ip")))
            .withColumn("dest_kind", F.when(named, "domain").otherwise("ip")))


def relations(rows: DataFrame) -> DataFrame:
    """Edges (host -> destination) with counts and protocol labels.

    Labels are folded to distinct values per edge first; the sets stay as small as the protocol
    vocabulary.
    """
    labels = F.filter(F.array(jtrim(detail_text(F.col("detail"), "protocol")),
                              jtrim(detail_text(F.col("detail"), "l7Protocol"))),
                      lambda s: s.isNotNull() & (s != ""))
    keys = ["tenant_id", "host", "dest", "dest_kind"]
    per_label = rows.withColumn("_labels", labels).groupBy(*keys, "_labels").agg(
        F.count("*").alias("n"), F.max("ts").alias("last"))
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_set("_labels"))))
    return per_label.groupBy(*keys).agg(F.sum("n").alias("events"),
                                        F.max("last").alias("last_seen"),
                                        merged.alias("protocols"))


def top_relations(edges: DataFrame, limit: int) -> DataFrame:
    """Each tenant's busiest edges."""
    return top_per(edges, ["tenant_id"], [F.desc("events"), F.col("host"), F.col("dest")], limit).drop("has_more")


def relation_total(rows: DataFrame) -> DataFrame:
    """Distinct pairs before any cut; distinct first, so that the count is spread out."""
    return (rows.select("tenant_id", "host", "dest").distinct()
            .groupBy("tenant_id").agg(F.count("*").alias("total")))


def registrable_domains(names: DataFrame, suffixes: DataFrame, column: str = "dest") -> DataFrame:
    """(name, registrable): longest listed suffix plus one label.

    Addresses, bare suffixes, single labels and names below unlisted suffixes have none.
    """
    distinct = names.select(F.lower(F.col(column)).alias("name")).distinct().where(
        ~is_ip(F.col("name")))
    parts = F.split("name", r"\.")
    tails = distinct.select("name", parts.alias("_p"), F.posexplode(parts).alias("_i", "_l")).select(
        "name", "_p", "_i", F.array_join(F.slice("_p", F.col("_i") + 1, F.size("_p")), ".").alias(
            "suffix"))
    longest = (tails.join(suffixes, "suffix").groupBy("name")
               .agg(F.min("_i").alias("_i"), F.first("_p").alias("_p")))
    return longest.where("_i > 0").select("name", F.array_join(
        F.slice("_p", F.col("_i"), F.size("_p")), ".").alias("registrable"))


def domain_groups(edges: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Registrable domains with at least two destinations."""
    dests = edges.select("tenant_id", "dest").distinct()
    named = registrable_domains(dests, suffixes)
    return (dests.join(named, F.lower(dests["dest"]) == named["name"])
            .groupBy("tenant_id", "registrable").agg(F.count("*").alias("members"))
            .where("members > 1"))


def edge_table(edges: DataFrame, alerts_per_dest: DataFrame) -> DataFrame:
    return edges.join(alerts_per_dest, ["tenant_id", "host", "dest"], "left").select(
        "tenant_id", F.concat(F.lit("host:"), "host").alias("from"),
        F.concat(F.lit("dest:"), "dest").alias("to"), "events",
        F.coalesce("alerts", F.lit(0).cast("long")).alias("alerts"), "protocols", "last_seen")


def node_table(edges: DataFrame, risk: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Endpoint, destination and domain-group nodes of the shown edges."""
    zero = F.lit(0).cast("long")
    none = F.lit(None)
    endpoints = (edges.select("tenant_id", "host").distinct()
                 .join(risk.select("tenant_id", "host", "risk_score", "open_alerts"),
                       ["tenant_id", "host"], "left")
                 .select("tenant_id", F.concat(F.lit("host:"), "host").alias("node_id"),
                         F.lit("endpoint").alias("kind"), F.col("host").alias("label"),
                         none.cast("string").alias("dest_kind"),
                         none.cast("string").alias("group_id"),
                         F.coalesce("risk_score", zero).alias("risk_score"),
                         F.coalesce("open_alerts", zero).alias("open_alerts"),
                         none.cast("long").alias("members")))
    groups = domain_groups(edges, suffixes)
    # The kind of a destination is that of its first edge in display order.
    first = F.min_by("dest_kind", F.struct((-F.col("events")).alias("n"), "host"))
    dests = edges.groupBy("tenant_id", "dest").agg(first.alias("dest_kind"))
    named = registrable_domains(dests, suffixes)
    grouped = (dests.join(named, F.lower(dests["dest"]) == named["name"], "left")
               .join(groups, ["tenant_id", "registrable"], "left"))
    blank = [none.cast("long").alias(c) for c in ("risk_score", "open_alerts")]
    dest_nodes = grouped.select(
        "tenant_id", F.concat(F.lit("dest:"), "dest").alias("node_id"),
        F.lit("destination").alias("kind"), F.col("dest").alias("label"), "dest_kind",
        F.when(F.col("members").isNotNull(), F.concat(F.lit("group:"), "registrable")).alias(
            "group_id"), *blank, none.cast("long").alias("members"))
    group_nodes = groups.select(
        "tenant_id", F.concat(F.lit("group:"), "registrable").alias("node_id"),
        F.lit("domainGroup").alias("kind"), F.col("registrable").alias("label"),
        none.cast("string").alias("dest_kind"), none.cast("string").alias("group_id"), *blank,
        "members")
    return endpoints.unionByName(dest_nodes).unionByName(group_nodes)


def shown_and_total(rows: DataFrame, limit: int) -> DataFrame:
    """How many of its relations each tenant is shown."""
    total = relation_total(rows)
    shown = F.least("total", F.lit(limit).cast("long"))
    return total.select("tenant_id", "total", shown.alias("shown"), (shown < F.col("total")).alias("truncated"))
