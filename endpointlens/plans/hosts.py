"""Host list, risk and enrolment."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import host_status, is_blank, risk_score
from ..scope import id_filter, time_range
from .alerts import open_per_host
from .events import hosts_last_seen


def severity_per_host(alerts: DataFrame, status: DataFrame, start: int | None = None,
                      end: int | None = None) -> DataFrame:
    """Severity mix of undecided alerts."""
    rows = time_range(id_filter(alerts, status, keep=False), start, end, closed=False)
    return rows.groupBy("tenant_id", "host").agg(
        *[F.count_if(F.col("severity") == s.upper()).alias(s)
          for s in ("critical", "high", "medium", "low")])


def risk_per_host(mix: DataFrame) -> DataFrame:
    score = risk_score(*[F.col(c) for c in ("critical", "high", "medium", "low")])
    total = F.col("critical") + F.col("high") + F.col("medium") + F.col("low")
    return (mix.withColumn("risk_score", score).withColumn("status", host_status(score))
            .withColumn("open_alerts", total))


def enrolled_nodes(enrolments: DataFrame) -> DataFrame:
    """One row per (tenant, host): newest key and platform, first enrolment, last contact."""
    host = F.when(is_blank(F.col("host")), F.lit("unknown")).otherwise(F.col("host"))
    newest = F.struct("at", "node_key")
    return (enrolments.withColumn("host", host).groupBy("tenant_id", "host").agg(
        F.sha2(F.max_by("node_key", newest), 256).alias("node_key_hash"),
        F.max_by("platform", newest).alias("platform"),
        F.min("at").alias("enrolled_at"), F.max("at").alias("last_seen_at")))


def tenant_nodes(nodes: DataFrame, tenant_id: str) -> DataFrame:
    """Nodes of one tenant; a tenant that is no number has none."""
    wanted = F.lit(tenant_id).try_cast("bigint")
    return nodes.where(F.col("tenant_id").try_cast("bigint") == wanted).select(
        "host", "last_seen_at", "platform")


def owners(owner_log: DataFrame) -> DataFrame:
    """First registration of a host wins."""
    first = F.struct("at", "user_id")
    return owner_log.groupBy("tenant_id", "host").agg(
        F.min_by("user_id", first).alias("user_id"), F.min("at").alias("at"))


def ownership_conflicts(owner_log: DataFrame) -> DataFrame:
    """Later registrations by somebody else."""
    own = owners(owner_log).select("tenant_id", "host", F.col("user_id").alias("owner_id"))
    return owner_log.join(own, ["tenant_id", "host"]).where(F.col("user_id") != F.col("owner_id"))


def hosts_of_user(owned: DataFrame, user_id: int) -> DataFrame:
    return owned.where(F.col("user_id") == user_id).select("tenant_id", "host")


def host_list(events: DataFrame, alerts: DataFrame, status: DataFrame, nodes: DataFrame
              ) -> DataFrame:
    """Observed and enrolled hosts; names meet without case, the observed spelling wins.

    Open counts and risk join by exact name. Of several nodes with one folded name the first
    by name counts.
    """
    risk = risk_per_host(severity_per_host(alerts, status)).select(
        "tenant_id", "host", "risk_score")
    seen = (hosts_last_seen(events)
            .join(open_per_host(alerts, status), ["tenant_id", "host"], "left")
            .join(risk, ["tenant_id", "host"], "left")
            .withColumn("_name", F.lower("host")))
    node = nodes.groupBy("tenant_id", F.lower("host").alias("_name")).agg(
        F.min(F.struct(F.col("host").alias("node_host"), "last_seen_at", "platform")).alias("_n"))
    both = seen.join(node, ["tenant_id", "_name"], "full_outer")
    score = F.coalesce("risk_score", F.lit(0).cast("long"))
    return both.select(
        "tenant_id", F.coalesce("host", "_n.node_host").alias("host"),
        F.coalesce("last_seen", F.lit(0).cast("long")).alias("last_seen"),
        host_status(score).alias("status"),
        F.coalesce("open_total", F.lit(0).cast("long")).alias("threats"),
        score.alias("risk_score"), F.col("_n").isNotNull().alias("enrolled"),
        F.coalesce("_n.last_seen_at", F.lit(0).cast("long")).alias("agent_seen"),
        F.coalesce("_n.platform", F.lit("")).alias("platform"))


def host_order(hosts: DataFrame) -> DataFrame:
    """Observed hosts by last event, then enrolled-only ones by last contact."""
    return hosts.orderBy("tenant_id", F.col("last_seen") == 0, F.desc("last_seen"),
                         F.desc("agent_seen"), "host")


def host_summary(hosts: DataFrame) -> DataFrame:
    silent = (F.col("last_seen") == 0) & F.col("enrolled")
    return hosts.groupBy("tenant_id").agg(
        *[F.count_if(~silent & (F.col("status") == s)).alias(s)
          for s in ("healthy", "warning", "critical")],
        F.count("*").alias("total"), F.count_if(silent).alias("no_events"))
