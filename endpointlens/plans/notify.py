"""Alert routing, notification and response recommendations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cmdline import target_key, target_matches
from ..functions.text import basename, has_separator, is_blank, kill_outcome, notification_line, response_line
from ..operators.scan import cooldown
from ..schema import COOLDOWN_MS


def routes(alerts: DataFrame, owners: DataFrame, user_webhooks: DataFrame,
           tenant_webhooks: DataFrame) -> DataFrame:
    """Owner's webhook, else the tenant's, else the alert is not sent."""
    def usable(hooks, key, out):
        return hooks.where(~is_blank(F.col("url"))).select(key, F.col("url").alias(out))

    personal = (owners.select("tenant_id", "host", "user_id")
                .join(usable(user_webhooks, "user_id", "_user_url"), "user_id"))
    return (alerts.join(personal, ["tenant_id", "host"], "left")
            .join(usable(tenant_webhooks, "tenant_id", "_tenant_url"), "tenant_id", "left")
            .withColumn("webhook_url", F.coalesce("_user_url", "_tenant_url"))
            .withColumn("cooldown_id", F.when(
                F.col("_user_url").isNotNull(),
                F.concat(F.lit("user:"), F.col("user_id").cast("string")))
                .otherwise(F.concat(F.lit("tenant:"), "tenant_id")))
            .where(F.col("webhook_url").isNotNull())
            .drop("_user_url", "_tenant_url", "user_id"))


def notifications(routed: DataFrame, order: str = "seq", send_ok: str | None = None,
                  window: int = COOLDOWN_MS) -> DataFrame:
    """Rows to send: one per (route, host, rule) and cooldown, in arrival order."""
    judged = cooldown(routed, ["cooldown_id", "host", "rule_id"], order, "ts", window, send_ok)
    line = notification_line(*[F.col(c) for c in ("severity", "host", "rule_id", "mitre",
                                                  "action")])
    return judged.where("passed").withColumn("text", line)


def recommendations(alerts: DataFrame, order: str = "seq", window: int = COOLDOWN_MS) -> DataFrame:
    usable = alerts.where(F.col("host").isNotNull() & F.col("action").isNotNull())
    judged = cooldown(usable, ["host", "action"], order, "ts", window)
    return judged.where("passed").withColumn(
        "text", response_line(F.col("host"), F.col("rule_id"), F.col("action")))


def kill_targets(alerts: DataFrame, inventory: DataFrame, fold_case: bool = True) -> DataFrame:
    """Processes of the host that an alert's action would hit.

    A full path is compared with the path, a bare name with the file name, so both sides offer
    one equi key each. Both sides are distinct: repeated alerts on one target ask once.
    """
    wanted = target_key(F.col("target"), fold_case)
    asked = (alerts.select("tenant_id", "host", "target").distinct()
             .withColumn("_key", F.when(has_separator(wanted), F.concat(F.lit("p:"), wanted))
                         .otherwise(F.concat(F.lit("n:"), wanted)))
             .where(wanted != ""))
    path = F.lower("path") if fold_case else F.col("path")
    have = (inventory.select("tenant_id", "host", "path").distinct().where(path != "")
            .withColumn("_key", F.explode(F.array(F.concat(F.lit("p:"), path),
                                                  F.concat(F.lit("n:"), basename(path))))))
    return (asked.join(have, ["tenant_id", "host", "_key"])
            .where(target_matches(F.col("target"), F.col("path"), fold_case))
            .select("tenant_id", "host", "target", "path").distinct())


def confirmations(results: DataFrame, alerts: DataFrame) -> DataFrame:
    """Triage rows for alerts whose action was reported as done."""
    done = results.where(kill_outcome(F.col("outcome")) == "KILLED")
    return (done.join(alerts.select("tenant_id", "id"), ["tenant_id", "id"])
            .select("tenant_id", "id", F.lit("confirmed").alias("status"),
                    F.col("at").alias("updated_at")))
