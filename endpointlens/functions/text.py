"""Small text helpers shared by the other function modules."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def jtrim(c: Column) -> Column:
    """Trim every control character and blank up to U+0020 on both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (jtrim(c) == "")


def nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def basename(path: Column) -> Column:
    """Part after the last slash or backslash."""
    return F.regexp_replace(path, r"(?s)^.*[/\\]", "")


def has_separator(path: Column) -> Column:
    return path.rlike(r"[/\\]")


def contains_any(fields: list[Column], term: str) -> Column:
    """Literal, case-insensitive substring in at least one field."""
    needle = F.lower(F.lit(term))
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(nz(f)), needle)
    return hit


def epoch_ms_of_text(c: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss.SSS` read as UTC; unreadable text gives null, not 0."""
    iso = F.replace(jtrim(c), F.lit(" "), F.lit("T"))
    # An explicit zone keeps the result independent of the session zone.
    return F.unix_millis(F.try_to_timestamp(F.concat(iso, F.lit("Z"))))


def tenant_key_ok(c: Column) -> Column:
    return F.coalesce(c.rlike("^[1-9][0-9]*$"), F.lit(False))


def severity_rank(c: Column) -> Column:
    return (F.when(c == "CRITICAL", 0).when(c == "HIGH", 1).when(c == "MEDIUM", 2)
            .when(c == "LOW", 3).otherwise(4))


def severity_action(c: Column) -> Column:
    return F.when(c.isin("CRITICAL", "HIGH"), F.lit("kill")).otherwise(F.lit("notify"))


def severity_icon(c: Column) -> Column:
    # Icon per severity.
    return (F.when(c == "CRITICAL", F.lit("🔴")).when(c == "HIGH", F.lit("🟠"))
            .when(c == "MEDIUM", F.lit("🟡")).otherwise(F.lit("⚪")))


def notification_line(severity: Column, host: Column, rule: Column, mitre: Column,
                      action: Column) -> Column:
    return F.format_string("%s [%s] host=%s rule=%s mitre=%s action=%s",
                           severity_icon(severity), severity, host, rule, mitre, action)


def response_line(host: Column, rule: Column, action: Column) -> Column:
    # Wording of the dry-run recommendation.
    label = (F.when(action == "kill", F.lit("프로세스 종료 권장"))
             .when(action == "isolate", F.lit("호스트 격리 권장"))
             .otherwise(F.lit("알림 권장")))
    return F.format_string(
        "[DRY-RUN] trigger=response host=%s rule=%s action=%s → %s (실행 안 함)",
        host, rule, action, label)


def kill_outcome(c: Column) -> Column:
    return F.when(c.isin("KILLED", "NO_MATCH", "FAILED"), c).otherwise(F.lit("FAILED"))


def risk_score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    return F.least(F.lit(100).cast("long"), critical * 25 + high * 10 + medium * 3 + low)


def host_status(score: Column) -> Column:
    return (F.when(score >= 25, F.lit("critical")).when(score >= 10, F.lit("warning"))
            .otherwise(F.lit("healthy")))


def bucket_floor(ts: Column, step: int) -> Column:
    """Start of the UTC-aligned bucket; floors below zero as well."""
    return ts - F.pmod(ts, F.lit(step).cast("long"))


def bucket_step(name: str) -> int:
    steps = {"hour": 3_600_000, "day": 86_400_000}
    if name not in steps:
        raise ValueError(f"unknown bucket: {name}")
    return steps[name]
