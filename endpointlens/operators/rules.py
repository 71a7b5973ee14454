"""Detection rules: point rules are plain columns, sequence rules are bounded as-of lookups.

A `SequenceRule` names a trigger, the evidence it needs and the equi keys that tie the two
together, so further rules can be registered without touching the detectors.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cmdline import executable_from_temp, path_argument_from_temp
from ..functions.detail import detail_number, detail_text
from ..functions.ids import alert_id
from ..functions.paths import is_autorun_path
from ..functions.text import is_blank, nz, severity_action
from ..schema import (ALERT_COLUMNS, BASELINE_SAFE, DOWNLOAD_PORTS, LOOKBACK_MS, OFFICE_APPS,
                      SHELLS, WEAK_TLS)
from .asof import asof_lookup


def _c(name: str) -> Column:
    return F.col(name)


def _is(type_: str) -> Column:
    return _c("type") == type_


def _lower(name: str) -> Column:
    return F.lower(_c(name))


def not_baseline() -> Column:
    return ~_lower("process").isin(*BASELINE_SAFE)


def runs_from_temp() -> Column:
    return _is("process") & not_baseline() & executable_from_temp(_c("cmdline"))


def office_child_shell() -> Column:
    return (_is("process") & not_baseline() & _lower("process").isin(*SHELLS)
            & _lower("parent").isin(*OFFICE_APPS))


def is_download() -> Column:
    return _is("network") & _c("dest_port").isin(*DOWNLOAD_PORTS)


def is_office_exec() -> Column:
    return _is("process") & _lower("process").isin(*OFFICE_APPS)


def is_sequence_trigger() -> Column:
    return F.coalesce(runs_from_temp() | office_child_shell(), F.lit(False))


def is_correlatable() -> Column:
    """Worth keeping as evidence; everything else is dropped before any shuffle."""
    temp_exec = _is("process") & executable_from_temp(_c("cmdline"))
    return F.coalesce(is_download() | is_office_exec() | temp_exec, F.lit(False))


@dataclass(frozen=True)
class PointRule:
    rule_id: str
    mitre: str
    severity: str
    when: Callable[[], Column]


@dataclass(frozen=True)
class SequenceRule:
    """`trigger_keys` and `evidence_keys` are arrays; sharing one element makes a pair."""

    rule_id: str
    mitre: str
    severity: str
    trigger: Callable[[], Column]
    evidence: Callable[[], Column]
    trigger_keys: Callable[[], Column]
    evidence_keys: Callable[[], Column]


def _script_from_temp() -> Column:
    return _is("script") & path_argument_from_temp(_c("cmdline"))


def _file_in_autorun() -> Column:
    removed = F.coalesce(F.lower(detail_text(_c("detail"), "action")) == "delete", F.lit(False))
    return _is("file") & is_autorun_path(_c("cmdline")) & ~removed


def _weak_tls() -> Column:
    version = F.lower(detail_text(_c("detail"), "tlsVersion"))
    return _is("l7") & F.coalesce(version.isin(*WEAK_TLS), F.lit(False))


def _parent_key(*parts: Column) -> Column:
    return F.concat_ws("|", F.lit("parent"), *parts)


def _chain_trigger_keys() -> Column:
    """An unobserved ppid accepts any pid; an observed one accepts its equal or an unobserved."""
    name, ppid = _lower("parent"), detail_number(_c("detail"), "ppid")
    return F.when(ppid.isNull(), F.array(_parent_key(name, F.lit("*")))).otherwise(
        F.array(_parent_key(name, ppid.cast("string")), _parent_key(name, F.lit("?"))))


def _chain_evidence_keys() -> Column:
    name, pid = _lower("process"), detail_number(_c("detail"), "pid")
    return F.array(_parent_key(name, F.lit("*")),
                   _parent_key(name, F.coalesce(pid.cast("string"), F.lit("?"))))


# In order of priority; the first rule that fires names the alert.
SEQUENCE_RULES = (
    SequenceRule("DOWNLOAD_AND_EXECUTE", "T1105+T1204", "CRITICAL", runs_from_temp, is_download,
                 lambda: F.array(F.lit("download")), lambda: F.array(F.lit("download"))),
    SequenceRule("SUSPICIOUS_PROCESS_CHAIN", "T1059", "HIGH", office_child_shell, is_office_exec,
                 _chain_trigger_keys, _chain_evidence_keys),
)
POINT_RULES = (
    PointRule("SCRIPT_FROM_TEMP_PATH", "T1059", "MEDIUM", _script_from_temp),
    PointRule("FILE_IN_AUTORUN_PATH", "T1547", "MEDIUM", _file_in_autorun),
    PointRule("WEAK_TLS_HANDSHAKE", "T1573", "MEDIUM", _weak_tls),
)

# The columns of an event that judging and summarising need.
FACTS = ["seq", "host", "tenant_id", "type", "ts", "process", "parent", "cmdline", "dest_ip",
         "dest_port", "domain", "detail"]
EVIDENCE_FACTS = ["seq", "type", "process", "parent", "cmdline", "dest_ip", "dest_port", "domain",
                  "detail"]


def summary(e: Column) -> Column:
    """One evidence line; the source-event match reads this format back."""
    tls = nz(F.get_json_object(e["detail"], "$.tlsVersion"))
    return (F.when(e["type"] == "network",
                   F.concat(F.lit("network "), e["dest_ip"], F.lit(":"),
                            e["dest_port"].cast("string")))
            .when(e["type"] == "script",
                  F.concat(F.lit("script "), e["process"], F.lit(" ("), e["cmdline"], F.lit(")")))
            .when(e["type"] == "file", F.concat(F.lit("file "), e["cmdline"]))
            .when(e["type"] == "l7",
                  F.concat(F.lit("l7 "), e["domain"], F.lit(" ("), tls, F.lit(")")))
            .otherwise(F.concat(F.lit("process "), e["process"], F.lit(" (parent "), e["parent"],
                                F.lit(")"))))


def _has_dest(e: Column) -> Column:
    return F.coalesce(~is_blank(e["dest_ip"]) | ~is_blank(e["domain"]), F.lit(False))


def assemble(judged: DataFrame, rule_id: Column, mitre: Column, severity: Column,
             trigger: Column, prior: Column | None = None) -> DataFrame:
    """Alert rows: evidence first, trigger last; time, tenant and host come from the trigger."""
    lines = F.array(summary(trigger))
    owner_ip = F.when(_has_dest(trigger), trigger["dest_ip"])
    owner_domain = F.when(_has_dest(trigger), trigger["domain"])
    if prior is not None:
        lines = F.when(prior.isNotNull(), F.array(summary(prior), summary(trigger))).otherwise(lines)
        owner_ip = F.when(_has_dest(prior), prior["dest_ip"]).otherwise(owner_ip)
        owner_domain = F.when(_has_dest(prior), prior["domain"]).otherwise(owner_domain)
    columns = {
        "id": alert_id(trigger["tenant_id"], trigger["host"], rule_id, trigger["ts"]),
        "tenant_id": trigger["tenant_id"], "host": trigger["host"], "rule_id": rule_id,
        "mitre": mitre, "severity": severity, "action": severity_action(severity),
        "ts": trigger["ts"], "matched": lines,
        "target": F.when(is_blank(trigger["cmdline"]), trigger["process"]).otherwise(
            trigger["cmdline"]),
        "domain": nz(owner_domain), "dest_ip": nz(owner_ip), "seq": trigger["seq"],
    }
    return judged.select(*[columns[c].alias(c) for c in ALERT_COLUMNS])


def point_alerts(events: DataFrame, rules: tuple[PointRule, ...] = POINT_RULES) -> DataFrame:
    """Stateless branch: no shuffle, works on batches and streams alike."""
    fired = None
    for r in rules:
        verdict = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.mitre).alias("mitre"),
                           F.lit(r.severity).alias("severity"))
        fired = F.when(r.when(), verdict) if fired is None else fired.when(r.when(), verdict)
    # The type filter is stated on its own so that it reaches the scan.
    types = events.where(_c("type").isin("script", "file", "l7")).where(_c("host") != "")
    judged = (types.select(F.struct(*FACTS).alias("e"), fired.alias("v"))
              .where(F.col("v").isNotNull()))
    return assemble(judged, F.col("v.rule_id"), F.col("v.mitre"), F.col("v.severity"), F.col("e"))


def _tagged(keys: Column, index: int) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(f"{index}:"), k))


def rule_keys(rules, predicate: str, keys: str) -> Column:
    """Keys of every rule whose predicate holds, marked with the index of the rule."""
    parts = [F.when(getattr(r, predicate)(), _tagged(getattr(r, keys)(), i))
             .otherwise(F.array().cast("array<string>")) for i, r in enumerate(rules)]
    return F.concat(*parts)


def sequence_pairs(events: DataFrame, rules: tuple[SequenceRule, ...] = SEQUENCE_RULES,
                   lookback: int = LOOKBACK_MS) -> DataFrame:
    """Triggers with the nearest evidence of the first rule that has any.

    All rules share one as-of lookup: keys carry the rule's index, triggers and evidence are
    exploded over their keys, and only those rows are shuffled.
    """
    known = events.where(_c("type").isin("process", "network")).where(_c("host") != "")
    evidence = (known.select(*FACTS, rule_keys(rules, "evidence", "evidence_keys").alias("_keys"))
                .where(F.size("_keys") > 0).withColumn("_key", F.explode("_keys")))
    triggers = (known.where(_is("process"))
                .select(*FACTS, rule_keys(rules, "trigger", "trigger_keys").alias("_keys"))
                .where(F.size("_keys") > 0).withColumn("_key", F.explode("_keys")))
    found = asof_lookup(triggers, evidence, ["host", "_key"], back=lookback, order=["seq"],
                        payload=EVIDENCE_FACTS)
    ranked = triggers.join(found, ["host", "_key", "ts"]).select(
        "host", F.struct(*FACTS).alias("e"),
        F.struct((-F.substring_index("_key", ":", 1).cast("int")).alias("rank"),
                 F.col("match.ts").alias("ts"), F.col("match.seq").alias("seq"),
                 F.col("match").alias("row")).alias("cand"))
    # A trigger has at most a handful of keys, so these groups stay tiny.
    return (ranked.groupBy("host", F.col("e.seq").alias("_seq"))
            .agg(F.first("e").alias("e"), F.max("cand").alias("cand"))
            .select("e", (-F.col("cand.rank")).alias("rule"), F.col("cand.row").alias("prior")))


def sequence_alerts(pairs: DataFrame, rules: tuple[SequenceRule, ...] = SEQUENCE_RULES) -> DataFrame:
    def pick(field):
        return F.element_at(F.array(*[F.lit(getattr(r, field)) for r in rules]),
                            F.col("rule") + 1)

    return assemble(pairs, pick("rule_id"), pick("mitre"), pick("severity"), F.col("e"),
                    F.col("prior"))


def detect(events: DataFrame, lookback: int = LOOKBACK_MS,
           sequence_rules: tuple[SequenceRule, ...] = SEQUENCE_RULES,
           point_rules: tuple[PointRule, ...] = POINT_RULES) -> DataFrame:
    """Judge a whole event table with complete information."""
    found = sequence_alerts(sequence_pairs(events, sequence_rules, lookback), sequence_rules)
    return found.unionByName(point_alerts(events, point_rules)) if point_rules else found
