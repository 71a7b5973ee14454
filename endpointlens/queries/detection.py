"""Registered queries: ingestion, rules, alert storage, notification."""

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import scope
from ..catalog import RULES, with_catalog, with_rule_texts
from ..functions.ids import alert_id
from ..functions.text import nz
from ..operators import rules
from ..operators.asof import asof_join
from ..plans import alerts as alert_plans
from ..plans import hosts as host_plans
from ..plans import notify
from ..schema import ALERT_COLUMNS, EVENT, LOOKBACK_MS
from ..session import shared_folder
from ..sources import ingest, store
from ..sources.commits import CommittedTable
from .base import A, BASE, N, NOW, O, R, S, T, jtext, nodes_of, query, status_of, uuid3

def alert_rows(df):
    """Evidence lines as one text, so that result tables hold plain values only."""
    lines = F.array_join("matched", "\n").alias("matched")
    return df.select(*[c for c in df.columns if c != "matched"], lines)


# --- Rules -----------------------------------------------------------------------------------

_DETECTED = ", ".join(ALERT_COLUMNS)


@query("detections", f"WITH {R} SELECT {_DETECTED} FROM detected")
def detections(spark, d):
    return alert_rows(rules.detect(fx.telemetry(spark, d)))


def _rule(rule_id):
    return f"WITH {R} SELECT {_DETECTED} FROM detected WHERE rule_id = '{rule_id}'"


@query("rule_suspicious_process_chain", _rule("SUSPICIOUS_PROCESS_CHAIN"))
def rule_chain(spark, d):
    found = rules.sequence_alerts(rules.sequence_pairs(fx.telemetry(spark, d)))
    return alert_rows(found.where(F.col("rule_id") == "SUSPICIOUS_PROCESS_CHAIN"))


@query("rule_download_and_execute", _rule("DOWNLOAD_AND_EXECUTE"))
def rule_download(spark, d):
    only = rules.SEQUENCE_RULES[:1]
    return alert_rows(rules.sequence_alerts(
        rules.sequence_pairs(fx.telemetry(spark, d), only), only))


def _point(index):
    def run(spark, d):
        return alert_rows(rules.point_alerts(fx.telemetry(spark, d),
                                             rules.POINT_RULES[index:index + 1]))
    return run


query("rule_script_from_temp_path", _rule("SCRIPT_FROM_TEMP_PATH"))(_point(0))
query("rule_file_in_autorun_path", _rule("FILE_IN_AUTORUN_PATH"))(_point(1))
query("rule_weak_tls_handshake", _rule("WEAK_TLS_HANDSHAKE"))(_point(2))


@query("sequence_triggers", f"""WITH {R} SELECT seq, host, ts, process, cmdline FROM flags
WHERE temp_exec OR chain""")
def sequence_triggers(spark, d):
    return fx.telemetry(spark, d).where(rules.is_sequence_trigger()).select(
        "seq", "host", "ts", "process", "cmdline")


@query("correlatable_events", f"""WITH {R} SELECT seq, host, ts, type, process FROM flags
WHERE download OR office OR (type = 'process' AND regexp_matches(tk[1], 'downloads|temp|tmp'))""")
def correlatable_events(spark, d):
    return fx.telemetry(spark, d).where(rules.is_correlatable()).select(
        "seq", "host", "ts", "type", "process")


@query("asof_nearest_download", f"""WITH {T} SELECT p.seq, p.host, p.ts,
  (SELECT d.ts FROM telemetry d WHERE d.host = p.host AND d.type = 'network' AND d.dest_port IN (80,443,8080)
   AND d.ts BETWEEN p.ts - 300000 AND p.ts ORDER BY d.ts DESC, d.seq DESC LIMIT 1) AS download_ts,
  (SELECT d.seq FROM telemetry d WHERE d.host = p.host AND d.type = 'network' AND d.dest_port IN (80,443,8080)
   AND d.ts BETWEEN p.ts - 300000 AND p.ts ORDER BY d.ts DESC, d.seq DESC LIMIT 1) AS download_seq
  FROM telemetry p WHERE p.type = 'process'""")
def asof_nearest_download(spark, d):
    t = fx.telemetry(spark, d)
    left = t.where("type = 'process'").select("seq", "host", "ts")
    right = t.where(rules.is_download()).select("host", "ts", "seq")
    return asof_join(left, right, ["host"], back=LOOKBACK_MS, payload=["seq"]).select(
        "seq", "host", "ts", F.col("match.ts").alias("download_ts"),
        F.col("match.seq").alias("download_seq"))


# --- Ingestion -------------------------------------------------------------------------------

def _batches(spark, d):
    """One posted batch per event: the event with typical defects, plus a scalar element."""
    t = fx.telemetry(spark, d)
    n = F.col("seq")
    ts = (F.when(n % 13 == 0, F.floor(F.col("ts") / 1000).cast("string"))
          .when(n % 17 == 0, F.concat(F.lit('" '), F.col("ts").cast("string"), F.lit(' "')))
          .when(n % 23 == 0, F.lit(str(NOW * 2))).when(n % 29 == 0, F.lit('"soon"'))
          .otherwise(F.col("ts").cast("string")))
    rest = F.to_json(F.struct(
        F.when(n % 11 == 0, F.lit(" ")).otherwise(F.col("host")).alias("host"),
        F.when(n % 19 == 0, F.lit("registry")).otherwise(F.col("type")).alias("type"),
        "process", "parent", "cmdline",
        F.when(n % 7 == 0, F.lit(" ")).otherwise(F.col("dest_ip")).alias("destIp"),
        F.col("dest_port").cast("string").alias("destPort"),
        F.when(n % 31 == 0, F.lit("")).otherwise(F.col("domain")).alias("domain"), "detail",
        F.when(n % 2 == 0, F.concat(F.lit(" "), F.upper("sha256"))).otherwise(
            F.lit("xyz")).alias("sha256"), F.lit("evil").alias("tenantId")))
    event = F.concat(F.lit('{"ts":'), ts, F.lit(","), F.substr(rest, F.lit(2)))
    # Node keys of customers; the last ones of each host are current, the others are unknown.
    key = F.concat(F.lit("key-"), (n % 2000).cast("string"))
    return t.select(key.alias("node_key"), "seq",
                    F.concat(F.lit('{"events":[5,'), event, F.lit("]}")).alias("body"))


_INGEST = f"""{T}, {N},
raw AS (SELECT t.seq, CASE WHEN seq % 11 = 0 THEN ' ' ELSE t.host END AS host,
  CASE WHEN seq % 19 = 0 THEN 'registry' ELSE type END AS type,
  CASE WHEN seq % 13 = 0 THEN ts // 1000 WHEN seq % 17 = 0 THEN ts WHEN seq % 23 = 0 THEN {NOW * 2}
    WHEN seq % 29 = 0 THEN NULL ELSE ts END AS ts,
  process, parent, cmdline, CASE WHEN seq % 7 = 0 THEN ' ' ELSE dest_ip END AS dest_ip, dest_port,
  CASE WHEN seq % 31 = 0 THEN '' ELSE domain END AS domain, detail,
  CASE WHEN seq % 2 = 0 THEN sha256 ELSE '' END AS sha256, nodes.tenant_id AS tenant_id
  FROM telemetry t JOIN nodes ON nodes.node_key_hash = sha256('key-' || (t.seq % 2000))),
judged AS (SELECT *, CASE WHEN trim(host) = '' THEN 'no_host' WHEN type = 'registry' THEN 'unknown_type'
  WHEN ts IS NULL OR ts <= 0 THEN 'bad_ts' WHEN ts < 100000000000 THEN 'ts_in_seconds'
  WHEN type = 'network' AND trim(dest_ip) = '' THEN 'no_dest_ip'
  WHEN type IN ('dns','l7') AND trim(domain) = '' THEN 'no_domain' ELSE 'accepted' END AS outcome FROM raw)"""


@query("ingest_accepted", f"""WITH {_INGEST} SELECT seq, tenant_id, host, type,
  CASE WHEN ts > {NOW} + 60000 THEN {NOW} ELSE ts END AS ts, process, parent, cmdline, dest_ip, dest_port,
  domain, detail, sha256 FROM judged WHERE outcome = 'accepted'""")
def ingest_accepted(spark, d):
    accepted, _ = ingest.ingest(_batches(spark, d), nodes_of(spark, d), NOW)
    return accepted.select("seq", "tenant_id", "host", "type", "ts", "process", "parent",
                           "cmdline", "dest_ip", "dest_port", "domain", "detail", "sha256")


@query("ingest_outcomes", f"""WITH {_INGEST} SELECT outcome, count(*) AS events FROM judged GROUP BY outcome""")
def ingest_outcomes(spark, d):
    known, _ = ingest.authenticate(_batches(spark, d), nodes_of(spark, d))
    judged = ingest.validate(ingest.explode_batches(known), NOW)
    return judged.groupBy("outcome").agg(F.count("*").alias("events"))


@query("ingest_unknown_nodes", f"""WITH {T}, {N} SELECT 'key-' || (seq % 2000) AS node_key, count(*) AS batches
FROM telemetry WHERE sha256('key-' || (seq % 2000)) NOT IN (SELECT node_key_hash FROM nodes) GROUP BY 1""")
def ingest_unknown_nodes(spark, d):
    _, rejected = ingest.authenticate(_batches(spark, d), nodes_of(spark, d))
    return rejected.groupBy("node_key").agg(F.count("*").alias("batches"))


_EVENT_ROW = ("host, tenant_id, type, ts, process, parent, cmdline, dest_ip, dest_port, domain, "
              "detail, sha256, ingested_at")


@query("event_rows", f"WITH {T} SELECT {_EVENT_ROW} FROM telemetry")
def event_rows(spark, d):
    return store.event_rows(fx.telemetry(spark, d))


@query("retained_events", f"""WITH {T} SELECT {_EVENT_ROW} FROM telemetry
WHERE ingested_at >= {BASE + 10_000_000}""")
def retained_events(spark, d):
    now = BASE + 10_000_000 + 7 * 86_400_000
    return store.event_rows(store.retained(fx.telemetry(spark, d), "ingested_at", 7, now))


def _committed(spark, rows, schema, arrival):
    """A new table of commits that holds these rows."""
    held = CommittedTable(spark, f"{shared_folder(spark)}/endpointlens/commits/{uuid.uuid4().hex}", schema, arrival)
    held.append(rows, 0)
    return held


@query("retained_event_days", f"""WITH {T} SELECT {_EVENT_ROW} FROM telemetry
WHERE ingested_at >= {BASE + 10_000_000}""")
def retained_event_days(spark, d):
    """Retention by commits: days that are over leave without being read, the edge alone is written anew."""
    held = _committed(spark, fx.telemetry(spark, d), EVENT, "ingested_at")
    held.expire(BASE + 10_000_000 + 7 * 86_400_000, 7)
    return store.event_rows(held.read())


@query("retained_alert_versions", f"""WITH {A} SELECT id, tenant_id, host, rule_id, ts, ts + 2000 + later AS created_at
FROM alerts, (VALUES (0), (60000)) v(later) WHERE (later = 0 OR seq % 10 = 0) AND ts + 2000 + later >= {BASE + 10_000_000}""")
def retained_alert_versions(spark, d):
    held = _committed(spark, fx.stored_alerts(spark, d), store.ALERT_TABLE, "created_at")
    held.expire(BASE + 10_000_000 + store.ALERT_RETENTION_DAYS * 86_400_000, store.ALERT_RETENTION_DAYS)
    return held.read().select("id", "tenant_id", "host", "rule_id", "ts", "created_at")


# --- Alert storage ---------------------------------------------------------------------------

@query("alert_messages_ingested", f"""WITH {A} SELECT id, tenant_id, host, rule_id, severity, ts, matched,
  created_at FROM alerts WHERE seq % 17 <> 0 AND seq % 19 <> 0 AND seq % 13 <> 0 AND seq % 23 <> 0""")
def alert_messages_ingested(spark, d):
    parsed = store.parse_alert_messages(fx.alert_messages(fx.alerts(spark, d)))
    return alert_rows(parsed.select("id", "tenant_id", "host", "rule_id", "severity", "ts",
                                    "matched", "created_at"))


@query("latest_alerts", f"""WITH {A} SELECT id, tenant_id, host, rule_id, ts, created_at FROM alerts""")
def latest_alerts(spark, d):
    return fx.alerts(spark, d).select("id", "tenant_id", "host", "rule_id", "ts", "created_at")


@query("alert_version_counts", f"""WITH {A} SELECT versions, count(*) AS alerts FROM
  (SELECT tenant_id, host, id, count(*) AS versions FROM alert_log GROUP BY ALL) GROUP BY versions""")
def alert_version_counts(spark, d):
    per = fx.stored_alerts(spark, d).groupBy("tenant_id", "host", "id").agg(
        F.count("*").alias("versions"))
    return per.groupBy("versions").agg(F.count("*").alias("alerts"))


@query("alert_arrivals", f"""WITH {A} SELECT tenant_id, id, min(created_at) AS arrived_at FROM alert_log
GROUP BY ALL""")
def alert_arrivals(spark, d):
    return alert_plans.arrivals(fx.stored_alerts(spark, d))


@query("recent_alerts", f"""WITH {A} SELECT id, host, rule_id, ts, created_at FROM alerts
ORDER BY created_at DESC, seq DESC, id LIMIT 50""")
def recent_alerts(spark, d):
    return alert_plans.most_recent(fx.alerts(spark, d)).select("id", "host", "rule_id", "ts",
                                                               "created_at")


@query("detections_by_rule", f"""WITH {R} SELECT rule_id, severity, count(*) AS detections FROM detected
GROUP BY ALL""")
def detections_by_rule(spark, d):
    return alert_plans.detections_by_rule(rules.detect(fx.telemetry(spark, d)))


@query("detection_rate", f"""WITH {A}, slides AS (SELECT rule_id, (ts // 10000 - i) * 10000 AS window_start
  FROM alerts, range(3) r(i)) SELECT rule_id, window_start, count(*) AS alerts, round(count(*) / 30.0, 6) AS rate
FROM slides GROUP BY ALL""")
def detection_rate(spark, d):
    return alert_plans.detection_rate(fx.alerts(spark, d))


@query("stage_latency", f"""WITH {A}, arr AS (SELECT tenant_id, id, min(created_at) AS arrived FROM alert_log GROUP BY ALL)
SELECT a.id, a.rule_id, arr.arrived - t.ingested_at AS detect_ms, a.created_at - arr.arrived AS store_ms
FROM alerts a JOIN arr USING (tenant_id, id) JOIN telemetry t ON a.seq = t.seq""")
def stage_latency(spark, d):
    return alert_plans.stage_latency(fx.telemetry(spark, d), fx.stored_alerts(spark, d),
                                     fx.alerts(spark, d))


# --- Routing, cooldown, responses ------------------------------------------------------------

_ROUTED = f"""{A}, {O}, routed AS (SELECT a.*, coalesce(u.url, th.url) AS webhook_url,
  CASE WHEN u.url IS NOT NULL THEN 'user:' || o.user_id ELSE 'tenant:' || a.tenant_id END AS cooldown_id
  FROM alerts a LEFT JOIN owners o USING (tenant_id, host)
  LEFT JOIN (SELECT * FROM user_hooks WHERE trim(url) <> '') u ON o.user_id = u.user_id
  LEFT JOIN tenant_hooks th ON a.tenant_id = th.tenant_id WHERE coalesce(u.url, th.url) IS NOT NULL)"""


def _fold(rows: str, key: str, ok: str = "true") -> str:
    """Greedy cooldown as a recursive walk over the arrival order of each key."""
    return f"""ord AS (SELECT *, {key} AS ck, {ok} AS ok, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS rn FROM {rows}),
walk AS (SELECT ck, rn, seq, true AS passed, CASE WHEN ok THEN ts END AS last FROM ord WHERE rn = 1
  UNION ALL SELECT o.ck, o.rn, o.seq, w.last IS NULL OR o.ts - w.last >= 60000,
    CASE WHEN w.last IS NULL OR o.ts - w.last >= 60000 THEN CASE WHEN o.ok THEN o.ts END ELSE w.last END
  FROM walk w JOIN ord o ON o.ck = w.ck AND o.rn = w.rn + 1)"""


def _routed(spark, d):
    return notify.routes(fx.alerts(spark, d), host_plans.owners(fx.owner_log(spark, d)),
                         fx.user_webhooks(spark, d), fx.tenant_webhooks(spark, d))


@query("alert_routes", f"WITH {_ROUTED} SELECT id, host, rule_id, webhook_url, cooldown_id FROM routed")
def alert_routes(spark, d):
    return _routed(spark, d).select("id", "host", "rule_id", "webhook_url", "cooldown_id")


_ICON = ("CASE severity WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡' ELSE '⚪' END")
_KEY = "cooldown_id || '|' || host || '|' || rule_id"


@query("notifications", f"""WITH RECURSIVE {_ROUTED}, {_fold('routed', _KEY)}
SELECT r.id, r.webhook_url, {_ICON} || ' [' || severity || '] host=' || host || ' rule=' || rule_id || ' mitre=' ||
  mitre || ' action=' || action AS text FROM walk w JOIN routed r ON w.seq = r.seq AND w.ck = {_KEY}
WHERE w.passed""")
def notifications(spark, d):
    return notify.notifications(_routed(spark, d)).select("id", "webhook_url", "text")


@query("notifications_with_failures", f"""WITH RECURSIVE {_ROUTED}, {_fold('routed', _KEY, 'seq % 3 <> 0')}
SELECT r.id, r.cooldown_id, r.ts FROM walk w JOIN routed r ON w.seq = r.seq AND w.ck = {_KEY} WHERE w.passed""")
def notifications_with_failures(spark, d):
    routed = _routed(spark, d).withColumn("send_ok", F.col("seq") % 3 != 0)
    return notify.notifications(routed, send_ok="send_ok").select("id", "cooldown_id", "ts")


@query("response_recommendations", f"""WITH RECURSIVE {A}, {_fold('alerts', "host || '|' || action")}
SELECT a.id, a.host, '[DRY-RUN] trigger=response host=' || a.host || ' rule=' || a.rule_id || ' action=' || a.action ||
  ' → ' || CASE a.action WHEN 'kill' THEN '프로세스 종료 권장' WHEN 'isolate' THEN '호스트 격리 권장' ELSE '알림 권장' END ||
  ' (실행 안 함)' AS text FROM walk w JOIN alerts a ON w.seq = a.seq WHERE w.passed""")
def response_recommendations(spark, d):
    return notify.recommendations(fx.alerts(spark, d)).select("id", "host", "text")


@query("kill_targets", f"""WITH {A}, inv AS (SELECT DISTINCT tenant_id, host,
  CASE WHEN process = 'evil.exe' THEN 'c:\\users\\U\\downloads\\EVIL.exe' ELSE '/usr/bin/' || process END AS path
  FROM telemetry WHERE process <> ''),
tg AS (SELECT DISTINCT tenant_id, host, target, lower(regexp_extract(trim(target), '^([^ \\t]*)', 1)) AS w FROM alerts)
SELECT DISTINCT tg.tenant_id, tg.host, tg.target, inv.path FROM tg JOIN inv USING (tenant_id, host)
WHERE CASE WHEN regexp_matches(w, '[/\\\\]') THEN w = lower(path) ELSE w = regexp_extract(lower(path), '([^/\\\\]*)$', 1) END""")
def kill_targets(spark, d):
    path = F.when(F.col("process") == "evil.exe", F.lit("c:\\users\\U\\downloads\\EVIL.exe")).otherwise(
        F.concat(F.lit("/usr/bin/"), "process"))
    inventory = fx.telemetry(spark, d).where("process <> ''").select(
        "tenant_id", "host", path.alias("path"))
    return notify.kill_targets(fx.alerts(spark, d), inventory)


def _results(alerts):
    outcome = (F.when(F.col("seq") % 4 == 0, "KILLED").when(F.col("seq") % 4 == 1, "NO_MATCH")
               .when(F.col("seq") % 4 == 2, "oops"))
    return alerts.where("action = 'kill'").select(
        "tenant_id", "id", outcome.alias("outcome"), (F.col("ts") + 9000).alias("at"))


@query("kill_outcomes", f"""WITH {A} SELECT CASE seq % 4 WHEN 0 THEN 'KILLED' WHEN 1 THEN 'NO_MATCH' ELSE 'FAILED' END
  AS outcome, count(*) AS results FROM alerts WHERE action = 'kill' GROUP BY 1""")
def kill_outcomes(spark, d):
    from ..functions.text import kill_outcome
    return _results(fx.alerts(spark, d)).groupBy(
        kill_outcome(F.col("outcome")).alias("outcome")).agg(F.count("*").alias("results"))


@query("confirmed_on_kill", f"""WITH {S} SELECT tenant_id, id, arg_max(status, updated_at) AS status FROM (
  SELECT tenant_id, id, status, updated_at FROM overlay_log UNION ALL
  SELECT tenant_id, id, 'confirmed', ts + 9000 FROM alerts WHERE action = 'kill' AND seq % 4 = 0) GROUP BY ALL""")
def confirmed_on_kill(spark, d):
    alerts = fx.alerts(spark, d)
    log = fx.overlay_log(alerts).unionByName(notify.confirmations(_results(alerts), alerts))
    return alert_plans.triage_status(log).select("tenant_id", "id", "status")


# --- Triage and catalogue --------------------------------------------------------------------

@query("triage_status", f"WITH {S} SELECT tenant_id, id, status, updated_at FROM status")
def triage_status(spark, d):
    alerts = fx.alerts(spark, d)
    bad = alerts.select("tenant_id", "id", F.lit("closed").alias("status"),
                        (F.col("ts") + 90000).alias("updated_at"))
    return alert_plans.triage_status(fx.overlay_log(alerts).unionByName(bad))


@query("alert_status_overlay", f"""WITH {S} SELECT a.id, a.host, a.severity, coalesce(s.status,'open') AS status
FROM alerts a LEFT JOIN status s USING (tenant_id, id)""")
def alert_status_overlay(spark, d):
    return alert_plans.with_status(fx.alerts(spark, d), status_of(spark, d)).select(
        "id", "host", "severity", "status")


@query("open_alerts", f"""WITH {S} SELECT id, host, ts FROM alerts WHERE (tenant_id, id) NOT IN
  (SELECT (tenant_id, id) FROM status)""")
def open_alerts(spark, d):
    return alert_plans.with_status_filter(fx.alerts(spark, d), status_of(spark, d), "open").select(
        "id", "host", "ts")


@query("confirmed_alerts", f"""WITH {S} SELECT id, host, ts FROM alerts WHERE (tenant_id, id) IN
  (SELECT (tenant_id, id) FROM status WHERE status = 'confirmed')""")
def confirmed_alerts(spark, d):
    return alert_plans.with_status_filter(
        fx.alerts(spark, d), status_of(spark, d), "confirmed").select("id", "host", "ts")


@query("alert_threat_names", f"""WITH {S}, mixed AS (SELECT id, CASE WHEN seq % 5 = 0 THEN 'UNLISTED' ELSE rule_id END AS rule_id
  FROM alerts) SELECT s.id, s.rule_id, coalesce(c.threat_name, s.rule_id) AS threat_name,
  coalesce(c.category, '기타') AS category FROM mixed s LEFT JOIN catalog c USING (rule_id)""")
def alert_threat_names(spark, d):
    mixed = fx.alerts(spark, d).select("id", F.when(F.col("seq") % 5 == 0, "UNLISTED").otherwise(
        F.col("rule_id")).alias("rule_id"))
    return with_catalog(mixed).select("id", "rule_id", "threat_name", "category")


_TEXTS = ", ".join("('" + "','".join((r[0], r[1], r[3], r[4])) + "')" for r in RULES)


@query("alert_rule_texts", f"""WITH {A}, texts(rule_id, threat_name, catalog_mitre, description) AS (VALUES {_TEXTS}),
mixed AS (SELECT tenant_id, CASE WHEN seq % 5 = 0 THEN 'UNLISTED' ELSE rule_id END AS rule_id FROM alerts)
SELECT tenant_id, rule_id, coalesce(threat_name, rule_id) AS threat_name, catalog_mitre, coalesce(description, rule_id) AS description,
  count(*) AS alerts FROM mixed LEFT JOIN texts USING (rule_id) GROUP BY ALL""")
def alert_rule_texts(spark, d):
    mixed = fx.alerts(spark, d, ["rule_id"]).select("tenant_id", F.when(F.col("seq") % 5 == 0, "UNLISTED").otherwise(
        F.col("rule_id")).alias("rule_id"))
    counted = mixed.groupBy("tenant_id", "rule_id").agg(F.count("*").alias("alerts"))
    return with_rule_texts(counted).select("tenant_id", "rule_id", "threat_name", "catalog_mitre", "description", "alerts")


@query("alert_responses", f"""WITH {S} SELECT a.tenant_id, a.id, a.host, a.rule_id, c.threat_name, a.mitre, a.severity,
  a.action, a.ts, coalesce(s.status,'open') AS status, a.matched, a.domain, a.dest_ip
FROM alerts a JOIN catalog c USING (rule_id) LEFT JOIN status s USING (tenant_id, id)""")
def alert_responses(spark, d):
    return alert_rows(alert_plans.responses(fx.alerts(spark, d), status_of(spark, d)))


_OPEN = f"""{S}, op AS (SELECT a.id, a.host, a.severity, a.ts FROM alerts a WHERE tenant_id = '1'
  AND severity = 'MEDIUM' AND (tenant_id, id) NOT IN (SELECT (tenant_id, id) FROM status))"""


@query("alert_list_page", f"""WITH {_OPEN} SELECT *, (SELECT count(*) > 200 FROM op) AS has_more,
  (SELECT count(*) FROM op) AS total FROM op ORDER BY ts DESC, id OFFSET 100 LIMIT 100""")
def alert_list_page(spark, d):
    """Second page of a tenant's open alerts with the total of the same filter."""
    mine = scope.tenant_scope(fx.alerts(spark, d), "1")
    rows = alert_plans.with_status_filter(
        alert_plans.filtered(mine, severity="MEDIUM"), status_of(spark, d), "open").select(
        "id", "host", "severity", "ts")
    shown = scope.page(rows, scope.newest_first(rows), scope.clamp_limit("alerts", 0),
                       scope.resolve_offset(100))
    # One row on the right side.
    return shown.join(F.broadcast(rows.agg(F.count("*").alias("total"))))
