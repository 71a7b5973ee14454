"""Registered queries: event, alert, host, topology, geo, search and operations reports."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import scope
from ..catalog import rule_ids_named
from ..functions.text import contains_any
from ..plans import alerts as alert_plans
from ..plans import events as event_plans
from ..plans import geo, hosts, ops, search, topology
from .base import (A, BASE, FROM, N, NOW, O, S, T, TO, jint, jtext, nodes_of, query,
                   status_of, uuid3)

EVENT_ID = uuid3("host||'|'||ts||'|'||type||'|'||process||'|'||coalesce(CAST("
                 + jint("pid") + " AS VARCHAR),'')||'|'||parent||'|'||dest_ip||'|'||dest_port")


# --- Events ----------------------------------------------------------------------------------

@query("events_in_range", f"""WITH {T} SELECT seq, tenant_id, host, type, ts, cmdline FROM telemetry
WHERE type = 'process' AND ts >= {FROM} AND ts <= {TO}""")
def events_in_range(spark, d):
    rows = event_plans.filtered(fx.telemetry(spark, d), host=" ", type_=" process ", start=FROM,
                                end=TO)
    return rows.select("seq", "tenant_id", "host", "type", "ts", "cmdline")


@query("events_by_hash", f"""WITH {T} SELECT seq, host, sha256 FROM telemetry
WHERE sha256 = sha256('evil.exe' || '2')""")
def events_by_hash(spark, d):
    import hashlib
    wanted = hashlib.sha256(b"evil.exe2").hexdigest().upper()
    return event_plans.filtered(fx.telemetry(spark, d), sha256=wanted).select("seq", "host",
                                                                             "sha256")


@query("event_responses", f"""WITH {T} SELECT {EVENT_ID} AS id, seq, host, type, ts, process, ingested_at,
  {jint('pid')} AS pid, {jint('ppid')} AS ppid, {jtext('protocol')} AS protocol, {jtext('action')} AS action,
  {jtext('queryType')} AS dns_record_type, CASE WHEN type = 'dns' THEN json_extract_string(detail, '$.answers[0]') END AS dns_answers,
  {jtext('tlsVersion')} AS tls_version, {jtext('l7Protocol')} AS l7_protocol FROM telemetry""")
def event_responses(spark, d):
    rows = event_plans.responses(fx.telemetry(spark, d))
    return rows.select("id", "seq", "host", "type", "ts", "process", "ingested_at", "pid", "ppid",
                       "protocol", "action", "dns_record_type",
                       F.array_join("dns_answers", ",").alias("dns_answers"), "tls_version",
                       "l7_protocol")


@query("newest_events_page", f"""WITH {T}, p AS (SELECT {EVENT_ID} AS id, host, ts, type FROM telemetry
  WHERE tenant_id = '2' AND ts <= {TO} ORDER BY ts DESC, id OFFSET 100 LIMIT 101)
SELECT *, (SELECT count(*) > 100 FROM p) AS has_more FROM p ORDER BY ts DESC, id LIMIT 100""")
def newest_events_page(spark, d):
    """The second page of a tenant's list, its end frozen by the first page."""
    rows = scope.tenant_scope(fx.telemetry(spark, d), " 2 ")
    rows = event_plans.with_event_id(event_plans.filtered(rows, end=TO)).select(
        F.col("event_id").alias("id"), "host", "ts", "type")
    return scope.page(rows, scope.newest_first(rows), scope.clamp_limit("events", None),
                      scope.resolve_offset(100))


@query("event_by_id", f"""WITH {T}, ids AS (SELECT *, {EVENT_ID} AS event_id FROM telemetry WHERE type = 'network')
SELECT event_id, host, ts, dest_ip FROM ids ORDER BY ts DESC, seq DESC LIMIT 1""")
def event_by_id(spark, d):
    """Looks up the newest connection by its id."""
    t = fx.telemetry(spark, d)
    newest = event_plans.with_event_id(t.where("type = 'network'")).orderBy(
        F.desc("ts"), F.desc("seq")).select("host", "ts", "event_id").first()
    return event_plans.by_id(t, newest["host"], newest["ts"], newest["event_id"]).select(
        "event_id", "host", "ts", "dest_ip")


@query("tenant_sql_by_type", f"""WITH {T} SELECT type, count(*) AS events, max(ts) AS last_seen FROM telemetry
WHERE tenant_id = '2' AND ts >= {FROM} AND ts < {TO} GROUP BY type""")
def tenant_sql_by_type(spark, d):
    """SQL text with named parameters over tables locked to one tenant."""
    return scope.tenant_sql(
        spark, "SELECT type, count(*) AS events, max(ts) AS last_seen FROM {events} "
               "WHERE ts >= :start AND ts < :stop GROUP BY type",
        "2", {"start": FROM, "stop": TO}, events=fx.telemetry(spark, d))


@query("events_by_type", f"""WITH {T} SELECT tenant_id, type, count(*) AS events FROM telemetry
GROUP BY GROUPING SETS ((tenant_id, type), (tenant_id))""")
def events_by_type(spark, d):
    return event_plans.count_by_type(fx.telemetry(spark, d))


@query("hosts_last_seen", f"WITH {T} SELECT tenant_id, host, max(ts) AS last_seen FROM telemetry GROUP BY ALL")
def hosts_last_seen(spark, d):
    return event_plans.hosts_last_seen(fx.telemetry(spark, d))


@query("event_count", f"WITH {T} SELECT tenant_id, count(*) AS events FROM telemetry WHERE ts >= {FROM} AND ts <= {TO} GROUP BY tenant_id")
def event_count(spark, d):
    return event_plans.filtered(fx.telemetry(spark, d), start=FROM, end=TO).groupBy("tenant_id").agg(
        F.count("*").alias("events"))


@query("events_per_destination", f"""WITH {T} SELECT tenant_id, dest_ip, count(*) AS events FROM telemetry
WHERE dest_ip <> '' AND ts >= {FROM} AND ts < {TO} GROUP BY ALL""")
def events_per_destination(spark, d):
    return event_plans.per_destination(fx.telemetry(spark, d), FROM, TO)


# --- Alerts ----------------------------------------------------------------------------------

@query("alerts_without_destination", f"""WITH {A} SELECT id, host, ts FROM alerts
WHERE domain = '' AND dest_ip = '' AND severity = 'MEDIUM' AND ts >= {FROM} AND ts < {TO}""")
def alerts_without_destination(spark, d):
    return alert_plans.filtered(fx.alerts(spark, d), severity="MEDIUM", domain="", dest_ip="",
                                start=FROM, end=TO).select("id", "host", "ts")


@query("alerts_for_domain", f"WITH {A} SELECT id, host, ts FROM alerts WHERE domain = 'a3.example.com'")
def alerts_for_domain(spark, d):
    return alert_plans.filtered(fx.alerts(spark, d), domain=" A3.Example.com ").select(
        "id", "host", "ts")


@query("alert_by_id", f"""WITH {A} SELECT id, host, rule_id FROM alerts WHERE tenant_id = '1'
ORDER BY ts DESC, id LIMIT 1""")
def alert_by_id(spark, d):
    mine = scope.tenant_scope(fx.alerts(spark, d), "1")
    newest = mine.orderBy(F.desc("ts"), "id").select("id").first()[0]
    return mine.where(F.col("id") == newest).limit(1).select("id", "host", "rule_id")


@query("alert_count", f"WITH {A} SELECT tenant_id, count(*) AS alerts FROM alerts WHERE ts >= {FROM} AND ts < {TO} GROUP BY tenant_id")
def alert_count(spark, d):
    return alert_plans.filtered(fx.alerts(spark, d, []), start=FROM, end=TO).groupBy("tenant_id").agg(
        F.count("*").alias("alerts"))


@query("alert_severity_summary", f"""WITH {A} SELECT tenant_id, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) AS total FROM alerts GROUP BY tenant_id""")
def alert_severity_summary(spark, d):
    return alert_plans.by_severity(fx.alerts(spark, d, ["severity"]))


@query("top_threats", f"""WITH {S} SELECT tenant_id, coalesce(category, '기타') AS category, count(*) AS alerts
FROM alerts LEFT JOIN catalog USING (rule_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY count(*) DESC, coalesce(category, '기타')) <= 5""")
def top_threats(spark, d):
    return alert_plans.top_threats(fx.alerts(spark, d, ["rule_id"]))


_SERIES = f"""{A}, grid AS (SELECT tenant_id, unnest(range({FROM - FROM % 3_600_000}, {TO}, 3600000)) AS bucket_start FROM (SELECT DISTINCT tenant_id FROM alerts)),
  hits AS (SELECT tenant_id, ts // 3600000 * 3600000 AS bucket_start, severity FROM alerts WHERE ts >= {FROM} AND ts < {TO})"""


@query("alert_timeseries", f"""WITH {_SERIES} SELECT tenant_id, bucket_start, count(severity) FILTER (severity = 'CRITICAL') AS critical,
  count(severity) FILTER (severity = 'HIGH') AS high, count(severity) FILTER (severity = 'MEDIUM') AS medium,
  count(severity) AS total FROM grid LEFT JOIN hits USING (tenant_id, bucket_start) GROUP BY ALL""")
def alert_timeseries(spark, d):
    alerts = fx.alerts(spark, d, ["severity"])
    return alert_plans.zero_filled(alert_plans.timeseries(alerts, FROM, TO, "hour"), alerts, FROM, TO, "hour")


@query("alert_timeseries_daily", f"""WITH {A} SELECT b.tenant_id, b.bucket_start, count(severity) FILTER (severity = 'CRITICAL') AS critical,
  count(severity) FILTER (severity = 'HIGH') AS high, count(severity) FILTER (severity = 'MEDIUM') AS medium,
  count(severity) AS total FROM (SELECT tenant_id, unnest(range({BASE - 86_400_000}, {BASE + 86_400_001}, 86400000)) AS bucket_start FROM (SELECT DISTINCT tenant_id FROM alerts)) b
  LEFT JOIN alerts a ON a.tenant_id = b.tenant_id AND ts // 86400000 * 86400000 = b.bucket_start GROUP BY ALL""")
def alert_timeseries_daily(spark, d):
    start, end = BASE - 86_400_000, BASE + 86_400_001
    alerts = fx.alerts(spark, d, ["severity"])
    return alert_plans.zero_filled(alert_plans.timeseries(alerts, start, end, "day"), alerts, start, end, "day")


@query("open_alerts_per_host", f"""WITH {S} SELECT tenant_id, host, count(*) AS open_total,
  count(*) FILTER (severity = 'CRITICAL') AS open_critical, count(*) FILTER (severity = 'HIGH') AS open_high
FROM alerts WHERE (tenant_id, id) NOT IN (SELECT (tenant_id, id) FROM status) GROUP BY ALL""")
def open_alerts_per_host(spark, d):
    return alert_plans.open_per_host(fx.alerts(spark, d), status_of(spark, d))


@query("alerts_per_destination", f"""WITH {A} SELECT tenant_id, host, CASE WHEN domain <> '' THEN domain ELSE dest_ip END AS dest,
  count(*) AS alerts FROM alerts WHERE (domain <> '' OR dest_ip <> '') AND ts >= {FROM} AND ts < {TO} GROUP BY ALL""")
def alerts_per_destination(spark, d):
    return alert_plans.per_destination(fx.alerts(spark, d), FROM, TO)


# --- Hosts -----------------------------------------------------------------------------------

_RISK = f"""{S}, mix AS (SELECT tenant_id, host, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity = 'LOW') AS low, count(*) AS open_total FROM alerts
  WHERE (tenant_id, id) NOT IN (SELECT (tenant_id, id) FROM status) GROUP BY ALL),
risk AS (SELECT *, least(100, 25 * critical + 10 * high + 3 * medium + low) AS risk_score FROM mix)"""
_LEVEL = "CASE WHEN {0} >= 25 THEN 'critical' WHEN {0} >= 10 THEN 'warning' ELSE 'healthy' END"


@query("host_risk", f"""WITH {_RISK} SELECT tenant_id, host, critical, high, medium, low, risk_score,
  {_LEVEL.format('risk_score')} AS status, open_total AS open_alerts FROM risk""")
def host_risk(spark, d):
    return hosts.risk_per_host(hosts.severity_per_host(fx.alerts(spark, d), status_of(spark, d)))


_HOSTS = f"""{_RISK}, {N}, seen AS (SELECT tenant_id, host, max(ts) AS last_seen FROM telemetry GROUP BY ALL),
hosts AS (SELECT coalesce(s.tenant_id, n.tenant_id) AS tenant_id, coalesce(s.host, n.host) AS host,
  coalesce(last_seen, 0) AS last_seen, {_LEVEL.format('coalesce(risk_score, 0)')} AS status,
  coalesce(open_total, 0) AS threats, coalesce(risk_score, 0) AS risk_score, n.host IS NOT NULL AS enrolled,
  coalesce(n.last_seen_at, 0) AS agent_seen, coalesce(platform, '') AS platform
  FROM seen s FULL JOIN nodes n ON s.tenant_id = n.tenant_id AND lower(s.host) = lower(n.host)
  LEFT JOIN risk r ON r.tenant_id = s.tenant_id AND r.host = s.host)"""


def _hosts(spark, d):
    return hosts.host_list(fx.telemetry(spark, d), fx.alerts(spark, d), status_of(spark, d),
                           nodes_of(spark, d))


@query("host_list", f"WITH {_HOSTS} SELECT * FROM hosts")
def host_list(spark, d):
    return hosts.host_order(_hosts(spark, d))


@query("host_summary", f"""WITH {_HOSTS} SELECT tenant_id,
  count(*) FILTER (NOT (last_seen = 0 AND enrolled) AND status = 'healthy') AS healthy,
  count(*) FILTER (NOT (last_seen = 0 AND enrolled) AND status = 'warning') AS warning,
  count(*) FILTER (NOT (last_seen = 0 AND enrolled) AND status = 'critical') AS critical,
  count(*) AS total, count(*) FILTER (last_seen = 0 AND enrolled) AS no_events FROM hosts GROUP BY tenant_id""")
def host_summary(spark, d):
    return hosts.host_summary(_hosts(spark, d))


@query("enrolled_nodes", f"WITH {N} SELECT * FROM nodes")
def enrolled_nodes(spark, d):
    return nodes_of(spark, d)


@query("tenant_nodes", f"WITH {N} SELECT host, last_seen_at, platform FROM nodes WHERE tenant_id = '1'")
def tenant_nodes(spark, d):
    return hosts.tenant_nodes(nodes_of(spark, d), "1")


@query("host_owners", f"WITH {O} SELECT tenant_id, host, user_id, t_at AS at FROM owners")
def host_owners(spark, d):
    return hosts.owners(fx.owner_log(spark, d))


@query("ownership_conflicts", f"""WITH {O} SELECT l.tenant_id, l.host, l.user_id, l.t_at AS at, o.user_id AS owner_id
FROM owner_log l JOIN owners o USING (tenant_id, host) WHERE l.user_id <> o.user_id""")
def ownership_conflicts(spark, d):
    return hosts.ownership_conflicts(fx.owner_log(spark, d))


@query("hosts_of_user", f"WITH {O} SELECT tenant_id, host FROM owners WHERE user_id = 7")
def hosts_of_user(spark, d):
    return hosts.hosts_of_user(hosts.owners(fx.owner_log(spark, d)), 7)


# --- Topology --------------------------------------------------------------------------------

_REL = f"""{T}, dest AS (SELECT *, CASE WHEN domain <> '' THEN domain ELSE dest_ip END AS dest,
  CASE WHEN domain <> '' THEN 'domain' ELSE 'ip' END AS dest_kind FROM telemetry
  WHERE (domain <> '' OR dest_ip <> '') AND ts >= {FROM} AND ts < {TO}),
labels AS (SELECT *, unnest([{jtext('protocol')}, {jtext('l7Protocol')}]) AS label FROM dest),
rel AS (SELECT tenant_id, host, dest, dest_kind, count(*) // 2 AS events, max(ts) AS last_seen,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label IS NOT NULL), '') AS protocols FROM labels GROUP BY ALL)"""


def _edges(spark, d, find=None):
    rows = topology.with_destination(fx.telemetry(spark, d), FROM, TO, find)
    return topology.relations(rows)


def _flat(df):
    return df.withColumn("protocols", F.array_join("protocols", ","))


@query("egress_relations", f"""WITH {_REL} SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY events DESC, host, dest) <= 200""")
def egress_relations(spark, d):
    return _flat(topology.top_relations(_edges(spark, d), scope.clamp_limit("topology", None)))


@query("egress_search", f"""WITH {_REL} SELECT * FROM rel WHERE dest ILIKE '%A3.EXAMPLE%'""")
def egress_search(spark, d):
    return _flat(_edges(spark, d, " A3.exAmple "))


@query("relation_total", f"WITH {_REL} SELECT tenant_id, count(DISTINCT (host, dest)) AS total FROM dest GROUP BY tenant_id")
def relation_total(spark, d):
    return topology.relation_total(topology.with_destination(fx.telemetry(spark, d), FROM, TO))


@query("relation_truncation", f"""WITH {_REL}, n AS (SELECT tenant_id, count(DISTINCT (host, dest)) AS total FROM dest GROUP BY tenant_id)
SELECT tenant_id, total, least(total, 200) AS shown, total > 200 AS truncated FROM n""")
def relation_truncation(spark, d):
    rows = topology.with_destination(fx.telemetry(spark, d), FROM, TO)
    return topology.shown_and_total(rows, 200)


@query("topology_edges", f"""WITH {_REL}, {A.replace(T + ',', '', 1).lstrip()},
per AS (SELECT tenant_id, host, CASE WHEN domain <> '' THEN domain ELSE dest_ip END AS dest, count(*) AS alerts
  FROM alerts WHERE (domain <> '' OR dest_ip <> '') AND ts >= {FROM} AND ts < {TO} GROUP BY ALL)
SELECT tenant_id, 'host:' || host AS "from", 'dest:' || dest AS "to", events, coalesce(alerts, 0) AS alerts,
  protocols, last_seen FROM rel LEFT JOIN per USING (tenant_id, host, dest)""")
def topology_edges(spark, d):
    per = alert_plans.per_destination(fx.alerts(spark, d), FROM, TO)
    return _flat(topology.edge_table(_edges(spark, d), per))


_NODES = f"""{_REL}, {_RISK.replace(T + ',', '', 1).lstrip()},
grp AS (SELECT tenant_id, count(DISTINCT dest) AS members FROM rel WHERE dest LIKE '%.example.com' GROUP BY 1 HAVING count(DISTINCT dest) > 1)"""


@query("topology_nodes", f"""WITH {_NODES}
SELECT DISTINCT tenant_id, 'host:' || host AS node_id, 'endpoint' AS kind, host AS label, NULL AS dest_kind, NULL AS group_id,
  coalesce(risk_score, 0) AS risk_score, coalesce(open_total, 0) AS open_alerts, NULL AS members FROM rel LEFT JOIN risk USING (tenant_id, host)
UNION ALL SELECT DISTINCT tenant_id, 'dest:' || dest, 'destination', dest, dest_kind,
  CASE WHEN dest_kind = 'domain' AND members IS NOT NULL THEN 'group:example.com' END, NULL, NULL, NULL FROM rel LEFT JOIN grp USING (tenant_id)
UNION ALL SELECT tenant_id, 'group:example.com', 'domainGroup', 'example.com', NULL, NULL, NULL, NULL, members FROM grp""")
def topology_nodes(spark, d):
    risk = hosts.risk_per_host(hosts.severity_per_host(fx.alerts(spark, d), status_of(spark, d)))
    return topology.node_table(_edges(spark, d), risk, fx.suffixes(spark))


_SUFFIX = "('com'),('net'),('org'),('io'),('kr'),('co.kr'),('or.kr'),('jp'),('co.jp'),('uk'),('co.uk')"
_PAGE_DOMAINS = f"""names AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS name FROM pages),
sfx(s) AS (VALUES {_SUFFIX}),
best AS (SELECT name, arg_max(s, length(s)) AS s FROM names JOIN sfx ON name LIKE '%.' || s GROUP BY name),
regd AS (SELECT name, regexp_extract(name, '([^.]+)\\.' || replace(s, '.', '\\.') || '$', 1) || '.' || s AS registrable FROM best)"""


@query("registrable_domains", f"WITH {_PAGE_DOMAINS} SELECT name, registrable FROM regd")
def registrable_domains(spark, d):
    return topology.registrable_domains(fx.domains(spark, d), fx.suffixes(spark), "domain")


@query("page_domain_groups", f"""WITH {_PAGE_DOMAINS} SELECT '1' AS tenant_id, registrable, count(*) AS members
FROM regd GROUP BY registrable HAVING count(*) > 1""")
def page_domain_groups(spark, d):
    dests = fx.domains(spark, d).select(F.lit("1").alias("tenant_id"), F.lower("domain").alias(
        "dest"))
    return topology.domain_groups(dests, fx.suffixes(spark))


# --- Geography -------------------------------------------------------------------------------

_ISO = "['US','KR','JP','DE','FR','ZZ','GB','BR','IN','AU']"


_GEO = f"""WITH {T}, per AS (SELECT tenant_id, dest_ip, count(*) AS n FROM telemetry WHERE dest_ip <> ''
  AND ts >= {FROM} AND ts < {TO} GROUP BY ALL),
rng AS (SELECT '203.0.113.' || n_nationkey AS ip, {_ISO}[n_nationkey % 10 + 1] AS code FROM nation),
c(code, country, lat, lng) AS (VALUES ('US','United States',37.09,-95.71),('KR','South Korea',35.91,127.77),('JP','Japan',36.2,138.25),
 ('DE','Germany',51.17,10.45),('FR','France',46.23,2.21),('GB','United Kingdom',55.38,-3.44),('BR','Brazil',-14.24,-51.93),
 ('IN','India',20.59,78.96),('AU','Australia',-25.27,133.78))
SELECT tenant_id, code, CAST(sum(n) AS BIGINT) AS events, country, lat, lng FROM per JOIN rng ON per.dest_ip = rng.ip
JOIN c USING (code) GROUP BY ALL"""


@query("geo_by_country", _GEO)
def geo_by_country(spark, d):
    per_ip = event_plans.per_destination(fx.telemetry(spark, d), FROM, TO)
    return geo.by_country(per_ip, fx.ip_ranges(spark, d))


@query("geo_by_country_v6", _GEO)
def geo_by_country_v6(spark, d):
    """The same destinations with a third of them as mapped and a third as IPv6 addresses."""
    last = F.substring_index("dest_ip", ".", -1).try_cast("int")
    six = F.concat(F.lit("2001:DB8::"), F.hex(last))
    shown = F.when(last % 3 == 1, F.concat(F.lit("::ffff:"), "dest_ip")).when(
        (last % 3 == 2) & F.col("dest_ip").startswith("203.0.113."), six).otherwise(F.col("dest_ip"))
    per_ip = event_plans.per_destination(fx.telemetry(spark, d), FROM, TO).withColumn("dest_ip", shown)
    n = F.substring_index("start_ip", ".", -1).cast("int")
    same = F.concat(F.lit("2001:db8:0:0::"), F.hex(n))
    ranges = fx.ip_ranges(spark, d)
    return geo.by_country(per_ip, ranges.union(ranges.select(same, same, "iso2")))


# --- Search ----------------------------------------------------------------------------------

_EV_HIT = ("(contains(lower(host), '{0}') OR contains(lower(process), '{0}') OR contains(lower(parent), '{0}') OR "
           "contains(lower(cmdline), '{0}') OR contains(domain, '{0}') OR contains(dest_ip, '{0}') OR contains(sha256, '{0}'))")
_AL_HIT = ("(contains(id, '{0}') OR contains(host, '{0}') OR contains(lower(rule_id), '{0}') OR contains(lower(mitre), '{0}') "
           "OR contains(domain, '{0}') OR contains(dest_ip, '{0}'))")


@query("event_search", f"""WITH {T} SELECT {EVENT_ID} AS id, tenant_id, host, ts, type, process, cmdline, domain, dest_ip, sha256
FROM telemetry WHERE ts >= {FROM} AND ts <= {TO} AND {_EV_HIT.format('downloads\\evil')}""")
def event_search(spark, d):
    return search.event_hits(search.event_matches(fx.telemetry(spark, d), " DownLoads\\evil ",
                                                  FROM, TO))


@query("alert_search_by_threat_name", f"""WITH {S} SELECT id, tenant_id, host, rule_id, threat_name, mitre, severity, ts
FROM alerts JOIN catalog USING (rule_id) WHERE threat_name LIKE '%다운로드%' AND ts >= {FROM} AND ts <= {TO}""")
def alert_search_by_threat_name(spark, d):
    return search.alert_hits(search.alert_matches(fx.alerts(spark, d), "다운로드", FROM, TO))


@query("unified_search", f"""WITH {_HOSTS}, e AS (SELECT {EVENT_ID} AS id, tenant_id, host, ts FROM telemetry
  WHERE ts >= {FROM} AND ts <= {TO} AND {_EV_HIT.format('h1')}),
a AS (SELECT id, tenant_id, host, ts FROM alerts WHERE ts >= {FROM} AND ts <= {TO} AND {_AL_HIT.format('h1')}),
h AS (SELECT * FROM hosts WHERE contains(lower(host), 'h1'))
SELECT 'hosts' AS section, tenant_id, host AS id, host, last_seen AS ts, count(*) OVER (PARTITION BY tenant_id) > 5 AS has_more
  FROM h QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY last_seen DESC, host) <= 5
UNION ALL SELECT 'alerts', tenant_id, id, host, ts, count(*) OVER (PARTITION BY tenant_id) > 5 FROM a QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, id) <= 5
UNION ALL SELECT 'events', tenant_id, id, host, ts, count(*) OVER (PARTITION BY tenant_id) > 5 FROM e QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, id) <= 5""")
def unified_search(spark, d):
    return search.unified(_hosts(spark, d), fx.alerts(spark, d), fx.telemetry(spark, d), "H1",
                          FROM, TO)


@query("literal_text_search", """SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the 1')
OR contains(lower(source), 'the 1')""")
def literal_text_search(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.where(contains_any([F.col("text"), F.col("source")], "The 1")).select("doc_id",
                                                                                     "n_chars")


@query("threat_name_rules", f"""WITH {S} SELECT rule_id, count(*) AS alerts FROM alerts JOIN catalog USING (rule_id)
WHERE threat_name LIKE '%실행%' GROUP BY rule_id""")
def threat_name_rules(spark, d):
    named = rule_ids_named("실행")
    return fx.alerts(spark, d).where(F.col("rule_id").isin(named)).groupBy("rule_id").agg(
        F.count("*").alias("alerts"))


# --- Operations ------------------------------------------------------------------------------

@query("ingestion_lag", f"""WITH {T} SELECT count(*) AS rows, {NOW} - max(ingested_at) AS lag_ms,
  count(*) FILTER (ingested_at >= {NOW} - 300000) AS recent FROM telemetry""")
def ingestion_lag(spark, d):
    return ops.ingestion_lag(fx.telemetry(spark, d), NOW)


@query("consumer_lag", """WITH p AS (SELECT event_type AS topic, 'g' || (user_id % 2) AS grp, event_id % 3 AS part,
  max(event_id) AS e, count(*) AS n FROM events GROUP BY ALL),
o AS (SELECT *, CASE WHEN topic = 'view' AND grp = 'g1' AND part = 2 THEN NULL ELSE e - n % 50 + 10 END AS c FROM p)
SELECT topic, grp AS "group", CASE WHEN count(*) = count(c) THEN CAST(sum(greatest(0, e - c)) AS BIGINT) END AS lag
FROM o GROUP BY topic, grp""")
def consumer_lag(spark, d):
    return ops.consumer_lag(fx.offsets(spark, d))


_LATE = f"""{T}, late AS (SELECT seq, type, max(ts) OVER (PARTITION BY host ORDER BY seq) - ts AS lateness FROM telemetry)"""


@query("event_lateness", f"WITH {_LATE} SELECT seq, lateness FROM late")
def event_lateness(spark, d):
    return ops.with_lateness(fx.telemetry(spark, d)).select("seq", "lateness")


@query("lateness_percentiles", f"""WITH {_LATE} SELECT type, count(*) AS events, count(*) FILTER (lateness > 1500) AS late,
  quantile_disc(lateness, 0.5) AS p50, quantile_disc(lateness, 0.95) AS p95, quantile_disc(lateness, 0.99) AS p99
FROM late GROUP BY type""")
def lateness_percentiles(spark, d):
    return ops.lateness_percentiles(ops.with_lateness(fx.telemetry(spark, d)))


@query("dependency_status", """WITH c AS (SELECT event_id AS seq, event_type || '-' || (user_id % 40) AS dependency,
  CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 7 = 0 THEN NULL ELSE 'e' || event_id END AS error FROM events)
SELECT dependency, CASE WHEN count(*) FILTER (error IS NULL) > 0 THEN 'UP' ELSE 'DOWN' END AS status,
  CASE WHEN count(*) FILTER (error IS NULL) = 0 THEN arg_min(error, seq) END AS error FROM c GROUP BY dependency""")
def dependency_status(spark, d):
    e = fx.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    checks = e.select(
        F.col("event_id").alias("seq"),
        F.concat_ws("-", "event_type", (F.col("user_id") % 40).cast("string")).alias("dependency"),
        F.when(k % 7 != 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"))
    return ops.dependency_status(checks)
