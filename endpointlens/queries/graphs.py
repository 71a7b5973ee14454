"""Registered queries: source events, lineage, correlation, incidents, flows."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.detail import parse_detail
from ..functions.ids import process_node
from ..operators import correlation, flows, incidents, lineage
from ..operators.source_event import source_event_id, with_source_event
from ..catalog import RULES, with_catalog
from ..plans import alerts as alert_plans
from ..plans import incidents as incident_plans
from .base import A, T, jint, query, uuid3

TYPE_OF_RULE = ("CASE rule_id WHEN 'SCRIPT_FROM_TEMP_PATH' THEN 'script' WHEN 'FILE_IN_AUTORUN_PATH' THEN 'file' "
                "WHEN 'WEAK_TLS_HANDSHAKE' THEN 'l7' WHEN 'DOWNLOAD_AND_EXECUTE' THEN 'process' "
                "WHEN 'SUSPICIOUS_PROCESS_CHAIN' THEN 'process' END")


def source_sql(al: str, ev: str) -> str:
    return f"""lines AS (SELECT *, string_split(matched, chr(10))[-1] AS line FROM {al}),
parsed AS (SELECT *, CASE WHEN line LIKE 'network %' THEN 'network' WHEN line LIKE 'file %' THEN 'file'
    WHEN regexp_matches(line, '^l7 .+ \\(') THEN 'l7' WHEN regexp_matches(line, '^script .+ \\(') THEN 'script'
    WHEN regexp_matches(line, '^process .+ \\(parent ') THEN 'process' END AS kind,
  regexp_extract(line, ' \\(parent (.+)\\)', 1) AS par FROM lines),
src AS (SELECT p.id, p.tenant_id, p.host, p.kind, e.seq, e.ts, e.type, e.process, e.parent, e.dest_ip, e.dest_port, e.detail
  FROM parsed p JOIN {ev} e ON e.tenant_id = p.tenant_id AND e.host = p.host AND abs(e.ts - p.ts) <= 5000 AND CASE p.kind
    WHEN 'network' THEN e.type = 'network' AND e.dest_ip || ':' || e.dest_port = substr(p.line, 9)
    WHEN 'file' THEN e.type = 'file' AND e.cmdline = substr(p.line, 6)
    WHEN 'l7' THEN e.type = 'l7' AND e.domain = regexp_extract(p.line, '^l7 (.+?) \\(', 1)
    WHEN 'script' THEN e.type = 'script' AND e.process = regexp_extract(p.line, '^script (.+?) \\(', 1)
    WHEN 'process' THEN e.type = 'process' AND e.process = regexp_extract(p.line, '^process (.+?) \\(parent ', 1)
      AND (p.par IN ('', 'null') OR e.parent = p.par)
    ELSE e.type = {TYPE_OF_RULE} END
  QUALIFY row_number() OVER (PARTITION BY p.tenant_id, p.host, p.id ORDER BY abs(e.ts - p.ts), e.ts, e.seq) = 1)"""


_VARIED = """varied AS (SELECT * REPLACE (CASE WHEN seq % 6 = 0 THEN 'unreadable'
  WHEN seq % 10 = 1 THEN 'process nosuch.exe (parent x)' WHEN seq % 10 = 3 THEN 'network ' || dest_ip || ':443' ELSE matched END AS matched,
  CASE WHEN seq % 12 = 0 THEN 'UNLISTED' ELSE rule_id END AS rule_id) FROM alerts)"""
_SRC_ID = uuid3("s.host||'|'||s.ts||'|'||s.type||'|'||s.process||'|'||coalesce(CAST("
                + jint("pid") + " AS VARCHAR),'')||'|'||s.parent||'|'||s.dest_ip||'|'||s.dest_port")


@query("alert_source_events", f"""WITH {A}, {_VARIED}, {source_sql('varied', 'telemetry')}
SELECT v.id, s.seq AS source_seq, s.ts AS source_ts, {_SRC_ID} AS source_id,
  CASE WHEN s.id IS NOT NULL THEN CASE WHEN s.kind IS NULL THEN 'rule_type' ELSE 'summary' END END AS matched_by
FROM varied v LEFT JOIN src s USING (tenant_id, host, id)""")
def alert_source_events(spark, d):
    line = (F.when(F.col("seq") % 6 == 0, F.array(F.lit("unreadable")))
            .when(F.col("seq") % 10 == 1, F.array(F.lit("process nosuch.exe (parent x)")))
            .when(F.col("seq") % 10 == 3, F.array(F.concat(F.lit("network "), "dest_ip",
                                                           F.lit(":443"))))
            .otherwise(F.col("matched")))
    varied = (fx.alerts(spark, d).withColumn("matched", line)
              .withColumn("rule_id", F.when(F.col("seq") % 12 == 0, "UNLISTED").otherwise(
                  F.col("rule_id"))))
    found = with_source_event(varied, fx.telemetry(spark, d))
    return found.select("id", F.col("source.seq").alias("source_seq"),
                        F.col("source.ts").alias("source_ts"),
                        source_event_id(F.col("host"), F.col("source")).alias("source_id"),
                        "matched_by")


# --- Lineage ---------------------------------------------------------------------------------

def graph_sql(ev: str, keys: str, newest: bool = False) -> str:
    """`ev` needs ts, seq and the keys; gives gnodes and gedges."""
    order = "ts DESC, seq DESC" if newest else "ts, seq"
    return f"""grow AS (SELECT {keys}, ts, seq, type, trim(process) AS pr, trim(parent) AS pa, trim(dest_ip) AS ip,
  trim(dest_ip) || ':' || dest_port AS target, {jint('pid')} AS pid, {jint('ppid')} AS ppid FROM {ev}),
gid AS (SELECT *, 'proc:' || pr || coalesce(':' || pid, '') AS prid, 'proc:' || pa || coalesce(':' || ppid, '') AS paid FROM grow),
gall AS (SELECT {keys}, ts, seq, 0 AS step, 'net:' || target AS node_id, 'network' AS kind, target AS label FROM gid WHERE type = 'network' AND ip <> ''
  UNION ALL SELECT {keys}, ts, seq, 1, prid, 'process', pr FROM gid WHERE pr <> '' AND (type <> 'network' OR ip <> '')
  UNION ALL SELECT {keys}, ts, seq, 2, paid, 'process', pa FROM gid WHERE pr <> '' AND pa <> '' AND type <> 'network'),
gnodes AS (SELECT * FROM gall QUALIFY row_number() OVER (PARTITION BY {keys}, node_id ORDER BY {order}, step) = 1),
gedge AS (SELECT {keys}, ts, seq, prid AS "from", 'net:' || target AS "to", 'connected' AS rel FROM gid WHERE type = 'network' AND ip <> '' AND pr <> ''
  UNION ALL SELECT {keys}, ts, seq, paid, prid, 'spawned' FROM gid WHERE type <> 'network' AND pr <> '' AND pa <> ''),
gedges AS (SELECT * FROM gedge QUALIFY row_number() OVER (PARTITION BY {keys}, "from", "to", rel ORDER BY {order}) = 1)"""


_TREE = f"{T}, {graph_sql('telemetry', 'tenant_id, host')}"


@query("process_tree_nodes", f"WITH {_TREE} SELECT * FROM gnodes")
def process_tree_nodes(spark, d):
    return lineage.build_graph(fx.telemetry(spark, d), ["tenant_id", "host"])[0]


@query("process_tree_edges", f"WITH {_TREE} SELECT * FROM gedges")
def process_tree_edges(spark, d):
    return lineage.build_graph(fx.telemetry(spark, d), ["tenant_id", "host"])[1]


_AROUND = f"""{A}, picked AS (SELECT tenant_id, host, ts AS mid, id AS graph_id FROM alerts
  QUALIFY row_number() OVER (PARTITION BY tenant_id, host ORDER BY ts DESC, id DESC) = 1),
around AS (SELECT p.graph_id, t.* FROM picked p JOIN telemetry t USING (tenant_id, host) WHERE t.ts BETWEEN p.mid - 300000 AND p.mid + 300000),
{graph_sql('around', 'graph_id')}"""


def _around(spark, d):
    """Lineage of the newest alert of every host."""
    newest = fx.alerts(spark, d).groupBy("tenant_id", "host").agg(
        F.max(F.struct("ts", "id")).alias("a")).select("tenant_id", "host", "a.ts", "a.id")
    return lineage.window_graphs(newest, fx.telemetry(spark, d))


@query("alert_lineage_nodes", f"WITH {_AROUND} SELECT graph_id, node_id, kind, label, ts, seq, step FROM gnodes")
def alert_lineage_nodes(spark, d):
    return _around(spark, d)[0]


@query("alert_lineage_edges", f"WITH {_AROUND} SELECT * FROM gedges")
def alert_lineage_edges(spark, d):
    return _around(spark, d)[1]


_EVERY = _AROUND.replace("""ts AS mid, id AS graph_id FROM alerts
  QUALIFY row_number() OVER (PARTITION BY tenant_id, host ORDER BY ts DESC, id DESC) = 1)""",
                         "ts AS mid, min(id) AS graph_id FROM alerts GROUP BY tenant_id, host, ts)")


def _around_every(spark, d):
    """Lineage of every alert; alerts of one host and time share a graph."""
    return lineage.window_graphs(fx.alerts(spark, d), fx.telemetry(spark, d))


@query("every_alert_lineage_nodes", f"WITH {_EVERY} SELECT graph_id, node_id, kind, label, ts, seq, step FROM gnodes")
def every_alert_lineage_nodes(spark, d):
    return _around_every(spark, d)[0]


@query("every_alert_lineage_edges", f"WITH {_EVERY} SELECT * FROM gedges")
def every_alert_lineage_edges(spark, d):
    return _around_every(spark, d)[1]


@query("every_alert_lineage_members", f"WITH {_EVERY} SELECT a.id, p.graph_id FROM alerts a JOIN picked p ON a.tenant_id = p.tenant_id AND a.host = p.host AND a.ts = p.mid")
def every_alert_lineage_members(spark, d):
    return lineage.graph_members(fx.alerts(spark, d))


# --- Correlation -----------------------------------------------------------------------------

_FILL = """need AS (SELECT *, json_extract_string(detail, '$.answers[0]') AS ans FROM telemetry WHERE type = 'dns' AND trim(process) = ''),
fill AS (SELECT n.tenant_id, n.host, n.seq, c.process AS inferred_process, c.type || ' 이벤트 dest_ip=' || n.ans || ' ts=' || c.ts AS basis
  FROM need n JOIN telemetry c ON c.tenant_id = n.tenant_id AND c.host = n.host AND c.type IN ('network','l7') AND trim(c.process) <> ''
    AND c.dest_ip = n.ans AND c.ts BETWEEN n.ts - 1000 AND n.ts + 30000
  QUALIFY row_number() OVER (PARTITION BY n.tenant_id, n.host, n.seq ORDER BY abs(c.ts - n.ts), c.ts, c.seq) = 1)"""


@query("dns_process_backfill", f"""WITH {T}, {_FILL} SELECT t.seq, t.process, inferred_process, basis
FROM telemetry t LEFT JOIN fill USING (tenant_id, host, seq) WHERE t.type = 'dns'""")
def dns_process_backfill(spark, d):
    t = fx.telemetry(spark, d)
    return correlation.backfill(t.where("type = 'dns'"), t).select(
        "seq", "process", "inferred_process", "basis")


_CORR = f"""{T}, {_FILL}, co AS (SELECT t.*, f.inferred_process, f.basis, t.domain AS seed FROM telemetry t
  LEFT JOIN fill f USING (tenant_id, host, seq) WHERE t.type IN ('dns','network','l7') AND t.domain <> ''),
ce AS (
  SELECT tenant_id, seed, ts, seq, 'domain:' || domain AS "from", 'ip:' || json_extract_string(detail, '$.answers[0]') AS "to", 'RESOLVED_TO' AS relation, 'OBSERVED' AS origin, NULL AS basis FROM co WHERE type = 'dns'
  UNION ALL SELECT tenant_id, seed, ts, seq, 'host:' || host, 'domain:' || domain, CASE type WHEN 'dns' THEN 'QUERIED' ELSE 'CONNECTED' END, 'OBSERVED', NULL FROM co
  UNION ALL SELECT tenant_id, seed, ts, seq, 'process:' || process, 'domain:' || domain, CASE type WHEN 'dns' THEN 'QUERIED' ELSE 'CONNECTED' END, 'OBSERVED', NULL FROM co WHERE trim(process) <> ''
  UNION ALL SELECT tenant_id, seed, ts, seq, 'process:' || inferred_process, 'domain:' || domain, 'QUERIED', 'INFERRED', basis FROM co WHERE type = 'dns' AND inferred_process IS NOT NULL
  UNION ALL SELECT tenant_id, seed, ts, seq, 'domain:' || domain, 'ip:' || dest_ip, 'CONNECTED_VIA', 'OBSERVED', NULL FROM co WHERE type <> 'dns' AND dest_ip <> ''),
merged AS (SELECT tenant_id, seed, "from", "to", relation, origin, count(*) AS observations, min(ts) AS first_seen, max(ts) AS last_seen,
  first(basis ORDER BY ts, seq) AS basis FROM ce GROUP BY ALL)"""
_CKEYS = ["tenant_id", "seed"]


def _correlated(spark, d):
    """Every domain as its own seed; one event belongs to one domain seed."""
    t = fx.telemetry(spark, d)
    seeds = t.where(F.col("type").isin(*correlation.SEED_TYPES) & (F.col("domain") != ""))
    filled = correlation.backfill(seeds, t).withColumn("seed", F.col("domain"))
    return correlation.merge_edges(correlation.observed_edges(filled, _CKEYS), _CKEYS)


@query("correlation_edges", f"WITH {_CORR.replace('GROUP BY ALL)', 'GROUP BY tenant_id, seed, \"from\", \"to\", relation, origin)')} SELECT * FROM merged")
def correlation_edges(spark, d):
    return _correlated(spark, d)


@query("correlation_nodes", f"""WITH {_CORR.replace('GROUP BY ALL)', 'GROUP BY tenant_id, seed, "from", "to", relation, origin)')},
ends AS (SELECT tenant_id, seed, "from" AS node_id FROM merged UNION SELECT tenant_id, seed, "to" FROM merged
  UNION SELECT tenant_id, domain, 'domain:' || domain FROM co)
SELECT tenant_id, seed, node_id, upper(split_part(node_id, ':', 1)) AS kind, substr(node_id, strpos(node_id, ':') + 1) AS value FROM ends""")
def correlation_nodes(spark, d):
    edges = _correlated(spark, d)
    seeds = edges.select(*_CKEYS, F.concat(F.lit("domain:"), "seed").alias("node_id")).distinct()
    return correlation.graph_nodes(edges, seeds, _CKEYS)


@query("correlation_seed_events", f"""WITH {T} SELECT seq, host, type, ts FROM telemetry WHERE type IN ('dns','network','l7')
AND (dest_ip = '203.0.113.4' OR (type = 'dns' AND json_extract_string(detail, '$.answers[0]') = '203.0.113.4'))""")
def correlation_seed_events(spark, d):
    return correlation.seed_events(fx.telemetry(spark, d), "IP", "203.0.113.4").select(
        "seq", "host", "type", "ts")


_SAID = """said AS (SELECT seq, tenant_id, host, type, ts, 'DOMAIN' AS kind, domain AS value FROM telemetry
    WHERE type IN ('dns','network','l7') AND domain <> ''
  UNION SELECT seq, tenant_id, host, type, ts, 'IP', dest_ip FROM telemetry WHERE type IN ('dns','network','l7') AND dest_ip <> ''
  UNION SELECT seq, tenant_id, host, type, ts, 'IP', json_extract_string(detail, '$.answers[0]') FROM telemetry WHERE type = 'dns'),
seeds AS (SELECT DISTINCT kind, value FROM said WHERE seq % 3 = 0)"""


def _asked_targets(spark, d):
    """What callers might type: domains in capitals with a trailing dot, addresses plain or mapped, and junk."""
    t = fx.telemetry(spark, d).where((F.col("seq") % 3 == 0) & F.col("type").isin(*correlation.SEED_TYPES))
    answer = F.get_json_object("detail", "$.answers[0]")
    shown = lambda ip: F.when(F.col("seq") % 2 == 0, F.concat(F.lit(" ::FFFF:"), ip)).otherwise(ip)
    typed = F.array(F.concat(F.lit(" "), F.upper("domain"), F.lit(". ")), shown(F.col("dest_ip")), shown(answer),
                    F.concat(F.lit("no target "), "host"), F.concat("dest_ip", F.lit("999")))
    return t.select(F.explode(typed).alias("raw"))


@query("correlation_events_of_every_seed", f"""WITH {T}, {_SAID} SELECT kind, value, seq, tenant_id, host, type, ts
FROM said JOIN seeds USING (kind, value)""")
def correlation_events_of_every_seed(spark, d):
    """The seed scan for any number of domains and addresses, as callers wrote them."""
    seeds = correlation.parsed_targets(_asked_targets(spark, d))
    return correlation.events_of_seeds(fx.telemetry(spark, d), seeds).select("kind", "value", "seq", "tenant_id", "host", "type", "ts")


@query("correlation_live_edges", f"""WITH {T}, r AS (SELECT tenant_id, seq, domain, json_extract_string(detail, '$.answers[0]') AS ip FROM telemetry
  WHERE type = 'dns'), e AS (SELECT tenant_id, 'domain:' || domain AS "from", 'ip:' || ip AS "to", 'RESOLVED_TO' AS relation FROM r WHERE seq % 4 <> 0
  UNION SELECT tenant_id, 'ip:' || ip, 'ptr_name:' || domain, 'PTR_CANDIDATE' FROM r WHERE seq % 5 <> 0)
SELECT *, 'LIVE_DNS' AS origin, CAST(0 AS BIGINT) AS observations, CAST(NULL AS BIGINT) AS first_seen,
  CAST(NULL AS BIGINT) AS last_seen, CAST(NULL AS VARCHAR) AS basis FROM e""")
def correlation_live_edges(spark, d):
    """Relations of live lookups of all domains and addresses; some of the lookups failed."""
    t = fx.telemetry(spark, d).where("type = 'dns'").select(
        "tenant_id", "seq", "domain", F.get_json_object("detail", "$.answers[0]").alias("ip"))
    forward = t.select("tenant_id", F.lit("DOMAIN").alias("seed_kind"), F.col("domain").alias("seed"), F.col("ip").alias("answer"),
                       (F.col("seq") % 4 != 0).alias("ok"))
    reverse = t.select("tenant_id", F.lit("IP").alias("seed_kind"), F.col("ip").alias("seed"), F.col("domain").alias("answer"),
                       (F.col("seq") % 5 != 0).alias("ok"))
    return correlation.live_edges(forward.unionByName(reverse), ["tenant_id"])


# --- Incidents -------------------------------------------------------------------------------

THREAT_CASE = "CASE rule_id " + " ".join(f"WHEN '{r[0]}' THEN '{r[1]}'" for r in RULES) + " ELSE rule_id END"


def incident_sql(al: str, ev: str) -> str:
    return f"""{source_sql(al, ev)},
anch AS (SELECT a.tenant_id, a.host, a.id, a.ts, a.severity, a.rule_id, a.mitre,
  CASE WHEN trim(s.process) <> '' THEN 'proc:' || s.process || coalesce(':' || {jint('pid')}, '') END AS anchor,
  s.process AS anchor_process FROM {al} a LEFT JOIN src s USING (tenant_id, host, id)),
span AS (SELECT tenant_id, host, greatest(min(ts) - 300000, 0) AS f, max(ts) + 300000 AS t FROM {al} GROUP BY ALL),
par AS (SELECT e.tenant_id, e.host, 'proc:' || e.process || coalesce(':' || {jint('pid')}, '') AS node,
    'proc:' || e.parent || coalesce(':' || {jint('ppid')}, '') AS parent FROM {ev} e JOIN span USING (tenant_id, host)
  WHERE e.ts BETWEEN f AND t AND e.process <> '' AND e.parent <> ''
  QUALIFY row_number() OVER (PARTITION BY e.tenant_id, e.host, node ORDER BY e.ts DESC, e.seq DESC) = 1),
an AS (SELECT DISTINCT tenant_id, host, anchor AS node FROM anch WHERE anchor IS NOT NULL),
anc AS (SELECT tenant_id, host, node AS start, node, 0 AS depth, [node] AS path FROM an
  UNION ALL SELECT a.tenant_id, a.host, a.start, p.parent, a.depth + 1, list_append(a.path, p.parent) FROM anc a JOIN par p
    ON p.tenant_id = a.tenant_id AND p.host = a.host AND p.node = a.node WHERE NOT list_contains(a.path, p.parent)),
lnk AS (SELECT a.tenant_id, a.host, a.start AS x, a.node AS y FROM anc a JOIN an b ON a.tenant_id = b.tenant_id AND a.host = b.host AND a.node = b.node),
sym AS (SELECT * FROM lnk UNION SELECT tenant_id, host, y, x FROM lnk),
reach AS (SELECT tenant_id, host, x, y FROM sym UNION SELECT r.tenant_id, r.host, r.x, s.y FROM reach r JOIN sym s
  ON r.tenant_id = s.tenant_id AND r.host = s.host AND r.y = s.x),
comp AS (SELECT tenant_id, host, x AS node, min(y) AS comp FROM reach GROUP BY ALL),
grp AS (SELECT a.*, coalesce('a' || c.comp, 's' || a.id) AS g FROM anch a LEFT JOIN comp c ON a.tenant_id = c.tenant_id AND a.host = c.host AND a.anchor = c.node),
head AS (SELECT tenant_id, host, g, {uuid3("tenant_id||'|'||host||'|'||id")} AS incident_id FROM grp
  QUALIFY row_number() OVER (PARTITION BY tenant_id, host, g ORDER BY ts, id) = 1),
mem AS (SELECT grp.*, head.incident_id, EXISTS (SELECT 1 FROM lnk WHERE lnk.tenant_id = grp.tenant_id AND lnk.host = grp.host
  AND lnk.x = grp.anchor AND lnk.y <> lnk.x) AS below FROM grp JOIN head USING (tenant_id, host, g)),
top AS (SELECT incident_id, anchor AS start_anchor, anchor_process AS root_process FROM mem WHERE anchor IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY below, ts, id) = 1),
rl AS (SELECT incident_id, string_agg(rule_id, ',' ORDER BY t1, i1) AS rule_ids FROM (SELECT incident_id, rule_id, min(ts) AS t1, arg_min(id, (ts, id)) AS i1 FROM mem GROUP BY ALL) GROUP BY ALL),
mt AS (SELECT incident_id, string_agg(mitre, ',' ORDER BY t1, i1) AS mitre FROM (SELECT incident_id, mitre, min(ts) AS t1, arg_min(id, (ts, id)) AS i1 FROM mem WHERE trim(mitre) <> '' GROUP BY ALL) GROUP BY ALL),
tn AS (SELECT incident_id, string_agg(threat_name, ',' ORDER BY t1, i1) AS threat_names FROM (SELECT incident_id, {THREAT_CASE} AS threat_name, min(ts) AS t1, arg_min(id, (ts, id)) AS i1 FROM mem GROUP BY ALL) GROUP BY ALL),
inc AS (SELECT m.tenant_id, m.host, m.incident_id, min(m.ts) AS first_ts, max(m.ts) AS last_ts,
  ['CRITICAL','HIGH','MEDIUM','LOW'][CAST(min(CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END) AS INT)] AS severity,
  count(*) AS alert_count FROM mem m GROUP BY ALL),
incident AS (SELECT inc.*, rl.rule_ids, tn.threat_names, mt.mitre, start_anchor, coalesce(root_process, '') AS root_process
  FROM inc LEFT JOIN rl USING (incident_id) LEFT JOIN tn USING (incident_id) LEFT JOIN mt USING (incident_id) LEFT JOIN top USING (incident_id)),
deep AS (SELECT l.tenant_id, l.host, l.x, max(a.depth) AS d FROM lnk l JOIN anc a ON a.tenant_id = l.tenant_id AND a.host = l.host AND a.start = l.x AND a.node = l.y GROUP BY ALL),
chain AS (SELECT DISTINCT m.tenant_id, m.host, m.incident_id, a.node FROM mem m JOIN anc a ON a.tenant_id = m.tenant_id AND a.host = m.host AND a.start = m.anchor
  JOIN deep ON deep.tenant_id = m.tenant_id AND deep.host = m.host AND deep.x = m.anchor WHERE a.depth <= deep.d),
cev AS (SELECT c.incident_id, c.node, e.* FROM {ev} e JOIN chain c ON e.tenant_id = c.tenant_id AND e.host = c.host
    AND c.node = 'proc:' || e.process || coalesce(':' || {jint('pid')}, '') JOIN inc USING (incident_id)
  WHERE e.ts BETWEEN greatest(inc.first_ts - 300000, 0) AND inc.last_ts + 300000)"""


def _flat(rolled):
    return rolled.withColumns({c: F.array_join(c, ",") for c in ("rule_ids", "threat_names", "mitre")})


def forest(spark, d):
    """A process tree with three children per process on every host, from the event table."""
    t = fx.telemetry(spark, d)
    i = F.floor(F.col("seq") / 20)
    up = F.floor((i - 1) / 3)

    def name(x):
        return F.concat(F.lit("p"), (x % 4).cast("string"), F.lit(".exe"))

    detail = F.concat(F.lit('{"pid":'), (i + 1).cast("string"), F.lit(',"ppid":'),
                      (up + 1).cast("string"), F.lit("}"))
    return t.select(
        "seq", F.concat(F.lit("f"), (F.col("seq") % 20).cast("string")).alias("host"),
        F.lit("1").alias("tenant_id"), F.lit("process").alias("type"), "ts",
        name(i).alias("process"), F.when(i == 0, "").otherwise(name(up)).alias("parent"),
        F.lit("").alias("cmdline"), F.lit("").alias("dest_ip"), F.lit(0).alias("dest_port"),
        F.lit("").alias("domain"), detail.alias("detail"), F.lit("").alias("sha256"),
        "ingested_at")


def forest_alerts(tree):
    """Alerts on a seventh of the processes, of varied severity."""
    s = F.col("seq")
    line = F.concat(F.lit("process "), "process", F.lit(" (parent "), "parent", F.lit(")"))
    return tree.where((s * 7919) % 49 < 7).select(
        F.md5(s.cast("string").cast("binary")).alias("id"), "tenant_id", "host",
        F.when(s % 3 == 0, "DOWNLOAD_AND_EXECUTE").otherwise("SUSPICIOUS_PROCESS_CHAIN").alias(
            "rule_id"),
        F.when(s % 3 == 0, "T1105+T1204").otherwise("T1059").alias("mitre"),
        F.when(s % 5 == 0, "CRITICAL").when(s % 5 == 1, "MEDIUM").otherwise("LOW").alias(
            "severity"), "ts", F.array(line).alias("matched"), F.lit("").alias("domain"), "seq")


_FOREST = f"""{T}, forest AS (SELECT seq, 'f' || (seq % 20) AS host, '1' AS tenant_id, 'process' AS type, ts,
  'p' || (seq // 20 % 4) || '.exe' AS process,
  CASE WHEN seq // 20 = 0 THEN '' ELSE 'p' || ((seq // 20 - 1) // 3 % 4) || '.exe' END AS parent, '' AS cmdline, '' AS dest_ip, 0 AS dest_port,
  '' AS domain, '{{"pid":' || (seq // 20 + 1) || ',"ppid":' || CAST(floor((seq // 20 - 1) / 3.0) + 1 AS BIGINT) || '}}' AS detail FROM telemetry),
fal AS (SELECT md5(CAST(seq AS VARCHAR)) AS id, tenant_id, host, CASE WHEN seq % 3 = 0 THEN 'DOWNLOAD_AND_EXECUTE' ELSE 'SUSPICIOUS_PROCESS_CHAIN' END AS rule_id,
  CASE WHEN seq % 3 = 0 THEN 'T1105+T1204' ELSE 'T1059' END AS mitre,
  CASE seq % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity, ts,
  'process ' || process || ' (parent ' || parent || ')' AS matched, seq FROM forest WHERE (seq * 7919) % 49 < 7)"""

_INC = f"WITH RECURSIVE {A}, {incident_sql('alerts', 'telemetry')}"
_FINC = f"WITH RECURSIVE {_FOREST}, {incident_sql('fal', 'forest')}"


@query("incidents", f"{_INC} SELECT * FROM incident")
def incidents_all(spark, d):
    members, _ = incidents.group_alerts(fx.alerts(spark, d), fx.telemetry(spark, d))
    return _flat(incidents.roll_up(members))


@query("incident_list_page", f"""{_INC} SELECT incident_id, host, last_ts, alert_count FROM incident WHERE host = 'h3'
ORDER BY last_ts DESC, incident_id LIMIT 100""")
def incident_list_page(spark, d):
    """Host filter after grouping, because ids depend on the whole group."""
    members, _ = incidents.group_alerts(fx.alerts(spark, d), fx.telemetry(spark, d))
    rolled = incidents.roll_up(members).where("host = 'h3'")
    return rolled.orderBy(F.desc("last_ts"), "incident_id").limit(100).select(
        "incident_id", "host", "last_ts", "alert_count")


@query("alert_incident_ids", f"{_INC} SELECT id, incident_id, anchor FROM mem")
def alert_incident_ids(spark, d):
    members, _ = incidents.group_alerts(fx.alerts(spark, d), fx.telemetry(spark, d))
    return members.select("id", "incident_id", "anchor")


def _decided(rolled):
    """A decision on the incidents whose id begins with 0 to 4."""
    first = F.substring("incident_id", 1, 1)
    return rolled.where(first.isin("0", "1", "2", "3", "4")).select(
        "tenant_id", F.col("incident_id").alias("id"), F.col("last_ts").alias("updated_at"),
        F.when(first == "4", "false_positive").otherwise("confirmed").alias("status"))


@query("incident_open_page", f"""{_INC}, shown AS (SELECT incident_id, host, last_ts, alert_count FROM incident
  WHERE substr(incident_id, 1, 1) NOT IN ('0','1','2','3','4') AND host = 'h3')
SELECT *, (SELECT count(*) FROM shown) > 7 AS has_more FROM shown ORDER BY last_ts DESC, incident_id LIMIT 5 OFFSET 2""")
def incident_open_page(spark, d):
    members, _ = incidents.group_alerts(fx.alerts(spark, d), fx.telemetry(spark, d))
    rolled = incidents.roll_up(members)
    shown = incident_plans.incident_page(rolled, alert_plans.triage_status(_decided(rolled)), "open", "h3", 5, 2)
    return shown.select("incident_id", "host", "last_ts", "alert_count", "has_more")


@query("alert_incidents_in_range", f"{_INC} SELECT tenant_id, id, incident_id, anchor FROM mem WHERE ts >= {fx.FROM} AND ts <= {fx.TO}")
def alert_incidents_in_range(spark, d):
    members, _ = incidents.group_alerts(fx.alerts(spark, d), fx.telemetry(spark, d))
    return incident_plans.incidents_of_alerts(members, fx.FROM, fx.TO)


@query("alert_host_spans", f"""WITH {A} SELECT tenant_id, host, min(ts) AS first_ts, max(ts) AS last_ts,
  greatest(min(ts) - 300000, 0) AS scan_from, max(ts) + 300000 AS scan_to FROM alerts GROUP BY ALL""")
def alert_host_spans(spark, d):
    return incidents.alert_spans(fx.alerts(spark, d))


@query("process_index", f"""WITH {T} SELECT tenant_id, host, 'proc:' || process || coalesce(':' || {jint('pid')}, '') AS node,
  'proc:' || parent || coalesce(':' || {jint('ppid')}, '') AS parent FROM telemetry t WHERE process <> '' AND t.parent <> ''
QUALIFY row_number() OVER (PARTITION BY tenant_id, host, node ORDER BY ts DESC, seq DESC) = 1""")
def process_index(spark, d):
    return incidents.process_index(fx.telemetry(spark, d))


@query("ancestor_paths", f"""{_FINC} SELECT tenant_id, host, start, depth, node FROM anc""")
def ancestor_paths(spark, d):
    tree = forest(spark, d)
    starts = forest_alerts(tree).select("seq").join(tree, "seq").select(
        "tenant_id", "host", process_node(F.col("process"), parse_detail(F.col("detail"))[
            "pid"]).alias("node")).distinct()
    seen = incidents.events_in_spans(tree, forest_alerts(tree))
    return incidents.ancestor_paths(starts, incidents.process_index(seen))


@query("incident_trees", f"{_FINC} SELECT * FROM incident")
def incident_trees(spark, d):
    tree = forest(spark, d)
    members, _ = incidents.group_alerts(forest_alerts(tree), tree)
    return _flat(incidents.roll_up(members))


@query("incident_chain_nodes", f"{_FINC} SELECT tenant_id, host, incident_id, node FROM chain")
def incident_chain_nodes(spark, d):
    tree = forest(spark, d)
    return incidents.group_alerts(forest_alerts(tree), tree)[1]


@query("incident_timeline", f"""{_FINC} SELECT incident_id, ts, 'event' AS kind, seq, process, NULL AS alert_id, NULL AS threat_name FROM cev
UNION ALL SELECT m.incident_id, m.ts, 'alert', NULL, m.anchor_process, m.id, CASE m.rule_id WHEN 'DOWNLOAD_AND_EXECUTE'
  THEN '다운로드 후 실행' ELSE '의심스러운 프로세스 실행 체인' END FROM mem m""")
def incident_timeline(spark, d):
    tree = forest(spark, d)
    members, chain = incidents.group_alerts(forest_alerts(tree), tree)
    events = incidents.chain_events(tree, members, chain).select(
        "incident_id", "ts", F.lit("event").alias("kind"), "seq", "process")
    alerts = with_catalog(members).select(
        "incident_id", "ts", F.lit("alert").alias("kind"), F.col("anchor_process").alias("process"),
        F.col("id").alias("alert_id"), "threat_name")
    both = events.unionByName(alerts, allowMissingColumns=True)
    # An event precedes the alert it caused at the same time.
    return both.orderBy("incident_id", "ts", F.when(F.col("kind") == "event", 0).otherwise(1))


@query("incident_graph_nodes", f"{_FINC}, {graph_sql('cev', 'incident_id', True)} SELECT incident_id, node_id, kind, label FROM gnodes")
def incident_graph_nodes(spark, d):
    tree = forest(spark, d)
    members, chain = incidents.group_alerts(forest_alerts(tree), tree)
    rows = incidents.chain_events(tree, members, chain)
    return lineage.build_graph(rows, ["incident_id"], newest=True)[0].select(
        "incident_id", "node_id", "kind", "label")


@query("incident_graph_edges", f"{_FINC}, {graph_sql('cev', 'incident_id', True)} SELECT * FROM gedges")
def incident_graph_edges(spark, d):
    tree = forest(spark, d)
    members, chain = incidents.group_alerts(forest_alerts(tree), tree)
    rows = incidents.chain_events(tree, members, chain)
    return lineage.build_graph(rows, ["incident_id"], newest=True)[1]


@query("incident_status", f"""{_FINC} SELECT incident_id, host, CASE WHEN substr(incident_id, 1, 1) IN ('0','1','2','3') THEN 'confirmed'
  WHEN substr(incident_id, 1, 1) = '4' THEN 'false_positive' ELSE 'open' END AS status FROM inc""")
def incident_status(spark, d):
    """Triage decisions on incidents; ids come from the whole window, so they are looked up last."""
    tree = forest(spark, d)
    members, _ = incidents.group_alerts(forest_alerts(tree), tree)
    rolled = incidents.roll_up(members).withColumnRenamed("incident_id", "id")
    first = F.substring("id", 1, 1)
    decided = rolled.select("tenant_id", "id", F.col("last_ts").alias("updated_at"), F.when(
        first.isin("0", "1", "2", "3"), "confirmed").when(first == "4", "false_positive").otherwise(
        "closed").alias("status"))
    status = alert_plans.triage_status(decided)
    return alert_plans.with_status(rolled, status).select(F.col("id").alias("incident_id"), "host",
                                                          "status")


# --- Flows -----------------------------------------------------------------------------------

def remembered_flows(t):
    k = F.substring_index("dest_ip", ".", -1).try_cast("int")
    return t.where("type = 'network'").select(
        "tenant_id", "host", "ts", "seq", (F.lit(40000) + k).alias("local_port"),
        F.col("dest_ip").alias("remote_ip"), F.lit(443).alias("remote_port"),
        F.concat(F.lit("/opt/app/"), "process").alias("path"))


def flow_lookups(t):
    k = F.substring_index("dest_ip", ".", -1).try_cast("int")
    return t.where("type = 'l7'").select(
        "tenant_id", "host", "ts", "seq", (F.lit(40000) + k).alias("local_port"),
        F.concat(F.lit("[::ffff:"), "dest_ip", F.lit("]")).alias("remote_ip"),
        F.col("dest_port").alias("remote_port"))


@query("flow_owners", f"""WITH {T} SELECT l.seq, l.host, coalesce(arg_max(n.process, (n.ts, n.seq)), '') AS owner, count(n.seq) > 0 AS hit
FROM telemetry l LEFT JOIN telemetry n ON n.type = 'network' AND n.tenant_id = l.tenant_id AND n.host = l.host AND n.dest_ip = l.dest_ip
  AND n.ts BETWEEN l.ts - 60000 AND l.ts WHERE l.type = 'l7' GROUP BY l.seq, l.host""")
def flow_owners(spark, d):
    t = fx.telemetry(spark, d)
    return flows.flow_owners(flow_lookups(t), remembered_flows(t)).select("seq", "host", "owner",
                                                                         "hit")


@query("process_name_at_time", f"""WITH {T} SELECT n.seq, n.host, arg_max(p.process, (p.ts, p.seq)) AS pid_path FROM telemetry n
LEFT JOIN telemetry p ON p.type = 'process' AND p.tenant_id = n.tenant_id AND p.host = n.host AND {jint('pid').replace('detail', 'p.detail')} = 1000 + n.seq % 150 AND p.ts <= n.ts
WHERE n.type = 'network' GROUP BY n.seq, n.host""")
def process_name_at_time(spark, d):
    t = fx.telemetry(spark, d)
    starts = t.where("type = 'process'").select(
        "tenant_id", "host", "ts", "seq", parse_detail(F.col("detail"))["pid"].alias("pid"),
        F.col("process").alias("path"))
    asked = t.where("type = 'network'").select(
        "tenant_id", "host", "ts", "seq", (1000 + F.col("seq") % 150).cast("int").alias("pid"))
    return flows.process_names(asked, starts).select("seq", "host", "pid_path")


@query("new_connections", f"""WITH {T}, c AS (SELECT DISTINCT tenant_id, host, ts // 600000 AS s, 1000 + seq % 5 AS pid, process AS path, dest_ip, dest_port
  FROM telemetry WHERE type = 'network'), polls AS (SELECT tenant_id, host, s, lag(s) OVER (PARTITION BY tenant_id, host ORDER BY s) AS prev FROM (SELECT DISTINCT tenant_id, host, s FROM c))
SELECT c.tenant_id, c.host, c.s AS snapshot_seq, c.pid, c.path, c.dest_ip AS remote_ip, c.dest_port AS remote_port FROM c JOIN polls USING (tenant_id, host, s)
WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c o WHERE o.tenant_id = c.tenant_id AND o.host = c.host AND o.s = prev AND o.pid = c.pid AND o.path = c.path
  AND o.dest_ip = c.dest_ip AND o.dest_port = c.dest_port)""")
def new_connections(spark, d):
    snap = fx.telemetry(spark, d).where("type = 'network'").select(
        "tenant_id", "host", F.floor(F.col("ts") / 600_000).alias("snapshot_seq"),
        (1000 + F.col("seq") % 5).alias("pid"), F.col("process").alias("path"),
        F.col("dest_ip").alias("remote_ip"), F.col("dest_port").alias("remote_port"))
    return flows.new_connections(snap)
