"""Query registry and the SQL building blocks of the DuckDB checks.

The SQL derives the same telemetry and alerts on its own from the given tables; it shares no
code with the Spark plans.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures as fx
from ..catalog import RULES
from ..plans import alerts as alert_plans
from ..plans import hosts as host_plans

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def status_of(spark: SparkSession, d: str) -> DataFrame:
    return alert_plans.triage_status(fx.overlay_log(fx.alerts(spark, d)))


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    return host_plans.enrolled_nodes(fx.enrolments(spark, d))


BASE, NOW, FROM, TO = fx.BASE, fx.NOW, fx.FROM, fx.TO


def uuid3(seed: str) -> str:
    h = f"md5({seed})"
    return (f"(substr({h},1,8)||'-'||substr({h},9,4)||'-3'||substr({h},14,3)||'-'||"
            f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||"
            f"substr({h},18,3)||'-'||substr({h},21,12))")


def temp(p: str) -> str:
    """SQL test for a temp or download path (lower case)."""
    return (f"(regexp_matches({p}, '^/(tmp/|private/tmp/|var/folders/|users/[^/]+/downloads/|"
            f"home/[^/]+/downloads/)') OR regexp_matches({p}, '^([a-z]:)?\\\\(temp\\\\|windows\\\\temp\\\\|"
            f"users\\\\[^\\\\]+\\\\(appdata\\\\local\\\\temp|downloads)\\\\)'))")


def jint(field: str) -> str:
    return (f"CASE WHEN detail = '' THEN NULL ELSE "
            f"TRY_CAST(json_extract_string(detail, '$.{field}') AS INTEGER) END")


def jtext(field: str, detail: str = "detail") -> str:
    return (f"CASE WHEN {detail} = '' THEN NULL ELSE "
            f"json_extract_string({detail}, '$.{field}') END")


def summary(e: str) -> str:
    return (f"CASE {e}.type WHEN 'network' THEN 'network '||{e}.dest_ip||':'||{e}.dest_port "
            f"WHEN 'script' THEN 'script '||{e}.process||' ('||{e}.cmdline||')' "
            f"WHEN 'file' THEN 'file '||{e}.cmdline "
            f"WHEN 'l7' THEN 'l7 '||{e}.domain||' ('||coalesce({jtext('tlsVersion', e + '.detail')},'')||')' "
            f"ELSE 'process '||{e}.process||' (parent '||{e}.parent||')' END")


T = f"""
ev AS (SELECT event_id AS n, user_id AS u, event_type AS et,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, epoch_us(ts) // 1000 AS ms FROM events),
typed AS (SELECT *, CASE et WHEN 'click' THEN 'network' WHEN 'view' THEN 'process'
  WHEN 'error' THEN 'script' WHEN 'purchase' THEN 'file'
  ELSE CASE WHEN n % 2 = 0 THEN 'dns' ELSE 'l7' END END AS type,
  '203.0.113.' || (k % 10) AS ip,
  {BASE} + (ms - {BASE}) // 120 AS ts FROM ev),
telemetry AS (SELECT n AS seq, 'h' || (u % 20) AS host, CAST(1 + u % 3 AS VARCHAR) AS tenant_id,
  type, ts,
  CASE type WHEN 'network' THEN 'chrome.exe'
    WHEN 'process' THEN ['winword.exe','powershell.exe','evil.exe','OneDrive.exe','ls','chrome.exe'][CAST(k % 6 + 1 AS INT)]
    WHEN 'script' THEN ['powershell.exe','zsh','sh','python3'][CAST(k % 4 + 1 AS INT)]
    WHEN 'file' THEN 'x.lnk' ELSE CASE WHEN k % 2 = 0 THEN '' ELSE 'curl' END END AS process,
  CASE WHEN type = 'process' AND k % 6 = 1 THEN 'winword.exe'
    WHEN type IN ('process','script') THEN 'explorer.exe' ELSE '' END AS parent,
  CASE type WHEN 'process' THEN ['"C:\\Program Files\\Office\\winword.exe"','powershell -enc AAAA',
      'C:\\Users\\u\\Downloads\\evil.exe','C:\\Users\\u\\Downloads\\OneDrive.exe','/bin/ls /tmp/x','/opt/chrome'][CAST(k % 6 + 1 AS INT)]
    WHEN 'script' THEN ['powershell -File C:\\Users\\u\\Downloads\\setup.ps1','/bin/zsh -c pwd >| /tmp/cwd',
      '/bin/sh -c true && /tmp/evil.sh','python3 /opt/app.py'][CAST(k % 4 + 1 AS INT)]
    WHEN 'file' THEN ['C:\\Users\\u\\AppData\\Roaming\\Microsoft\\Windows\\Start Menu\\Programs\\Startup\\x.lnk',
      '/Library/LaunchDaemons/x.plist','C:\\dev\\startup\\x.lnk','/Users/u/Library/LaunchAgents/x.plist'][CAST(k % 4 + 1 AS INT)]
    ELSE '' END AS cmdline,
  CASE WHEN type IN ('network','l7') THEN ip ELSE '' END AS dest_ip,
  CAST(CASE type WHEN 'network' THEN [443,80,22,8080][CAST(n % 4 + 1 AS INT)] WHEN 'l7' THEN 443 ELSE 0 END AS INT) AS dest_port,
  CASE WHEN type IN ('dns','l7') OR (type = 'network' AND n % 5 = 0) THEN 'a' || (k % 7) || '.example.com' ELSE '' END AS domain,
  CASE WHEN type = 'process' AND n % 7 = 0 THEN ''
    WHEN type = 'process' THEN '{{"pid":' || (CASE WHEN k % 6 = 0 THEN 1000 + u ELSE 5000 + n END) || ',"ppid":' ||
      (CASE WHEN k % 6 = 1 AND n % 3 <> 0 THEN 1000 + u ELSE 1 END) || '}}'
    WHEN type = 'file' THEN '{{"action":"' || ['CREATE','DELETE','RENAME'][CAST(n % 3 + 1 AS INT)] || '"}}'
    WHEN type = 'network' THEN '{{"pid":' || (5000 + n) || ',"protocol":"tcp"}}'
    WHEN type = 'dns' THEN '{{"queryType":"A","answers":["' || ip || '"]}}'
    WHEN type = 'l7' THEN '{{"l7Protocol":"TLS","tlsVersion":"' || ['TLS 1.0','TLS 1.2','TLS 1.3','TLS 1.1'][CAST(k % 4 + 1 AS INT)] || '"}}'
    ELSE '' END AS detail,
  CASE WHEN type = 'process' THEN sha256(
    ['winword.exe','powershell.exe','evil.exe','OneDrive.exe','ls','chrome.exe'][CAST(k % 6 + 1 AS INT)] || k) ELSE '' END AS sha256,
  ts + 1000 * (n % 4) AS ingested_at, k, u FROM typed)"""

_TOKENS = (r"""list_filter(list_transform(regexp_extract_all(lower(cmdline), """
           r"""'(?:[^\s"'']|"[^"]*(?:"|$)|''[^'']*(?:''|$))+'), """
           r"""lambda x: replace(replace(x,'"',''),'''','')), lambda x: x <> '')""")

# Office apps, shells and the quiet list as SQL lists.
OFFICE = "('winword.exe','excel.exe','powerpnt.exe','outlook.exe')"
SHELLS = "('powershell.exe','cmd.exe','wscript.exe','cscript.exe','mshta.exe')"
QUIET = "('onedrive.exe','teams.exe','gupdate.exe','msedgeupdate.exe','update.exe')"

R = T + f""",
toks AS (SELECT *, {_TOKENS} AS tk, lower(process) AS lp, lower(parent) AS lpar,
  {jint('pid')} AS pid, {jint('ppid')} AS ppid FROM telemetry),
flags AS (SELECT *, type = 'process' AND lp NOT IN {QUIET} AND coalesce({temp('tk[1]')}, false) AS temp_exec,
  type = 'process' AND lp NOT IN {QUIET} AND lp IN {SHELLS} AND lpar IN {OFFICE} AS chain,
  type = 'network' AND dest_port IN (80,443,8080) AS download,
  type = 'process' AND lp IN {OFFICE} AS office FROM toks),
pair2 AS (SELECT t.seq, d.seq AS prior FROM flags t JOIN flags d ON t.host = d.host AND t.temp_exec AND d.download
  AND d.ts BETWEEN t.ts - 300000 AND t.ts
  QUALIFY row_number() OVER (PARTITION BY t.seq ORDER BY d.ts DESC, d.seq DESC) = 1),
pair1 AS (SELECT t.seq, d.seq AS prior FROM flags t JOIN flags d ON t.host = d.host AND t.chain AND d.office
  AND d.lp = t.lpar AND (d.pid IS NULL OR t.ppid IS NULL OR d.pid = t.ppid) AND d.ts BETWEEN t.ts - 300000 AND t.ts
  QUALIFY row_number() OVER (PARTITION BY t.seq ORDER BY d.ts DESC, d.seq DESC) = 1),
autorun AS (SELECT *, replace(trim(lower(cmdline)),'"','') AS p FROM telemetry WHERE type = 'file'),
fired AS (
  SELECT seq, prior, 'DOWNLOAD_AND_EXECUTE' AS rule_id, 'T1105+T1204' AS mitre, 'CRITICAL' AS severity FROM pair2
  UNION ALL SELECT seq, prior, 'SUSPICIOUS_PROCESS_CHAIN', 'T1059', 'HIGH' FROM pair1 WHERE seq NOT IN (SELECT seq FROM pair2)
  UNION ALL SELECT seq, NULL, 'SCRIPT_FROM_TEMP_PATH', 'T1059', 'MEDIUM' FROM toks WHERE type = 'script' AND
    len(list_filter(range(1, len(tk) + 1), lambda i: {temp('tk[i]')} AND (i = 1 OR tk[i - 1] NOT IN ('>','>>','>|','<')))) > 0
  UNION ALL SELECT seq, NULL, 'FILE_IN_AUTORUN_PATH', 'T1547', 'MEDIUM' FROM autorun WHERE
    (regexp_matches(p, '^/(library/launchagents/|library/launchdaemons/|system/library/launchagents/|users/[^/]+/library/launchagents/)')
     OR contains(p, '\\software\\microsoft\\windows\\currentversion\\run')
     OR regexp_matches(p, '^([a-z]:)?\\\\(users\\\\[^\\\\]+\\\\appdata\\\\roaming|programdata)\\\\microsoft\\\\windows\\\\start menu\\\\programs\\\\startup\\\\'))
    AND coalesce(lower({jtext('action')}), '') <> 'delete'
  UNION ALL SELECT seq, NULL, 'WEAK_TLS_HANDSHAKE', 'T1573', 'MEDIUM' FROM telemetry WHERE type = 'l7'
    AND lower({jtext('tlsVersion')}) IN ('ssl 3.0','tls 1.0','tls 1.1')),
detected AS (SELECT {uuid3("t.tenant_id||'|'||t.host||'|'||f.rule_id||'|'||t.ts")} AS id, t.tenant_id, t.host, f.rule_id, f.mitre,
  f.severity, CASE WHEN f.severity IN ('CRITICAL','HIGH') THEN 'kill' ELSE 'notify' END AS action, t.ts,
  coalesce({summary('p')} || chr(10), '') || {summary('t')} AS matched,
  CASE WHEN trim(t.cmdline) = '' THEN t.process ELSE t.cmdline END AS target,
  CASE WHEN p.dest_ip <> '' OR p.domain <> '' THEN p.domain ELSE t.domain END AS domain,
  CASE WHEN p.dest_ip <> '' OR p.domain <> '' THEN p.dest_ip ELSE t.dest_ip END AS dest_ip, t.seq
  FROM fired f JOIN telemetry t ON f.seq = t.seq LEFT JOIN telemetry p ON f.prior = p.seq)"""

A = R + """,
alert_log AS (SELECT *, ts + 2000 AS created_at FROM detected
  UNION ALL SELECT *, ts + 62000 FROM detected WHERE seq % 10 = 0),
alerts AS (SELECT * FROM alert_log
  QUALIFY row_number() OVER (PARTITION BY tenant_id, host, id ORDER BY created_at DESC, seq DESC) = 1)"""

# Threat names and categories as a SQL table.
_NAMES = ", ".join(f"('{r[0]}','{r[1]}','{r[2]}')" for r in RULES)

S = A + f""",
nib AS (SELECT tenant_id, id, ts, CAST(('0x' || substr(md5(id),1,1)) AS INT) AS nib FROM alerts),
overlay_log AS (SELECT tenant_id, id, CASE WHEN nib <= 3 THEN 'confirmed' ELSE 'false_positive' END AS status,
    ts + 5000 AS updated_at FROM nib WHERE nib <= 5
  UNION ALL SELECT tenant_id, id, 'false_positive', ts + 1000 FROM nib WHERE nib <= 5 AND nib % 2 = 0),
status AS (SELECT tenant_id, id, arg_max(status, updated_at) AS status, max(updated_at) AS updated_at
  FROM overlay_log GROUP BY ALL),
catalog(rule_id, threat_name, category) AS (VALUES {_NAMES})"""

N = """
enrol AS (SELECT c_custkey AS key, 'key-' || c_custkey AS node_key, CAST(1 + c_custkey % 3 AS VARCHAR) AS tenant_id,
  CASE WHEN c_custkey % 97 = 0 THEN 'unknown' ELSE 'H' || (c_custkey % 23) END AS host,
  CASE WHEN c_custkey % 2 = 0 THEN 'windows' ELSE 'darwin' END AS platform,
  {base} + c_custkey * 1000  AS t_at FROM customer),
nodes AS (SELECT tenant_id, host, sha256(arg_max(node_key, t_at)) AS node_key_hash, arg_max(platform, t_at) AS platform,
  min(t_at) AS enrolled_at, max(t_at) AS last_seen_at FROM enrol GROUP BY tenant_id, host)""".replace("{base}", str(BASE))

O = """
owner_log AS (SELECT CAST(1 + c_custkey % 3 AS VARCHAR) AS tenant_id, 'h' || (2 * (c_custkey % 10)) AS host,
  c_custkey % 50 AS user_id, {base} + c_custkey  AS t_at FROM customer),
owners AS (SELECT tenant_id, host, arg_min(user_id, t_at) AS user_id, min(t_at) AS t_at FROM owner_log GROUP BY ALL),
user_hooks AS (SELECT DISTINCT c_custkey % 50 AS user_id, CASE WHEN (c_custkey % 50) % 7 = 0 THEN ' '
  ELSE 'https://hooks.invalid/u/' || (c_custkey % 50) END AS url FROM customer WHERE (c_custkey % 50) % 3 <> 0),
tenant_hooks AS (SELECT DISTINCT CAST(1 + c_custkey % 3 AS VARCHAR) AS tenant_id,
  'https://hooks.invalid/t/' || (1 + c_custkey % 3) AS url FROM customer WHERE 1 + c_custkey % 3 <> 2)""".replace(
    "{base}", str(BASE))
