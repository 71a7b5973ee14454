"""Registered queries: raw macOS, Windows and L7 records, and the scalar functions."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import cmdline, dns, net, paths, text
from ..sources import l7, macos, typed, windows
from .base import FROM, NOW, R, T, query, temp
from .graphs import remembered_flows

_OUT = ["seq", "host", "ts", "type", "process", "parent", "cmdline", "dest_ip", "dest_port",
        "domain", "detail"]


# --- macOS -----------------------------------------------------------------------------------

HOME = "/Users/u"
MAC_WATCH = ["/Library/LaunchAgents/", "~/Library/LaunchAgents"]


def mac_lines(t):
    n = F.col("seq")
    at = F.when(n % 9 == 0, F.lit("garbage")).otherwise(
        F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))

    def file(path):
        return F.struct(path.alias("path"))

    def destination(existing, folder, name):
        return F.struct(
            F.when(existing.isNotNull(), file(existing)).alias("existing_file"),
            F.when(folder.isNotNull(), F.struct(file(folder).alias("dir"),
                                                name.alias("filename"))).alias("new_path"))

    none = F.lit(None).cast("string")
    target = F.struct(
        file(F.concat(F.lit("/usr/bin/"), "process")).alias("executable"),
        F.struct((5000 + n).cast("int").alias("pid")).alias("audit_token"),
        F.when(n % 4 == 0, 0).otherwise(1).alias("ppid"))
    args = F.array(F.col("process"), F.lit("--api-token=abc"), F.lit("-p"),
                   F.concat(F.lit("v"), n.cast("string")), F.lit("--Pass-Word"), F.lit("hunter2"))
    run = F.when(F.col("type").isin("process", "script"),
                 F.struct(args.alias("args"), target.alias("target")))
    is_file = F.col("type") == "file"
    create = F.when(is_file & (n % 3 == 0), F.struct(destination(
        F.lit("/Library/LaunchAgents/x.plist"), none, none).alias("destination")))
    rename = F.when(is_file & (n % 3 == 1), F.struct(
        file(F.lit("/Library/LaunchAgents/old.plist")).alias("source"),
        destination(none, F.when(n % 2 == 0, "/tmp/").otherwise("/Library/LaunchAgents/"),
                    F.lit("y.plist")).alias("destination")))
    gone = F.when(n % 2 == 0, F.lit("/Users/u/Library/LaunchAgents/q")).otherwise(F.lit("/tmp/z"))
    unlink = F.when(is_file & (n % 3 == 2), F.struct(file(gone).alias("target")))
    other = F.when(F.col("type") == "dns", F.struct(F.lit(1).alias("x")))
    line = F.to_json(F.struct(
        at.alias("time"),
        F.struct(file(F.concat(F.lit("/Applications/"), "parent")).alias("executable")).alias(
            "process"),
        F.struct(run.alias("exec"), create.alias("create"), rename.alias("rename"),
                 unlink.alias("unlink"), other.alias("lookup")).alias("event")))
    return t.select("seq", "host", F.when(n % 37 == 0, F.concat(F.lit("{{"), line)).otherwise(
        line).alias("value"))


@query("macos_events", f"""WITH {T}, m AS (SELECT *, CASE WHEN seq % 9 = 0 THEN {NOW} ELSE ts END AS at_ms,
  CASE WHEN type = 'file' THEN CASE seq % 3 WHEN 0 THEN '/Library/LaunchAgents/x.plist'
    WHEN 1 THEN CASE WHEN seq % 2 = 0 THEN '/Library/LaunchAgents/old.plist' ELSE '/Library/LaunchAgents/y.plist' END
    ELSE CASE WHEN seq % 2 = 0 THEN '/Users/u/Library/LaunchAgents/q' END END END AS path FROM telemetry WHERE seq % 37 <> 0)
SELECT seq, host, at_ms AS ts, CASE WHEN process IN ('sh','zsh') OR process LIKE 'python%' THEN 'script' ELSE 'process' END AS type, process, parent,
  '/usr/bin/' || process || ' --api-token=<redacted> -p v' || seq || ' --Pass-Word <redacted>' AS cmdline, '' AS dest_ip, 0 AS dest_port, '' AS domain,
  '{{"pid":' || (5000 + seq) || CASE WHEN seq % 4 = 0 THEN '' ELSE ',"ppid":1' END || '}}' AS detail FROM m WHERE type IN ('process','script')
UNION ALL SELECT seq, host, at_ms, 'file', regexp_extract(path, '([^/]*)$', 1), '', path, '', 0, '',
  '{{"action":"' || ['CREATE','RENAME','DELETE'][CAST(seq % 3 + 1 AS INT)] || '"}}' FROM m WHERE type = 'file' AND path IS NOT NULL""")
def macos_events(spark, d):
    watch = [paths.expand_home(p, HOME) for p in MAC_WATCH]
    return macos.parse_lines(mac_lines(fx.telemetry(spark, d)), watch, NOW).select(*_OUT)


# --- Windows ---------------------------------------------------------------------------------

WIN_WATCH = ["C:\\Users\\*\\Startup", "C:/ProgramData/"]


def windows_records(t):
    """Provider records; user numbers are the process ids."""
    n, k = F.col("seq"), F.col("seq") % 10
    u = F.col("seq") % 150
    kind = F.col("type")
    provider = (F.when(kind == "process", "process").when(kind == "network", "network")
                .when(kind == "file", "file").when(kind == "dns", "dns"))
    event_id = (F.when(kind == "process", F.when(k == 3, 2).otherwise(1))
                .when(kind == "network", F.when(k == 5, 10).when(k < 5, 12).otherwise(28))
                .when(kind == "file", F.when(k == 7, 12).otherwise(30)).otherwise(3008))
    watched = (F.when(n % 3 == 0, "\\Device\\HarddiskVolume3\\Users\\Bob\\Startup\\x.lnk")
               .when(n % 3 == 1, "c:\\Users\\bob\\AppData\\Startup\\y.lnk")
               .otherwise("\\??\\C:\\ProgramData\\z.exe"))

    def pairs(*kv):
        return F.map_from_arrays(F.array(*[F.lit(x) for x in kv[::2]]), F.array(*kv[1::2]))

    props = (
        F.when(kind == "process", pairs(
            "ImageName", F.col("process"), "ImagePath", F.concat(F.lit("C:\\Win\\"), "process"),
            "commandline", F.concat("process", F.lit("  -Password s3cret /token:"),
                                    n.cast("string"), F.lit(" run")),
            "ProcessID", (1000 + u).cast("string"),
            "PARENTPROCESSID", (1000 + (u + 20) % 150).cast("string")))
        .when(kind == "network", pairs(
            "daddr", F.when(n % 4 == 0, "10.0.0.1").otherwise(F.col("dest_ip")),
            "dport", F.when(n % 7 == 0, "70000").otherwise(F.col("dest_port").cast("string")),
            "PID", (1000 + u).cast("string")))
        .when(kind == "file", pairs("FileName", watched))
        .otherwise(pairs(
            "QueryName", F.when(n % 8 == 0, "4.3.2.1.IN-ADDR.ARPA.").otherwise(
                F.concat(F.upper("domain"), F.lit("."))),
            "QueryType", F.when(n % 6 == 0, "28").when(n % 6 == 2, "999").otherwise("A"),
            "QueryStatus", F.when(n % 6 == 4, "x").otherwise("0"),
            "QueryResults", F.when(n % 12 == 0, F.lit(" ; ")).otherwise(
                F.lit("type:  5 cdn.example.net;type: 5;203.0.113.1,")))))
    return t.where("type IN ('process', 'network', 'file', 'dns')").select(
        "tenant_id", "host", "ts", "seq", provider.alias("provider"), event_id.alias("event_id"),
        (1000 + u).cast("int").alias("header_pid"), props.alias("props"))


_WIN = f"""{T}, w AS (SELECT *, seq % 150 AS uu, CASE type WHEN 'process' THEN 1000 + (seq % 150 + 20) % 150 ELSE 1000 + seq % 150 END AS asked FROM telemetry),
st AS (SELECT tenant_id, host, ts, seq, 1000 + uu AS pid, process FROM w WHERE type = 'process' AND seq % 10 <> 3),
nm AS (SELECT w.seq, arg_max(st.process, (st.ts, st.seq)) AS owner FROM w JOIN st ON st.tenant_id = w.tenant_id AND st.host = w.host AND st.pid = w.asked AND st.ts <= w.ts GROUP BY w.seq),
x AS (SELECT w.*, coalesce(owner, '') AS owner FROM w LEFT JOIN nm USING (seq))"""


def _records(spark, d):
    """The records as a stored table, as a collector would leave them."""
    path = fx.stored_table(spark, d, "windows-records", lambda p: windows_records(
        fx.telemetry(spark, d)).write.mode("overwrite").parquet(p))
    return spark.read.parquet(path)


@query("windows_events", f"""WITH {_WIN}
SELECT seq, tenant_id, host, ts, CASE WHEN lower(process) = 'powershell.exe' THEN 'script' ELSE 'process' END AS type, process, owner AS parent,
  'C:\\Win\\' || process || '  -Password <redacted> /token:<redacted> run' AS cmdline, '' AS dest_ip, 0 AS dest_port, '' AS domain,
  '{{"pid":' || (1000 + uu) || ',"ppid":' || asked || '}}' AS detail FROM x WHERE type = 'process' AND seq % 10 <> 3
UNION ALL SELECT seq, tenant_id, host, ts, 'network', owner, '', '', dest_ip, CASE WHEN seq % 7 = 0 THEN 0 ELSE dest_port END, '',
  '{{"pid":' || asked || ',"protocol":"tcp"}}' FROM x WHERE type = 'network' AND seq % 4 <> 0 AND seq % 10 <> 5
UNION ALL SELECT seq, tenant_id, host, ts, 'file', CASE seq % 3 WHEN 0 THEN 'x.lnk' ELSE 'z.exe' END, '', CASE seq % 3 WHEN 0
  THEN '\\Device\\HarddiskVolume3\\Users\\Bob\\Startup\\x.lnk' ELSE '\\??\\C:\\ProgramData\\z.exe' END, '', 0, '', '{{"action":"CREATE"}}'
  FROM x WHERE type = 'file' AND seq % 10 <> 7 AND seq % 3 <> 1
UNION ALL SELECT seq, tenant_id, host, ts, 'dns', owner, '', '', '', 0, domain, '{{' || CASE WHEN seq % 12 = 0 THEN '' ELSE '"answers":["cdn.example.net","203.0.113.1"],' END ||
  '"pid":' || asked || ',"queryType":"' || CASE seq % 6 WHEN 0 THEN 'AAAA' WHEN 2 THEN '999' ELSE 'A' END || '"' ||
  CASE WHEN seq % 6 = 4 THEN '' ELSE ',"status":0' END || '}}' FROM x WHERE type = 'dns' AND seq % 8 <> 0""")
def windows_events(spark, d):
    return windows.parse_records(_records(spark, d), WIN_WATCH).select("tenant_id", *_OUT)


@query("windows_process_stops", f"""WITH {T} SELECT tenant_id, host, count(*) AS stops FROM telemetry
WHERE type = 'process' AND seq % 10 = 3 GROUP BY tenant_id, host""")
def windows_process_stops(spark, d):
    return windows.stop_count(_records(spark, d))


# --- L7 --------------------------------------------------------------------------------------

def l7_metadata(t):
    n, kind = F.col("seq"), F.col("type")
    octet = F.substring_index("dest_ip", ".", -1).try_cast("int")
    return t.where("type IN ('dns', 'l7', 'network')").select(
        "tenant_id", "host", "ts", "seq",
        F.when(kind == "dns", "dns").when(kind == "l7", "tls").otherwise("http").alias("kind"),
        (n % 3 == 0).alias("is_response"),
        F.when(n % 5 == 1, "").otherwise(F.col("domain")).alias("domain"),
        (F.lit(40000) + octet).alias("local_port"), F.col("dest_ip").alias("remote_ip"),
        F.when(kind == "dns", 53).otherwise(443).alias("remote_port"),
        F.lit("A").alias("query_type"), F.array(F.lit("203.0.113.9")).alias("answers"),
        F.when(n % 2 == 0, "").otherwise("TLS 1.2").alias("tls_version"),
        F.when(n % 4 == 1, F.array(F.lit("h2"), F.lit("http/1.1"))).otherwise(
            F.array().cast("array<string>")).alias("alpn"),
        F.when(n % 3 == 0, "").otherwise("GET").alias("method"),
        F.when(n % 3 == 0, "").otherwise("/x").alias("path"),
        F.lit("").alias("user_agent"), F.when(n % 3 == 0, 200).otherwise(0).alias("status_code"))


_L7 = f"""{T}, l AS (SELECT *, CASE WHEN seq % 5 = 1 THEN '' ELSE domain END AS dom FROM telemetry),
own AS (SELECT l.seq, arg_max(n.process, (n.ts, n.seq)) AS owner FROM l JOIN telemetry n ON n.type = 'network' AND n.tenant_id = l.tenant_id AND n.host = l.host
  AND n.dest_ip = l.dest_ip AND n.ts BETWEEN l.ts - 60000 AND l.ts WHERE l.type IN ('l7','network') GROUP BY l.seq)"""


@query("l7_metadata_events", f"""WITH {_L7}
SELECT seq, tenant_id, host, ts, 'dns' AS type, '' AS process, '' AS parent, '' AS cmdline, '' AS dest_ip, 0 AS dest_port, dom AS domain,
  '{{"answers":["203.0.113.9"],"protocol":"udp","queryType":"A"}}' AS detail FROM l WHERE type = 'dns' AND seq % 3 = 0
UNION ALL SELECT seq, tenant_id, host, ts, 'l7', coalesce(owner, ''), '', '', dest_ip, 443, dom, '{{' || CASE WHEN seq % 4 = 1 THEN '"alpn":["h2","http/1.1"],' ELSE '' END ||
  '"l7Protocol":"TLS","protocol":"tcp"' || CASE WHEN seq % 2 = 0 THEN '' ELSE ',"tlsVersion":"TLS 1.2"' END || '}}'
  FROM l LEFT JOIN own USING (seq) WHERE type = 'l7' AND dom <> ''
UNION ALL SELECT seq, tenant_id, host, ts, 'l7', CASE WHEN seq % 3 = 0 THEN '' ELSE coalesce(owner, '') END, '', '', dest_ip, 443, dom,
  CASE WHEN seq % 3 = 0 THEN '{{"httpStatusCode":200,"l7Protocol":"HTTP","protocol":"tcp"}}'
  ELSE '{{"httpMethod":"GET","httpPath":"/x","l7Protocol":"HTTP","protocol":"tcp"}}' END
  FROM l LEFT JOIN own USING (seq) WHERE type = 'network' AND (seq % 3 = 0 OR dom <> '')""")
def l7_metadata_events(spark, d):
    t = fx.telemetry(spark, d)
    return l7.metadata_events(l7_metadata(t), remembered_flows(t)).select("tenant_id", *_OUT)


@query("typed_event_details", f"""WITH {T} SELECT seq, regexp_extract(cmdline, '([^/\\\\]*)$', 1) AS process, cmdline,
  CASE WHEN seq % 5 = 0 THEN '' ELSE '{{"action":"WRITE"}}' END AS detail FROM telemetry WHERE type = 'file'""")
def typed_event_details(spark, d):
    action = F.when(F.col("seq") % 5 == 0, "").otherwise("WRITE")
    return fx.telemetry(spark, d).where("type = 'file'").select(
        "seq", *typed.file(F.col("cmdline"), action, F.lit(""))).select(
        "seq", "process", "cmdline", "detail")


# --- Scalar functions ------------------------------------------------------------------------

@query("command_line_tokens", f"""WITH {R} SELECT seq, array_to_string(tk, '|') AS tokens, coalesce(tk[1], '') AS first,
  coalesce({temp('tk[1]')}, false) AS from_temp FROM toks WHERE type IN ('process','script')""")
def command_line_tokens(spark, d):
    c = F.lower("cmdline")
    return fx.telemetry(spark, d).where("type IN ('process', 'script')").select(
        "seq", F.array_join(cmdline.tokenize(c), "|").alias("tokens"),
        cmdline.first_token(c).alias("first"),
        cmdline.executable_from_temp(F.col("cmdline")).alias("from_temp"))


@query("autorun_paths", f"""WITH {T} SELECT seq, cmdline NOT LIKE 'C:\\dev%' AS autorun,
  regexp_extract(cmdline, '([^/\\\\]*)$', 1) AS base FROM telemetry WHERE type = 'file'""")
def autorun_paths(spark, d):
    return fx.telemetry(spark, d).where("type = 'file'").select(
        "seq", paths.is_autorun_path(F.col("cmdline")).alias("autorun"),
        text.basename(F.col("cmdline")).alias("base"))


@query("destination_classes", f"""WITH {T}, v AS (SELECT DISTINCT unnest([dest_ip, domain, '10.0.0.' || (seq % 9), '::ffff:' || dest_ip, '172.' || (seq % 40) || '.0.1']) AS v FROM telemetry)
SELECT v AS value, regexp_matches(v, '^[0-9]+\\.') OR v LIKE '::ffff:2%' AS is_ip,
  CASE WHEN v LIKE '203.%' OR v LIKE '::ffff:203%' THEN true WHEN v LIKE '172.%' THEN NOT CAST(split_part(v, '.', 2) AS INT) BETWEEN 16 AND 31 ELSE false END AS public,
  CASE WHEN v LIKE '::ffff:2%' THEN substr(v, 8) WHEN regexp_matches(v, '^[0-9]+\\.') THEN v END AS canonical FROM v""")
def destination_classes(spark, d):
    n = F.col("seq")
    values = F.array("dest_ip", "domain", F.concat(F.lit("10.0.0."), (n % 9).cast("string")),
                     F.concat(F.lit("::ffff:"), "dest_ip"),
                     F.concat(F.lit("172."), (n % 40).cast("string"), F.lit(".0.1")))
    v = F.col("value")
    return fx.telemetry(spark, d).select(F.explode(values).alias("value")).distinct().select(
        "value", net.is_ip(v).alias("is_ip"), net.is_public_ip(v).alias("public"),
        net.canonical_ip(v).alias("canonical"))


@query("page_domains", """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages)
SELECT page_id, lower(host) AS domain, page_id % 10 = 0 AS reverse FROM p""")
def page_domains(spark, d):
    raw = F.concat(F.lit(" "), F.upper("domain"), F.lit(".. "))
    raw = F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("x.ip6.arpa"))).otherwise(raw)
    name = dns.normalize_domain(raw)
    shown = F.when(dns.is_reverse_name(name), F.lower("domain")).otherwise(name)
    return fx.domains(spark, d).select("page_id", shown.alias("domain"),
                                       dns.is_reverse_name(name).alias("reverse"))


@query("redacted_command_lines", f"""WITH {T} SELECT seq,
  'tool "a b"  -ENC <redacted> --password=<redacted> /secret:<redacted>  tail' || seq AS windows,
  '/bin/tool --auth_token <redacted> -k=1 --secret=<redacted> x' || seq AS posix FROM telemetry""")
def redacted_command_lines(spark, d):
    n = F.col("seq").cast("string")
    line = F.concat(F.lit('tool "a b"  -ENC abc'), n, F.lit(" --password=p"), n,
                    F.lit(" /secret:"), n, F.lit("  tail"), n)
    args = F.array(F.lit("tool"), F.lit("--auth_token"), F.concat(F.lit("-t"), n), F.lit("-k=1"),
                   F.concat(F.lit("--secret="), n), F.concat(F.lit("x"), n))
    return fx.telemetry(spark, d).select(
        "seq", cmdline.redact_windows(line).alias("windows"),
        cmdline.posix_cmdline(F.lit("/bin/tool"), args).alias("posix"))


@query("expanded_home_paths", f"""WITH {T} SELECT seq, CASE seq % 4 WHEN 0 THEN '/Users/u' WHEN 1 THEN '/Users/u/x' || seq
  WHEN 2 THEN '~bob/x' ELSE '/etc/' || seq END AS path FROM telemetry""")
def expanded_home_paths(spark, d):
    n = F.col("seq")
    raw = (F.when(n % 4 == 0, F.lit("~")).when(n % 4 == 1, F.concat(F.lit("~/x"), n.cast("string")))
           .when(n % 4 == 2, F.lit("~bob/x")).otherwise(F.concat(F.lit("/etc/"), n.cast("string"))))
    return fx.telemetry(spark, d).select("seq", paths.expand_home_column(raw, HOME).alias("path"))


@query("arrival_times_of_text", f"""WITH {T} SELECT seq, CASE WHEN seq % 11 = 0 THEN NULL ELSE ingested_at END AS at_ms,
  tenant_id <> '3' AS key_ok FROM telemetry WHERE ts >= {FROM}""")
def arrival_times_of_text(spark, d):
    shown = F.date_format(F.timestamp_millis("ingested_at"), "yyyy-MM-dd HH:mm:ss.SSS")
    raw = F.when(F.col("seq") % 11 == 0, F.lit("soon")).otherwise(shown)
    key = F.when(F.col("tenant_id") == "3", F.lit("03")).otherwise(F.col("tenant_id"))
    return fx.telemetry(spark, d).where(F.col("ts") >= FROM).select(
        "seq", text.epoch_ms_of_text(raw).alias("at_ms"),
        text.tenant_key_ok(key).alias("key_ok"))
