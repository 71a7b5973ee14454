"""Explicit schemas and the constants the detection rules share."""

from pyspark.sql import types as T

EVENT_TYPES = ("process", "network", "file", "script", "dns", "l7")
CONNECT_TYPES = ("network", "l7")

EVENT = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("host", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("process", T.StringType()),
    T.StructField("parent", T.StringType()),
    T.StructField("cmdline", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("domain", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("ingested_at", T.LongType()),
])

EVENT_COLUMNS = [f.name for f in EVENT.fields if f.name != "seq"]

DETAIL = T.StructType([
    T.StructField("pid", T.IntegerType()),
    T.StructField("ppid", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("queryType", T.StringType()),
    T.StructField("answers", T.ArrayType(T.StringType())),
    T.StructField("status", T.IntegerType()),
    T.StructField("tlsVersion", T.StringType()),
    T.StructField("alpn", T.ArrayType(T.StringType())),
    T.StructField("l7Protocol", T.StringType()),
    T.StructField("httpMethod", T.StringType()),
    T.StructField("httpPath", T.StringType()),
    T.StructField("httpUserAgent", T.StringType()),
    T.StructField("httpStatusCode", T.IntegerType()),
])

ALERT_JSON = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("ruleId", T.StringType()),
    T.StructField("mitre", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("matched", T.ArrayType(T.StringType())),
    T.StructField("tenantId", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("destIp", T.StringType()),
])

# What one judged rule hands on; `seq` is the arrival order of the trigger.
ALERT_COLUMNS = [
    "id", "tenant_id", "host", "rule_id", "mitre", "severity", "action", "ts",
    "matched", "target", "domain", "dest_ip", "seq",
]

# Windows and bounds in milliseconds.
LOOKBACK_MS = 300_000
GRACE_MS = 1_500
SOURCE_WINDOW_MS = 5_000
LINEAGE_WINDOW_MS = 300_000
BACKFILL_BEFORE_MS = 1_000
BACKFILL_AFTER_MS = 30_000
FLOW_OWNER_TTL_MS = 60_000
COOLDOWN_MS = 60_000
MIN_PLAUSIBLE_MS = 100_000_000_000
MAX_SKEW_MS = 60_000
EVENT_LOOKUP_MS = 1_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000

# Rule word lists (lower case).
OFFICE_APPS = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe")
SHELLS = ("powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe")
DOWNLOAD_PORTS = (80, 443, 8080)
BASELINE_SAFE = ("onedrive.exe", "teams.exe", "gupdate.exe", "msedgeupdate.exe", "update.exe")
WEAK_TLS = ("ssl 3.0", "tls 1.0", "tls 1.1")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
