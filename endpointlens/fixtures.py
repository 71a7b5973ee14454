"""Telemetry and its side tables derived from the driver's generic tables.

Only column arithmetic over the given parquet tables; every derived table grows with them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.dedup import latest_alerts
from .operators.rules import detect
from .session import shared_folder
from .sources.store import read_alert_log, read_events, write_alerts, write_events

BASE = 1_704_067_200_000
NOW = BASE + 21_600_000          # end of the compressed month
FROM = BASE + 3_600_000
TO = BASE + 18_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def telemetry_of(events: DataFrame) -> DataFrame:
    """Maps the generic event table (batch or stream) to endpoint telemetry."""
    e = events.select(
        F.col("event_id").alias("n"), F.col("user_id").alias("u"), "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    n, u, k = F.col("n"), F.col("u"), F.col("k")
    type_ = (F.when(F.col("event_type") == "click", "network")
             .when(F.col("event_type") == "view", "process")
             .when(F.col("event_type") == "error", "script")
             .when(F.col("event_type") == "purchase", "file")
             .when(n % 2 == 0, "dns").otherwise("l7"))
    e = e.withColumn("type", type_)
    t = F.col("type")
    ip = F.concat(F.lit("203.0.113."), (k % 10).cast("string"))
    process = (F.when(t == "network", "chrome.exe")
               .when(t == "process", _pick(k % 6, "winword.exe", "powershell.exe", "evil.exe",
                                           "OneDrive.exe", "ls", "chrome.exe"))
               .when(t == "script", _pick(k % 4, "powershell.exe", "zsh", "sh", "python3"))
               .when(t == "file", "x.lnk")
               .otherwise(F.when(k % 2 == 0, "").otherwise("curl")))
    parent = (F.when((t == "process") & (k % 6 == 1), "winword.exe")
              .when(t.isin("process", "script"), "explorer.exe").otherwise(""))
    startup = "C:\\Users\\u\\AppData\\Roaming\\Microsoft\\Windows\\Start Menu\\Programs\\Startup\\x.lnk"
    cmdline = (
        F.when(t == "process", _pick(
            k % 6, '"C:\\Program Files\\Office\\winword.exe"', "powershell -enc AAAA",
            "C:\\Users\\u\\Downloads\\evil.exe", "C:\\Users\\u\\Downloads\\OneDrive.exe",
            "/bin/ls /tmp/x", "/opt/chrome"))
        .when(t == "script", _pick(
            k % 4, "powershell -File C:\\Users\\u\\Downloads\\setup.ps1",
            "/bin/zsh -c pwd >| /tmp/cwd", "/bin/sh -c true && /tmp/evil.sh",
            "python3 /opt/app.py"))
        .when(t == "file", _pick(
            k % 4, startup, "/Library/LaunchDaemons/x.plist", "C:\\dev\\startup\\x.lnk",
            "/Users/u/Library/LaunchAgents/x.plist"))
        .otherwise(""))
    pid = F.when(k % 6 == 0, 1000 + u).otherwise(5000 + n)
    ppid = F.when((k % 6 == 1) & (n % 3 != 0), 1000 + u).otherwise(F.lit(1))
    detail = (
        F.when((t == "process") & (n % 7 == 0), "")
        .when(t == "process", F.concat(F.lit('{"pid":'), pid.cast("string"), F.lit(',"ppid":'),
                                       ppid.cast("string"), F.lit("}")))
        .when(t == "file", F.concat(F.lit('{"action":"'),
                                    _pick(n % 3, "CREATE", "DELETE", "RENAME"), F.lit('"}')))
        .when(t == "network", F.concat(F.lit('{"pid":'), (5000 + n).cast("string"),
                                       F.lit(',"protocol":"tcp"}')))
        .when(t == "dns", F.concat(F.lit('{"queryType":"A","answers":["'), ip, F.lit('"]}')))
        .when(t == "l7", F.concat(F.lit('{"l7Protocol":"TLS","tlsVersion":"'),
                                  _pick(k % 4, "TLS 1.0", "TLS 1.2", "TLS 1.3", "TLS 1.1"),
                                  F.lit('"}')))
        .otherwise(""))
    ts = F.lit(BASE) + F.floor((F.col("ms") - BASE) / 120)
    named = t.isin("dns", "l7") | ((t == "network") & (n % 5 == 0))
    return e.select(
        n.alias("seq"),
        F.concat(F.lit("h"), (u % 20).cast("string")).alias("host"),
        (1 + u % 3).cast("string").alias("tenant_id"),
        t.alias("type"), ts.alias("ts"), process.alias("process"), parent.alias("parent"),
        cmdline.alias("cmdline"),
        F.when(t.isin("network", "l7"), ip).otherwise("").alias("dest_ip"),
        F.when(t == "network", _pick(n % 4, 443, 80, 22, 8080)).when(t == "l7", 443)
        .otherwise(0).cast("int").alias("dest_port"),
        F.when(named, F.concat(F.lit("a"), (k % 7).cast("string"), F.lit(".example.com")))
        .otherwise("").alias("domain"),
        detail.alias("detail"),
        F.when(t == "process", F.sha2(F.concat(process, k.cast("string")), 256)).otherwise("")
        .alias("sha256"),
        (ts + 1000 * (n % 4)).alias("ingested_at"))


_written: dict[tuple, str] = {}


def stored_table(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """Path of a derived table, written once per application to the shared folder."""
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, name)
    if key not in _written:
        place = sf_dir.strip("/").replace("/", "_")
        path = f"{shared_folder(spark)}/endpointlens/{app}/{place}/{name}"
        build(path)
        _written[key] = path
    return _written[key]


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table."""
    path = stored_table(spark, sf_dir, "events", lambda p: write_events(
        telemetry_of(table(spark, sf_dir, "events")), p, "overwrite"))
    return read_events(spark, path)


def _delivered(detected: DataFrame) -> DataFrame:
    """Alert log as stored: every tenth alert was delivered twice."""
    copies = F.when(F.col("seq") % 10 == 0, F.array(F.lit(0), F.lit(60000))).otherwise(
        F.array(F.lit(0)))
    return (detected.withColumn("_later", F.explode(copies))
            .withColumn("created_at", F.col("ts") + 2000 + F.col("_later")).drop("_later"))


def stored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert table with all its versions."""
    path = stored_table(spark, sf_dir, "alerts", lambda p: write_alerts(
        _delivered(detect(telemetry(spark, sf_dir))), p, "overwrite"))
    return read_alert_log(spark, path)


def alerts(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return latest_alerts(stored_alerts(spark, sf_dir), columns)


def overlay_log(alerts_: DataFrame) -> DataFrame:
    """Triage decisions on a part of the alerts; some were decided twice."""
    nibble = F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 1), 16, 10).cast("int")
    final = F.when(nibble <= 3, "confirmed").when(nibble <= 5, "false_positive")
    first = alerts_.select("tenant_id", "id", "ts", nibble.alias("nib"), final.alias("status"))
    first = first.where(F.col("status").isNotNull())
    early = first.where("nib % 2 = 0").select("tenant_id", "id", F.lit("false_positive").alias(
        "status"), (F.col("ts") + 1000).alias("updated_at"))
    return first.select("tenant_id", "id", "status", (F.col("ts") + 5000).alias(
        "updated_at")).unionByName(early)


def enrolments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One enrolment per customer; several fall on one host."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("key-"), key.cast("string")).alias("node_key"),
        (1 + key % 3).cast("string").alias("tenant_id"),
        F.when(key % 97 == 0, F.lit("")).otherwise(
            F.concat(F.lit("H"), (key % 23).cast("string"))).alias("host"),
        _pick(key % 2, "windows", "darwin").alias("platform"),
        (BASE + key * 1000).alias("at"))


def owner_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        (1 + key % 3).cast("string").alias("tenant_id"),
        F.concat(F.lit("h"), (2 * (key % 10)).cast("string")).alias("host"),
        (key % 50).alias("user_id"), (BASE + key).alias("at"))


def user_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return (table(spark, sf_dir, "customer").select((key % 50).alias("user_id")).distinct()
            .where("user_id % 3 <> 0")
            .withColumn("url", F.when(F.col("user_id") % 7 == 0, " ").otherwise(
                F.concat(F.lit("https://hooks.invalid/u/"), F.col("user_id").cast("string")))))


def tenant_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return (table(spark, sf_dir, "customer").select((1 + key % 3).cast("string").alias("tenant_id"))
            .distinct().where("tenant_id <> '2'")
            .withColumn("url", F.concat(F.lit("https://hooks.invalid/t/"), F.col("tenant_id"))))


ISO_CODES = ("US", "KR", "JP", "DE", "FR", "ZZ", "GB", "BR", "IN", "AU")


def ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address per nation, mapped to ISO codes (one of them unknown)."""
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("203.0.113."), n.cast("string")).alias("start_ip"),
        F.concat(F.lit("203.0.113."), n.cast("string")).alias("end_ip"),
        _pick(n % 10, *ISO_CODES).alias("iso2"))


def alert_messages(alerts_: DataFrame) -> DataFrame:
    """JSON messages of an alert topic, some of them unusable."""
    body = F.to_json(F.struct(
        F.when(F.col("seq") % 17 == 0, None).otherwise(F.col("host")).alias("host"),
        F.when(F.col("seq") % 19 == 0, None).otherwise(F.col("rule_id")).alias("ruleId"),
        "mitre", "severity", "action", "ts", "matched",
        F.when(F.col("seq") % 13 == 0, F.lit(" ")).otherwise(F.col("tenant_id")).alias("tenantId"),
        "target", "domain", F.col("dest_ip").alias("destIp")))
    broken = F.concat(F.lit("{oops"), body)
    return alerts_.select(F.when(F.col("seq") % 23 == 0, broken).otherwise(body).alias("value"),
                          F.col("created_at").alias("arrived_at"), "seq")


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumer positions per topic partition, some of them unknown."""
    e = table(spark, sf_dir, "events")
    per = e.groupBy(F.col("event_type").alias("topic"),
                    F.concat(F.lit("g"), (F.col("user_id") % 2).cast("string")).alias("group"),
                    (F.col("event_id") % 3).alias("partition"))
    rows = per.agg(F.max("event_id").alias("end_offset"), F.count("*").alias("n"),
                   F.max(F.col("user_id") % 10).alias("m"))
    committed = F.when((F.col("topic") == "view") & (F.col("group") == "g1")
                       & (F.col("partition") == 2), None).otherwise(
        F.col("end_offset") - F.col("n") % 50 + 10)
    return rows.select("topic", "group", "partition", "end_offset", committed.alias("committed"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host part of the page addresses."""
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("domain"))


def suffixes(spark: SparkSession) -> DataFrame:
    """Small public-suffix list; a full list can be passed instead."""
    # Sample suffixes.
    rules = ("com", "net", "org", "io", "kr", "co.kr", "or.kr", "jp", "co.jp", "uk", "co.uk")
    return spark.createDataFrame([(s,) for s in rules], "suffix string")


