"""Guards, ingestion, and registry checks."""

import ipaddress
import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as entry
from endpointlens import scope
from endpointlens.operators.dedup import latest_alerts
from endpointlens.plans import alerts as alert_plans
from endpointlens.plans import geo, hosts, ops, topology
from endpointlens.sources import ingest, store

NOW = 1_700_000_000_000
GOOD = {"host": "h", "type": "process", "ts": NOW}


def test_tenant_is_mandatory(make_events):
    df = make_events([{"tenant_id": "1"}, {"tenant_id": "2"}])
    assert scope.tenant_scope(df, " 1 ").count() == 1
    for bad in (None, "", "  "):
        with pytest.raises(ValueError):
            scope.tenant_scope(df, bad)


def test_guards():
    assert [scope.clamp_limit("search", n) for n in (None, 0, -1, 7, 99)] == [5, 5, 5, 7, 20]
    assert [scope.resolve_offset(n) for n in (None, 0, 10_000)] == [0, 0, 10_000]
    for bad in (-1, 10_001):
        with pytest.raises(ValueError):
            scope.resolve_offset(bad)
    assert scope.search_term("  ab ") == "ab"
    for bad in (None, " a ", "x" * 201):
        with pytest.raises(ValueError):
            scope.search_term(bad)


def test_empty_text_is_a_filter_for_destinations(make_events):
    df = make_events([{"domain": ""}, {"domain": "a.b"}])
    assert scope.exact_filter(df, "domain", None).count() == 2
    assert scope.exact_filter(df, "domain", "").count() == 1
    assert scope.exact_filter(df, "domain", " A.B ").count() == 1


def test_page_reports_more(make_events):
    df = make_events([{"ts": t} for t in range(5)]).select("ts", F.col("seq").alias("id"))
    rows = scope.page(df, scope.newest_first(df), 2, 1).collect()
    assert [(r.ts, r.has_more) for r in rows] == [(3, True), (2, True)]
    assert [r.has_more for r in scope.page(df, scope.newest_first(df), 5).collect()] == [False] * 5


@pytest.mark.parametrize("change,outcome", [
    ({}, "accepted"), ({"host": " "}, "no_host"), ({"host": None}, "no_host"),
    ({"type": "registry"}, "unknown_type"), ({"ts": "soon"}, "bad_ts"), ({"ts": True}, "bad_ts"),
    ({"ts": f" {NOW} "}, "accepted"), ({"ts": NOW // 1000}, "ts_in_seconds"), ({"ts": -1}, "bad_ts"),
    ({"type": "network"}, "no_dest_ip"), ({"type": "network", "destIp": "1.1.1.1"}, "accepted"),
    ({"type": "dns", "domain": " "}, "no_domain"), ({"host": {"a": 1}}, "no_host"),
])
def test_validation(spark, change, outcome):
    body = json.dumps({"events": [{**GOOD, **change}]})
    rows = ingest.explode_batches(spark.createDataFrame([(body,)], "body string"))
    assert [r.outcome for r in ingest.validate(rows, NOW).collect()] == [outcome]


def test_ingest_values_and_counts(spark):
    events = [7, "{}", {**GOOD, "ts": NOW + 60_001, "destPort": " 80 ", "sha256": " " + "A" * 64,
                        "detail": {"x": 1}, "tenantId": "9", "process": 5},
              {**GOOD, "ts": NOW + 60_000, "destPort": "x", "sha256": "zz"}, {"host": "h"}]
    batches = spark.createDataFrame([("k1", json.dumps({"events": events})),
                                     ("k2", json.dumps({"events": events}))],
                                    "node_key string, body string")
    nodes = spark.range(1).select(F.sha2(F.lit("k1"), 256).alias("node_key_hash"),
                                  F.lit("1").alias("tenant_id"), F.lit("h").alias("host"))
    counts = Observation("ingest")
    accepted, _ = ingest.ingest(batches, nodes, NOW, counts)
    rows = sorted(accepted.collect(), key=lambda r: r.pos)
    assert counts.get == {"accepted": 2, "dropped": 1}
    a, b = rows
    assert (a.ts, a.dest_port, a.sha256, a.detail, a.tenant_id, a.process) == (
        NOW, 80, "a" * 64, "", "1", "5")
    assert (b.ts, b.dest_port, b.sha256) == (NOW + 60_000, 0, "")


def test_alert_messages(spark):
    good = {"host": "h", "ruleId": "R", "tenantId": "1", "ts": 5, "matched": ["a"]}
    values = [json.dumps(good), "{oops", json.dumps({**good, "tenantId": " "}),
              json.dumps({**good, "host": None})]
    df = spark.createDataFrame([(v, 1, i) for i, v in enumerate(values)],
                               "value string, arrived_at long, seq long")
    assert [r.seq for r in store.parse_alert_messages(df).collect()] == [0]


def test_tables_round_trip_and_expire(spark, make_events, tmp_path):
    day = 86_400_000
    events = make_events([{"ts": NOW, "ingested_at": NOW}, {"ts": NOW, "ingested_at": NOW - 8 * day}])
    store.write_events(events, str(tmp_path / "e"))
    back = store.read_events(spark, str(tmp_path / "e"))
    back = back.drop("event_date")
    assert sorted(back.collect()) == sorted(events.select(*back.columns).collect())
    store.expire_events(spark, str(tmp_path / "e"), str(tmp_path / "f"), NOW)
    assert store.read_events(spark, str(tmp_path / "f")).count() == 1


def test_old_alert_versions_expire(spark, tmp_path):
    day = 86_400_000
    rows = [(f"a{n}", "1", "h", "R", "T1", "LOW", "log", NOW, ["x"], "", "", "", n, NOW - n * day, None) for n in (0, 89, 91)]
    store.write_alerts(spark.createDataFrame(rows, store.ALERT_TABLE), str(tmp_path / "a"))
    store.expire_alerts(spark, str(tmp_path / "a"), str(tmp_path / "b"), NOW)
    assert sorted(r.id for r in store.read_alerts(spark, str(tmp_path / "b")).collect()) == ["a0", "a89"]


def test_scan_prunes_columns_and_pushes_filters(spark, make_events, tmp_path):
    store.write_events(make_events([{"tenant_id": "1"}, {"tenant_id": "2"}]), str(tmp_path / "e"))
    df = scope.tenant_scope(store.read_events(spark, str(tmp_path / "e")), "2")
    plan = df.where("ts >= 5 AND host = 'h1'").select("ts")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan
    assert "GreaterThanOrEqual(ts,5)" in plan
    assert "ReadSchema: struct<host:string,ts:bigint>" in plan


def test_time_ranges_open_days_only(spark, make_events, tmp_path):
    day = 86_400_000
    store.write_events(make_events([{"ts": NOW}, {"ts": NOW - 3 * day}]), str(tmp_path / "e"))
    rows = scope.time_range(store.read_events(spark, str(tmp_path / "e")), NOW - 5, NOW + 5, closed=True)
    plan = rows.select("host")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert filters.count("event_date") >= 2 and "GreaterThanOrEqual(ts" in plan and rows.count() == 1


def test_alert_fold_is_pruned(spark, tmp_path):
    spark.createDataFrame([], store.ALERT_TABLE).write.partitionBy("tenant_id", "event_date").parquet(str(tmp_path / "a"))
    log = store.read_alert_log(spark, str(tmp_path / "a"))
    rows = scope.time_range(latest_alerts(log, ["severity"]), NOW, NOW + 5, closed=False)
    plan = alert_plans.by_severity(rows)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "event_date" in plan[plan.index("PartitionFilters"):]
    assert "matched" not in plan and "dest_ip" not in plan and "severity" in plan


def test_registrable_domains(spark):
    names = ["api.example.co.kr", "db.corp.internal", "10.0.0.9", "co.kr", "a.b.example.com",
             "com", "Example.com"]
    df = spark.createDataFrame([(n,) for n in names], "dest string")
    suffixes = spark.createDataFrame([("com",), ("kr",), ("co.kr",)], "suffix string")
    got = {r.name: r.registrable for r in topology.registrable_domains(df, suffixes).collect()}
    assert got == {"api.example.co.kr": "example.co.kr", "a.b.example.com": "example.com",
                   "example.com": "example.com"}


def test_unknown_offset_hides_the_sum(spark):
    df = spark.createDataFrame([("a", "g", 10, 4), ("a", "g", 3, 9), ("b", "g", 5, None)],
                               "topic string, group string, end_offset long, committed long")
    assert {r.topic: r.lag for r in ops.consumer_lag(df).collect()} == {"a": 6, "b": None}


def test_non_numeric_tenant_has_no_nodes(spark):
    nodes = spark.createDataFrame([("1", "h", 5, "mac")],
                                  "tenant_id string, host string, last_seen_at long, platform string")
    assert hosts.tenant_nodes(nodes, "demo").count() == 0
    assert hosts.tenant_nodes(nodes, "1").count() == 1


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


SAMPLE = ("asof_nearest_download", "ingest_accepted", "notifications_with_failures",
          "host_list", "topology_edges", "correlation_edges", "incident_trees", "windows_events")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    from oracle_check import compare, connect
    sf = entry.SMALL
    note, _, rows = compare(spark, connect(sf), sf, entry.queries()[name], entry.oracle_sql()[name])
    assert note == "" and rows > 0


def test_country_of_an_address_by_order(spark):
    """Wide ranges, one crowded network, gaps, equal starts and partitions without a start of their own."""
    rng = random.Random(5)
    ranges = [("20.0.0.0", "20.255.255.255", "us"), ("2a00::", "2aff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "DE"),
              ("2a00::", "2bff::", "XX"), ("8.8.8.8", "8.8.8.8", " jp "), ("9.0.0.0", "8.0.0.0", "ZZ")]
    ranges += [(f"2001:db8::{i:x}00", f"2001:db8::{i:x}7f", rng.choice(["KR", "FR"])) for i in range(200)]
    asked = [f"2001:db8::{rng.randrange(200 << 8):x}" for _ in range(3000)] + ["8.8.8.8", "8.8.8.9", "9.0.0.0", "nonsense", "10.0.0.1", None]
    asked += [f"20.{rng.randrange(256)}.1.{i}" for i in range(200)] + [f"2a{i:02x}::{i}" for i in range(256)] + ["2bff::1", "::ffff:20.1.1.1"]

    def number(text):
        ip = ipaddress.ip_address(text)
        return int(ip) if ip.version == 6 else (0xFFFF << 32) + int(ip)

    spans = sorted((number(a), number(b), c.strip().upper()) for a, b, c in ranges if number(a) <= number(b))
    want = set()
    for ip in {a for a in asked if a and a not in ("nonsense", "10.0.0.1")}:
        below = [s for s in spans if s[0] <= number(ip)]
        start = max((s[0] for s in below), default=None)
        best = min((s for s in below if s[0] == start), default=None)
        if best and best[1] >= number(ip):
            want.add((ip, best[2]))
    addresses = spark.createDataFrame([(a,) for a in asked], "dest_ip string")
    table = spark.createDataFrame(ranges, "start_ip string, end_ip string, iso2 string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", before, "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = geo.countries_of(addresses, table).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert geo.countries_of(addresses.limit(0), table).count() == 0
    assert geo.countries_of(addresses, table.limit(0)).count() == 0
