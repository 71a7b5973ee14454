"""Ordered and graph operators against brute force on small, skewed tables."""

import random

import pytest
from pyspark.sql import functions as F

from endpointlens.operators import correlation, incidents, lineage
from endpointlens.operators.asof import asof_join
from endpointlens.operators.dedup import latest_alerts
from endpointlens.operators.rules import SequenceRule, detect
from endpointlens.operators import scan
from endpointlens.operators.scan import cooldown, running_max
from endpointlens.operators.source_event import summary_key, with_source_event
from endpointlens.sources.store import ALERT_TABLE


def keyed_rows(seed, n, span):
    rng = random.Random(seed)
    # A third of the rows sits on one key.
    return [(i, "hot" if rng.random() < 0.4 else rng.choice("abc"), rng.randrange(span))
            for i in range(n)]


@pytest.mark.parametrize("back,ahead", [(50, 0), (20, 70), (None, 0)])
def test_asof_matches_brute_force(spark, back, ahead):
    scale = 100_000 if back is None else 1
    left = [(i, k, t * scale) for i, k, t in keyed_rows(1, 200, 900)]
    right = [(i, k, t * scale) for i, k, t in keyed_rows(2, 120, 900)]
    schema = "seq long, k string, ts long"
    got = asof_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema),
                    ["k"], back=back, ahead=ahead, payload=["seq"])
    found = {r.seq: (r.match.ts, r.match.seq) if r.match else None for r in got.collect()}
    for seq, key, ts in left:
        near = [(abs(t - ts), t, -s, s) for s, k, t in right if k == key
                and (back is None or t >= ts - back) and t <= ts + ahead]
        want = (min(near)[1], min(near)[3]) if near else None
        assert found[seq] == want
    assert len(found) == len(left)


def test_running_max_crosses_chunks(spark):
    rows = keyed_rows(3, 300, 1000)
    got = running_max(spark.createDataFrame(rows, "seq long, k string, ts long"), ["k"], "seq",
                      "ts", "top", chunk=16)
    tops = {}
    want = {}
    for seq, k, ts in rows:
        tops[k] = max(tops.get(k, ts), ts)
        want[seq] = tops[k]
    assert {r.seq: r.top for r in got.collect()} == want


def cooldown_by_hand(rows, window):
    last, passed = {}, set()
    for seq, k, ts, ok in sorted(rows):
        if last.get(k) is None or ts - last[k] >= window:
            passed.add(seq)
            last[k] = ts if ok else None
    return passed


@pytest.mark.parametrize("chunk", [3, 17, 65_536])
@pytest.mark.parametrize("fails", [0.0, 0.5])
def test_cooldown_matches_fold(spark, chunk, fails):
    rng = random.Random(4)
    # Mostly ascending with late rows, so that negative gaps occur.
    rows = [(s, k, s * 3 + rng.randrange(-60, 60), rng.random() >= fails)
            for s, k, _ in keyed_rows(5, 400, 10)]
    df = spark.createDataFrame(rows, "seq long, k string, ts long, ok boolean")
    got = cooldown(df, ["k"], "seq", "ts", 40, "ok", chunk=chunk)
    assert {r.seq for r in got.where("passed").collect()} == cooldown_by_hand(rows, 40)
    assert got.count() == len(rows)


# --- Rules -----------------------------------------------------------------------------------

def download(ts, **kw):
    return {"type": "network", "process": "chrome", "dest_ip": "203.0.113.9", "dest_port": 443,
            "ts": ts, **kw}


def execution(ts, **kw):
    return {"process": "evil.exe", "parent": "explorer.exe",
            "cmdline": "C:\\Users\\v\\Downloads\\evil.exe", "ts": ts, **kw}


def fired(df):
    return sorted((r.rule_id, r.ts) for r in detect(df).collect())


def test_download_and_execute(make_events):
    assert fired(make_events([download(1000), execution(2000)])) == [
        ("DOWNLOAD_AND_EXECUTE", 2000)]
    a = detect(make_events([download(1000), execution(2000)])).first()
    assert a.matched == ["network 203.0.113.9:443", "process evil.exe (parent explorer.exe)"]
    assert (a.severity, a.action, a.dest_ip) == ("CRITICAL", "kill", "203.0.113.9")


@pytest.mark.parametrize("rows", [
    [execution(1000), download(2000)],
    [download(1000, host="h2"), execution(2000)],
    [download(1000), execution(301_001)],
    [download(1000, dest_port=22), execution(2000)],
    [download(1000), execution(2000, process="OneDrive.exe")],
    [download(1000), execution(2000, cmdline="find /private/tmp/x -name a")],
    [download(1000, host=""), execution(2000, host="")],
])
def test_download_and_execute_silent(make_events, rows):
    assert fired(make_events(rows)) == []


def test_window_edge_is_inclusive(make_events):
    assert len(fired(make_events([download(1000), execution(301_000)]))) == 1


@pytest.mark.parametrize("pid,ppid,hit", [
    ('{"pid":10}', '{"ppid":10}', True), ('{"pid":10}', '{"ppid":11}', False),
    ("", '{"ppid":11}', True), ('{"pid":10}', "", True), ('{"pid":"10"}', '{"ppid":11}', True)])
def test_process_chain_lineage(make_events, pid, ppid, hit):
    rows = [{"process": "WINWORD.EXE", "ts": 1000, "detail": pid},
            {"process": "powershell.exe", "parent": "winword.exe", "ts": 2000, "detail": ppid}]
    assert bool(fired(make_events(rows))) is hit


def test_priority_and_points(make_events):
    chain_and_download = [
        download(900), {"process": "winword.exe", "ts": 950},
        {"process": "powershell.exe", "parent": "winword.exe", "ts": 1000, "cmdline": "/tmp/x"}]
    assert fired(make_events(chain_and_download)) == [("DOWNLOAD_AND_EXECUTE", 1000)]
    points = [
        {"type": "file", "cmdline": "/Library/LaunchAgents/a", "ts": 1},
        {"type": "file", "cmdline": "/Library/LaunchAgents/a", "detail": '{"action":"Delete"}'},
        {"type": "l7", "domain": "a.b", "detail": '{"tlsVersion":"TLS 1.0"}', "ts": 2},
        {"type": "l7", "domain": "a.b", "detail": '{"alpn":[]}'}]
    assert fired(make_events(points)) == [("FILE_IN_AUTORUN_PATH", 1), ("WEAK_TLS_HANDSHAKE", 2)]


# --- Source events ---------------------------------------------------------------------------

def make_alerts(spark, rows):
    base = {"id": "a", "tenant_id": "1", "host": "h1", "rule_id": "X", "mitre": "T1",
            "severity": "HIGH", "action": "kill", "ts": 1000, "matched": [], "target": "",
            "domain": "", "dest_ip": "", "seq": 0, "created_at": 0, "event_date": None}
    full = [{**base, "id": f"a{i + 1}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in ALERT_TABLE.fields) for r in full],
                                 ALERT_TABLE)


def test_summary_round_trip(spark):
    lines = ["network 1.2.3.4:443", "file /a b", "l7 a.b (TLS 1.0)", "l7  (TLS)", "script sh (x (y))",
             "process p (parent q (r))", "process p (parent )", "process p (parent null)", "what"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string")
    got = [r.k.split("\x01") if r.k else None for r in rows.select(
        "i", summary_key(F.col("s")).alias("k")).orderBy("i").collect()]
    assert got == [["network", "1.2.3.4:443"], ["file", "/a b"], ["l7", "a.b"], None,
                   ["script", "sh"], ["child", "p", "q (r)"], ["process", "p"], ["process", "p"],
                   None]


def test_source_event_ties_and_fallback(spark, make_events):
    events = make_events([{"process": "p", "parent": "q", "ts": 900},
                          {"process": "p", "parent": "q", "ts": 1100},
                          {"type": "script", "process": "sh", "ts": 6000}])
    line = "process p (parent q)"
    alerts = make_alerts(spark, [
        {"matched": [line]}, {"matched": [line], "ts": 7000},
        {"matched": ["??"], "rule_id": "SCRIPT_FROM_TEMP_PATH", "ts": 1000},
        {"matched": ["process z (parent q)"], "rule_id": "DOWNLOAD_AND_EXECUTE"},
        {"matched": [], "rule_id": "OTHER"}])
    got = {r.id: (r.source.ts if r.source else None, r.matched_by)
           for r in with_source_event(alerts, events).collect()}
    # Equal distance takes the earlier; a readable line without an event gives nothing.
    assert got == {"a1": (900, "summary"), "a2": (None, None), "a3": (6000, "rule_type"),
                   "a4": (None, None), "a5": (None, None)}


# --- Incidents -------------------------------------------------------------------------------

def proc(process, parent, ts, pid=None, ppid=None):
    detail = "" if pid is None else f'{{"pid":{pid},"ppid":{ppid}}}'
    return {"process": process, "parent": parent, "ts": ts, "detail": detail}


def grouped(spark, make_events, alerts, rows):
    members, chain = incidents.group_alerts(
        make_alerts(spark, [{"ts": t, "severity": s, "matched": [m]} for t, s, m in alerts]),
        make_events(rows))
    return incidents.roll_up(members).orderBy("first_ts").collect(), chain


def spawned(process, parent):
    return f"process {process} (parent {parent})"


def test_process_ids_keep_trees_apart(spark, make_events):
    """Two build shells: their ids part them, without ids they are one."""
    alerts = [(t, "LOW", spawned("make", shell)) for t, shell in ((40_000, "zsh"), (71_000, "fish"))]
    with_ids = [proc("make", "zsh", 40_000, 311, 300), proc("make", "fish", 71_000, 512, 500)]
    without = [proc("make", "zsh", 40_000), proc("make", "fish", 71_000)]
    assert [i.alert_count for i in grouped(spark, make_events, alerts, with_ids)[0]] == [1, 1]
    assert [i.alert_count for i in grouped(spark, make_events, alerts, without)[0]] == [2]


def test_branches_below_one_alert_join_and_others_do_not(spark, make_events):
    """init > cron > (backup > tar, rotate) and init > sshd; alerts on cron, tar, rotate and sshd."""
    tree = [proc("cron", "init", 10_000, 20, 1), proc("backup", "cron", 11_000, 30, 20),
            proc("tar", "backup", 12_500, 40, 30), proc("rotate", "cron", 13_000, 50, 20), proc("sshd", "init", 14_000, 60, 1)]
    alerts = [(10_000, "LOW", spawned("cron", "init")), (12_500, "HIGH", spawned("tar", "backup")),
              (13_000, "MEDIUM", spawned("rotate", "cron")), (14_000, "CRITICAL", spawned("sshd", "init"))]
    got, chain = grouped(spark, make_events, alerts, tree)
    assert [(i.alert_count, i.severity, i.root_process) for i in got] == [(3, "HIGH", "cron"), (1, "CRITICAL", "sshd")]
    nodes = {r.node for r in chain.where(F.col("incident_id") == got[0].incident_id).collect()}
    assert nodes == {"proc:cron:20", "proc:backup:30", "proc:tar:40", "proc:rotate:50"}


def test_two_processes_that_name_each_other(spark, make_events):
    alerts = [(5_000, "HIGH", spawned("left", "right")), (8_000, "HIGH", spawned("right", "left"))]
    got, _ = grouped(spark, make_events, alerts, [proc("left", "right", 5_000, 8, 9), proc("right", "left", 8_000, 9, 8)])
    assert [(i.alert_count, i.root_process) for i in got] == [(2, "left")]


def test_deep_chain_and_cycle_above_the_start(spark, make_events):
    """Alerts at both ends of 200 processes belong together; a cycle above an alert ends the walk."""
    deep = [proc(f"s{i}", f"s{i - 1}", 1_000 + i, 100 + i, 99 + i) for i in range(1, 201)]
    alerts = [(1_001, "LOW", spawned("s1", "s0")), (1_200, "LOW", spawned("s200", "s199"))]
    got, chain = grouped(spark, make_events, alerts, deep)
    assert [i.alert_count for i in got] == [2] and chain.count() == 200
    ring = [proc("x", "y", 1_000, 1, 2), proc("y", "z", 1_000, 2, 3), proc("z", "y", 1_000, 3, 2)]
    got, chain = grouped(spark, make_events, [(1_000, "LOW", spawned("x", "y"))], ring)
    assert [i.alert_count for i in got] == [1] and {r.node for r in chain.collect()} == {"proc:x:1"}
    starts = spark.createDataFrame([("1", "h1", "proc:s200:300"), ("1", "h1", "proc:x:1")], "tenant_id string, host string, node string")
    paths = incidents.ancestor_paths(starts, incidents.process_index(make_events(deep + ring)))
    found = {(r.start, r.depth): r.node for r in paths.collect()}
    assert found["proc:s200:300", 200] == "proc:s0:100" and len(found) == 201 + 3
    assert [found["proc:x:1", i] for i in range(3)] == ["proc:x:1", "proc:y:2", "proc:z:3"]


def test_walks_over_forests_and_cycles_equal_plain_walks(spark):
    """Random parents, so deep chains, wide trees, cycles and tails of cycles, on several hosts."""
    rng = random.Random(7)
    parent, anchors = {}, set()
    for host, size, reach in (("deep", 80, 2), ("wide", 80, 80), ("rings", 60, None)):
        for i in range(size):
            up = rng.randrange(size) if reach is None else max(-1, i - rng.randint(1, reach))
            if up >= 0:
                parent[host, f"n{i}"] = f"n{up}"
            if rng.random() < 0.15:
                anchors.add((host, f"n{i}"))
    place = "tenant_id string, host string, node string"
    a = spark.createDataFrame([("1", h, n) for h, n in anchors], place)
    p = spark.createDataFrame([("1", h, n, up) for (h, n), up in parent.items()], place + ", parent string")
    found, steps = incidents.anchor_walks(a, p)
    links = found.where("up IS NOT NULL").select("tenant_id", "host", "node", "up")
    got_way = {(r.host, r.node, r.up) for r in incidents.nodes_between(links, steps).collect()}

    above, way, joined = {}, set(), {x: {x} for x in anchors}
    for host, start in anchors:
        path, node = [], parent.get((host, start))
        while node is not None and node not in path and node != start:
            path.append(node)
            node = parent.get((host, node))
        hits = [n for n in path if (host, n) in anchors]
        above[host, start] = hits[0] if hits else None
        if hits:
            way |= {(host, n, hits[0]) for n in path[:path.index(hits[0])]}
        for n in hits:
            both = joined[host, start] | joined[host, n]
            for x in both:
                joined[x] = both
    rows = found.collect()
    assert {(r.host, r.node): r.up for r in rows} == above and len(rows) == len(anchors) and got_way == way
    parts = {}
    for r in rows:
        parts.setdefault((r.host, r.component), set()).add((r.host, r.node))
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, {frozenset(x) for x in joined.values()}))


def test_very_long_path_finds_its_event(spark, make_events):
    path = "/srv/" + "d" * 1_100_000
    events = make_events([{"type": "file", "cmdline": path, "ts": 700}])
    alerts = make_alerts(spark, [{"matched": ["file " + path], "rule_id": "FILE_IN_AUTORUN_PATH", "ts": 800}])
    assert [r.source.ts for r in with_source_event(alerts, events).collect()] == [700]


def test_lineage_first_wins(make_events):
    nodes, edges = lineage.build_graph(make_events([
        proc("a", "p", 5, 7, 1), proc("a", "p", 3, 7, 1),
        {"type": "network", "process": "a", "dest_ip": "1.1.1.1", "dest_port": 80, "ts": 9,
         "detail": '{"pid":7}'}, {"type": "network", "process": "a", "ts": 9},
        {"type": "dns", "process": "", "ts": 1}]), ["host"])
    assert {(r.node_id, r.ts) for r in nodes.collect()} == {
        ("proc:a:7", 3), ("proc:p:1", 3), ("net:1.1.1.1:80", 9)}
    assert {(r["from"], r["to"], r.rel) for r in edges.collect()} == {
        ("proc:p:1", "proc:a:7", "spawned"), ("proc:a:7", "net:1.1.1.1:80", "connected")}


def test_latest_alert_version(spark):
    log = make_alerts(spark, [{"id": "x", "created_at": 5, "action": "old"},
                              {"id": "x", "created_at": 9, "action": "new"}]).drop("event_date")
    assert [r.action for r in latest_alerts(log).collect()] == ["new"]


# --- Correlation -----------------------------------------------------------------------------

def dns_row(ts, process="", answers='["198.51.100.7"]'):
    return {"type": "dns", "process": process, "domain": "mirror.test", "ts": ts,
            "detail": f'{{"answers":{answers}}}'}


def correlated(make_events, rows):
    events = make_events(rows)
    seeds = events.where("type <> 'process'").withColumn("seed", F.lit("s"))
    filled = correlation.backfill(seeds, events)
    edges = correlation.merge_edges(correlation.observed_edges(filled, ["seed"]), ["seed"])
    return {(r["from"], r["to"], r.relation, r.origin): r for r in edges.collect()}


def test_dns_edges_merge_and_alias(make_events):
    """Four answers of one name, two of them by way of an alias, on two hosts."""
    got = correlated(make_events, [
        dns_row(90_000), {**dns_row(20_000, "apt", '["edge.mirror.test","198.51.100.7"]'), "host": "h2"},
        dns_row(45_000, "pip", '["edge.mirror.test","198.51.100.7"]'), dns_row(60_000)])
    e = got["domain:mirror.test", "ip:198.51.100.7", "RESOLVED_TO", "OBSERVED"]
    assert (e.observations, e.first_seen, e.last_seen, e.basis) == (4, 20_000, 90_000, None)
    assert ("domain:mirror.test", "domain:edge.mirror.test", "ALIAS_OF", "OBSERVED") in got
    for asker in ("host:h1", "host:h2", "process:apt", "process:pip"):
        assert (asker, "domain:mirror.test", "QUERIED", "OBSERVED") in got


def test_inferred_process_has_a_basis(make_events):
    connect = {"type": "network", "process": "curl", "dest_ip": "198.51.100.7"}
    got = correlated(make_events, [dns_row(50_000), {**connect, "ts": 52_500},
                                   {**connect, "ts": 47_000, "process": "before"}])
    e = got["process:curl", "domain:mirror.test", "QUERIED", "INFERRED"]
    assert e.basis == "network 이벤트 dest_ip=198.51.100.7 ts=52500"
    # A connection without a domain points at the address.
    assert ("process:curl", "ip:198.51.100.7", "CONNECTED", "OBSERVED") in got


def test_live_answers_carry_no_counts(spark):
    rows = spark.createDataFrame([("s", "DOMAIN", "example.com", "1.2.3.4", True),
                                  ("s", "IP", "1.2.3.4", "example.com", True),
                                  ("s", "DOMAIN", "example.com", "9.9.9.9", False)],
                                 "seed_key string, seed_kind string, seed string, answer string, ok boolean")
    got = {(r["from"], r["to"], r.relation, r.observations, r.first_seen)
           for r in correlation.live_edges(rows, ["seed_key"]).collect()}
    assert got == {("domain:example.com", "ip:1.2.3.4", "RESOLVED_TO", 0, None),
                   ("ip:1.2.3.4", "ptr_name:example.com", "PTR_CANDIDATE", 0, None)}


def test_targets():
    parse = correlation.parse_target
    assert parse(" 1.2.3.4 ") == ("IP", "1.2.3.4")
    assert parse("2001:DB8:0::1") == ("IP", "2001:db8::1")
    assert parse("Example.COM..") == ("DOMAIN", "example.com")
    for bad in (None, " ", "...", "a b", "-x.com", "1.2.3", "x" * 64 + ".com"):
        with pytest.raises(ValueError):
            parse(bad)


def test_own_sequence_rule(make_events):
    """A rule of the caller's: a script within the look-back before a write to /etc."""
    rule = SequenceRule(
        "SCRIPT_THEN_WRITE", "T0", "LOW",
        trigger=lambda: (F.col("type") == "process") & F.col("cmdline").startswith("/etc/"),
        evidence=lambda: (F.col("type") == "process") & (F.col("process") == "sh"),
        trigger_keys=lambda: F.array(F.lit("k")), evidence_keys=lambda: F.array(F.lit("k")))
    events = make_events([{"process": "sh", "ts": 10}, {"cmdline": "/etc/x", "ts": 50},
                          {"cmdline": "/etc/x", "ts": 500}])
    got = detect(events, lookback=100, sequence_rules=(rule,), point_rules=())
    assert [(r.rule_id, r.ts, r.action) for r in got.collect()] == [("SCRIPT_THEN_WRITE", 50, "notify")]


def test_lineage_of_every_alert(spark, make_events):
    """Two alerts of a host apart by more than the window have a graph each; alerts of one time share it."""
    alerts = spark.createDataFrame([("1", "h1", 1_000_000, "b"), ("1", "h1", 1_000_000, "a"), ("1", "h1", 9_000_000, "c")],
                                   "tenant_id string, host string, ts long, id string")
    events = make_events([{"ts": ts, "process": p, "parent": "sh"} for ts, p in
                          ((699_999, "early"), (700_000, "one"), (1_300_000, "two"), (9_000_000, "three"))])
    nodes, _ = lineage.window_graphs(alerts, events)
    assert {(r.graph_id, r.label) for r in nodes.collect()} == {
        ("a", "one"), ("a", "two"), ("a", "sh"), ("c", "three"), ("c", "sh")}
    assert {tuple(r) for r in lineage.graph_members(alerts).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    import __spark_entry__ as entry
    assert {f"every_alert_lineage_{x}" for x in ("nodes", "edges", "members")} <= set(entry.queries())


@pytest.mark.parametrize("low,high", [(0, 0), (3, 4), (0, 64), (5, 77), (63, 65), (1, 128), (1000, 1061), (64, 128)])
def test_dyadic_cells_cover_a_window_once(spark, low, high):
    cells = spark.range(1).select(lineage._cells(F.lit(low).cast("long"), F.lit(high).cast("long"), 5).alias("c")).first().c
    covered = sorted(i for c in cells for i in range(c["cell"] << c["level"], (c["cell"] + 1) << c["level"]))
    assert covered == list(range(low, high))
    assert len(cells) <= 2 * 5 + max(0, (high - low) >> 5)


@pytest.mark.parametrize("window", [1, 40, 1000])
def test_window_graphs_equal_the_events_of_each_window(spark, make_events, window):
    """Dense alerts on a busy host, windows that begin before time zero, repeated times and ids."""
    rng = random.Random(window)
    rows = [{"host": rng.choice(["busy", "busy", "busy", "calm"]), "ts": rng.randint(0, 2500),
             "type": rng.choice(["process", "network", "file"]), "process": rng.choice(["a", "b", "", "c"]),
             "parent": rng.choice(["a", "p", ""]), "dest_ip": rng.choice(["", "1.1.1.1", "2.2.2.2"]), "dest_port": 443,
             "detail": rng.choice(["", '{"pid":1,"ppid":2}', '{"pid":3}'])} for _ in range(300)]
    events = make_events(rows)
    spots = [(f"a{i}", "1", rng.choice(["busy", "calm", "none"]), rng.randint(0, 2600)) for i in range(60)]
    alerts = spark.createDataFrame([*spots, ("a00", *spots[0][1:])], "id string, tenant_id string, host string, ts long")
    graphs = {(s[2], s[3]): min(t[0] for t in [*spots, ("a00", *spots[0][1:])] if t[2:] == s[2:]) for s in spots}
    near = None
    for (host, at), graph in graphs.items():
        some = events.where((F.col("host") == host) & F.col("ts").between(max(at - window, 0), at + window)).withColumn("graph_id", F.lit(graph))
        near = some if near is None else near.unionByName(some)
    near = spark.createDataFrame(near.collect(), near.schema)
    for got, want in zip(lineage.window_graphs(alerts, events, window), lineage.build_graph(near, ["graph_id"])):
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == {tuple(r) for r in want.collect()}


def test_a_window_does_not_copy_every_event(spark, make_events):
    """One process told of a thousand times: many alerts near it read its folds, not its events."""
    events = make_events([{"ts": i * 600, "process": "p", "parent": "q"} for i in range(1000)])
    alerts = spark.createDataFrame([(f"a{i}", "1", "h1", 150_000 + i * 600) for i in range(500)], "id string, tenant_id string, host string, ts long")
    width = 1 << (2 * 300_000 // lineage.FINEST).bit_length() - 1
    spots = lineage._windows(alerts, 300_000, width, 6)
    asked = spots.agg(F.sum(F.size("whole")), F.sum(F.size("cut"))).first()
    assert asked[0] <= 500 * 13 and asked[1] <= 500 * 2
    nodes, _ = lineage.window_graphs(alerts, events)
    assert nodes.count() == 1000


def test_events_are_spread_over_asked_kinds_only(spark, make_events):
    """Alerts that tell of a process with its parent need one key of an event, not all three."""
    from pyspark.sql import Observation
    from endpointlens.operators import source_event
    events = make_events([{"ts": 1000 + i, "process": "p", "parent": "q", "type": "process"} for i in range(50)])
    alerts = spark.createDataFrame([("1", "h1", "a", 1010, "SUSPICIOUS_PROCESS_CHAIN", ["process p (parent q)"]),
                                    ("1", "h1", "b", 1020, "UNLISTED", ["unreadable"])],
                                   "tenant_id string, host string, id string, ts long, rule_id string, matched array<string>")
    seen, plain = Observation(), source_event.asof_join

    def counted(left, right, *args, **bounds):
        return plain(left, right.observe(seen, F.count(F.lit(1)).alias("n")), *args, **bounds)

    source_event.asof_join = counted
    try:
        found = {r.id: r.source and r.source.seq for r in source_event.with_source_event(alerts, events).collect()}
    finally:
        source_event.asof_join = plain
    assert found == {"a": 10, "b": None}
    assert seen.get["n"] == 50


def test_a_task_reads_bounded_shuffle_bytes(spark):
    from endpointlens.session import TASK_BYTES, prepare
    before = spark.conf.get(TASK_BYTES[0], None)
    try:
        spark.conf.unset(TASK_BYTES[0])
        prepare(spark)
        assert spark.conf.get(TASK_BYTES[0]) == TASK_BYTES[1]
        spark.conf.set(TASK_BYTES[0], "8m")
        prepare(spark)
        assert spark.conf.get(TASK_BYTES[0]) == "8m"  # the caller's own size stays
    finally:
        spark.conf.set(TASK_BYTES[0], before or TASK_BYTES[1])


def test_graphs_of_windows_are_not_shuffled(spark, make_events):
    """Overlapping graphs hold far more rows than the events; exchanges carry events and windows alone."""
    events = make_events([{"ts": 1_000_000 + i, "process": "p", "parent": "q", "detail": f'{{"pid":{i},"ppid":{i}}}'} for i in range(300)])
    alerts = spark.createDataFrame([(f"a{i}", "1", "h1", 1_000_000 + i) for i in range(300)], "id string, tenant_id string, host string, ts long")
    for graph in lineage.window_graphs(alerts, events):
        assert graph.count() >= 300 * 300
        plan = graph._jdf.queryExecution().optimizedPlan().toString()
        folds = [line for line in plan.splitlines() if "Aggregate" in line and "first" in line]
        assert len(folds) == 1  # that of graphs of several windows
    twice = spark.createDataFrame([("a", "1", "h1", 1_000_000), ("a", "1", "h1", 1_000_100), (None, "1", "h1", 1_000_200)],
                                  "id string, tenant_id string, host string, ts long")
    nodes, edges = (g.groupBy("graph_id").count().collect() for g in lineage.window_graphs(twice, events))
    assert {tuple(r) for r in nodes} == {("a", 600), (None, 600)} and {tuple(r) for r in edges} == {("a", 300), (None, 300)}


def test_windows_and_spans_are_joined_as_plain_rows(spark, make_events):
    """Each of a graph's many rows is copied out of the join, so its sides hold no nested columns; spans of two
    window lengths fill two cells, or three off the grid, and windows go out once for each of three widths."""
    events = make_events([{"ts": 1_000_000 + 50 * i, "process": "p", "parent": "q", "detail": f'{{"pid":{i},"ppid":{i}}}'} for i in range(40)])
    alerts = spark.createDataFrame([(f"a{i}", "1", "h1", 1_000_000 + 70 * i) for i in range(40)], "id string, tenant_id string, host string, ts long")

    def joins(plan):
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        return [plan] * (plan.nodeName() == "Join") + [j for c in children for j in joins(c)]

    for graph in lineage.window_graphs(alerts, events, 1000):
        found = joins(graph._jdf.queryExecution().optimizedPlan())
        sides = [side for j in found for side in (j.left(), j.right())]
        kinds = [side.output().apply(i).dataType().typeName() for side in sides for i in range(side.output().size())]
        assert len(found) == 2 and "struct" not in kinds  # of single graphs and of those that several windows share
        sizes = sorted(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, side).count() for side in (found[0].left(), found[0].right()))
        assert sizes[1] <= 3 * 80 and sizes[0] <= 3 * 40


def test_composed_steps_equal_a_walk():
    """Any tree of chunks, any incoming state it can meet, times in and out of order."""
    rng = random.Random(3)
    for trial in range(300):
        window = rng.choice([1, 5, 40])
        rows, now = [], 0
        for _ in range(rng.randint(2, 40)):
            now += rng.randint(0, 9)
            rows.append((max(0, now - rng.choice([0, 0, 0, rng.randint(0, 60)])), rng.random() < 0.8))
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randint(1, 6))))
        chunks = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        reach, steps = max(t for t, _ in chunks[0]), None
        states = {scan._NONE, *(t for t, _ in chunks[0])}
        for at, chunk in enumerate(chunks[1:], 1):
            top = max(t for c in chunks[:at] for t, _ in c)
            one = scan._reachable(scan._chunk_effect([t for t, _ in chunk], [o for _, o in chunk], window), top, window)
            steps = one if steps is None else scan._reachable(scan._composed(steps, one, window), reach, window)
        for last in states:
            want = last
            for t, o in (row for chunk in chunks[1:] for row in chunk):
                if want == scan._NONE or t - want >= window:
                    want = t if o else scan._NONE
            assert scan._leaves(steps, last, window) == want


def test_summaries_hold_one_window_of_steps():
    """A key that sends every millisecond: however long the chunks, no summary outgrows the window."""
    window, size = 50, 1000
    chunk = lambda c: scan._reachable(scan._chunk_effect(
        list(range(c * size, (c + 1) * size)), [True] * size, window), c * size - 1, window)
    steps = chunk(1)
    for c in range(2, 20):
        steps = scan._reachable(scan._composed(steps, chunk(c), window), size - 1, window)
        assert len(steps[0]) <= window + 2


def test_cooldown_of_one_key_over_a_thousand_chunks(spark):
    rng = random.Random(8)
    rows = [("hot", i, i * 3 + rng.choice([0, 0, -5]), i % 11 != 0) for i in range(4000)] + [
        ("calm", 4000, 7, True), ("twice", 1, 5, True), ("twice", 3999, 6, True)]
    df = spark.createDataFrame(rows, "k string, seq long, ts long, ok boolean")
    got = cooldown(df, ["k"], "seq", "ts", 40, "ok", chunk=4)
    assert {(r.k, r.seq) for r in got.where("passed").collect()} == {
        (k, seq) for k in ("hot", "calm", "twice") for seq in cooldown_by_hand([(seq, key, ts, ok) for key, seq, ts, ok in rows if key == k], 40)}


def test_column_form_of_targets_follows_the_rule(spark):
    texts = [" 8.8.8.8 ", "::ffff:8.8.8.8", "2001:DB8::1", "Example.COM.", "a-b.c", "-a.b", "a..b", "", None, ".", "1.2.3", "x_y.de",
             "_dmarc.x.de", "bücher.example", "a" * 64 + ".de", "host", "1.2.3.999", "two words", "x.1a", "a." * 130 + "de"]
    want = set()
    for text in texts:
        try:
            want.add(correlation.parse_target(text))
        except ValueError:
            pass
    found = correlation.parsed_targets(spark.createDataFrame([(t,) for t in texts], "raw string"))
    assert {tuple(r) for r in found.collect()} == want
