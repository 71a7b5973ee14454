"""Arrival orders, silence and restarts of the streaming detector."""

import glob
import random
import threading
import time
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from endpointlens.operators.rules import detect
from endpointlens.streaming import asof, tables
from endpointlens.streaming.detect import judged_triggers
from endpointlens.streaming.flows import flow_owner_stream

from test_operators import download, execution

NOW = 1_700_000_000_000


@pytest.fixture
def folder(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/stream-{uuid.uuid4().hex}"


class Feed:
    """Drops one file per micro-batch into the source and collects judged triggers."""

    def __init__(self, spark, make_events, folder):
        self.spark, self.make_events, self.folder = spark, make_events, folder
        self.count = 0
        make_events([]).write.parquet(f"{folder}/in")

    def put(self, *rows):
        batch = [{**r, "seq": self.count + i} for i, r in enumerate(rows)]
        self.count += len(rows)
        self.make_events(batch).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self, quiet=3_600_000):
        """Takes in what is there, then stops; state stays in the checkpoint."""
        events = tables.event_stream(self.spark, f"{self.folder}/in")
        query = tables.start(judged_triggers(events, quiet=quiet),
                             tables.batch_writer(f"{self.folder}/out", []),
                             f"{self.folder}/checkpoint")
        tables.drain(query)

    def judged(self):
        df = self.spark.read.option("basePath", f"{self.folder}/out").parquet(
            f"{self.folder}/out/batch=*")
        return sorted((r.ts - NOW, r.rule, r.late) for r in df.collect())


@pytest.fixture
def feed(spark, make_events, folder):
    return Feed(spark, make_events, folder)


def idle(ts):
    return {"type": "dns", "domain": "a.b", "ts": ts}


def test_grace_lateness_and_restart(feed):
    """One host per arrival order; every `run` is a restart from the checkpoint."""
    feed.put(download(NOW - 2000, host="inorder"), execution(NOW, host="shuffled"),
             download(NOW, host="latetrigger"), execution(NOW, host="lateevidence"))
    feed.run()
    feed.put(execution(NOW, host="inorder"), download(NOW - 2000, host="shuffled"),
             download(NOW - 6000, host="latetrigger"))
    feed.run()
    feed.put(execution(NOW - 4000, host="latetrigger"))
    feed.run()
    df = feed.spark.read.parquet(f"{feed.folder}/out/batch=*")
    # The late trigger is judged on the spot, the others wait for their watermark.
    assert [(r.host, r.late, r.rule) for r in df.where("rule IS NOT NULL").collect()
            if r.late] == [("latetrigger", True, 0)]
    hosts = ("inorder", "shuffled", "lateevidence")
    feed.put(*[{**idle(NOW + 1501), "host": h} for h in hosts])
    feed.run()
    feed.put(download(NOW - 2000, host="lateevidence"))
    feed.run()
    df = feed.spark.read.parquet(f"{feed.folder}/out/batch=*")
    got = sorted((r.host, r.rule, r.late) for r in df.collect())
    assert got == [("inorder", 0, False), ("latetrigger", 0, True), ("shuffled", 0, False)]


def test_silent_host_is_flushed_by_the_clock(spark, feed):
    feed.put(download(NOW - 2000), execution(NOW))
    events = tables.event_stream(spark, f"{feed.folder}/in")
    query = tables.start(judged_triggers(events), tables.batch_writer(f"{feed.folder}/out", []),
                         f"{feed.folder}/checkpoint", once=False)
    end = time.time() + 60
    try:
        while time.time() < end:
            time.sleep(1)
            if query.lastProgress and query.lastProgress["batchId"] > 0 and feed.judged():
                break
    finally:
        query.stop()
    assert feed.judged() == [(0, 0, False)]


def test_noise_does_not_push_evidence_out(spark, make_events, feed):
    rows = [download(NOW - 2000)] + [idle(NOW - 1900 + i) for i in range(500)] + [
        execution(NOW), idle(NOW + 5000)]
    feed.put(*rows)
    feed.run()
    assert feed.judged() == [(0, 0, False)]
    assert detect(make_events(rows)).where(F.col("rule_id") == "DOWNLOAD_AND_EXECUTE").count() == 1


def test_busy_host_loses_nothing(spark, make_events, feed):
    """More than 200 pieces of evidence and more than 50 waiting triggers, over three batches."""
    def downloads(first, count):
        return [download(NOW + first + 3 * i, dest_ip=f"203.0.113.{i % 250}") for i in range(count)]

    def executions(first, count):
        return [execution(NOW + first + 7 * i) for i in range(count)]

    waves = [downloads(-60_000, 300) + executions(0, 70)[::-1], executions(500, 40) + downloads(-900, 250)[::-1],
             [idle(NOW + 9000)]]
    for wave in waves:
        feed.put(*wave)
        feed.run()
    batch = detect(make_events([{**r, "seq": i} for i, r in enumerate(sum(waves, []))]))
    want = sorted((r.ts - NOW, 0, False) for r in batch.where("rule_id = 'DOWNLOAD_AND_EXECUTE'").collect())
    assert len(want) == 110 and feed.judged() == want


def test_two_tenants_with_one_host_name(spark, make_events, folder):
    rows = [download(NOW - 2000, tenant_id="1"), execution(NOW, tenant_id="2"), idle(NOW + 5000), {**idle(NOW + 5000), "tenant_id": "2"}]
    make_events(rows).write.parquet(f"{folder}/in")

    def fired(group):
        events = tables.event_stream(spark, f"{folder}/in")
        return tables.run_to_table(judged_triggers(events, group=group)).where("rule IS NOT NULL").count()

    assert fired(("host",)) == 1 and fired(("tenant_id", "host")) == 0


def test_flow_owners_out_of_order(spark, folder):
    """A later flow must not answer an earlier lookup, nor an old one replace a newer; four batches."""
    flow = "tenant_id string, host string, ts long, seq long, local_port int, remote_ip string, remote_port int, path string"
    key = (40_000, "203.0.113.5", 443)
    flows = [("1", "h", 90_000, 1, *key, "/old"), ("1", "h", 100_000, 0, *key, "/new"), ("2", "h", 50_000, 5, *key, "/other")]
    asked = [("1", "h", 50_000, 10, *key, ""), ("1", "h", 95_000, 11, *key, ""), ("1", "h", 101_000, 12, *key, ""),
             ("1", "h", 161_000, 13, *key, "")]
    for n, wave in enumerate(([flows[1], asked[0]], [flows[0], asked[1]], [asked[2], flows[2]], [asked[3]])):
        spark.createDataFrame(wave, flow).coalesce(1).write.mode("append").parquet(f"{folder}/flows")
        time.sleep(0.05)

    def read():
        return spark.readStream.schema(flow).option("maxFilesPerTrigger", 1).parquet(f"{folder}/flows")

    stream = flow_owner_stream(read().where("path = ''"), read().where("path <> ''"), grace=70_000, quiet=1500)
    got = {r.seq: r.owner_path for r in tables.run_to_table(stream, settle_ms=2500).collect()}
    assert got == {11: "/old", 12: "/new"}


def test_runs_leave_no_checkpoint(spark, make_events, folder):
    make_events([idle(NOW)]).write.parquet(f"{folder}/in")
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/endpointlens/streams/*/checkpoint"))
    assert tables.run_to_table(tables.event_stream(spark, f"{folder}/in")).count() == 1
    assert set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/endpointlens/streams/*/checkpoint")) == before


class _Map:
    """A map state in memory that counts the values written."""

    def __init__(self):
        self.held, self.written = {}, 0

    def exists(self):
        return bool(self.held)

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value
        self.written += sum(len(v) if isinstance(v, list) else 1 for v in value)

    def removeKey(self, key):
        self.held.pop(key, None)

    def clear(self):
        self.held.clear()


class _Value(_Map):
    def get(self):
        return self.held[()]

    def update(self, value):
        self.updateValue((), value)


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _Map())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, _Value())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Now:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


@pytest.fixture
def judge():
    stored = T.StructType([T.StructField(n, T.LongType()) for n in ("ts", "seq")]
                          + [T.StructField(n, T.StringType()) for n in ("ask", "tell")])
    out = ["host", "ts", "seq", "late", "key", "prior_ts", "prior_seq"]
    made = asof.AsOfJudge(["host"], stored, out, grace=100, lookback=80_000, quiet=100, keep_late=True)
    made.init(_Handle())
    return made


def _feed(judge, now, rows):
    batch = pd.DataFrame(rows, columns=["ts", "seq", "ask", "tell"])
    return [tuple(r) for f in judge.handleInputRows(("h",), iter([batch]), _Now(now)) for r in f[["seq", "late", "prior_seq"]].itertuples(index=False)]


def _written(judge):
    return sum(s.written for s in judge.handle.states.values())


def test_a_micro_batch_writes_what_it_touches(judge):
    """State grows a hundredfold; what a batch of ten rows writes does not."""
    costs = []
    for b in range(100):
        before = _written(judge)
        _feed(judge, b, [(b * 500 + i * 7, b * 10 + i, "", f"0:k{i % 3}") for i in range(10)])
        costs.append(_written(judge) - before)
    assert len(judge.handle.states["evidence"].held) == 1000
    # The list of a cell's milliseconds is the only thing that is written again: a cell holds 200 rows here.
    assert max(costs) <= 10 * 4 + 3 * 70 + 40
    assert sum(costs[80:]) <= 1.5 * sum(costs[20:40])


def test_answers_equal_a_search_of_all_rows(judge):
    """Rows in any order inside the grace period, ties in time, keys of two ranks, late questions."""
    rng = random.Random(2)
    rows, now = [], 1000
    for seq in range(400):
        now += rng.choice([0, 1, 30, 3000])
        keys = asof.KEY_SEP.join(rng.sample(["0:a", "1:b", "1:c"], rng.randint(1, 3)))
        rows.append((now, seq, keys if seq % 2 else "", "" if seq % 2 else keys))
    arrivals = sorted(rows, key=lambda r: (r[0] + rng.randint(0, 90), r[1]))
    got = [a for b in range(0, 400, 25) for a in _feed(judge, b, arrivals[b:b + 25])]
    got += [tuple(r) for f in judge.handleExpiredTimer(("h",), _Now(10_000), None) for r in f[["seq", "late", "prior_seq"]].itertuples(index=False)]
    want = set()
    for ts, seq, ask, _ in (r for r in rows if r[2]):
        found = [(int(k[0]), -t, -s) for t, s, _, tell in rows if tell and ts - 80_000 <= t <= ts
                 for k in set(ask.split(asof.KEY_SEP)) & set(tell.split(asof.KEY_SEP))]
        if found:
            want.add((seq, False, -min(found)[2]))
    assert len(got) == len(set(got)) and set(got) == want


def test_what_a_micro_batch_settles_never_enters_the_state(judge):
    """A long backlog in one micro-batch: only what outlasts it is written; a repeated question has one answer."""
    rows = [r for i in range(2000) for r in ((i * 1000, 2 * i, "", f"0:k{i % 7}"), (i * 1000 + 5, 2 * i + 1, f"0:k{i % 7}", ""))]
    got = _feed(judge, 0, [*rows, rows[1]])
    assert sorted(got) == [(2 * i + 1, False, 2 * i) for i in range(1999)]
    # The evidence of the last look-back (81 rows, up to a cell more), each with its lists, and one question.
    assert _written(judge) < 91 * 6 + 50
    assert len(judge.handle.states["waiting"].held) == 1


@pytest.mark.parametrize("most", [0, 3, 20])
def test_rows_beyond_what_is_held_go_by_the_state(judge, monkeypatch, most):
    monkeypatch.setattr(asof, "HELD", most)
    rng = random.Random(4)
    rows = [(rng.randrange(0, 200_000, 50), seq, *(("", f"0:k{seq % 3}") if rng.random() < 0.5 else (f"0:k{seq % 3}", ""))) for seq in range(300)]
    batches = [pd.DataFrame(rows[i:i + 10], columns=["ts", "seq", "ask", "tell"]) for i in range(0, 300, 10)]
    got = {tuple(r) for f in judge.handleInputRows(("h",), iter(batches), _Now(0)) for r in f[["seq", "prior_seq"]].itertuples(index=False)}
    got |= {tuple(r) for f in judge.handleExpiredTimer(("h",), _Now(10_000), None) for r in f[["seq", "prior_seq"]].itertuples(index=False)}
    want = set()
    for ts, seq, ask, _ in (r for r in rows if r[2]):
        found = [(t, s) for t, s, _, tell in rows if tell == ask and ts - 80_000 <= t <= ts]
        want |= {(seq, max(found)[1])} if found else set()
    assert len(want) > 50 and got == want


def test_a_silent_host_leaves_no_state(judge):
    _feed(judge, 0, [(1000, 1, "", "0:k"), (1050, 2, "0:k", "")])
    assert len(judge.handle.timers) == 1
    answers = [r for f in judge.handleExpiredTimer(("h",), _Now(200), None) for r in f["prior_seq"]]
    assert answers == [1] and judge.handle.states["evidence"].held
    judge.handle.timers.clear()
    assert list(judge.handleExpiredTimer(("h",), _Now(90_000), None)) == []
    assert not any(s.held for s in judge.handle.states.values())


def test_expired_evidence_goes_by_cells(judge):
    _feed(judge, 0, [(i * 1000, i, "", "0:k") for i in range(50)])
    _feed(judge, 1, [(500_000, 99, "", "0:k")])
    assert list(judge.handle.states["evidence"].held) == [("0:k", 500_000)]
    assert len(judge.handle.states["times"].held) == len(judge.handle.states["keys"].held) == 1


def test_runs_over_one_source_go_on_at_one_time(feed, monkeypatch):
    """Both queries are active at once, with a table each; settings of the session are as before."""
    feed.put(download(NOW - 2000), execution(NOW), idle(NOW + 5000))
    feed.put(download(NOW + 6000, host="h2"), execution(NOW + 7000, host="h2"), {**idle(NOW + 9000), "host": "h2"})
    events = [tables.event_stream(feed.spark, f"{feed.folder}/in", files_per_trigger=1) for _ in range(2)]
    partitions, drain, both = feed.spark.conf.get("spark.sql.shuffle.partitions"), tables.drain, threading.Barrier(2, timeout=60)

    def together(query, **how):
        assert query.isActive
        both.wait()
        drain(query, **how)

    monkeypatch.setattr(tables, "drain", together)
    runs = tables.run_to_tables([judged_triggers(e, quiet=3_600_000) for e in events])
    for run in runs:
        assert sorted((r.host, r.ts - NOW, r.rule, r.late) for r in run.collect()) == [("h1", 0, 0, False), ("h2", 7000, 0, False)]
    assert feed.spark.conf.get("spark.sql.shuffle.partitions") == partitions and not feed.spark.streams.active


def test_a_repeated_empty_batch_does_not_end_a_run():
    """A run that was stopped inside an empty batch is resumed with that batch, before what has arrived since."""
    def batch(number, first, last, rows):
        return {"batchId": number, "timestamp": f"2024-01-01T00:00:0{number}.000Z", "numInputRows": rows, "durationMs": {"triggerExecution": 10},
                "sources": [{"startOffset": first, "endOffset": last}]}

    class Resumed:
        script = [batch(3, "a", "a", 0), batch(4, "a", "b", 0), batch(5, "b", "c", 7), batch(6, "c", "c", 0), batch(7, "c", "c", 0)]
        isActive, recentProgress, exception, ended = True, [], staticmethod(lambda: None), None

        def stop(self):
            self.isActive, self.ended = False, self.ended or self.recentProgress[-1]["batchId"]

    query = Resumed()
    steps = [query.recentProgress.append] * len(query.script)
    real, tables.time = tables.time, type("Clock", (), {"sleep": staticmethod(lambda _: steps and steps.pop()(query.script[len(query.recentProgress)]))})
    try:
        tables.drain(query)
    finally:
        tables.time = real
    assert query.ended == 6
