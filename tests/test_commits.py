"""Tables of commits: killed and repeated batches, compaction, retention, conflicts."""

import pytest
from pyspark.sql import types as T

from endpointlens.schema import DAY_MS
from endpointlens.sources.commits import CommitConflict, CommittedTable

SHAPE = T.StructType([T.StructField("tenant_id", T.StringType()), T.StructField("host", T.StringType()),
                      T.StructField("ts", T.LongType()), T.StructField("ingested_at", T.LongType())])
T0 = 1_700_006_400_000


@pytest.fixture
def events(spark, tmp_path):
    return CommittedTable(spark, str(tmp_path / "events"), SHAPE, "ingested_at")


def rows(spark, *times):
    return spark.createDataFrame([("t", f"h{i}", t, t + 5) for i, t in enumerate(times)], SHAPE)


def times(table):
    return sorted(r.ts for r in table.read().collect())


def folders(table):
    return {(r["write"], str(r["event_date"])) for r in table.folders().collect()}


def test_an_empty_table_has_no_rows(events):
    assert events.read().count() == 0 and events.last_batch("s") == -1


def test_a_killed_batch_shows_nothing_and_its_repetition_each_row_once(spark, events):
    events.append(rows(spark, T0, T0 + 1), 0, "s")
    events.draft(rows(spark, T0 + 2))  # killed between its rows and its commit
    assert times(events) == [T0, T0 + 1]
    events.append(rows(spark, T0 + 2), 1, "s")
    events.append(rows(spark, T0 + 2), 1, "s")
    events.append(rows(spark, T0 + 3), 1, "other")
    assert times(events) == [T0, T0 + 1, T0 + 2, T0 + 3]


def test_an_empty_batch_and_one_without_time_are_kept_in_the_log(spark, events):
    events.append(rows(spark), 0, "s")
    events.append(spark.createDataFrame([("t", "h", None, 7)], SHAPE), 1, "s")
    assert events.last_batch("s") == 1
    assert [tuple(r) for r in events.read().collect()] == [("t", "h", None, 7, None)]
    events.compact(1)
    assert events.read().count() == 1


def test_compaction_bounds_the_folders_of_a_day_and_keeps_all_rows(spark, events):
    for i in range(4):
        events.append(rows(spark, T0 + i), i, "s")
    events.append(rows(spark, T0 + DAY_MS), 4, "s")
    untouched = {f for f in folders(events) if f[1] == "2023-11-16"}
    events.compact(3)
    assert len(folders(events)) == 2 and untouched <= folders(events)
    before = times(events)
    events.sweep()
    assert times(events) == before == [T0, T0 + 1, T0 + 2, T0 + 3, T0 + DAY_MS]
    assert len(events.versions()) == 1 and events.last_batch("s") == 4
    events.append(rows(spark, T0), 4, "s")
    assert times(events) == before


def test_retention_writes_only_the_edge_anew(spark, events):
    for i in range(4):
        events.append(rows(spark, T0 + i * DAY_MS, T0 + i * DAY_MS + 100), i, "s")
    before = folders(events)
    events.expire(T0 + DAY_MS + 50 + DAY_MS, 1)
    assert times(events) == [T0 + DAY_MS + 100, T0 + 2 * DAY_MS, T0 + 2 * DAY_MS + 100, T0 + 3 * DAY_MS, T0 + 3 * DAY_MS + 100]
    assert len(folders(events) & before) == 2 and len(folders(events)) == 3
    events.sweep()
    assert len(times(events)) == 5


def test_of_two_writers_of_one_version_one_fails(spark, events, monkeypatch):
    events.append(rows(spark, T0), 0, "s")
    monkeypatch.setattr(CommittedTable, "versions", lambda self: [])
    with pytest.raises(CommitConflict):
        events._commit([events._row(stream="s", batch=1)])
    monkeypatch.undo()
    assert events.last_batch("s") == 0 and times(events) == [T0]
