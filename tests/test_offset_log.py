"""The log with offsets: numbering, bounded batches, restarts, replays, appends that were killed."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from endpointlens.sources import offset_log as ol
from endpointlens.streaming import tables

SHAPE = "host string, ts long"


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "log")


def append(spark, root, rows):
    df = spark.createDataFrame(rows, "p int, host string, ts long")
    ol.append_log(df.select("host", "ts", "p"), root, F.col("p"), ["ts"])


def run(stream, folder, rows):
    """Runs until all is read; returns the rows of every batch."""
    batches = []
    query = stream.writeStream.foreachBatch(
        lambda batch, n: batches.append([tuple(r) for r in batch.collect()])).option(
        "checkpointLocation", f"{folder}/checkpoint").start()
    query.processAllAvailable()
    query.stop()
    rows.extend(r for b in batches for r in b)
    return [len(b) for b in batches if b]


def test_offsets_count_without_gaps_over_appends(spark, root):
    append(spark, root, [(0, "a", t) for t in range(40)] + [(7, "b", t) for t in range(3)])
    append(spark, root, [])
    append(spark, root, [(7, "b", 10 + t) for t in range(5)] + [(2, None, None)])
    parts = ol.segments(root)
    assert ol.log_ends(parts) == {"0": 40, "7": 8, "2": 1}
    seen = tables.run_batches(ol.log_stream(spark, root, SHAPE)).collect()
    for p, n in ((0, 40), (7, 8), (2, 1)):
        assert [r.offset for r in sorted((r for r in seen if r.partition == p), key=lambda r: r.offset)] == list(range(n))
    assert [r.ts for r in sorted(seen) if r.partition == 7] == [0, 1, 2, 10, 11, 12, 13, 14]
    assert [(r.host, r.ts) for r in seen if r.partition == 2] == [(None, None)]


def test_what_no_index_names_is_not_read(spark, root):
    append(spark, root, [(0, "a", 1)])
    append(spark, root, [(0, "lost", 2)])
    os.remove(f"{root}/index/{1:0{ol.DIGITS}d}")  # killed before its index file
    append(spark, root, [(0, "b", 3)])
    seen = tables.run_batches(ol.log_stream(spark, root, SHAPE)).collect()
    assert sorted((r.offset, r.host) for r in seen) == [(0, "a"), (1, "b")]


def test_batches_are_bounded_and_a_hot_partition_leaves_room_for_others(spark, root, tmp_path):
    append(spark, root, [(0, "hot", t) for t in range(90)] + [(1, "b", t) for t in range(10)])
    rows = []
    sizes = run(ol.log_stream(spark, root, SHAPE, 30), tmp_path, rows)
    assert sizes == [30, 30, 30, 10] and len(set(rows)) == 100
    assert Counter(r[0] for r in rows[:30]) == {0: 20, 1: 10}


def test_every_restart_goes_on_where_the_checkpoint_ends(spark, root, tmp_path):
    append(spark, root, [(p, "h", t) for p in range(3) for t in range(20)])
    rows = []
    assert run(ol.log_stream(spark, root, SHAPE, 25), tmp_path, rows) == [25, 25, 10]
    assert run(ol.log_stream(spark, root, SHAPE, 25), tmp_path, rows) == []
    append(spark, root, [(1, "late", 100 + t) for t in range(30)])
    assert run(ol.log_stream(spark, root, SHAPE, 25), tmp_path, rows) == [25, 5]
    append(spark, root, [(4, "new", t) for t in range(30)])
    assert run(ol.log_stream(spark, root, SHAPE), tmp_path, rows) == [30]  # without a bound
    assert len(rows) == len({r[:2] for r in rows}) == 120


def test_a_failed_batch_is_read_again_with_the_same_rows(spark, root, tmp_path):
    append(spark, root, [(0, "h", t) for t in range(20)])
    tried = []

    def fail(batch, n):
        tried.append((n, sorted(r.offset for r in batch.collect())))
        if n == 1:
            raise RuntimeError("lost")

    stream = ol.log_stream(spark, root, SHAPE, 8)
    query = stream.writeStream.foreachBatch(fail).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    with pytest.raises(Exception, match="lost"):
        query.processAllAvailable()
    rows = []
    assert run(ol.log_stream(spark, root, SHAPE, 8), tmp_path, rows) == [8, 4]
    assert tried == [(0, list(range(8))), (1, list(range(8, 16)))] and sorted(r[1] for r in rows) == list(range(8, 20))


def test_a_reader_that_starts_again_is_told_where_it_is(root, spark):
    append(spark, root, [(0, "h", t) for t in range(20)])
    schema = spark.createDataFrame([], f"partition int, offset long, {SHAPE}").schema
    reader = ol.LogReader(schema, {"path": root, "rows_per_batch": "8"})
    assert reader.latestOffset() == {"0": 8} == reader.latestOffset()
    assert reader.partitions({"0": 16}, {"0": 16}) == [] and reader.latestOffset() == {"0": 20}
    with pytest.raises(ValueError, match="before"):
        reader.partitions({"0": 16}, {"0": 8})


def test_a_replay_starts_at_offsets_even_beyond_the_end(spark, root):
    append(spark, root, [(p, "h", t) for p in range(2) for t in range(10)])
    seen = tables.run_batches(ol.log_stream(spark, root, SHAPE, starting_offsets={0: 7, 1: 15})).collect()
    assert sorted((r.partition, r.offset) for r in seen) == [(0, 7), (0, 8), (0, 9)]
    append(spark, root, [(1, "h", 100 + t) for t in range(8)])
    seen = tables.run_batches(ol.log_stream(spark, root, SHAPE, starting_offsets={0: 10, 1: 15})).collect()
    assert sorted((r.partition, r.offset) for r in seen) == [(1, 15), (1, 16), (1, 17)]


def test_a_null_partition_is_an_error(spark, root):
    with pytest.raises(Exception, match="null partition"):
        append(spark, root, [(None, "h", 1)])
