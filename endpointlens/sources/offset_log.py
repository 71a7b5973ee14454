"""A log of events in numbered partitions with offsets, and a streaming source that reads it.

A log is a folder of Parquet segments and an index. Every row has a `partition` and an `offset`, which
counts from 0 without gaps inside its partition. An append writes its segments first and names them in
one index file last, so readers see an append as a whole or not at all; what a killed append leaves
is named nowhere. There is one writer at a time.

The source is `LogSource`, format `offset_log`. Its offsets are {partition: next offset to read}. A
micro-batch takes at most `rows_per_batch` rows, shared among the partitions that have any, and is read
by one task for each segment file it touches, so a partition with most of the rows is read by many.

Spark asks for the end of a batch without telling its start, but it asks for the partitions of every batch
and, after a restart, for those of the last known end; so the reader knows where it is and keeps no state of
its own. Runs triggered by `availableNow` ask for one end only; they must do without `rows_per_batch`.

Nulls in any column are kept. Null partitions are an error. Equal rows are separate rows of the log. An
empty append adds nothing. Columns named `partition` and `offset` belong to the log.
"""

import json
import uuid

from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import remove_folder, shared_folder

#: Digits of an index file's number, so that names sort.
DIGITS = 12


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _put(path: str, text: str) -> None:
    """A small file that is there as a whole or not at all."""
    files, path = _place(path)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(text.encode())
    files.move(draft, path)


def _get(path: str) -> str:
    files, path = _place(path)
    with files.open_input_stream(path) as source:
        return source.read().decode()


def _index_files(root: str) -> list[str]:
    files, path = _place(f"{root}/index")
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if not f.base_name.startswith("."))


def segments(root: str, known: dict[str, list] | None = None) -> list[dict]:
    """Segments of all finished appends: partition, base (first offset), rows, file (below `root`).
    `known` keeps what was read before, as index files never change."""
    known = {} if known is None else known
    for name in _index_files(root):
        if name not in known:
            known[name] = json.loads(_get(f"{root}/index/{name}"))
    return [s for name in sorted(known) for s in known[name]]


def log_ends(parts: list[dict]) -> dict[str, int]:
    """Partition -> offset after its last row."""
    ends = {}
    for s in parts:
        key = str(s["partition"])
        ends[key] = max(ends.get(key, 0), s["base"] + s["rows"])
    return ends


def append_log(rows: DataFrame, root: str, partition: Column, order: list[str]) -> None:
    """Appends `rows`, numbered within each partition by `order`, which should have no ties.

    Rows are dealt out by ranges of (partition, order), so a hot partition is written by many tasks.
    Only one row a segment reaches the driver.
    """
    spark = rows.sparkSession
    staged = f"{shared_folder(spark)}/endpointlens/log-drafts/{uuid.uuid4().hex}"
    keyed = rows.withColumn("partition", F.when(partition.isNull(), F.raise_error(F.lit("null partition")))
                            .otherwise(partition.cast("int")))
    dealt = (keyed.repartitionByRange("partition", *order).sortWithinPartitions("partition", *order)
             .withColumn("_piece", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    dealt.write.parquet(staged)
    held = spark.read.schema(dealt.schema).parquet(staged)
    if held.isEmpty():
        remove_folder(spark, staged)
        return
    counts = held.groupBy("partition", "_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("rows"))
    before = Window.partitionBy("partition").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.withColumn("_base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    ends = log_ends(segments(root))
    if ends:
        old = F.create_map(*[F.lit(x) for p, end in ends.items() for x in (int(p), end)])
        based = based.withColumn("_base", F.col("_base") + F.coalesce(F.try_element_at(old, F.col("partition")), F.lit(0)))
    folder = f"segments/{uuid.uuid4().hex}"
    (held.join(based.drop("rows"), ["partition", "_piece"])
     .withColumn("offset", F.col("_base") + F.col("_at") - F.col("_first")).drop("_piece", "_at", "_first", "_base")
     # A segment is the rows of one partition that one task holds; tasks again hold ranges.
     .repartitionByRange("partition", "offset").sortWithinPartitions("partition", "offset")
     .withColumn("_p", F.col("partition")).write.partitionBy("_p").parquet(f"{root}/{folder}"))
    written = spark.read.schema("partition int, offset long").parquet(f"{root}/{folder}")
    found = (written.groupBy("partition", F.col("_metadata.file_path").alias("file"))
             .agg(F.min("offset").alias("base"), F.count("*").alias("rows")).orderBy("partition", "base").collect())
    listed = [{**r.asDict(), "file": folder + r["file"].split(folder, 1)[1]} for r in found]
    _put(f"{root}/index/{len(_index_files(root)):0{DIGITS}d}", json.dumps(listed))
    remove_folder(spark, staged)


class Piece(InputPartition):
    """Offsets from `low` up to, not including, `high` of one segment file."""

    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class LogReader(DataSourceStreamReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.root, self.most = options["path"], int(options.get("rows_per_batch") or 0)
        self.first = {str(k): int(v) for k, v in json.loads(options.get("starting_offsets") or "{}").items()}
        self.known, self.at = {}, self.first

    def initialOffset(self) -> dict:
        return self.first

    def _next(self, at: dict, ends: dict) -> dict:
        """The end of a batch that starts at `at`: partitions share what a batch may take evenly, and
        those with fewer rows leave the rest to others."""
        open_ = {p: end - at.get(p, 0) for p, end in ends.items() if end > at.get(p, 0)}
        end, left = dict(at), self.most
        for place, (p, rows) in enumerate(sorted(open_.items(), key=lambda kv: (kv[1], kv[0]))):
            taken = min(rows, -(-left // (len(open_) - place))) if self.most else rows
            end[p], left = at.get(p, 0) + taken, left - taken
        return end

    def latestOffset(self) -> dict:
        ends = log_ends(segments(self.root, self.known))
        if self.most:
            return self._next(self.at, ends)
        return {p: max(ends.get(p, 0), self.first.get(p, 0)) for p in {*ends, *self.first}}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if any(end.get(p, 0) < at for p, at in start.items()):
            raise ValueError(f"the log ends at {end}, before {start}")
        self.at = dict(end)
        pieces = []
        for s in segments(self.root, self.known):
            p = str(s["partition"])
            low = max(start.get(p, self.first.get(p, 0)), s["base"])
            high = min(end.get(p, 0), s["base"] + s["rows"])
            if low < high:
                pieces.append(Piece(f"{self.root}/{s['file']}", low, high))
        return pieces

    def read(self, partition: Piece):
        files, path = _place(partition.path)
        asked = (dataset.field("offset") >= partition.low) & (dataset.field("offset") < partition.high)
        for batch in dataset.dataset(path, format="parquet", filesystem=files).to_batches(columns=self.names, filter=asked):
            if batch.num_rows:
                yield batch

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """Options: path; rows_per_batch; starting_offsets as JSON {partition: offset}."""

    @classmethod
    def name(cls) -> str:
        return "offset_log"

    def streamReader(self, schema) -> LogReader:
        return LogReader(schema, self.options)


def log_stream(spark: SparkSession, root: str, schema: str, rows_per_batch: int | None = None,
               starting_offsets: dict[int, int] | None = None) -> DataFrame:
    """Rows of a log with `partition` and `offset`; `schema` names the other columns as DDL."""
    spark.dataSource.register(LogSource)
    reader = spark.readStream.format("offset_log").schema(f"partition int, offset long, {schema}").option("path", root)
    if rows_per_batch:
        reader = reader.option("rows_per_batch", rows_per_batch)
    if starting_offsets:
        reader = reader.option("starting_offsets", json.dumps(starting_offsets))
    return reader.load()
