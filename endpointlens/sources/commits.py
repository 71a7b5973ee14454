"""Tables whose readers see finished commits only: appends by micro-batch, compaction, retention.

Rows lie in `data/write=<id>/event_date=<day>/`. Each commit is one file of `log/`, put there by a
rename that fails if its number is taken, so it happens as a whole or not at all. It says which
(write, day) folders are live from then on and which are not. A batch that was killed before its
commit leaves a folder nobody reads; one that is repeated after it does nothing.

The log holds a row for each folder and stream, none for events, so it stays small: `compact` puts
the writes of a day together, and its commit restates all that is live, so older log files can go.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DAY_MS
from ..scope import day_of
from ..session import remove_folder

#: Live writes of one day from which on `compact` puts them together.
WRITES_PER_DAY = 8

LOG = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("base", T.BooleanType()),
    T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType()),
    T.StructField("write", T.StringType()), T.StructField("event_date", T.StringType()),
    T.StructField("live", T.BooleanType()), T.StructField("rows", T.LongType()),
    T.StructField("oldest", T.LongType()), T.StructField("newest", T.LongType()),
])


class CommitConflict(Exception):
    """Another writer has taken the number of this commit."""


@dataclass(frozen=True)
class CommittedTable:
    """A table below `root` with the columns of `schema` (`event_date` comes from `ts`); `arrival` is
    the column its retention goes by."""

    spark: SparkSession
    root: str
    schema: T.StructType
    arrival: str

    # Log

    def log(self) -> DataFrame:
        """The rows of all commits since the newest that restates the whole table."""
        rows = self.spark.read.schema(LOG).json(f"{self.root}/log")
        base = rows.where("base").agg(F.coalesce(F.max("version"), F.lit(0)).alias("start"))
        return rows.join(F.broadcast(base), F.col("version") >= F.col("start")).drop("start")

    def folders(self) -> DataFrame:
        """The live folders (write, event_date, rows, oldest, newest)."""
        last = self.log().where("write IS NOT NULL").groupBy("write", "event_date").agg(
            F.max(F.struct("version", "live", "rows", "oldest", "newest")).alias("last"))
        return last.where("last.live").select("write", F.col("event_date").cast("date").alias("event_date"),
                                              "last.rows", "last.oldest", "last.newest")

    def versions(self) -> list[int]:
        """Numbers of the log's files, from a listing."""
        place, files = self._files(f"{self.root}/log")
        if not files.exists(place):
            return []
        names = [f.getPath().getName() for f in files.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def last_batch(self, stream: str) -> int:
        """Number of the last micro-batch of a stream that was committed, -1 if none was."""
        if not self.versions():
            return -1
        return self.log().where(F.col("stream") == stream).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    # Commits

    def append(self, rows: DataFrame, batch: int, stream: str = "") -> None:
        """Adds the rows of a micro-batch, unless it or a later one of the stream is in the table."""
        if batch <= self.last_batch(stream):
            return
        added = self.draft(rows)
        self._commit([*added, self._row(stream=stream, batch=batch)])

    def compact(self, writes: int = WRITES_PER_DAY) -> None:
        """Days of `writes` live folders and more get one each; all happens in one commit."""
        folders = self.folders()
        crowded = folders.groupBy("event_date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= writes)
        old = folders.join(crowded, "event_date", "left_semi").collect()
        added = self.draft(self._read(old)) if old else []
        gone = {(r["write"], r["event_date"]) for r in old}
        kept = [self._row(r["write"], r["event_date"], True, r["rows"], r["oldest"], r["newest"])
                for r in folders.collect() if (r["write"], r["event_date"]) not in gone]
        streams = self.log().where("stream IS NOT NULL").groupBy("stream").agg(F.max("batch").alias("batch")).collect()
        self._commit([*kept, *added, *[self._row(stream=r["stream"], batch=r["batch"]) for r in streams]], base=True)

    def expire(self, now: int, days: int) -> None:
        """Drops what arrived before the retention period. Folders older as a whole leave by the commit
        alone, those with rows on both sides are written anew, all others keep their files."""
        cut = now - days * DAY_MS
        old = self.folders().where(F.col("oldest") < cut).collect()
        edge = [r for r in old if r["newest"] >= cut]
        added = self.draft(self._read(edge).where(F.col(self.arrival) >= cut)) if edge else []
        if old:
            self._commit([*[self._row(r["write"], r["event_date"], False) for r in old], *added])

    def sweep(self) -> None:
        """Deletes folders and log files that no reader of the present version needs. Run it when no
        older reader and no append is at work."""
        rows = self.log()
        start = rows.agg(F.min("version")).first()[0]
        live = {(r["write"], str(r["event_date"])) for r in self.folders().collect()}
        place, files = self._files(f"{self.root}/data")
        for write in files.listStatus(place) if files.exists(place) else []:
            name = write.getPath().getName().removeprefix("write=")
            days = [d.getPath() for d in files.listStatus(write.getPath())]
            dead = [d for d in days if (name, d.getName().removeprefix("event_date=")) not in live]
            for path in [write.getPath()] if len(dead) == len(days) else dead:
                remove_folder(self.spark, path.toString())
        for version in self.versions():
            if version < start:
                remove_folder(self.spark, self._log_file(version))

    # Reads

    def read(self) -> DataFrame:
        """All committed rows. Spark prunes the folders by the join, so dead ones are not opened."""
        if not self.versions():
            return self.spark.createDataFrame([], self._stored())
        live = self.folders().select("write", "event_date")
        data = self._data()
        same_day = data["event_date"].eqNullSafe(live["event_date"])
        return data.join(live, (data["write"] == live["write"]) & same_day, "left_semi").select(*self._stored().names)

    # Parts

    def _stored(self) -> T.StructType:
        names = [f for f in self.schema.fields if f.name != "event_date"]
        return T.StructType([*names, T.StructField("event_date", T.DateType())])

    def _data(self) -> DataFrame:
        shape = T.StructType([*self._stored().fields, T.StructField("write", T.StringType())])
        return self.spark.read.schema(shape).parquet(f"{self.root}/data")

    def _read(self, folders: list) -> DataFrame:
        """Rows of the folders named."""
        paths = [f"{self.root}/data/write={r['write']}/event_date={r['event_date'] or '__HIVE_DEFAULT_PARTITION__'}" for r in folders]
        return self.spark.read.schema(self._stored()).option("basePath", f"{self.root}/data").parquet(*paths)

    def draft(self, rows: DataFrame) -> list[dict]:
        """Writes rows that nobody sees yet; the log rows that make them live."""
        write = uuid.uuid4().hex
        path = f"{self.root}/data/write={write}"
        names = [n for n in self._stored().names if n != "event_date"]
        (rows.select(*names).withColumn("event_date", day_of(F.col("ts")))
         .hint("rebalance", "event_date").sortWithinPartitions("event_date", "tenant_id", "host", "ts")
         .write.partitionBy("event_date").parquet(path))
        stored = self.spark.read.schema(self._stored()).parquet(path)
        # Rows without an arrival leave with the oldest.
        arrival = F.coalesce(self.arrival, F.lit(0))
        days = stored.groupBy("event_date").agg(F.count(F.lit(1)).alias("rows"), F.min(arrival).alias("oldest"),
                                                F.max(arrival).alias("newest")).collect()
        return [self._row(write, d["event_date"], True, d["rows"], d["oldest"], d["newest"]) for d in days]

    @staticmethod
    def _row(write=None, event_date=None, live=None, rows=None, oldest=None, newest=None, stream=None, batch=None) -> dict:
        return {"write": write, "event_date": None if event_date is None else str(event_date), "live": live, "rows": rows,
                "oldest": oldest, "newest": newest, "stream": stream, "batch": batch}

    def _log_file(self, version: int) -> str:
        return f"{self.root}/log/{version:012d}.json"

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, rows: list[dict], base: bool = False) -> None:
        """Puts the next log file in its place by a rename that fails if another writer was first."""
        version = max(self.versions(), default=0) + 1
        lines = "".join(json.dumps({"version": version, "base": base, **r}) + "\n" for r in rows)
        jvm = self.spark._jvm
        draft, files = self._files(f"{self.root}/log/_{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(lines.encode())
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(self._log_file(version))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, options)
        except Exception as error:
            files.delete(draft, False)
            if files.exists(final):
                raise CommitConflict(f"version {version} is taken") from error
            raise
