"""macOS endpoint-security NDJSON -> events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cmdline import basename_posix, is_interpreter_posix, posix_cmdline
from ..functions.paths import under_watch_posix
from ..functions.text import nz
from . import typed

_FILE = T.StructType([T.StructField("path", T.StringType())])
_PROCESS = T.StructType([
    T.StructField("executable", _FILE),
    T.StructField("audit_token", T.StructType([T.StructField("pid", T.IntegerType())])),
    T.StructField("ppid", T.IntegerType()),
])
_DESTINATION = T.StructType([
    T.StructField("existing_file", _FILE),
    T.StructField("new_path", T.StructType([
        T.StructField("dir", _FILE), T.StructField("filename", T.StringType())])),
])
LINE = T.StructType([
    T.StructField("time", T.StringType()),
    T.StructField("process", _PROCESS),
    T.StructField("event", T.StructType([
        T.StructField("exec", T.StructType([
            T.StructField("args", T.ArrayType(T.StringType())),
            T.StructField("target", _PROCESS)])),
        T.StructField("create", T.StructType([T.StructField("destination", _DESTINATION)])),
        T.StructField("rename", T.StructType([
            T.StructField("source", _FILE), T.StructField("destination", _DESTINATION)])),
        T.StructField("unlink", T.StructType([T.StructField("target", _FILE)])),
    ])),
])


def _destination_paths(d: Column) -> Column:
    existing = d["existing_file"]["path"]
    folder, name = d["new_path"]["dir"]["path"], d["new_path"]["filename"]
    joined = F.regexp_replace(F.concat_ws("/", folder, name), "/+", "/")
    return F.array(F.when(existing != "", existing),
                   F.when((folder != "") & (name != ""), joined))


def parse_lines(lines: DataFrame, watch_paths: list[str], now: int, value: str = "value"
                ) -> DataFrame:
    """Events of the readable lines; other kinds and unwatched files drop out.

    Keeps the other input columns (`host` among them). Line times that cannot be read become
    `now`.
    """
    keep = [c for c in lines.columns if c != value]
    rows = lines.select(*keep, F.from_json(value, LINE).alias("l")).where(F.col("l").isNotNull())
    event = F.col("l.event")
    run, made, moved, gone = (event[k] for k in ("exec", "create", "rename", "unlink"))
    exe = run["target"]["executable"]["path"]
    candidates = (F.when(made.isNotNull(), _destination_paths(made["destination"]))
                  .when(moved.isNotNull(), F.concat(_destination_paths(moved["destination"]),
                                                    F.array(moved["source"]["path"])))
                  .when(gone.isNotNull(), F.array(gone["target"]["path"])))
    watched = F.get(F.filter(candidates, lambda p: p.isNotNull() & under_watch_posix(
        p, watch_paths)), F.lit(0))
    action = (F.when(made.isNotNull(), "CREATE").when(moved.isNotNull(), "RENAME")
              .otherwise("DELETE"))
    ts = F.coalesce(F.unix_millis(F.try_to_timestamp("l.time")), F.lit(now)).alias("ts")
    blank = F.lit("")
    execs = rows.where(run.isNotNull() & (nz(exe) != "")).select(
        *keep, ts, *typed.execution(
            is_interpreter_posix(exe), exe, posix_cmdline(exe, run["args"]),
            basename_posix(F.col("l.process.executable.path")),
            run["target"]["audit_token"]["pid"], run["target"]["ppid"], blank))
    files = rows.where(run.isNull()).withColumn("_path", watched).where(
        F.col("_path").isNotNull()).select(
        *keep, ts, *typed.file(F.col("_path"), action, blank))
    return execs.unionByName(files)
