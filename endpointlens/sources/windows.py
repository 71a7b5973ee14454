"""Windows provider telemetry (provider, event id, property map) -> events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cmdline import is_interpreter_windows, redact_windows, with_argv0
from ..functions.dns import is_reverse_name, normalize_domain, parse_answers, query_type_label
from ..functions.net import is_public_ip, port, positive_int
from ..functions.paths import under_watch_windows
from ..functions.text import basename, has_separator, jtrim, nz
from ..operators.flows import process_names
from . import typed

# Event ids per provider.
PROCESS_START, PROCESS_STOP = 1, 2
TCP_CONNECT = (12, 28)
FILE_CREATE = 30
DNS_COMPLETED = 3008


def prop(props: Column, key: str) -> Column:
    """Trimmed property: exact key first, then any spelling; missing is empty."""
    loose = F.get(F.map_values(F.map_filter(props, lambda k, v: F.lower(k) == key.lower())),
                  F.lit(0))
    return nz(jtrim(F.coalesce(F.try_element_at(props, F.lit(key)), loose)))


def _kind() -> Column:
    """The provider decides first: event ids overlap between providers."""
    p, i = F.col("provider"), F.col("event_id")
    return (F.when((p == "process") & (i == PROCESS_START), "process")
            .when((p == "network") & i.isin(*TCP_CONNECT), "network")
            .when((p == "file") & (i == FILE_CREATE), "file")
            .when((p == "dns") & (i == DNS_COMPLETED), "dns"))


def process_starts(raw: DataFrame) -> DataFrame:
    """(tenant_id, host, ts, seq, pid, path) of every process start, for naming pids later."""
    props = F.col("props")
    path = F.coalesce(F.nullif(prop(props, "ImagePath"), F.lit("")), prop(props, "ImageName"))
    return raw.where((F.col("provider") == "process") & (F.col("event_id") == PROCESS_START)
                     ).select("tenant_id", "host", "ts", "seq", positive_int(prop(props, "ProcessID"))
                              .alias("pid"), path.alias("path"))


def stop_count(raw: DataFrame) -> DataFrame:
    """Process ends are counted, not emitted."""
    return raw.where((F.col("provider") == "process") & (F.col("event_id") == PROCESS_STOP)
                     ).groupBy("tenant_id", "host").agg(F.count("*").alias("stops"))


def parse_records(raw: DataFrame, watch_paths: list[str]) -> DataFrame:
    """Events of one table (tenant_id, host, ts, seq, provider, event_id, header_pid, props).

    Rows that give no event leave before the shuffle. One as-of lookup then names the parent of
    a start and the owner of a connection or query, and one projection builds all kinds.
    """
    props = F.col("props")
    def of(kind: str, value: Column) -> Column:
        """Only rows of the kind are searched for its properties."""
        return F.when(_kind() == kind, value)

    fields = {
        "kind": _kind(),
        "exe": of("process", F.coalesce(F.nullif(prop(props, "ImagePath"), F.lit("")), prop(props, "ImageName"))),
        "line": of("process", prop(props, "CommandLine")),
        "own_pid": of("process", positive_int(prop(props, "ProcessID"))),
        "dest": of("network", prop(props, "daddr")), "dport": of("network", port(prop(props, "dport"))),
        "file": of("file", prop(props, "FileName")),
        "domain": of("dns", normalize_domain(prop(props, "QueryName"))),
        "query_type": of("dns", query_type_label(prop(props, "QueryType"))),
        "answers": of("dns", parse_answers(prop(props, "QueryResults"))),
        "status": of("dns", prop(props, "QueryStatus")),
        "pid": F.when(_kind() == "process", positive_int(prop(props, "ParentProcessID")))
        .when(_kind() == "network", positive_int(prop(props, "PID")))
        .when((_kind() == "dns") & (F.col("header_pid") > 0), F.col("header_pid")),
    }
    keep = ["tenant_id", "host", "ts", "seq"]
    c = {name: F.col(name) for name in fields}
    gives_event = (F.when(c["kind"] == "process", c["exe"] != "")
                   .when(c["kind"] == "network", is_public_ip(c["dest"]))
                   .when(c["kind"] == "file", (c["file"] != "") & under_watch_windows(
                       c["file"], watch_paths))
                   .when(c["kind"] == "dns", (c["domain"] != "") & ~is_reverse_name(c["domain"])))
    rows = raw.select(*keep, *[v.alias(k) for k, v in fields.items()]).where(gives_event)
    named = process_names(rows, process_starts(raw))

    owner, blank = nz(F.col("pid_path")), F.lit("")
    full = (F.when(c["line"] != "", with_argv0(c["line"], c["exe"]))
            .when(has_separator(c["exe"]), c["exe"]).otherwise(blank))
    status = F.when(c["status"].rlike("^[+-]?[0-9]+$"), c["status"].try_cast("int"))
    event = (
        F.when(c["kind"] == "process", F.struct(*typed.execution(
            is_interpreter_windows(c["exe"]), c["exe"], redact_windows(full), basename(owner),
            c["own_pid"], c["pid"], blank)))
        .when(c["kind"] == "network", F.struct(*typed.network(
            owner, c["pid"], F.lit("tcp"), c["dest"], c["dport"])))
        .when(c["kind"] == "file", F.struct(*typed.file(c["file"], F.lit("CREATE"), blank)))
        .otherwise(F.struct(*typed.dns(owner, c["pid"], blank, c["domain"], c["query_type"],
                                       c["answers"], status))))
    return named.select(*keep, event.alias("e")).select(*keep, "e.*")
