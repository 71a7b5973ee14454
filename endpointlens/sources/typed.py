"""Event constructors: which columns and detail keys each event type carries."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import basename, nz


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def encode_detail(**fields: Column) -> Column:
    """JSON of the observed fields in name order; empty text when nothing was observed."""
    body = F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]))
    return F.when(body == "{}", F.lit("")).otherwise(body)


def _event(type_: Column, **columns: Column) -> list[Column]:
    blank = F.lit("")
    base = {"process": blank, "parent": blank, "cmdline": blank, "dest_ip": blank,
            "dest_port": F.lit(0), "domain": blank, "detail": blank, "sha256": blank}
    base.update(columns)
    return [type_.alias("type")] + [nz(c).alias(n) if n != "dest_port" else
                                    F.coalesce(c, F.lit(0)).cast("int").alias(n)
                                    for n, c in base.items()]


def execution(script: Column, path: Column, cmdline: Column, parent: Column, pid: Column,
              ppid: Column, sha256: Column) -> list[Column]:
    return _event(F.when(script, F.lit("script")).otherwise(F.lit("process")),
                  process=basename(path), parent=parent, cmdline=cmdline, sha256=sha256,
                  detail=encode_detail(pid=_positive(pid), ppid=_positive(ppid)))


def network(path: Column, pid: Column, protocol: Column, dest_ip: Column, dest_port: Column
            ) -> list[Column]:
    return _event(F.lit("network"), process=basename(path), dest_ip=dest_ip, dest_port=dest_port,
                  detail=encode_detail(pid=_positive(pid), protocol=_filled(protocol)))


def file(path: Column, action: Column, sha256: Column) -> list[Column]:
    return _event(F.lit("file"), process=basename(path), cmdline=path, sha256=sha256,
                  detail=encode_detail(action=_filled(action)))


def dns(path: Column, pid: Column, protocol: Column, domain: Column, query_type: Column,
        answers: Column, status: Column) -> list[Column]:
    return _event(F.lit("dns"), process=basename(path), domain=domain, detail=encode_detail(
        answers=F.when(F.size(answers) > 0, answers), pid=_positive(pid),
        protocol=_filled(protocol), queryType=_filled(query_type), status=status))


def l7(path: Column, protocol: Column, domain: Column, dest_ip: Column, dest_port: Column,
       **detail: Column) -> list[Column]:
    return _event(F.lit("l7"), process=basename(path), domain=domain, dest_ip=dest_ip,
                  dest_port=dest_port,
                  detail=encode_detail(**detail, protocol=_filled(protocol)))
