"""Decoded DNS / TLS / HTTP metadata -> dns and l7 events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nz
from ..operators.flows import flow_owners
from . import typed


def metadata_events(meta: DataFrame, flows: DataFrame) -> DataFrame:
    """Keeps DNS responses, TLS greetings with a server name, HTTP requests with a host and all
    HTTP responses. Owners come from flows remembered up to a minute; responses have none.

    `meta`: tenant_id, host, ts, seq, kind, is_response, domain, local_port, remote_ip, remote_port,
    query_type, answers, tls_version, alpn, method, path, user_agent, status_code.
    """
    keep = ["tenant_id", "host", "ts", "seq"]
    blank = F.lit("")

    def filled(name):
        return F.when(F.col(name) != "", F.col(name))

    dns = meta.where((F.col("kind") == "dns") & F.col("is_response")).select(
        *keep, *typed.dns(blank, F.lit(0), F.lit("udp"), F.col("domain"), F.col("query_type"),
                          F.col("answers"), F.lit(None).cast("int")))
    tls = F.col("kind") == "tls"
    wanted = (tls & (nz(F.col("domain")) != "")) | (
        (F.col("kind") == "http") & (F.col("is_response") | (nz(F.col("domain")) != "")))
    owned = flow_owners(meta.where(wanted), flows)
    owner = F.when(tls | ~F.col("is_response"), nz(F.col("owner_path"))).otherwise(blank)
    http = F.col("kind") == "http"
    l7 = owned.select(*keep, *typed.l7(
        owner, F.lit("tcp"), nz(F.col("domain")), F.col("remote_ip"), F.col("remote_port"),
        alpn=F.when(tls & (F.size("alpn") > 0), F.col("alpn")),
        httpMethod=F.when(http, filled("method")), httpPath=F.when(http, filled("path")),
        httpStatusCode=F.when(http & (F.col("status_code") > 0), F.col("status_code")),
        httpUserAgent=F.when(http, filled("user_agent")),
        l7Protocol=F.when(tls, "TLS").otherwise("HTTP"),
        tlsVersion=F.when(tls, filled("tls_version"))))
    return dns.unionByName(l7)
