"""Domain/IP correlation: DNS process back-fill and the relation graph."""

import ipaddress
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detail import parse_detail
from ..functions.net import canonical_ip, is_ip
from ..functions.text import is_blank, jtrim, nz
from ..schema import BACKFILL_AFTER_MS, BACKFILL_BEFORE_MS, CONNECT_TYPES
from .asof import asof_lookup

SEED_TYPES = ("dns", "network", "l7")
PLACE = ["tenant_id", "host"]


def parse_target(raw: str | None) -> tuple[str, str]:
    """(kind, value) of what a caller asks about: an address first, else a domain."""
    text = (raw or "").strip()
    try:
        address = ipaddress.ip_address(text)
        return "IP", str(getattr(address, "ipv4_mapped", None) or address)
    except ValueError:
        pass
    domain = text.lower().rstrip(".")
    label = r"[^\W_](?:[\w-]{0,61}[^\W])?|\w"
    if not domain or len(domain) > 253 or not re.fullmatch(
            rf"(?:(?:{label})\.)*(?:{label})", domain) or domain.split(".")[-1][0].isdigit():
        raise ValueError(f"neither a domain nor an address: {raw}")
    return "DOMAIN", domain


_LABEL = r"(?:[\p{L}\p{N}](?:[\w-]{0,61}\w)?|\w)"


def parsed_targets(asked: DataFrame, raw: str = "raw") -> DataFrame:
    """(kind, value) of all that callers ask about, each once, by the rule of `parse_target`; what is
    neither an address nor a domain drops out."""
    text = jtrim(nz(F.col(raw)))
    address, domain = canonical_ip(text), F.regexp_replace(F.lower(text), r"\.+$", "")
    named = (domain.rlike(rf"(?U)^(?:{_LABEL}\.)*{_LABEL}$") & (F.char_length(domain) <= 253)
             & ~domain.rlike(r"(?U)(?:^|\.)\d[^.]*$"))
    return (asked.select(F.when(address.isNotNull(), F.struct(F.lit("IP").alias("kind"), address.alias("value")))
                         .when(named, F.struct(F.lit("DOMAIN").alias("kind"), domain.alias("value"))).alias("t"))
            .where("t IS NOT NULL").select("t.*").distinct())


def events_of_seeds(events: DataFrame, seeds: DataFrame) -> DataFrame:
    """Events by each of the seeds (kind, value; each once) that they mention: a domain, or an address as
    destination or DNS answer. One equality join, however many seeds there are."""
    def said(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    answers = F.coalesce(parse_detail(F.col("detail"))["answers"], F.array().cast("array<string>"))
    mentions = F.concat(said("DOMAIN", F.array("domain")), said("IP", F.array_distinct(F.concat(F.array("dest_ip"), answers))))
    rows = events.where(F.col("type").isin(*SEED_TYPES)).withColumn("m", F.explode(mentions)).where("m.value <> ''")
    return rows.select("*", "m.kind", "m.value").drop("m").join(seeds, ["kind", "value"])


def seed_events(events: DataFrame, kind: str, value: str) -> DataFrame:
    """Events that mention a domain, or an address as destination or DNS answer."""
    rows = events.where(F.col("type").isin(*SEED_TYPES))
    if kind == "DOMAIN":
        return rows.where(F.col("domain") == value)
    answers = parse_detail(F.col("detail"))["answers"]
    listed = F.coalesce(F.array_contains(answers, value), F.lit(False))
    return rows.where((F.col("dest_ip") == value) | listed)


def backfill(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Events plus `inferred_process` and `basis` for DNS rows that lack a process.

    The closest connection of the same host to one of the answers, from one second before to
    thirty seconds after; at equal distance the earlier one.
    """
    answers = parse_detail(F.col("detail"))["answers"]
    needs = (F.col("type") == "dns") & is_blank(F.col("process")) & (F.size(answers) > 0)
    asked = (events.where(F.coalesce(needs, F.lit(False)))
             .select(*PLACE, "ts", "seq", F.explode(F.array_distinct(answers)).alias("ip")))
    connects = candidates.where(
        F.col("type").isin(*CONNECT_TYPES) & ~is_blank(F.col("process"))).select(
        *PLACE, "ts", "seq", "type", "process", F.col("dest_ip").alias("ip"))
    found = asof_lookup(asked, connects, [*PLACE, "ip"], back=BACKFILL_BEFORE_MS,
                        ahead=BACKFILL_AFTER_MS, order=["seq"],
                        payload=["seq", "type", "process"], prefer_last=False, prune=True)
    m = F.col("match")
    cand = F.struct(F.abs(m["ts"] - F.col("ts")).alias("far"), m["ts"].alias("at"),
                    m["seq"].alias("match_seq"), m["type"].alias("type"),
                    m["process"].alias("process"), F.col("ip").alias("ip"))
    best = (asked.join(found, [*PLACE, "ip", "ts"]).groupBy(*PLACE, "seq")
            .agg(F.min(cand).alias("_best")))
    b = F.col("_best")
    # Fixed value: wording of the inference basis.
    basis = F.when(b.isNotNull(), F.concat(
        b["type"], F.lit(" 이벤트 dest_ip="), b["ip"], F.lit(" ts="), b["at"].cast("string")))
    return (events.join(best, [*PLACE, "seq"], "left")
            .withColumn("inferred_process", b["process"]).withColumn("basis", basis)
            .drop("_best"))


def node_id(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), value)


def _edge(from_: Column, to: Column, relation: str, origin: str = "OBSERVED",
          basis: Column | None = None) -> Column:
    return F.struct(from_.alias("from"), to.alias("to"), F.lit(relation).alias("relation"),
                    F.lit(origin).alias("origin"),
                    (F.lit(None).cast("string") if basis is None else basis).alias("basis"))


def observed_edges(correlated: DataFrame, keys: list[str]) -> DataFrame:
    """Relations one event shows; `correlated` comes from `backfill`."""
    domain, ip = F.col("domain"), F.col("dest_ip")
    d, i = node_id("domain", domain), node_id("ip", ip)
    host = node_id("host", F.col("host"))
    proc = node_id("process", F.col("process"))
    guess = node_id("process", F.col("inferred_process"))
    has_domain, has_ip = nz(domain) != "", nz(ip) != ""
    dns = (F.col("type") == "dns") & has_domain
    connect = F.col("type").isin(*CONNECT_TYPES)
    seen = ~is_blank(F.col("process"))
    answers = F.coalesce(parse_detail(F.col("detail"))["answers"],
                         F.array().cast("array<string>"))
    resolved = F.transform(F.filter(answers, lambda a: nz(a) != ""), lambda a: F.when(
        is_ip(a), _edge(d, node_id("ip", a), "RESOLVED_TO")).otherwise(
        _edge(d, node_id("domain", F.lower(a)), "ALIAS_OF")))
    target = F.when(has_domain, d).when(has_ip, i)
    single = F.array(
        F.when(dns, _edge(host, d, "QUERIED")),
        F.when(dns & seen, _edge(proc, d, "QUERIED")),
        F.when(dns & ~seen & F.col("inferred_process").isNotNull(),
               _edge(guess, d, "QUERIED", "INFERRED", F.col("basis"))),
        F.when(connect & has_domain & has_ip, _edge(d, i, "CONNECTED_VIA")),
        F.when(connect & target.isNotNull(), _edge(host, target, "CONNECTED")),
        F.when(connect & target.isNotNull() & seen, _edge(proc, target, "CONNECTED")))
    edges = F.concat(F.filter(single, lambda e: e.isNotNull()),
                     F.when(dns, resolved).otherwise(F.slice(resolved, 1, 0)))
    return correlated.select(*keys, "ts", "seq", F.explode(edges).alias("e")).select(
        *keys, "ts", "seq", "e.*")


def merge_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (from, to, relation, origin): how often, first and last seen."""
    return edges.groupBy(*keys, "from", "to", "relation", "origin").agg(
        F.count("*").alias("observations"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.min_by("basis", F.struct("ts", "seq")).alias("basis"))


def live_edges(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Relations from supplied live lookups: (keys, seed_kind, seed, answer, ok).

    They carry no observation count or times; failed lookups give nothing.
    """
    forward = F.col("seed_kind") == "DOMAIN"
    rows = answers.where("ok").select(
        *keys,
        F.when(forward, node_id("domain", F.col("seed"))).otherwise(
            node_id("ip", F.col("seed"))).alias("from"),
        F.when(forward, node_id("ip", F.col("answer"))).otherwise(
            node_id("ptr_name", F.col("answer"))).alias("to"),
        F.when(forward, "RESOLVED_TO").otherwise("PTR_CANDIDATE").alias("relation"),
        F.lit("LIVE_DNS").alias("origin"))
    none = F.lit(None)
    return rows.distinct().select("*", F.lit(0).cast("long").alias("observations"),
                                  none.cast("long").alias("first_seen"),
                                  none.cast("long").alias("last_seen"),
                                  none.cast("string").alias("basis"))


def graph_nodes(edges: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """Every end of an edge plus the seed itself."""
    ends = edges.select(*keys, F.explode(F.array("from", "to")).alias("node_id"))
    nodes = ends.unionByName(seeds.select(*keys, "node_id")).distinct()
    return nodes.select(*keys, "node_id",
                        F.upper(F.substring_index("node_id", ":", 1)).alias("kind"),
                        F.expr("substring(node_id, locate(':', node_id) + 1)").alias("value"))
