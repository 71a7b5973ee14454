"""Incidents: alerts whose processes are equal or ancestor and descendant.

Alerts hang on the process node of their source event (the anchor). All anchors on one path belong
together, so an anchor's component is named by the topmost anchor above it, and no pairs are ever
listed. Walks up the process tree double their reach every round and carry what they meet, so they
end after a number of rounds that grows with the logarithm of the depth, and on a cycle with that of
the number of processes. Reused process ids can close a cycle; its smallest anchor names the component.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import with_catalog
from ..functions.detail import parse_detail
from ..functions.ids import incident_id, process_node
from ..functions.text import is_blank, severity_rank
from ..schema import LINEAGE_WINDOW_MS, SEVERITIES
from ..session import cut_lineage
from .dedup import first_by
from .source_event import with_source_event

PLACE = ["tenant_id", "host"]

#: Rounds after which the size of the largest host is asked for; walks of 64 processes mostly end before.
SURELY_SHALLOW = 6
#: Joins of small tables that are planned together.
ROUNDS_OF_A_PLAN = 5


def alert_spans(alerts: DataFrame, window: int = LINEAGE_WINDOW_MS) -> DataFrame:
    """Per host: the time its alerts cover, widened on both sides."""
    return alerts.groupBy(*PLACE).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(
        *PLACE, "first_ts", "last_ts",
        F.greatest(F.col("first_ts") - window, F.lit(0).cast("long")).alias("scan_from"),
        (F.col("last_ts") + window).alias("scan_to"))


def events_in_spans(events: DataFrame, alerts: DataFrame) -> DataFrame:
    spans = alert_spans(alerts).select(*PLACE, "scan_from", "scan_to")
    return (events.join(spans, PLACE)
            .where(F.col("ts").between(F.col("scan_from"), F.col("scan_to")))
            .drop("scan_from", "scan_to"))


def node_of_event() -> Column:
    return F.when(F.col("process") != "",
                  process_node(F.col("process"), parse_detail(F.col("detail"))["pid"]))


def process_index(events: DataFrame) -> DataFrame:
    """Node -> parent node; of several observations the latest counts."""
    ppid = parse_detail(F.col("detail"))["ppid"]
    rows = events.where((F.col("process") != "") & (F.col("parent") != "")).select(
        *PLACE, node_of_event().alias("node"), process_node(F.col("parent"), ppid).alias("parent"),
        "ts", "seq")
    return first_by(rows, [*PLACE, "node"], [F.col("ts"), F.col("seq")], newest=True).select(
        *PLACE, "node", "parent")


def anchored_alerts(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts with `anchor` (process node, null when unknown) and `anchor_process`."""
    known = F.col("source").isNotNull() & ~is_blank(F.col("source.process"))
    node = process_node(F.col("source.process"), parse_detail(F.col("source.detail"))["pid"])
    return with_source_event(alerts, events).select(
        *alerts.columns, F.when(known, node).alias("anchor"),
        F.when(known, F.col("source.process")).alias("anchor_process"))


def _most_rounds(nodes: DataFrame) -> int:
    """Doublings after which a walk has seen every node of the largest host."""
    largest = nodes.groupBy(*PLACE).count().agg(F.max("count")).first()[0] or 1
    return math.ceil(math.log2(largest + 1)) + 1


def _doubled(jumps: DataFrame) -> DataFrame:
    """(node, jump) twice as far up; nodes whose walk ends before are left out."""
    far = jumps.select(*PLACE, F.col("node").alias("jump"), F.col("jump").alias("_far"))
    return cut_lineage(jumps.join(far, [*PLACE, "jump"]).select(*PLACE, "node", F.col("_far").alias("jump")))


def ancestor_paths(starts: DataFrame, parents: DataFrame) -> DataFrame:
    """(start, depth, node) up to the root or a repeated node; depth 0 is the start."""
    jumps = cut_lineage(parents.join(starts.select(*PLACE).distinct(), PLACE, "left_semi")
                        .select(*PLACE, "node", F.col("parent").alias("jump")))
    paths = cut_lineage(starts.select(*PLACE, F.col("node").alias("start"), F.lit(0).alias("depth"), "node").distinct())
    reach, known = 1, paths.count()
    for _ in range(_most_rounds(jumps)):
        further = paths.join(jumps, [*PLACE, "node"]).select(
            *PLACE, "start", (F.col("depth") + reach).alias("depth"), F.col("jump").alias("node"))
        # On a cycle a node comes again; its first place counts.
        paths = cut_lineage(paths.unionByName(further).groupBy(*PLACE, "start", "node").agg(F.min("depth").alias("depth")))
        before, known = known, paths.count()
        if known == before:
            break
        jumps, reach = _doubled(jumps), 2 * reach
    return paths.select(*PLACE, "start", "depth", "node")


def anchor_walks(anchors: DataFrame, parents: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(found, steps). `found` has a row for each anchor: node, up (nearest anchored proper ancestor, null
    if none or the node itself) and component. `steps` are the tables (node, jump) of the walks of
    1, 2, 4, ... processes that meet no anchor.

    A walk carries `up`, the first anchor above its start, `top`, the last one, and `low`, the smallest
    from its start to before its end. Walk and continuation are put together by one join a round.
    """
    marked = anchors.select(*PLACE, F.col("node").alias("parent"), F.col("node").alias("up"))
    own = anchors.select(*PLACE, "node", F.col("node").alias("low"))
    walks = cut_lineage(
        parents.join(anchors.select(*PLACE).distinct(), PLACE, "left_semi")
        .join(marked, [*PLACE, "parent"], "left").join(own, [*PLACE, "node"], "left")
        .select(*PLACE, "node", F.col("parent").alias("jump"), "up", F.col("up").alias("top"), "low"))
    steps, rounds, most = [], 0, None
    while True:
        steps.append(walks.where("jump IS NOT NULL AND up IS NULL").select(*PLACE, "node", "jump"))
        if walks.where("jump IS NOT NULL").join(anchors, [*PLACE, "node"], "left_semi").isEmpty():
            break
        if rounds >= SURELY_SHALLOW:
            most = most or _most_rounds(walks)
            if rounds >= most:
                break
        far = walks.select(*PLACE, F.col("node").alias("jump"), F.col("jump").alias("_jump"),
                           F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("low").alias("_low"))
        walks = cut_lineage(walks.join(far, [*PLACE, "jump"], "left").select(
            *PLACE, "node", F.col("_jump").alias("jump"), F.coalesce("up", "_up").alias("up"),
            F.coalesce("_top", "top").alias("top"), F.least("low", "_low").alias("low")))
        rounds += 1
    # A walk that is not over ends on a cycle, all of which the walk from there has seen.
    ends = walks.select(*PLACE, F.col("node").alias("jump"), F.col("low").alias("_ring"))
    found = (anchors.join(walks.drop("low"), [*PLACE, "node"], "left").join(ends, [*PLACE, "jump"], "left")
             .select(*PLACE, "node", F.when(F.col("up") != F.col("node"), F.col("up")).alias("up"),
                     F.coalesce("_ring", "top", "node").alias("component")))
    return found, steps


def nodes_between(links: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(node, up): processes strictly between an anchor and its nearest anchored ancestor.

    The steps of 1, 2, 4, ... are added up from the anchors on; each table is read once.
    """
    way = links.join(steps[0], [*PLACE, "node"]).select(*PLACE, F.col("jump").alias("node"), "up").distinct()
    for number, step in enumerate(steps):
        both = F.explode(F.array_compact(F.array("node", "jump")))
        way = way.join(step, [*PLACE, "node"], "left").select(*PLACE, both.alias("node"), "up").distinct()
        if number % ROUNDS_OF_A_PLAN == ROUNDS_OF_A_PLAN - 1:
            way = cut_lineage(way)
    return way


def group_alerts(alerts: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, chain): alerts with their incident, and the process nodes of each incident."""
    anchored = cut_lineage(anchored_alerts(alerts, events))
    anchors = anchored.where(F.col("anchor").isNotNull()).select(
        *PLACE, F.col("anchor").alias("node")).distinct()
    parents = process_index(events_in_spans(events, alerts))
    found, steps = anchor_walks(anchors, parents)
    found = cut_lineage(found)
    way = nodes_between(found.where("up IS NOT NULL").select(*PLACE, "node", "up"), steps)
    members = (anchored.withColumn("node", F.col("anchor"))
               .join(found.withColumn("below", F.when(F.col("up").isNotNull(), True)).drop("up"),
                     [*PLACE, "node"], "left")
               .withColumn("_group", F.coalesce(F.concat(F.lit("a:"), "component"),
                                                F.concat(F.lit("s:"), "id")))
               .drop("node", "component"))
    heads = members.groupBy(*PLACE, "_group").agg(F.min(F.struct("ts", "id")).alias("_head"))
    heads = heads.select(*PLACE, "_group", incident_id(
        F.col("tenant_id"), F.col("host"), F.col("_head.id")).alias("incident_id"))
    members = cut_lineage(members.join(heads, [*PLACE, "_group"]).drop("_group"))
    owner = members.where(F.col("anchor").isNotNull()).select(
        *PLACE, F.col("anchor").alias("node"), "incident_id").distinct()
    # A node on the way to an anchor belongs to that anchor's incident.
    between = way.join(owner.withColumnRenamed("node", "up"), [*PLACE, "up"]).select(*PLACE, "incident_id", "node")
    chain = owner.select(*PLACE, "incident_id", "node").unionByName(between).distinct()
    return members, chain


def in_time_order(members: DataFrame, field: str, out: str) -> DataFrame:
    """Distinct values of a field per incident in order of first appearance.

    Values are folded per incident first, so the final list is as short as the catalogue.
    """
    firsts = (members.where(~is_blank(F.col(field))).groupBy("incident_id", field)
              .agg(F.min(F.struct("ts", "id")).alias("_at")))
    listed = F.array_sort(F.collect_list(F.struct("_at", field)))
    return firsts.groupBy("incident_id").agg(
        F.transform(listed, lambda s: s[field]).alias(out))


def roll_up(members: DataFrame) -> DataFrame:
    """One row per incident."""
    start = F.when(F.col("anchor").isNotNull(), F.struct(
        F.coalesce("below", F.lit(False)).alias("below"), "ts", "id", "anchor",
        "anchor_process"))
    rank = F.min(severity_rank(F.col("severity")))
    named = F.try_element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (rank + 1).cast("int"))
    # Below the known severities the first one in time order is kept as it is.
    other = F.min_by("severity", F.struct(severity_rank(F.col("severity")), "ts", "id"))
    sums = members.groupBy("tenant_id", "host", "incident_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.coalesce(named, other).alias("severity"), F.count("*").alias("alert_count"),
        F.min(start).alias("_start"))
    named = with_catalog(members) if "threat_name" not in members.columns else members
    return (sums.join(in_time_order(members, "rule_id", "rule_ids"), "incident_id", "left")
            .join(in_time_order(named, "threat_name", "threat_names"), "incident_id", "left")
            .join(in_time_order(members, "mitre", "mitre"), "incident_id", "left")
            .withColumn("start_anchor", F.col("_start.anchor"))
            .withColumn("root_process", F.coalesce("_start.anchor_process", F.lit("")))
            .drop("_start"))


def chain_events(events: DataFrame, members: DataFrame, chain: DataFrame,
                 window: int = LINEAGE_WINDOW_MS) -> DataFrame:
    """Events of an incident's process chain around its alerts. A node has one incident."""
    spans = members.groupBy("incident_id").agg(
        F.greatest(F.min("ts") - window, F.lit(0)).alias("_from"),
        (F.max("ts") + window).alias("_to"))
    asked = chain.join(spans, "incident_id")
    return (events.withColumn("node", node_of_event())
            .join(asked, [*PLACE, "node"])
            .where(F.col("ts").between(F.col("_from"), F.col("_to")))
            .drop("_from", "_to"))
