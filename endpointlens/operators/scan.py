"""Ordered folds over one key that never put the whole key into one task."""

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = 65_536


def running_max(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                chunk: int = CHUNK) -> DataFrame:
    """Running maximum of `value` by `order` within `keys`.

    Chunks of the order column are folded on their own; what earlier chunks reached is carried
    over from one maximum per chunk.
    """
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    tops = df.groupBy(*keys, "_chunk").agg(F.max(value).alias("_top"))
    earlier = (Window.partitionBy(*keys).orderBy("_chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = tops.select(*keys, "_chunk", F.max("_top").over(earlier).alias("_carry"))
    within = (Window.partitionBy(*keys, "_chunk").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (df.join(carry, [*keys, "_chunk"])
            .withColumn(out, F.greatest(F.max(value).over(within), "_carry"))
            .drop("_chunk", "_carry"))


# A key that has never passed, or whose last send failed, has no "last".
_NONE = -(1 << 62)


def _passes(ts: list[int], ok: list[bool], window: int) -> list[int]:
    """For each row, the next row that passes if this one does; len(ts) when none does."""
    n = len(ts)
    nxt = [n] * n
    # Left-to-right maxima of the suffix, kept as a stack whose top is the nearest row.
    stack_ts: list[int] = []       # negated, so that it ascends from bottom to top
    stack_at: list[int] = []
    for j in range(n - 1, -1, -1):
        if not ok[j]:
            nxt[j] = j + 1
        else:
            k = bisect_left(stack_ts, -(ts[j] + window) + 1)
            # Entries below k have ts >= ts[j] + window; the last of them is the nearest.
            nxt[j] = stack_at[k - 1] if k else n
        while stack_ts and -stack_ts[-1] <= ts[j]:
            stack_ts.pop()
            stack_at.pop()
        stack_ts.append(-ts[j])
        stack_at.append(j)
    return nxt


def _first_at_least(ts: list[int], threshold: int) -> int:
    for j, t in enumerate(ts):
        if t >= threshold:
            return j
    return len(ts)


Steps = tuple[list[int], list[int]]


def _chunk_effect(ts: list[int], ok: list[bool], window: int) -> Steps:
    """How a chunk turns the incoming "last" into the outgoing one, as a step function.

    `at[i]` is the largest incoming last + window served by step i; past the last step the
    chunk leaves the incoming value alone. The first step is for "no last".
    """
    n = len(ts)
    nxt = _passes(ts, ok, window)
    leaves = [0] * n
    for j in range(n - 1, -1, -1):
        if nxt[j] < n:
            leaves[j] = leaves[nxt[j]]
        else:
            leaves[j] = ts[j] if ok[j] else _NONE
    at, exits = [_NONE], [leaves[0]]
    top = None
    for j in range(n):
        if top is None or ts[j] > top:
            top = ts[j]
            at.append(top)
            exits.append(leaves[j])
    return _merged(at, exits)


def _merged(at: list[int], exits: list[int]) -> Steps:
    """Neighbouring steps with one exit as one step; the step for "no last" stays apart."""
    out: Steps = at[:1], exits[:1]
    for a, e in zip(at[1:], exits[1:]):
        if len(out[0]) > 1 and out[1][-1] == e:
            out[0][-1] = a
        else:
            out[0].append(a)
            out[1].append(e)
    return out


def _reachable(steps: Steps, reach: int | None, window: int) -> Steps:
    """Steps that an incoming last of at most `reach` can meet; `reach` is null where only "no last" comes in.

    Times of a chunk lie behind those before it as a rule, so of a steady key no more steps are left than it
    has rows within one window.
    """
    at, exits = steps
    keep = 1 if reach is None else min(len(at), bisect_left(at, reach + window, lo=1) + 1)
    return at[:keep], exits[:keep]


def _leaves(steps: Steps, last: int, window: int) -> int:
    """The outgoing "last" for an incoming one."""
    at, exits = steps
    if last == _NONE:
        return exits[0]
    i = bisect_left(at, last + window, lo=1)
    return exits[i] if i < len(at) else last


def _composed(first: Steps, second: Steps, window: int) -> Steps:
    """The step function of two chunks in a row. A last that the first leaves alone meets the
    steps of the second which lie beyond all of the first's."""
    at, exits = list(first[0]), [_leaves(second, e, window) for e in first[1]]
    beyond = bisect_left(second[0], first[0][-1] + 1, lo=1) if len(first[0]) > 1 else 1
    return _merged(at + second[0][beyond:], exits + second[1][beyond:])


def cooldown(df: DataFrame, keys: list[str], order: str, ts: str, window: int,
             send_ok: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Greedy suppression: a row passes if its key has no last pass or `ts - last >= window`.

    Rows count in `order` (arrival, unique within a key). A pass whose `send_ok` is false gives
    the cooldown back. Each chunk of arrivals of a key with several is summarised by the step function
    it applies to the incoming state, as far as that state can reach. Summaries are composed pairwise up a
    binary tree over the chunk numbers, and entry states handed down it, one round a level; a
    group never holds more than two summaries. Then all chunks are judged in parallel. Adds
    boolean `passed`.
    """
    ok = F.lit(True) if send_ok is None else F.coalesce(F.col(send_ok), F.lit(False))
    df = df.withColumn("_key", F.struct(*keys)).withColumn("_chunk", F.floor(F.col(order) / chunk))
    slim = df.select("_key", "_chunk", F.col(order).alias("_order"), F.col(ts).alias("_ts"),
                     ok.alias("_ok"))
    key_type = slim.schema["_key"].dataType.simpleString()

    def columns(table: pa.Table, *names: str) -> list[list]:
        table = table.sort_by(names[0])
        return [table.column(n).to_pylist() for n in names]

    def answer(table: pa.Table, **values: pa.Array) -> pa.Table:
        """Columns led by the key, which never leaves Arrow."""
        size = len(next(iter(values.values())))
        key = table.column("_key").slice(0, 1).combine_chunks().take(pa.array([0] * size))
        return pa.table({"_key": key, **values})

    longs, lists = pa.int64(), pa.list_(pa.int64())

    def summarise(table: pa.Table) -> pa.Table:
        _, ts_list, ok_list = columns(table, "_order", "_ts", "_ok")
        reach = table.column("_reach")[0].as_py()
        at, exits = _reachable(_chunk_effect(ts_list, ok_list, window), reach, window)
        return answer(table, _node=table.column("_chunk").slice(0, 1).combine_chunks(),
                      _reach=pa.array([reach], longs), _at=pa.array([at], lists), _exit=pa.array([exits], lists))

    summary = f"_key {key_type}, _node bigint, _reach bigint, _at array<bigint>, _exit array<bigint>"

    def pair(table: pa.Table) -> list[tuple[int, int | None, Steps]]:
        """The one or two children of a node: number, reach, steps."""
        rows = columns(table, "_node", "_reach", "_at", "_exit")
        return [(node, reach, (at, exits)) for node, reach, at, exits in zip(*rows)]

    def compose(table: pa.Table) -> pa.Table:
        (node, reach, steps), *rest = pair(table)
        for _, _, after in rest:
            steps = _reachable(_composed(steps, after, window), reach, window)
        return answer(table, _node=pa.array([node >> 1], longs), _reach=pa.array([reach], longs),
                      _at=pa.array([steps[0]], lists), _exit=pa.array([steps[1]], lists))

    def hand_down(table: pa.Table) -> pa.Table:
        state, nodes, entry = table.column("_entry")[0].as_py(), [], []
        for node, _, steps in pair(table):
            nodes.append(node)
            entry.append(state)
            state = _leaves(steps, state, window)
        return pa.table({"_key": table.column("_key").slice(0, 1).combine_chunks().take(pa.array([0] * len(nodes))),
                         "_node": pa.array(nodes, longs), "_entry": pa.array(entry, longs)})

    def entered() -> DataFrame:
        """The state in which every chunk of a key begins."""
        # One row a chunk: how far earlier chunks have come, and whether the key has others.
        tops = slim.groupBy("_key", "_chunk").agg(F.max("_ts").alias("_top"))
        earlier = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        tops = cut_lineage(tops.select("_key", "_chunk", F.max("_top").over(earlier).alias("_reach"),
                                       (F.count(F.lit(1)).over(Window.partitionBy("_key")) > 1).alias("_many")))
        several, alone = tops.where("_many").drop("_many"), tops.where("NOT _many")
        levels = [cut_lineage(slim.join(several, ["_key", "_chunk"]).withColumn("_chunk", F.col("_chunk") - low)
                              .groupBy("_key", "_chunk").applyInArrow(summarise, summary))]
        parent = F.shiftright("_node", 1).alias("_parent")
        for _ in range((high - low).bit_length() - 1):
            levels.append(cut_lineage(levels[-1].groupBy("_key", parent).applyInArrow(compose, summary)))
        # Nothing lies before the topmost node.
        state = levels[-1].select("_key", F.shiftright("_node", 1).alias("_parent"), F.lit(_NONE).alias("_entry")).distinct()
        for level in reversed(levels):
            state = (level.withColumn("_parent", parent).join(state, ["_key", "_parent"]).groupBy("_key", "_parent")
                     .applyInArrow(hand_down, f"_key {key_type}, _node bigint, _entry bigint")
                     .select("_key", F.col("_node").alias("_parent"), "_entry"))
        return (alone.select("_key", "_chunk", F.lit(_NONE).alias("_entry"))
                .unionByName(state.select("_key", (F.col("_parent") + low).alias("_chunk"), "_entry")))

    def judge(table: pa.Table) -> pa.Table:
        order_list, ts_list, ok_list = columns(table, "_order", "_ts", "_ok")
        entry = table.column("_entry")[0].as_py()
        nxt = _passes(ts_list, ok_list, window)
        at = 0 if entry == _NONE else _first_at_least(ts_list, entry + window)
        hits = []
        while at < len(ts_list):
            hits.append(order_list[at])
            at = nxt[at]
        return answer(table, _hits=pa.array([hits], lists))

    low, high = slim.agg(F.min("_chunk"), F.max("_chunk")).first()
    # A single chunk is a tree without levels.
    begun = slim.withColumn("_entry", F.lit(_NONE)) if low == high else slim.join(entered(), ["_key", "_chunk"])
    passed = (begun.groupBy("_key", "_chunk")
              .applyInArrow(judge, f"_key {key_type}, _hits array<bigint>"))
    marks = passed.select("_key", F.explode("_hits").alias(order), F.lit(True).alias("passed"))
    return (df.join(marks, ["_key", order], "left")
            .withColumn("passed", F.coalesce("passed", F.lit(False)))
            .drop("_key", "_chunk"))
