"""SimHash near duplicates by vantage-point trees.

Every text becomes a 64-bit fingerprint, the bitwise majority of its word shingles' hashes. Two
texts are linked if their fingerprints differ in at most `radius` bits; links close transitively.

A vantage-point tree, fitted on a bounded sample, deals the distinct fingerprints into shards: a
node sends a fingerprint inside or outside by its Hamming distance to the vantage point. By the
triangle inequality a pair within the radius that a node separates has both distances within the
radius of the node's boundary, so only those fingerprints also visit the other branch. Each shard
then compares its own fingerprints with one another and with its visitors; a shard that holds too
many is cut into a grid of blocks, so no task holds more than two blocks, whatever the clusters.
Tasks return a spanning forest of the links they see, never all pairs of a cluster.

Defined cases: a null text counts as empty; a text without words has the fingerprint zero and is
linked like any other; equal texts and repeated rows share a fingerprint and so a component; a
component whose ids are all null has a null `component_id`. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, ready, store

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints of the sample the tree is fitted on, and wanted fingerprints of a shard.
SAMPLE, SHARD = 1 << 16, 2048
#: Own and visiting fingerprints of one block of a shard.
OWN_BLOCK, VISIT_BLOCK = 4096, 32768


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes (uint64) of the runs of `shingle` words, repeats included; a shorter text is one run."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    hash64 = xxhash.xxh64_intdigest
    return np.fromiter((hash64(joined[a:b], SEED) for a, b in
                        zip(begins[:n].tolist(), ends[width - 1:].tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit integer of the bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text as a signed 64-bit integer.

    ASCII letters are folded to lower case; words are runs of bytes other than ASCII blanks;
    shingles keep their repeats. A bit is set if more than half of the hashes have it.
    """
    return majority(shingle_hashes((text or b"").lower().split(), shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """(id, fp) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())],
                                             [id_column, "fp"])

    ready(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"`{id_column}` long, fp long")


@dataclass
class Node:
    """Inner node: fingerprints within `limit` bits of `point` go to `inside`."""
    point: int
    limit: int
    inside: "Node | int"
    outside: "Node | int"


def fit_tree(sample: np.ndarray, leaves: int) -> Node | int:
    """Vantage-point tree with about `leaves` shards over a sample of fingerprints (uint64).

    Of a few points of a node the one whose distances spread most is its vantage point, since the
    fewest fingerprints then lie at the boundary; the median distance is the limit.
    """
    shards = iter(range(1 << 62))

    def grow(points: np.ndarray, wanted: int) -> Node | int:
        if wanted < 2 or len(points) < 4:
            return next(shards)
        tried = points[np.linspace(0, len(points) - 1, 8).astype(int)]
        away = [np.bitwise_count(points ^ p) for p in tried]
        best = max(range(len(tried)), key=lambda i: away[i].std())
        far, limit = away[best], int(np.median(away[best]))
        if not (far > limit).any():
            limit -= 1
        if limit < 0:
            return next(shards)
        left = wanted // 2
        return Node(int(tried[best]), limit, grow(points[far <= limit], left), grow(points[far > limit], wanted - left))

    return grow(sample, leaves)


def route(tree: Node | int, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, position in prints, own): each fingerprint's own shard and those it visits.

    Of two fingerprints that a node separates, the inner one visits the outer branch, so every
    pair is compared in exactly one of the two.
    """
    found = []

    def walk(node: Node | int, at: np.ndarray, own: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, int):
            found.append((np.full(len(at), node, np.int64), at, own))
            return
        far = np.bitwise_count(prints[at] ^ np.uint64(node.point)).astype(np.int64)
        inner = far <= node.limit
        go_in = np.where(own, inner, far <= node.limit + radius)
        go_out = np.where(own, ~inner, far > node.limit - radius)
        visit = own & inner & (far > node.limit - radius)
        walk(node.inside, at[go_in], own[go_in])
        walk(node.outside, np.concatenate((at[go_out], at[visit])),
             np.concatenate((own[go_out], np.zeros(visit.sum(), bool))))

    walk(tree, np.arange(len(prints)), np.ones(len(prints), bool))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def forest(own: np.ndarray, others: np.ndarray, *radii: int) -> list[tuple[int, int, int]]:
    """Links (a, b, distance) that join all fingerprints of both sets as pairs within the radii do,
    closer ones first: what one radius has joined, a wider one doesn't join again.

    Visits the others in slices; a row's partners are merged by the roots they have so far, so a
    dense cluster yields one link for each member.
    """
    prints, position = np.unique(np.concatenate((own, others)), return_inverse=True)
    mine, theirs = position[:len(own)], position[len(own):]
    root = np.arange(len(prints))
    links = []
    for radius in radii:
        for at in range(0, len(theirs), 512):
            far = np.bitwise_count(others[at:at + 512, None] ^ own[None, :])
            near = (far <= radius) & (far > 0)
            for i in np.flatnonzero(near.any(axis=1)):
                me = theirs[at + i]
                at_most = np.flatnonzero(near[i])
                at_most = at_most[np.argsort(far[i][at_most], kind="stable")]
                partners = mine[at_most]
                _, first = np.unique(root[partners], return_index=True)
                for partner, distance in zip(partners[first], far[i][at_most][first]):
                    if root[me] != root[partner]:
                        links.append((int(prints[me]), int(prints[partner]), int(distance)))
                        low, high = sorted((root[me], root[partner]))
                        root[root == high] = low
    return links


def near_links(prints: DataFrame, *radii: int, shard: int = SHARD, sample: int = SAMPLE,
               own_block: int = OWN_BLOCK, visit_block: int = VISIT_BLOCK) -> DataFrame:
    """Links (a, b, distance) between distinct fingerprints `fp` that give the same components as
    all pairs within the largest radius; closer radii are joined first. Only the bounded sample and one count for each block reach the driver."""
    total = prints.count()
    drawn = (prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toArrow()
             .column("fp").to_numpy().astype(np.int64).view(np.uint64))
    tree = fit_tree(drawn, max(1, min(-(-total // shard), len(drawn) // 16)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            leaf, at, own = route(tree, fp.view(np.uint64), max(radii))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int64()), pa.array(fp[at], pa.int64()), pa.array(own.astype(bool))],
                ["shard", "fp", "own"])

    dealt = store(prints.select("fp").mapInArrow(deal, "shard long, fp long, own boolean"))
    sizes = dealt.groupBy("shard").agg(F.count_if("own").alias("owns"), F.count(F.lit(1)).alias("visits"))
    grid = sizes.select("shard", F.greatest(F.lit(1), F.ceil(F.col("owns") / own_block)).cast("int").alias("rows"),
                        F.greatest(F.lit(1), F.ceil(F.col("visits") / visit_block)).cast("int").alias("columns"))
    sized = dealt.join(grid, "shard")
    place = F.xxhash64("fp", F.lit("block"))
    # As one of the shard's own, a fingerprint meets every column of its row; as a visitor, and
    # an own one visits too, every row of its column.
    held = sized.where("own").select("shard", "fp", F.lit(True).alias("held"), F.pmod(place, "rows").cast("int").alias("r"),
                                     F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("c"))
    seen = sized.select("shard", "fp", F.lit(False).alias("held"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"),
                        F.pmod(place, "columns").cast("int").alias("c"))

    def link(block: pa.Table) -> pa.Table:
        fp = block.column("fp").to_numpy().view(np.uint64)
        held = block.column("held").to_numpy(zero_copy_only=False).astype(bool)
        links = np.array(forest(fp[held], fp[~held], *radii), np.uint64).reshape(-1, 3).view(np.int64)
        return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1]), "distance": pa.array(links[:, 2].astype(np.int32))})

    return held.union(seen).groupBy("shard", "r", "c").applyInArrow(link, "a long, b long, distance int")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    id_column: str = "doc_id", text_column: str = "text", **tuning: int) -> DataFrame:
    """(id, fp, component_id): fingerprint and smallest id reachable over links, for every row."""
    rows = store(fingerprints(docs, shingle, id_column, text_column))
    distinct = store(rows.groupBy("fp").agg(F.min(id_column).alias("first")))
    roots = components(near_links(distinct, radius, **tuning).select("a", "b"))
    member = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = store(member.join(lowest, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(id_column, "fp", "component_id")


#: For one document of each group: shingle, bits of the links that join clusters of copies first, similarity.
WORDS, SURE, SIMILARITY = 5, 3, 0.8
#: Texts whose shingles are counted to order the others' by, least count of a frequent one, and how many of them are kept.
COUNTED, FREQUENT, KEPT = 2000, 3, 1 << 18
#: Bins into which a text's shingles are counted, and pairs for each text of them that one job compares at most.
BINS, PAIRS = 256, 2


def signatures(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, id, body, fp, size, tokens, bins) of rows (key, id, text): hash of the words, fingerprint,
    number of distinct shingles, the shingles of which texts that are similar enough share one, and
    how many distinct shingles fall into each bin, a byte each (null if a byte can't hold it).

    Of n shingles a similar text holds at least similarity x n, so it misses fewer than there are
    tokens. That needs one order of all shingles, whichever: those frequent in a bounded count come
    last, so that a passage of many texts is seldom a token.
    """
    every = max(1, rows.count() // COUNTED)
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select(F.xxhash64("text").alias("fp"), "text").dropDuplicates(["fp"])
    counts = (shingle_sets(some).select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(KEPT).orderBy("shingle").toArrow())
    frequent, often = (counts.column(c).to_numpy().astype(np.int64) for c in ("shingle", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, prints, sizes, tokens, bins = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                words = (text or b"").lower().split()
                hashes = shingle_hashes(words, WORDS)
                known = np.unique(hashes).view(np.int64)
                n = len(known)
                count = np.zeros(n, np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, known), len(frequent) - 1)
                    count = np.where(frequent[at] == known, often[at], 0)
                order = np.lexsort((known, count))[:n - math.ceil(similarity * n - 1e-9) + 1]
                bodies.append(xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63))
                prints.append(majority(hashes))
                sizes.append(n)
                tokens.append(known[order])
                share = np.bincount(known & (BINS - 1), minlength=BINS)
                bins.append(share.astype(np.uint8).tobytes() if share.max() < 256 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bodies, pa.int64()), pa.array(prints, pa.int64()),
                 pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), pa.array(bins, pa.binary())],
                ["key", "id", "body", "fp", "size", "tokens", "bins"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("key", "id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"key long, id {kind}, body long, fp long, size int, tokens array<long>, bins binary")


def shingle_sets(docs: DataFrame, shingle: int = WORDS) -> DataFrame:
    """(fp, shingles) of texts (fp, text): the distinct hashes of their shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes((text or b"").lower().split(), shingle)).view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "shingles"])

    return docs.select("fp", F.col("text").cast("binary").alias("text")).mapInArrow(run, "fp long, shingles array<long>")


def conceivable(pairs: DataFrame, keyed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of the pairs (a, b) whose counts by bins leave room for enough common shingles. Two texts share no
    more of a bin than the one with fewer there has, so no similar pair is lost; few others stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(i).to_pylist() for i in (4, 5)]
            known = np.array([x is not None and y is not None for x, y in zip(*sides)], bool)
            one, other = (np.frombuffer(b"".join(x for x, k in zip(side, known) if k), np.uint8).reshape(-1, BINS) for side in sides)
            sizes = [batch.column(i).to_numpy().astype(np.int64) for i in (2, 3)]
            needed = similarity / (1 + similarity) * sum(sizes) - 1e-6
            enough = np.minimum(*sizes) >= needed
            enough[known] &= np.minimum(one, other).sum(axis=1, dtype=np.int64) >= needed[known]
            yield batch.select(["a", "b"]).filter(pa.array(enough))

    facts = keyed.select("body", "size", "bins")
    wide = pairs.join(facts.toDF("a", "size_a", "bins_a"), "a").join(facts.toDF("b", "size_b", "bins_b"), "b")
    return wide.select("a", "b", "size_a", "size_b", "bins_a", "bins_b").mapInArrow(run, "a long, b long")


def alike(pairs: DataFrame, keyed: DataFrame, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of the pairs (a, b) of bodies whose shingles' Jaccard similarity is large enough; stored.

    A pair carries its texts' shingles through a shuffle, so one job takes a few pairs for each text only:
    what lies on disk follows the texts, not the pairs.
    """
    likely = store(conceivable(pairs, keyed, similarity))
    # A table of its own, so that Spark knows its size and need not shuffle the texts for a small one.
    wanted = store(likely.select(F.explode(F.array("a", "b")).alias("body")).distinct().join(keyed, "body").select("body", "key"))
    texts = rows.select("key", "text").join(wanted, "key").dropDuplicates(["body"])
    sets = store(shingle_sets(texts.select(F.col("body").alias("fp"), "text")))
    one, other = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    # One lambda binds the common shingles, so that they are counted once.
    enough = F.get(F.transform(F.array(both), lambda n: n >= similarity * (F.size("set_a") + F.size("set_b") - n) - 1e-9), F.lit(0))
    turns = max(1, math.ceil(likely.count() / max(1, PAIRS * sets.count())))
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(turns))
    found = reduce(DataFrame.union, [store(likely.where(turn == i).join(one, "a").join(other, "b").where(enough).select("a", "b"))
                                     for i in range(turns)])
    for done in (likely, wanted, sets):
        discard(done)
    return found


def best_partner(votes: DataFrame) -> DataFrame:
    """(a, b) of votes (body, hub): each body with the hub that has most votes, ties to the larger hub."""
    counted = votes.where("body <> hub").groupBy("body", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("body").agg(F.max(F.struct("n", "hub")).alias("best")).select("body", F.col("best.hub").alias("hub"))
    return best.select(F.least("body", "hub").alias("a"), F.greatest("body", "hub").alias("b"))


def groups_of_similar(signed: DataFrame, rows: DataFrame, similarity: float = SIMILARITY, **tuning: int) -> DataFrame:
    """(body, root) of the bodies in `signed` that belong with others: pairs with enough shingles in
    common, close transitively. Fingerprints only propose pairs; equal ones are checked too.

    Of texts that share tokens each is first compared with one other, the smallest or largest body of
    most of its tokens; those whose tokens still hold several groups then with one of another group;
    after that, every pair of a token whose groups still differ is.
    """
    prints = store(signed.groupBy("fp").agg(F.min("body").alias("body")))
    close = near_links(prints, SURE, **tuning).select("a", "b")
    copies = signed.select("fp", F.col("body").alias("b")).join(prints, "fp").select(F.col("body").alias("a"), "b").where("a <> b")
    sure = store(close.join(prints.toDF("a", "one"), "a").join(prints.toDF("b", "other"), "b").select(
        F.col("one").alias("a"), F.col("other").alias("b")).union(copies))
    discard(prints)

    # Tokens of one row of a body only, with the number of the body's shingles from the token on.
    least = signed.groupBy("body").agg(F.min("key").alias("key"), F.max("size").alias("size"))
    keyed = store(least.join(signed.select("key", "bins"), "key").dropDuplicates(["key"]))
    # Repeated rows fold before their tokens are dealt out, so that the wide rows below need not be.
    once = signed.join(keyed.select("key"), "key", "left_semi").groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("body", "size", "tokens")])
    dealt = once.select("body", "size", F.posexplode("tokens").alias("pos", "token")).select(
        "token", "body", (F.col("size") - F.col("pos")).alias("rest"), "size")
    end = F.struct("body", "rest", "size")
    several = dealt.groupBy("token").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").select("token")
    shared = store(dealt.join(several, "token"))
    ends = shared.groupBy("token").agg(F.min(end).alias("low"), F.max(end).alias("high"))
    star = best_partner(shared.join(ends, "token").select("body", "rest", "size", F.explode(F.array("low", "high")).alias("hub"))
                        .where(_possible("rest", "size", "hub.rest", "hub.size", similarity)).select("body", F.col("hub.body").alias("hub")))
    asked = store(star.union(sure.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    discard(sure)
    first = alike(asked, keyed, rows, similarity)

    open_ = store(_open(shared, first))
    discard(shared)
    order = F.struct("own", "body", "rest", "size")
    hubs = open_.groupBy("token").agg(F.min(order).alias("low"), F.max(order).alias("high"))
    votes = open_.join(hubs, "token").select("body", "own", "rest", "size", F.explode(F.array("low", "high")).alias("hub")).where(
        _possible("rest", "size", "hub.rest", "hub.size", similarity) & F.expr("own <> hub.own"))
    again = store(best_partner(votes.select("body", F.col("hub.body").alias("hub"))).distinct().join(asked, ["a", "b"], "left_anti"))
    second = alike(again, keyed, rows, similarity)

    left = store(_open(open_.drop("own"), first.union(second)))
    discard(open_)
    one, other = left.toDF("a", "token", "rest_a", "size_a", "own_a"), left.toDF("b", "token", "rest_b", "size_b", "own_b")
    across = store(one.join(other, "token").where(
        F.expr("a < b AND own_a <> own_b") & _possible("rest_a", "size_a", "rest_b", "size_b", similarity)).select("a", "b").distinct()
        .join(asked.union(again), ["a", "b"], "left_anti"))
    links = first.union(second).union(alike(across, keyed, rows, similarity))
    grouped = components(links).select(F.col("node").alias("body"), "root")
    for done in (left, across, asked, again, keyed):
        discard(done)
    return grouped


def _open(shared: DataFrame, links: DataFrame) -> DataFrame:
    """(body, token, rest, size, own) of the rows whose token is shared by more than one group."""
    owned = shared.join(components(links).withColumnRenamed("node", "body"), "body", "left").select(
        "body", "token", "rest", "size", F.coalesce("root", "body").alias("own"))
    mixed = owned.groupBy("token").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least <> most").select("token")
    return owned.join(mixed, "token").select("body", "token", "rest", "size", "own")


def _possible(rest: str, size: str, other_rest: str, other_size: str, similarity: float) -> Column:
    """Whether two texts can be similar enough if this token is the first, in the order of all shingles,
    that they share: no more than what follows in either can be common. True for the first shared token
    of every similar pair, so no pair is lost."""
    needed = similarity / (1 + similarity) * (F.col(size) + F.col(other_size))
    return F.least(rest, other_rest) >= needed - 1e-6


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **tuning: int) -> DataFrame:
    """The rows without near duplicates, with the columns they came with: of every group, and of
    repeated rows, the one with the smallest id stays (a null id comes last). Texts of the same
    words are equal, those without words too."""
    names = docs.columns
    key = F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), key.alias("key"), F.col(f"`{text_column}`").alias("text"))
    signed = store(signatures(rows))
    grouped = groups_of_similar(signed, rows, **tuning)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    first = signed.select("key", "id", "body").join(grouped, "body", "left").withColumn("root", F.coalesce("root", "body"))
    kept = store(first.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.key").alias("kept_key")))
    discard(signed)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("kept_key"))
    once = whole.join(kept, "kept_key", "left_semi").dropDuplicates(["kept_key"])
    return once.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
