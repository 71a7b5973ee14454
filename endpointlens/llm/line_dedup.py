"""Fuzzy line dedup with DataFrame operations only.

Lines are normalised (lower case, every run of other characters than letters and digits as one
blank). Equal ones fold together by hash; each remaining line gets a 64-bit SimHash of its words of
five and more bytes, or of all words if it has none so long. Two lines are linked if their
SimHashes differ in at most three bits and their edit similarity, 1 - edits / length of the longer
one, is at least `SIMILARITY`. Of every connected group the first occurrence stays, by doc_id and
position; the texts are put together again from the lines that stay.

Candidates share bits by the pigeonhole principle: of `blocks` blocks of a SimHash at least
blocks - 3 agree. How many blocks there are follows the number of lines, so that a bucket holds
few unrelated lines at any size; every choice finds the same pairs. A bucket is first linked to
its smallest line only. After that, only pairs from different groups are formed, so that a cluster
of near copies never yields all its pairs.

Lines are told apart by 128 bits of hash, candidates by 64. Texts are fetched for candidates alone: a bitmap of fixed size over their documents filters the
second read of the documents before anything is shuffled.

Defined cases: a null text stays null; lines without letters and digits are always kept; rows of
equal id and text are one document, and both keep its first occurrences; a null id comes after all
others. A text whose lines all go becomes empty, its row stays. Columns other than the text are
passed through; a column named like a helper is no hindrance.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, row_key, store

BITS, RADIUS, SIMILARITY = 64, 3, 0.8
LONG_WORD = 5
#: Bits of a count of hashes in a sum, two of them spare.
LANE = 16
#: Different words of two lines up to which their words are aligned as characters of two bytes.
ALPHABET = 50_000
#: Unrelated lines of a bucket on average, at most; blocks to choose from.
LOAD, BLOCKS = 64, (4, 5, 6, 7)
#: Bits of the filter over documents, and those of its words.
FILTER_BITS, WORD_BITS = 1 << 22, 64
#: Lines from which on a bucket is asked whether it holds one group only.
CROWDED = 1024


def lane_mask(width: int) -> int:
    """A one in every lane of that width of a 64-bit word."""
    return sum(1 << i for i in range(0, BITS, width))


def lanes(hash_: Column, k: int, width: int) -> Column:
    """Bits k, k + width, ... of a hash, each in a lane of that width."""
    return F.shiftrightunsigned(hash_, k).bitwiseAND(F.lit(lane_mask(width)))


def over_half(counts: list[Column], n: Column) -> Column:
    """64 bits, set where more than half of n hashes have it, from the sums of their lanes.

    Bits that lie a lane's width apart are counted side by side in one number; a carry into a
    lane's last bit but one then tells which counts exceed half. For n < 2 ** (width - 2).
    """
    width = len(counts)
    mask = F.lit(lane_mask(width))
    missing = mask * (F.lit((1 << (width - 2)) - 1) - F.floor(n / 2))
    return reduce(Column.bitwiseOR, [
        F.shiftleft(F.shiftrightunsigned(counts[k] + missing, width - 2).bitwiseAND(mask), k) for k in range(width)])


def majority(hashes: Column, width: int) -> Column:
    """64-bit majority of an array of hashes, for fewer than 2 ** (width - 2) hashes."""
    return over_half([F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + lanes(h, k, width)) for k in range(width)], F.size(hashes))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, pos, k1, k2, print, size) of every line of `docs` (doc, doc_id, text).

    Texts are dealt out by a number of their own, so that the words of a line are summed up where
    its text lies; the hashes of a line of very many words are summed up in its row.
    """
    def hashed(words: Column) -> Column:
        return F.transform(words, lambda w: F.xxhash64(w))

    dealt = docs.where("text IS NOT NULL").select("doc", "doc_id", "text", F.monotonically_increasing_id().alias("row")).repartition("row")
    lines = dealt.select("row", "doc", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("row", "doc", "doc_id", "pos", words_of(F.col("line")).alias("words"))
    lines = lines.withColumn("hashes", hashed(F.filter("words", lambda w: F.octet_length(w) >= LONG_WORD)))
    blank, few = F.size("words") == 0, F.size("hashes")
    lines = lines.withColumn("hashes", F.when(few == 0, hashed(F.col("words"))).otherwise(F.col("hashes")))
    many = few >= 1 << (LANE - 2)
    lines = lines.select(
        "row", "doc", "doc_id", "pos",
        # A blank line has a key of its own, so that nothing is ever equal to it.
        F.when(blank, F.xxhash64("doc", "pos")).otherwise(F.xxhash64("words")).alias("k1"),
        F.when(blank, F.lit(0)).otherwise(F.xxhash64("hashes", F.lit("second"))).alias("k2"),
        F.size("words").alias("size"), F.when(many, majority(F.col("hashes"), 32)).alias("whole"),
        F.when(~many, F.col("hashes")).alias("hashes"))
    each = lines.select("row", "doc", "doc_id", "pos", "k1", "k2", "size", "whole", F.explode_outer("hashes").alias("hash"))
    summed = each.groupBy("row", "doc", "doc_id", "pos", "k1", "k2", "size", "whole").agg(
        F.count("hash").alias("n"), *[F.sum(lanes(F.coalesce("hash", F.lit(0).cast("long")), k, LANE)).alias(f"lane_{k}") for k in range(LANE)])
    return summed.select("doc", "doc_id", "pos", "k1", "k2", F.coalesce(
        "whole", over_half([F.col(f"lane_{k}") for k in range(LANE)], F.col("n"))).alias("print"), "size")


def words_of(line: Column) -> Column:
    """Words of a line: lower case, parted by runs of other characters than letters and digits."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def plan_blocks(lines: int, radius: int = RADIUS) -> int:
    """Fewest blocks whose shared bits keep a bucket of so many lines small."""
    for blocks in BLOCKS:
        if lines / 2 ** (BITS * (blocks - radius) // blocks) <= LOAD:
            return blocks
    return BLOCKS[-1]


def bucketed(lines: DataFrame, blocks: int, radius: int = RADIUS) -> DataFrame:
    """Adds `bucket`: a row for every choice of blocks that must agree."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.xxhash64(F.lit(n), F.col("print").bitwiseAND(F.lit(signed).cast("long"))))
    return lines.select(F.explode(F.array(*keys)).alias("bucket"), "*")


def near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def bucket_heads(rows: DataFrame) -> DataFrame:
    """(bucket, a, print_a, n) with the smallest line of each bucket that holds several."""
    return rows.groupBy("bucket").agg(F.min("line").alias("a"), F.min_by("print", "line").alias("print_a"),
                                      F.count(F.lit(1)).alias("n")).where("n > 1")


def candidates_by_star(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's smallest line and those near it."""
    return (rows.join(heads, "bucket").where(F.col("line") != F.col("a")).where(near("print", "print_a"))
            .select("a", F.col("line").alias("b")).distinct())


def candidates_across(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs (a, b) of near lines of one bucket that are not yet in one group `own`.

    A crowded bucket that holds one group only has no such pair, so it is left out as a whole.
    """
    crowded = rows.join(heads.where(F.col("n") > CROWDED).select("bucket"), "bucket").groupBy("bucket").agg(
        F.min("own").alias("low"), F.max("own").alias("high"))
    settled = store(crowded.where("low = high").select("bucket"))
    held = rows.join(settled, "bucket", "left_anti")
    left = held.select("bucket", F.col("line").alias("a"), F.col("print").alias("print_a"), F.col("own").alias("own_a"))
    right = held.select("bucket", F.col("line").alias("b"), F.col("print").alias("print_b"), F.col("own").alias("own_b"))
    return (left.join(right, "bucket").where("a < b AND own_a <> own_b").where(near("print_a", "print_b"))
            .select("a", "b").distinct())


def verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs whose lines are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    wanted = store(distinct.join(ids, "line", "left_semi").select("line", F.col("first.doc").alias("doc")))
    slot = F.pmod("doc", F.lit(FILTER_BITS))
    word, bit = F.floor(slot / WORD_BITS).cast("int"), F.pmod(slot, F.lit(WORD_BITS)).cast("int")
    used = wanted.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    every = docs.sparkSession.range(FILTER_BITS // WORD_BITS).select(F.col("id").cast("int"), F.lit(0).cast("long"))
    filled = used.union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # One array of FILTER_BITS bits, whatever the number of documents.
    bitmap = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])).scalar()
    few = docs.where("text IS NOT NULL").where(F.call_function("getbit", F.element_at(bitmap, word + 1), bit) == 1)
    lines = few.select(F.explode(F.transform(F.split("text", "\n"), words_of)).alias("words"))
    found = lines.where(F.size("words") > 0).select(F.xxhash64("words").alias("line"), "words").join(
        wanted.select("line").distinct(), "line", "left_semi").dropDuplicates(["line"])
    texts = store(found.withColumn("length", F.char_length(F.array_join("words", " "))))
    a, b = texts.toDF("a", "words_a", "length_a"), texts.toDF("b", "words_b", "length_b")
    return pairs.join(a, "a").join(b, "b").where(similar(similarity)).select("a", "b")


def few_words_apart(a: Column, b: Column, most: Column) -> Column:
    """Whether an alignment of whole words shows that the edits suffice; false says nothing.

    Words become characters, so that Levenshtein's distance counts words. Every word put in, taken
    out or replaced costs no more than the longest one concerned and its blank, and no word is
    concerned twice.
    """
    def spelled(words: Column, alphabet: Column) -> Column:
        codes = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(alphabet, w)), 4, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")

    def aligned(alphabet: Column) -> Column:
        return F.when(F.size(alphabet) <= ALPHABET, F.levenshtein(spelled(a, alphabet), spelled(b, alphabet)))

    def dearest(n: Column) -> Column:
        prices = F.reverse(F.array_sort(F.transform(F.concat(a, b), lambda w: F.char_length(w) + 1)))
        return F.aggregate(F.slice(prices, 1, n), F.lit(0), lambda total, price: total + price)

    words = F.get(F.transform(F.array(F.array_distinct(F.concat(a, b))), aligned), F.lit(0))
    return F.coalesce(F.get(F.transform(F.array(words), dearest), F.lit(0)) <= most, F.lit(False))


def similar(similarity: float) -> Column:
    """Whether the edit similarity of two lines of words (words_a, words_b) is large enough.

    If words replace words, the sum of the words' own distances bounds the distance, which settles
    most pairs in linear time; for the rest only what lies between the first and the last word
    that differ is aligned, word by word at first and, if that does not suffice, by characters
    within the edits that are allowed.
    """
    def same_from(x: Column, y: Column) -> Column:
        """Equal words at the head of both."""
        first = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False).cast("int")
        return F.when(first > 0, first - 1).otherwise(F.least(F.size(x), F.size(y)))

    a, b = F.col("words_a"), F.col("words_b")
    most = F.floor(F.greatest("length_a", "length_b") * F.lit(1 - similarity) + 1e-9).cast("int")
    apart = F.aggregate(F.zip_with(a, b, lambda p, q: F.when(p == q, 0).otherwise(F.levenshtein(p, q))), F.lit(0), lambda n, d: n + d)
    def between(ends: Column) -> Column:
        """Whether the edits suffice between the words that both begin with and those that both end with."""
        tail = F.least(ends["tail"], F.least(F.size(a), F.size(b)) - ends["head"])
        core = [F.slice(x, ends["head"] + 1, F.size(x) - ends["head"] - tail) for x in (a, b)]
        exact = F.call_function("levenshtein", *[F.array_join(x, " ") for x in core], most) >= 0
        return few_words_apart(*core, most) | exact

    # A lambda binds the ends, so that they are looked for once.
    ends = F.struct(same_from(a, b).alias("head"), same_from(F.reverse(a), F.reverse(b)).alias("tail"))
    aligned = F.get(F.transform(F.array(ends), between), F.lit(0))
    return (F.abs(F.col("length_a") - F.col("length_b")) <= most) & (((F.size(a) == F.size(b)) & (apart <= most)) | aligned)


def keepers(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(occurrences, keepers): every line, and (k1, k2, keep) of those with more than one occurrence
    in their group, where `keep` is the group's first occurrence."""
    every = store(occurrences(docs))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc", "pos")
    distinct = store(every.where("size > 0").groupBy("k1", "k2").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("print").alias("print"))
        .withColumn("line", F.col("k1")))
    blocks = plan_blocks(distinct.count())
    rows = bucketed(distinct.select("line", "print"), blocks)
    heads = store(bucket_heads(rows))
    star = store(verified(store(candidates_by_star(rows, heads)), distinct, docs, similarity))
    roots = components(star)
    owned = distinct.join(roots, distinct.line == roots.node, "left").select("line", "print", F.coalesce("root", "line").alias("own"))
    across = verified(store(candidates_across(bucketed(owned, blocks), heads)), distinct, docs, similarity)
    groups = components(star.union(across))
    member = distinct.join(groups, distinct.line == groups.node, "left").select(
        "k1", "k2", "first", "copies", F.coalesce("root", "line").alias("root"), F.col("root").isNotNull().alias("linked"))
    heads = groups.select(F.col("root").alias("line")).distinct().withColumn("head", F.lit(True))
    member = store(member.join(heads, member.root == heads.line, "left").where("copies > 1 OR head").drop("line", "linked"))
    lowest = member.groupBy("root").agg(F.min("first").alias("keep"))
    return every, member.join(lowest, "root").select("k1", "k2", "keep")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """(doc, lines, removed, text): rows of `docs` as a struct `doc`, how many lines they had and
    lost, and the text that is left."""
    text = F.col(f"`{text_column}`")
    named = docs.select(row_key(f"`{id_column}`", f"`{text_column}`").alias("doc"), F.col(f"`{id_column}`").alias("doc_id"), text.alias("text"))
    every, repeated = keepers(named, similarity)
    kept = F.col("keep").isNull() | ((F.col("keep.doc") == F.col("doc")) & (F.col("keep.pos") == F.col("pos")))
    marks = (every.select("doc", "pos", "k1", "k2").join(repeated, ["k1", "k2"], "left").select("doc", "pos", kept.alias("kept"))
             .groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("pos", "kept"))).alias("marks"))
             .where(F.exists("marks", lambda m: ~m["kept"])))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"),
                       row_key(f"`{id_column}`", f"`{text_column}`").alias("key"))
    joined = rows.join(marks, rows.key == marks.doc, "left")
    left = F.filter(F.zip_with(F.split("text", "\n"), "marks", lambda x, m: F.struct(x.alias("line"), m["kept"].alias("kept"))), lambda x: x["kept"])
    lost = F.coalesce(F.size(F.filter("marks", lambda m: ~m["kept"])), F.lit(0))
    return joined.select(
        F.col("row").alias("doc"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("lines"),
        F.when(F.col("marks").isNull(), 0).otherwise(lost).cast("long").alias("removed"),
        F.when(F.col("marks").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda x: x["line"]), "\n")).alias("text"))


def without_repeated_lines(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows with their repeated lines gone, with the columns they came with."""
    found = dedup_lines(docs)
    return found.select(*[F.col("text").alias(c) if c == text_column else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
