"""URL filter: rules where they fit, gradient-boosted trees elsewhere, DataFrame operations only.

A rule names a host and the start of a path; it fits the host and its subdomains, and the longest
fitting rule decides. Urls that a rule decides are the labelled ones: trees over lexical features
(lengths, depth, digit ratio, entropy, parameters, and how often a host's last label and last two
labels, and a path's first segment, were blocked among the labelled urls) learn from them and
decide the others. Suffix statistics are counted over all labelled urls; the trees are fitted on a
bounded sample of them. A labelled url's statistics come from the folds that it is not in, so that
its own label doesn't leak.

Defined cases: a null url, or one without `://`, has an empty host and path and is judged by its
features, which are those of an empty text; without labelled urls of both kinds the more frequent
label, or `allow`, is the verdict. Repeated rows are judged alike. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: Labelled urls that the trees are fitted on (expected number, drawn by hash), trees and their depth.
SAMPLE, TREES, DEPTH, STEP = 20_000, 16, 4, 0.3
#: Urls of a label that are taken if the draw has none of it.
LEAST = 50
#: Urls that a suffix's share of blocked ones is smoothed by.
SMOOTH = 10.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy",
           "parameters", "hyphens", "longest_segment", "secure", "fragment")
#: Suffixes of the host, and for paths their first segment, whose share of blocked urls is counted.
SUFFIXES = ("last_label", "last_two_labels", "path_head")
FOLDS = 4


@dataclass(frozen=True)
class Rule:
    """`verdict` for a host with its subdomains and paths that start with `path`."""
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a url that is null or has no `://`."""
    whole = F.coalesce(url, F.lit(""))
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, split, 1), UPPER, LOWER), F.regexp_extract(whole, split, 2)


def decided(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path, else nulls. The
    rules stand in the plan, so there may be some hundreds of them."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        fits = fits & F.col("path").startswith(rule.path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def count_of(text: Column, part: str) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def entropy(text: Column) -> Column:
    """Bits of a character of the text."""
    size = F.char_length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (size - F.char_length(F.replace(text, c, F.lit("")))) / size)
    return F.when(size > 0, F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def digits(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "[^0-9]", ""))


def lexical(urls: DataFrame) -> DataFrame:
    """`urls` (url, host, path and others) with its lexical features and its host's suffixes."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    values = {
        "url_length": F.char_length(url), "host_length": F.char_length(host), "path_length": F.char_length(path),
        "depth": count_of(path, "/"), "labels": count_of(host, ".") + (F.char_length(host) > 0).cast("int"),
        "digit_ratio": ratio(digits(url), F.char_length(url)), "host_digit_ratio": ratio(digits(host), F.char_length(host)),
        "entropy": entropy(url), "parameters": (F.char_length(query) > 0).cast("int") + count_of(query, "&"),
        "hyphens": count_of(url, "-"), "longest_segment": F.array_max(F.transform(F.split(path, "/"), F.char_length)),
        "secure": F.lower(url).startswith("https").cast("int"), "fragment": url.contains("#").cast("int")}
    named = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()}
    return urls.withColumns(named | {"last_label": F.regexp_extract("host", r"[^.]*$", 0),
                                     "last_two_labels": F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0),
                                     "path_head": F.regexp_extract("path", r"^/[^/]*", 0)})


def with_suffix_statistics(rows: DataFrame) -> DataFrame:
    """Adds each suffix's share of blocked urls and how many labelled ones there were, for a
    labelled row without those of its own fold."""
    labelled, blocked = F.col("verdict").isNotNull(), F.coalesce(F.col("verdict") == "block", F.lit(False))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("host", "path", F.lit("fold")), F.lit(FOLDS)).cast("int"))

    def others(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
        return total - F.when(labelled, F.element_at(counts, F.col("fold") + 1)).otherwise(0)

    for suffix in SUFFIXES:
        counts = rows.groupBy(suffix).agg(
            F.array(*[F.count_if(labelled & (F.col("fold") == f)) for f in range(FOLDS)]).alias("n"),
            F.array(*[F.count_if(blocked & (F.col("fold") == f)) for f in range(FOLDS)]).alias("b"))
        rows = (rows.join(counts, suffix)
                .withColumn(f"{suffix}_blocked", (others(F.col("b")) + SMOOTH / 2) / (others(F.col("n")) + SMOOTH))
                .withColumn(f"{suffix}_seen", F.log1p(others(F.col("n")))).drop("n", "b"))
    return rows.drop("fold")


def judge(pages: DataFrame, rules: list[Rule], sample: int = SAMPLE, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, block_probability) of every row; the last is the trees' opinion."""
    host, path = parsed(F.col(url_column))
    urls = pages.select(F.col(id_column), F.col(url_column).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = decided(rules)
    rows = store(lexical(urls.withColumns({"rule": rule, "verdict": verdict})).drop("url"))
    features = [*LEXICAL, *(f"{s}_{k}" for s in SUFFIXES for k in ("blocked", "seen"))]
    rich = with_suffix_statistics(rows)
    vectors = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    known = {r.verdict: r.n for r in rows.where("verdict IS NOT NULL").groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = [id_column, "host", "path", "rule"]
    if len(known) < 2:
        common = next(iter(known), "allow")
        return rows.select(*columns, F.coalesce("verdict", F.lit(common)).alias("verdict"), F.lit(float(common == "block")).alias("block_probability"))
    # Each label gives half of the sample, or all it has; weights bring its share of all labels back.
    shares = {v: min(1.0, sample / 2 / n) for v, n in known.items()}
    share = F.when(F.col("verdict") == "block", shares["block"]).otherwise(shares["allow"])
    place = F.pmod(F.xxhash64("host", "path", id_column, F.lit("sample")), F.lit(1 << 30))
    labelled = rich.where("verdict IS NOT NULL").select(
        (F.col("verdict") == "block").cast("double").alias("label"), (1 / share).alias("weight"), *features, place.alias("place"), share.alias("share"))
    learn = store(labelled.where(F.col("place") < F.col("share") * (1 << 30)))
    seen = {r.label for r in learn.select("label").distinct().collect()}
    for label in {0.0, 1.0} - seen:
        # All its rows lie beyond a small bound: its first ones in the order of the draw.
        learn = learn.unionByName(labelled.where(F.col("label") == label).orderBy("place").limit(LEAST))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=5, maxBins=64, weightCol="weight").fit(vectors.transform(learn))
    scored = trees.transform(vectors.transform(rich)).withColumn("block_probability", vector_to_array("probability")[1])
    own = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.select(*columns, F.coalesce("verdict", own).alias("verdict"), "block_probability")
