"""Personal data by weak supervision, with DataFrame operations only.

Four detectors give the base spans: e-mail addresses, IPv4 addresses, payment cards and phone
numbers. They always stay. The method adds credentials and phone numbers without a plus sign:
every long token with a digit, and every grouped number of ten digits, outside the base spans is a candidate.
Labelers vote for or against it, or abstain: patterns of the value, a gazetteer of words that name a
secret or a phone before it, and the signs around it. Expectation-maximisation over the counts of all vote
patterns estimates how reliable each labeler is; a logistic regression, trained with the resulting
posteriors on votes and the value's own features, is the final span classifier.

Each detector is one regular-expression pass that yields the matches and the gaps between them;
their lengths give the offsets, in code points. The expressions are possessive and may only
begin where a run begins or where the last match ended, which finds the same matches without ever
trying a long run twice.

Defined cases: a null text counts as empty; a text without candidates adds nothing; repeated rows
are judged alike; if no text has a candidate, only base spans are found. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
CANDIDATE = r"(?<![A-Za-z0-9_+/@.-])(?:(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{8,}+|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![A-Za-z0-9_@])"
#: Words that stand before a secret, and before a phone number.
SECRET_WORDS = "password|passwd|passphrase|pwd|token|secret|apikey|api_key|api-key|access_key|auth|credential|private_key"
PHONE_WORDS = "phone|tel|telephone|mobile|cell|fax|call|telefon|teléfono|téléphone|portable|handy"
#: Characters of context before a span, spans to train the classifier on (expected number, by hash), rounds of EM.
CONTEXT, SAMPLE, ROUNDS = 32, 50_000, 40
#: What the estimates are smoothed by, in spans.
SMOOTH = 1.0


def spans(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern as (kind, begin, end, value), in order."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("value")), lambda p: p["value"].isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<kind:int,begin:bigint,end:bigint,value:string>>").alias("found"))

    def move(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.char_length(pair["gap"])
        end = begin + F.char_length(pair["value"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("begin"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    return F.aggregate(pairs, start, move, lambda state: state["found"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def number_of_digits(value: Column, low: int, high: int) -> Column:
    return F.char_length(digits(value)).between(low, high)


def base_spans(text: Column) -> Column:
    """Base spans by kind and place; a detector only runs over texts with a sign it needs."""
    none = F.array().cast("array<struct<kind:int,begin:bigint,end:bigint,value:string>>")
    has = lambda sign: F.instr(text, sign) > 0
    email = F.when(has("@"), spans(text, EMAIL, 0)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(spans(text, IP, 1), lambda s: s["value"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))).otherwise(none)
    card = F.when(text.rlike("[0-9][ -]?[0-9]"), F.filter(spans(text, CARD, 2), lambda s: number_of_digits(s["value"], 16, 19) & F.call_function(
        "luhn_check", digits(s["value"])))).otherwise(none)
    phone = F.when(has("+"), F.filter(spans(text, PHONE, 3), lambda s: number_of_digits(s["value"], 8, 15))).otherwise(none)
    return F.concat(email, ip, card, phone)


@dataclass(frozen=True)
class Labeler:
    """Votes 1 for, -1 against and 0 to abstain; `vote` is SQL over value, before and after."""
    name: str
    vote: str


LABELERS = (
    Labeler("hex", "CASE WHEN value RLIKE '^[0-9a-f]{12,}$' AND value RLIKE '[a-f]' THEN 1 WHEN value RLIKE '^[0-9]+$' THEN -1 ELSE 0 END"),
    Labeler("mixed", "CASE WHEN value RLIKE '[a-z]' AND value RLIKE '[A-Z]' AND value RLIKE '[0-9].*[0-9]' THEN 1 "
                     "WHEN value RLIKE '^[A-Za-z]+[0-9]{1,3}$' THEN -1 ELSE 0 END"),
    Labeler("grouped", r"CASE WHEN value RLIKE '^\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}$' THEN 1 WHEN value RLIKE '^[0-9/-]+$' THEN -1 ELSE 0 END"),
    Labeler("gazetteer", rf"CASE WHEN before RLIKE '(?i)(?:{SECRET_WORDS}|{PHONE_WORDS})s?[\\s:=>\\x22\\x27.]*$' THEN 1 ELSE -1 END"),
    Labeler("signs", r"CASE WHEN before RLIKE '[=:]\\s*[\\x22\\x27]?$' THEN 1 WHEN before RLIKE '[A-Za-z],?\\s$' THEN -1 ELSE 0 END"),
    Labeler("length", "CASE WHEN char_length(value) >= 16 THEN 1 WHEN char_length(value) < 10 THEN -1 ELSE 0 END"),
)
FEATURES = ("digit_ratio", "size", "distinct_ratio")


def candidates(text: Column, base: Column) -> Column:
    """Candidate spans outside the base spans, with their votes and features."""
    found = F.when(text.rlike(r"[0-9]"), spans(text, CANDIDATE, 4)).otherwise(
        F.array().cast("array<struct<kind:int,begin:bigint,end:bigint,value:string>>"))
    free = F.filter(found, lambda c: ~F.exists(base, lambda b: (b["begin"] < c["end"]) & (c["begin"] < b["end"])))
    return F.transform(free, lambda c: F.struct(
        c["begin"].alias("begin"), c["end"].alias("end"), c["value"].alias("value"),
        F.substring(text, F.greatest(F.lit(1), c["begin"] - CONTEXT + 1).cast("int"),
                    F.least(F.lit(CONTEXT), c["begin"]).cast("int")).alias("before")))


def judged(found: DataFrame, array: str) -> DataFrame:
    """Adds votes and features to every span of an array column."""
    votes = ", ".join(f"'{x.name}', {x.vote}" for x in LABELERS)
    size = "char_length(value)"
    exact = (f"'digit_ratio', char_length(regexp_replace(value, '[^0-9]', '')) / {size}, 'size', least({size}, 64) / 64, "
             f"'distinct_ratio', size(array_distinct(split(value, ''))) / {size}")
    inner = f"named_struct('begin', c.begin, 'end', c.end, 'value', c.value, {votes}, {exact})"
    for name in ("value", "before"):
        inner = _qualified(inner, name)
    return found.withColumn(array, F.expr(f"transform({array}, c -> {inner})"))


def _qualified(sql: str, name: str) -> str:
    """The bare name as a field of the lambda's variable c."""
    out, quoted = [], False
    for part in sql.split("'"):
        out.append(part if quoted else _swap(part, name))
        quoted = not quoted
    return "'".join(out)


def _swap(part: str, name: str) -> str:
    return re.sub(rf"(?<![.\w]){name}\b", f"c.{name}", part)


@dataclass
class Reliabilities:
    """Share of true spans and, for each labeler, how it votes on true and on false ones."""
    share: float
    given: dict[str, dict[int, tuple[float, float]]] = field(default_factory=dict)

    def posterior(self, votes: dict[str, int]) -> float:
        odds = math.log(self.share / (1 - self.share)) + sum(
            math.log(self.given[n][v][0] / self.given[n][v][1]) for n, v in votes.items())
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def estimate(patterns: list[tuple[dict[str, int], int]], rounds: int = ROUNDS) -> Reliabilities:
    """Expectation-maximisation over vote patterns and their counts (at most 3 ** labelers)."""
    names = [x.name for x in LABELERS]
    # To begin with, every labeler is more often right than wrong.
    start = {1: (0.5, 0.1), 0: (0.3, 0.4), -1: (0.2, 0.5)}
    model = Reliabilities(0.3, {n: dict(start) for n in names})
    for _ in range(rounds):
        weights = [(votes, n, model.posterior(votes)) for votes, n in patterns]
        true, total = sum(n * p for _, n, p in weights), sum(n for _, n, _ in weights)
        given = {}
        for name in names:
            given[name] = {v: (
                (sum(n * p for votes, n, p in weights if votes[name] == v) + SMOOTH) / (true + 3 * SMOOTH),
                (sum(n * (1 - p) for votes, n, p in weights if votes[name] == v) + SMOOTH) / (total - true + 3 * SMOOTH))
                for v in (-1, 0, 1)}
        model = Reliabilities(min(0.99, max(0.01, (true + SMOOTH) / (total + 2 * SMOOTH))), given)
    return model


def classifier(found: DataFrame, sample: int = SAMPLE) -> str | None:
    """SQL of the log-odds that a candidate c is personal data; None without candidates."""
    names = [x.name for x in LABELERS]
    each = found.select(F.explode("candidates").alias("c")).select("c.*")
    patterns = [({n: r[n] for n in names}, r["count"]) for r in each.groupBy(*names).count().collect()]
    if not patterns:
        return None
    model = estimate(patterns)
    total = sum(n for _, n in patterns)
    share = int(min(1.0, sample / total) * (1 << 30))
    odds = F.lit(math.log(model.share / (1 - model.share)))
    for n in names:
        ratio = {v: math.log(a / b) for v, (a, b) in model.given[n].items()}
        odds = odds + F.when(F.col(n) == 1, ratio[1]).when(F.col(n) == -1, ratio[-1]).otherwise(ratio[0])
    posterior = 1 / (1 + F.exp(-odds))
    drawn = store(each.where(F.pmod(F.xxhash64("value", "begin"), F.lit(1 << 30)) < share).select(
        *[F.col(n).cast("double") for n in names], *FEATURES, posterior.alias("p")))
    columns = [*names, *FEATURES]
    both = drawn.select(*columns, F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(
        F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("y")).select(*columns, "y.label", "y.weight")
    if drawn.isEmpty():
        return None
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(both)
    fit = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50).fit(vectors)
    terms = " + ".join(f"({w!r}D) * c.{n}" for n, w in zip(columns, fit.coefficients.toArray().tolist()))
    return f"({float(fit.intercept)!r}D) + {terms}"


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, base, added): base spans and those the method adds, by kind and place."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column), text.alias("text"))
    based = rows.withColumn("base", base_spans(F.col("text")))
    found = store(judged(based.withColumn("candidates", candidates(F.col("text"), F.col("base"))), "candidates")
                  .select(id_column, F.transform("base", lambda s: s.dropFields("value")).alias("base"), "candidates"))
    odds = classifier(found)
    kind = "CASE WHEN c.grouped = 1 THEN 3 ELSE 4 END"
    none = F.array().cast("array<struct<kind:int,begin:bigint,end:bigint>>")
    added = none if odds is None else F.expr(
        f"transform(filter(candidates, c -> {odds} > 0), c -> named_struct('kind', {kind}, 'begin', c.begin, 'end', c.end))")
    return found.select(id_column, "base", added.alias("added"))


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans, and all spans as text."""
    def listed(array: Column) -> Column:
        kinds = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["begin"], s["end"])), ",")

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select(id_column, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
