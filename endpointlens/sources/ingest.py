"""Raw event batches -> validated, tenant-tagged events."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import is_blank, jtrim, nz
from ..schema import EVENT_TYPES, MAX_SKEW_MS, MIN_PLAUSIBLE_MS

ACCEPTED = "accepted"
_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def authenticate(batches: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, rejected): batches joined to the node whose key hash they carry."""
    hashed = batches.withColumn("node_key_hash", F.when(
        ~is_blank(F.col("node_key")), F.sha2("node_key", 256)))
    node = nodes.select("node_key_hash", "tenant_id", F.col("host").alias("node_host"))
    known = hashed.join(node, "node_key_hash").drop("node_key_hash", "node_key")
    rejected = hashed.join(node, "node_key_hash", "left_anti").drop("node_key_hash")
    return known, rejected


def _field(name: str) -> Column:
    return F.try_variant_get(F.col("event"), f"$.{name}", "variant")


def _text(name: str) -> Column:
    """JSON value as text; containers read as empty, null and absent as null."""
    v = _field(name)
    container = F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")
    return F.when(container, F.lit("")).otherwise(F.try_variant_get(v, "$", "string"))


def lenient_long(v: Column, type_: str = "bigint") -> Column:
    """A number, or text holding a whole number; anything else is null."""
    kind = F.schema_of_variant(v)
    text = jtrim(F.try_variant_get(v, "$", "string"))
    return (F.when(kind.rlike(_NUMBER), F.try_variant_get(v, "$", type_))
            .when(kind.startswith("STRING") & text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(type_)))


def normalize_sha256(c: Column) -> Column:
    t = jtrim(c)
    return F.when(t.rlike("^[0-9a-fA-F]{64}$"), F.lower(t)).otherwise(F.lit(""))


def explode_batches(batches: DataFrame, body: str = "body") -> DataFrame:
    """One row per element of the `events` array; `event` is null where it is no object."""
    events = F.try_variant_get(F.try_parse_json(F.col(body)), "$.events", "array<variant>")
    rows = batches.select(*[c for c in batches.columns if c != body],
                          F.posexplode(events).alias("pos", "event"))
    is_object = F.schema_of_variant("event").startswith("OBJECT")
    return rows.withColumn("event", F.when(is_object, F.col("event")))


def validate(rows: DataFrame, now: int) -> DataFrame:
    """Event columns plus `outcome`: accepted, or the first reason to reject."""
    v = rows.where(F.col("event").isNotNull()).select(
        *[c for c in rows.columns if c != "event"],
        _text("host").alias("host"), _text("type").alias("type"),
        lenient_long(_field("ts")).alias("_ts"), _text("process").alias("process"),
        _text("parent").alias("parent"), _text("cmdline").alias("cmdline"),
        _text("destIp").alias("dest_ip"),
        F.coalesce(lenient_long(_field("destPort"), "int"), F.lit(0)).alias("dest_port"),
        _text("domain").alias("domain"), _text("detail").alias("detail"),
        _text("sha256").alias("sha256"))
    t = F.col("type")
    outcome = (F.when(is_blank(F.col("host")), "no_host")
               .when(~F.coalesce(t.isin(*EVENT_TYPES), F.lit(False)), "unknown_type")
               .when(F.col("_ts").isNull() | (F.col("_ts") <= 0), "bad_ts")
               .when(F.col("_ts") < MIN_PLAUSIBLE_MS, "ts_in_seconds")
               .when((t == "network") & is_blank(F.col("dest_ip")), "no_dest_ip")
               .when(t.isin("dns", "l7") & is_blank(F.col("domain")), "no_domain")
               .otherwise(ACCEPTED))
    clamped = F.when(F.col("_ts") > now + MAX_SKEW_MS, F.lit(now).cast("long")).otherwise(
        F.col("_ts"))
    texts = ["process", "parent", "cmdline", "dest_ip", "domain", "detail"]
    return (v.withColumn("outcome", outcome).withColumn("ts", clamped)
            .withColumns({c: nz(F.col(c)) for c in texts})
            .withColumn("sha256", normalize_sha256(F.col("sha256"))).drop("_ts"))


def ingest(batches: DataFrame, nodes: DataFrame, now: int,
           counts: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) events of known nodes; the node's tenant overrides any supplied one.

    `counts` collects accepted and dropped rows while a sink consumes the accepted ones.
    """
    known, _ = authenticate(batches, nodes)
    judged = validate(explode_batches(known), now)
    if counts is not None:
        judged = judged.observe(counts,
                                F.count_if(F.col("outcome") == ACCEPTED).alias("accepted"),
                                F.count_if(F.col("outcome") != ACCEPTED).alias("dropped"))
    accepted = judged.where(F.col("outcome") == ACCEPTED).drop("outcome")
    return accepted, judged.where(F.col("outcome") != ACCEPTED)
