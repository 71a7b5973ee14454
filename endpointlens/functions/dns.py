"""DNS names, query types and answer lists."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import jtrim

# Query type numbers.
QUERY_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT",
               28: "AAAA", 33: "SRV", 64: "SVCB", 65: "HTTPS", 255: "ANY"}


def normalize_domain(c: Column) -> Column:
    return F.lower(F.regexp_replace(jtrim(c), r"\.+$", ""))


def is_reverse_name(name: Column) -> Column:
    return name.rlike(r"(^|\.)(in-addr|ip6)\.arpa$")


def query_type_label(raw: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in QUERY_TYPES.items() for x in kv])
    number = F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("int"))
    return F.coalesce(F.try_element_at(names, number), raw)


def _strip_answer_prefix(token: Column) -> Column:
    v = jtrim(token)
    rest = jtrim(F.substr(v, F.lit(6)))
    # "type: 5 name" keeps the name; "type: 5" keeps nothing; "type:5x" keeps all after "type:".
    named = F.regexp_extract(rest, r"(?s)^[0-9]+[ \t]+(.*)$", 1)
    stripped = (F.when(rest.rlike(r"^[0-9]+$"), F.lit(""))
                .when(rest.rlike(r"^[0-9]+[ \t]"), jtrim(named)).otherwise(rest))
    return F.when(F.lower(F.substring(v, 1, 5)) == "type:", stripped).otherwise(v)


def parse_answers(raw: Column) -> Column:
    """Answer list split on `;` and `,`; null when nothing is left."""
    parts = F.filter(F.transform(F.split(raw, "[;,]"), _strip_answer_prefix), lambda v: v != "")
    return F.when(F.size(parts) > 0, parts)
