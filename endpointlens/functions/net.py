"""IP address text: validity, canonical form and public/private classes."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import jtrim

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"


def is_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^{_V4}$"), F.lit(False))


def ipv4_number(c: Column) -> Column:
    parts = F.split(c, r"\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.get(parts, F.lit(i)).try_cast("long")
    return F.when(is_ipv4(c), value)


_H = "[0-9a-f]{1,4}"
_V6 = "^(?:" + "|".join(
    [f"(?:{_H}:){{7}}{_H}", f"(?:{_H}:){{1,7}}:", f":(?::{_H}){{1,7}}", "::"]
    + [f"(?:{_H}:){{1,{7 - n}}}(?::{_H}){{1,{n}}}" for n in range(1, 7)]) + ")$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value that `body` uses many times, so that it is evaluated and planned once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ipv6(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(c), rf"(?<=:){_V4}$", "0:0")
    return F.coalesce(F.contains(c, F.lit(":")) & plain.rlike(_V6), F.lit(False))


def _v6_groups(c: Column) -> Column:
    """Eight numbers of a valid IPv6 text."""
    def hex_tail(s: Column) -> Column:
        number = ipv4_number(F.regexp_extract(s, rf"({_V4})$", 1))
        return F.concat(F.regexp_replace(s, rf"{_V4}$", ""), F.concat_ws(
            ":", F.hex(F.shiftright(number, 16)), F.hex(number % 65536)))

    def numbers(s: Column) -> Column:
        def side(i):
            return F.filter(F.split(F.coalesce(F.get(F.split(s, "::"), F.lit(i)), F.lit("")), ":"),
                            lambda g: g != "")

        zeros = F.array_repeat(F.lit("0"), F.greatest(
            F.lit(8) - F.size(side(0)) - F.size(side(1)), F.lit(0)))
        return F.transform(F.concat(side(0), zeros, side(1)),
                           lambda g: F.conv(g, 16, 10).cast("int"))

    text = F.when(c.rlike(rf"{_V4}$"), _let(c, hex_tail)).otherwise(c)
    return _let(text, numbers)


def _is_mapped(g: Column) -> Column:
    return (F.aggregate(F.slice(g, 1, 5), F.lit(0), lambda x, v: x + v) == 0) & (
        F.get(g, F.lit(5)) == 65535)


def _v4_of_mapped(g: Column) -> Column:
    high, low = F.get(g, F.lit(6)), F.get(g, F.lit(7))
    return F.concat_ws(".", F.shiftright(high, 8), high % 256, F.shiftright(low, 8), low % 256)


def _compress(groups: Column) -> Column:
    """Lower-case hex with the longest run of zero groups (leftmost on ties) written `::`."""
    def cut(full: Column) -> Column:
        out = full
        for run in range(2, 9):            # the longest matching run wins, so it is tested last
            zero = r"(?:^|:)0" + r"(?::0)" * (run - 1) + r"(?:$|:)"
            out = F.when(full.rlike(zero), F.regexp_replace(full, rf"^(.*?){zero}(.*)$",
                                                            "$1::$2")).otherwise(out)
        return out

    return _let(F.array_join(F.transform(groups, lambda g: F.lower(F.hex(g))), ":"), cut)


def canonical_ip(c: Column) -> Column:
    """Plain text form of an address, mapped IPv6 as IPv4; null when it is no address."""
    six = _let(_v6_groups(c), lambda g: F.when(_is_mapped(g), _v4_of_mapped(g)).otherwise(
        _compress(g)))
    return F.when(is_ipv4(c), c).when(is_ipv6(c), six)


def ip_key(c: Column) -> Column:
    """32 hex digits that sort like the address; IPv4 counts as its mapped IPv6 address."""
    four = F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.lower(F.hex(ipv4_number(c))), 8, "0"))
    six = F.array_join(F.transform(_v6_groups(c), lambda g: F.lpad(F.lower(F.hex(g)), 4, "0")), "")
    return F.when(is_ipv4(c), four).when(is_ipv6(c), six)


def flow_ip(c: Column) -> Column:
    """Canonical address of a flow key, brackets removed."""
    return canonical_ip(F.regexp_replace(jtrim(c), r"^\[|\]$", ""))


def is_ip(c: Column) -> Column:
    return is_ipv4(c) | is_ipv6(c)


# Address blocks that are not public.
_HIDDEN_V4 = (r"^(?:127\.|10\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\."
              r"|2(?:2[4-9]|3[0-9])\.|0\.0\.0\.0$)")


def _v6_public(g: Column) -> Column:
    top = F.get(g, F.lit(0))
    leading = F.aggregate(F.slice(g, 1, 7), F.lit(0), lambda x, v: x + v)
    hidden = (((leading == 0) & (F.get(g, F.lit(7)) <= 1)) | top.between(0xFE80, 0xFEFF)
              | top.between(0xFC00, 0xFDFF) | (top >= 0xFF00))
    return F.when(_is_mapped(g), ~_v4_of_mapped(g).rlike(_HIDDEN_V4)).otherwise(~hidden)


def is_public_ip(c: Column) -> Column:
    """Numeric address that is none of loopback, link/site local, any, multicast or ULA."""
    s = jtrim(c)
    return F.coalesce(F.when(is_ipv4(s), ~s.rlike(_HIDDEN_V4)).when(
        is_ipv6(s), _let(_v6_groups(s), _v6_public)), F.lit(False))


def positive_int(c: Column) -> Column:
    """Positive whole number, otherwise null."""
    n = jtrim(c).try_cast("int")
    return F.when(jtrim(c).rlike(r"^[+]?[0-9]+$") & (n > 0), n)


def port(c: Column) -> Column:
    n = positive_int(c)
    return F.when(n <= 65535, n)
