"""Geolocation: IP addresses joined to a table of networks.

A network table has ``lo`` and ``hi`` (hex keys of ``functions.addresses``) and
``country``, ``country_code``, ``city``. Networks must not overlap, as in
published geolocation tables.

The range join becomes an equi join on address prefixes. A network is cut into
blocks that each hold all addresses of one prefix of hex digits: one for most networks,
and never more than 30 a digit. An address asks for its prefixes of the lengths that
the table has, and finds the one block that holds it, however many networks lie close by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions import predicates as P
from logweir.functions.addresses import is_public_key, with_ip_key
from logweir.functions.text import with_captures
from logweir.operators.topn import top_ips

_PLACE = ["country", "country_code", "city"]

_DIGITS = "0123456789abcdef"


def networks_from_ranges(ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Network table from IPv4 ranges given as numbers."""

    def key(column: str) -> Column:
        return F.lpad(F.lower(F.hex(F.col(column).cast("bigint"))), 8, "0")

    return ranges.select(key(lo).alias("lo"), key(hi).alias("hi"), *_PLACE)


def networks_from_cidr(blocks: DataFrame, network: str = "network") -> DataFrame:
    """Network table from CIDR texts such as ``2.125.160.216/29`` of either family."""
    cidr = F.split(F.col(network), "/", 2)
    parts = blocks.select(
        F.get(cidr, F.lit(0)).alias("address"),
        F.get(cidr, F.lit(1)).try_cast("int").alias("length"),
        *_PLACE,
    )
    parsed = with_ip_key(parts, "address").where(
        F.col("key").isNotNull() & F.col("length").between(0, F.length("key") * 4)
    )
    # Whole digits of the prefix stay; the next one is split; the rest is free.
    whole = F.floor(F.col("length") / 4).cast("int")
    step = F.pow(F.lit(2), 4 - F.col("length") % 4).cast("int")
    digit = F.conv(F.substring("key", whole + 1, F.lit(1)), 16, 10).cast("int")
    low = (digit - digit % step).cast("bigint")
    high = (low + step - 1).cast("bigint")

    def bound(split_digit: Column, fill: str) -> Column:
        start = F.concat(
            F.substring("key", F.lit(1), whole),
            F.when(whole < F.length("key"), F.lower(F.hex(split_digit))).otherwise(""),
        )
        return F.rpad(start, F.length("key"), F.lit(fill))

    return parsed.select(bound(low, "0").alias("lo"), bound(high, "f").alias("hi"), *_PLACE)


def _family(key: Column) -> Column:
    return F.when(F.length(key) == 8, "4").otherwise("6")


def _prefix(key: Column, digits: Column) -> Column:
    return F.concat(_family(key), F.lit(":"), F.substring(key, F.lit(1), digits))


def _digit(key: Column, place: Column) -> Column:
    """The number of a hex digit, by its place from 0."""
    return F.instr(F.lit(_DIGITS), F.substring(key, place + 1, F.lit(1))) - 1


def _span(prefix: Column, first: Column, last: Column) -> Column:
    """The prefixes one digit longer, from one digit to another; none if they are out of order."""
    longer = F.transform(
        F.sequence(first, F.greatest(first, last)),
        lambda d: F.concat(prefix, F.substring(F.lit(_DIGITS), d + 1, F.lit(1))),
    )
    return F.when(first <= last, longer).otherwise(F.array().cast("array<string>"))


def _places(first: Column, last: Column) -> Column:
    """Places of digits from one to another, in order; none if they are out of order."""
    return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))


def _blocks(lo: Column, hi: Column) -> Column:
    """The prefixes whose addresses are exactly those from lo to hi."""
    n = F.length(lo)
    differ = F.array_position(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(lo, i, F.lit(1)) != F.substring(hi, i, F.lit(1))), F.lit(True)
    )
    common = F.when(differ > 0, differ.cast("int") - 1).otherwise(n)
    # Digits behind these places do not cut a prefix: they are all the first, or all the last.
    low_end = F.length(F.rtrim(lo, F.lit("0"))) - 1
    high_end = F.length(F.rtrim(hi, F.lit("f"))) - 1
    head = F.substring(lo, F.lit(1), common)

    def above(p: Column) -> Column:
        return _span(F.substring(lo, F.lit(1), p), _digit(lo, p) + F.when(p < low_end, 1).otherwise(0), F.lit(15))

    def below(p: Column) -> Column:
        return _span(F.substring(hi, F.lit(1), p), F.lit(0), _digit(hi, p) - F.when(p < high_end, 1).otherwise(0))

    low = F.flatten(F.transform(_places(common + 1, low_end), above))
    high = F.flatten(F.transform(_places(common + 1, high_end), below))
    start = _digit(lo, common) + F.when(low_end > common, 1).otherwise(0)
    end = _digit(hi, common) - F.when(high_end > common, 1).otherwise(0)
    whole = (common == n) | ((start == 0) & (end == 15))
    between = F.when(whole, F.array(head)).otherwise(_span(head, start, end))
    return F.concat(low, between, high)


def _filed(networks: DataFrame) -> DataFrame:
    """(prefix, place) of each block of each network; the family stands before the prefix."""
    ends = networks.where((F.length("lo") == F.length("hi")) & (F.col("lo") <= F.col("hi")))
    blocks = with_captures(ends, "blocks", _blocks(F.col("lo"), F.col("hi")))
    cut = blocks.select(_family(F.col("lo")).alias("family"), F.explode("blocks").alias("digits"), *_PLACE)
    return cut.select(F.concat("family", F.lit(":"), "digits").alias("prefix"), "family", F.length("digits").alias("n"), *_PLACE)


def _asking(keyed: DataFrame, filed: DataFrame) -> DataFrame:
    """Each address with its prefixes of the lengths in use: at most 8, or 32."""
    used = filed.agg(F.collect_set(F.struct("family", "n"))).scalar()
    each = keyed.withColumn("used", used).select("ip", "key", F.explode("used").alias("used"))
    own = each.where(F.col("used.family") == _family(F.col("key")))
    return own.select("ip", _prefix(F.col("key"), F.col("used.n")).alias("prefix"))


def locate(ips: DataFrame, networks: DataFrame) -> DataFrame:
    """Place of each public address in ``ips``; others and unknown ones give no row."""
    keyed = with_ip_key(ips.select("ip"), "ip").where(is_public_key(F.col("key")))
    filed = _filed(networks)
    return _asking(keyed, filed).join(filed, "prefix").select(
        "ip", *_PLACE, F.lit(None).cast("string").alias("isp")
    )


def geo(
    entries: DataFrame, networks: DataFrame, ips: str = "top", n: int = 10
) -> DataFrame:
    """Places of the ``top`` n IPs of the entries, or of ``all`` of them."""
    if ips == "top":
        chosen = top_ips(entries, n).select("ip")
    elif ips == "all":
        chosen = entries.where(P.has("ip")).select("ip").distinct()
    else:
        raise ValueError(f"Unknown ips '{ips}'. Available: all, top")
    return locate(chosen, networks)
