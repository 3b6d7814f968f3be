"""IP addresses as sortable keys, and which of them are public.

An address becomes a fixed-width hex text (8 digits for IPv4, 32 for IPv6), so
that ranges of addresses are plain text comparisons in either family.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.text import with_captures

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEXTET = r"[0-9a-f]{1,4}"

# Networks that are private, loopback or reserved, and the parts
# of them that are public all the same.
NON_PUBLIC_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
PUBLIC_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
NON_PUBLIC_V6 = [
    # Reserved blocks of the address space.
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3",
    "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5",
    "f800::/6", "fe00::/9",
    # Private and special networks outside them.
    "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
]
PUBLIC_V6 = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
    "2001:20::/28", "2001:30::/28",
]


def with_ip_key(df: DataFrame, column: str, key: str = "key") -> DataFrame:
    """Add the hex key of the address in ``column``, NULL for a text that is none.

    Reads IPv6 with ``::`` and with a dotted tail; a zone such as ``%eth0`` is
    cut off. Each step is computed once per row, as the next uses it many times.
    """
    keep = df.columns
    text = F.regexp_replace(F.lower(F.col(column)), r"(:.*)%.+\z", "$1")
    steps = with_captures(df, "_text", F.coalesce(text, F.lit("")))
    # The dotted part: a whole IPv4 address, or the tail of an IPv6 one.
    dotted = F.regexp_extract("_text", rf"(?:\A|:)({_IPV4})\z", 1)
    steps = with_captures(
        steps, "_quad", F.struct(F.length(dotted).alias("n"), F.split(dotted, r"\.", -1).alias("o"))
    )
    octet = F.col("_quad")["o"]
    digits = [F.lpad(F.hex(F.get(octet, F.lit(i)).try_cast("bigint")), 2, "0") for i in range(4)]
    steps = with_captures(steps, "_hex", F.lower(F.concat(*digits)))
    head = F.substring(F.col("_text"), F.lit(1), F.length("_text") - F.col("_quad")["n"])
    full = F.when(
        F.col("_hex").isNotNull(),
        F.concat(head, F.substring("_hex", 1, 4), F.lit(":"), F.substring("_hex", 5, 4)),
    ).otherwise(F.col("_text"))
    steps = with_captures(steps, "_full", full)
    # `a::b` is two lists with zeros between; without `::` there is one list of eight.
    group = rf"{_HEXTET}(?::{_HEXTET})*"
    shape = rf"\A(?:{group}|(?:{group})?::(?:{group})?)\z"
    ends = F.when(
        F.col("_text").contains(":") & F.col("_full").rlike(shape), F.split("_full", "::", 2)
    )
    steps = with_captures(steps, "_ends", ends)

    def hextets(i: int) -> Column:
        part = F.nullif(F.get("_ends", F.lit(i)), F.lit(""))
        return F.coalesce(F.split(part, ":", -1), F.array().cast("array<string>"))

    steps = with_captures(steps, "_lists", F.struct(hextets(0).alias("l"), hextets(1).alias("r")))
    left, right = F.col("_lists")["l"], F.col("_lists")["r"]
    missing = 8 - F.size(left) - F.size(right)
    fits = F.when(F.size("_ends") == 2, missing >= 1).otherwise(missing == 0)
    hextet_list = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    v6 = F.array_join(F.transform(hextet_list, lambda h: F.lpad(h, 4, "0")), "")
    value = F.when(F.col("_ends").isNotNull(), F.when(fits, v6)).otherwise(
        F.when(~F.col("_text").contains(":"), F.col("_hex"))
    )
    return with_captures(steps, "_key", value).select(*keep, F.col("_key").alias(key))


def network_range(cidr: str) -> tuple[str, str]:
    """First and last address of a network as hex keys."""
    network = ipaddress.ip_network(cidr)
    width = network.max_prefixlen // 4
    first, last = int(network.network_address), int(network.broadcast_address)
    return f"{first:0{width}x}", f"{last:0{width}x}"


def _inside(key: Column, networks: list[str]) -> Column:
    found = F.lit(False)
    for network in networks:
        found = found | key.between(*network_range(network))
    return found


def is_public_key(key: Column) -> Column:
    """Whether the address of a hex key is public; false for NULL."""
    v4 = ~_inside(key, NON_PUBLIC_V4) | _inside(key, PUBLIC_V4)
    v6 = ~_inside(key, NON_PUBLIC_V6) | _inside(key, PUBLIC_V6)
    return F.coalesce(F.when(F.length(key) == 8, v4).otherwise(v6), F.lit(False))


def with_public(df: DataFrame, column: str, name: str = "public") -> DataFrame:
    """Add whether ``column`` is a valid address, neither private, loopback nor reserved."""
    keyed = with_ip_key(df, column, "_address")
    return keyed.withColumn(name, is_public_key(F.col("_address"))).drop("_address")
