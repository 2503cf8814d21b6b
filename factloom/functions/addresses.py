"""Network addresses: which may be fetched from, and the one that is.

An address is a key: its family and its number in hexadecimal digits, so that keys of a family order as numbers do. What
is not of the public internet is a table of ranges of keys, and a look-up in it is a comparison; all of it is JVM
expressions.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks that are not of the public internet, and the parts of them that are.
NOT_PUBLIC = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
PUBLIC_INSIDE = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
#: IPv6 addresses that stand for one of IPv4: these digits and then its eight.
MAPPED = "0" * 20 + "ffff"


def _range(block: str) -> tuple[str, str]:
    """First and last key of a block."""
    net = ipaddress.ip_network(block)
    digits = net.max_prefixlen // 4
    return tuple(f"{net.version}{int(a):0{digits}x}" for a in (net[0], net[-1]))


def _let(value: Column, use: object) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _within(key: Column, blocks: tuple[str, ...]) -> Column:
    """Whether a key lies in one of the blocks, which are ranges in their order."""
    ranges = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in sorted(map(_range, blocks))])
    return F.exists(ranges, lambda r: (key >= r["lo"]) & (key <= r["hi"]))


def _digits4(address: Column) -> Column:
    """The eight hexadecimal digits of an IPv4 address in the usual spelling (four numbers up to 255 without leading
    zeros); null if it is none."""
    octets = F.transform(F.split(address, r"\."), lambda o: o.cast("int"))
    spelled = address.rlike(r"\A(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})\z")
    return F.when(spelled, _let(octets, lambda os: F.when(F.forall(os, lambda o: o <= 255), F.lower(F.array_join(F.transform(os, lambda o: F.lpad(F.hex(o.cast("bigint")), 2, "0")), "")))))


def _digits6(address: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address: eight groups of up to four, of which "::" stands for one or more zeros
    once, and the last two may be spelled as IPv4; a zone behind "%" says nothing. Null if it is none."""
    bare = F.lower(F.regexp_replace(address, r"%[^%]+\z", ""))
    tail = F.regexp_extract(bare, r":([0-9.]+\.[0-9.]+)\z", 1)
    as_groups = lambda d: F.concat(F.left(bare, F.length(bare) - F.length(tail)), F.left(d, F.lit(4)), F.lit(":"), F.right(d, F.lit(4)))
    plain = F.when(tail == "", bare).otherwise(_let(_digits4(tail), as_groups))

    def filled(text: Column) -> Column:
        groups = lambda part: F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))
        halves = F.split(text, "::")
        both = F.struct(groups(halves[0]).alias("a"), F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("b"), F.size(halves).alias("n"))

        def joined(x: Column) -> Column:
            missing = 8 - F.size(x["a"]) - F.size(x["b"])
            fits = ((x["n"] == 1) & (missing == 0)) | ((x["n"] == 2) & (missing >= 1))
            sound = F.forall(F.concat(x["a"], x["b"]), lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
            padded = lambda part: F.array_join(F.transform(part, lambda g: F.lpad(g, 4, "0")), "")
            return F.when(fits & sound, F.concat(padded(x["a"]), F.repeat(F.lit("0000"), missing), padded(x["b"])))

        return _let(both, joined)

    return F.when(address.contains(":"), _let(plain, filled))


def address_key(address: Column) -> Column:
    """The key of an address, "4" or "6" and its digits; an IPv6 address that stands for one of IPv4 has that one's. Null
    for what is no address."""

    def of(d: Column) -> Column:
        return F.when(d["v4"].isNotNull(), F.concat(F.lit("4"), d["v4"])).when(F.left(d["v6"], F.lit(24)) == MAPPED, F.concat(F.lit("4"), F.right(d["v6"], F.lit(8)))).otherwise(F.concat(F.lit("6"), d["v6"]))

    return _let(F.struct(_digits4(address).alias("v4"), _digits6(address).alias("v6")), of)


def is_public(address: Column) -> Column:
    """Whether an address is one of the public internet; what is no address, or null, is not."""
    return F.coalesce(_let(address_key(address), lambda key: key.isNotNull() & (~_within(key, NOT_PUBLIC) | _within(key, PUBLIC_INSIDE))), F.lit(False))


def all_public(addresses: Column) -> Column:
    return F.coalesce((F.size(addresses) > 0) & F.forall(addresses, is_public), F.lit(False))


def resolution_code(addresses: Column) -> Column:
    """Why a host with these addresses is not fetched: null addresses were not resolved, and one address that is not
    public, or none at all, makes the target private. Null if it may be fetched."""
    return F.when(addresses.isNull(), "DNS_FAILED").when(~all_public(addresses), "PRIVATE_TARGET")


def chosen_address(addresses: Column) -> Column:
    """The first address in the order of their spelling, of a host that may be fetched."""
    return F.when(resolution_code(addresses).isNull(), F.array_min(addresses))
