"""Checks of repository addresses."""

from __future__ import annotations

import ipaddress
import socket
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARS = 2048


class UnsafeGitUrlError(ValueError):
    """An address that must not be cloned."""


def host_address(host: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """The address that a host name spells, in any notation that resolvers take (10.1, 0x7f000001, 017700000001)."""
    try:
        return ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        pass
    try:
        return ipaddress.ip_address(socket.inet_aton(host))
    except (OSError, ValueError):
        return None


def blocked(address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    return any((address.is_private, address.is_loopback, address.is_link_local, address.is_reserved, address.is_multicast, address.is_unspecified))


def checked_git_url(url: str, allowed: set[str] | None = None) -> str:
    url = url.strip()
    if len(url) > MOST_CHARS or any(c in url for c in "\0\r\n\t "):
        raise UnsafeGitUrlError("malformed address")
    try:
        parts = urlsplit(url)
    except ValueError as e:  # what is in brackets is no address
        raise UnsafeGitUrlError("malformed address") from e
    if parts.scheme != "https":
        raise UnsafeGitUrlError("only https addresses are taken")
    if "@" in parts.netloc or not parts.hostname:
        raise UnsafeGitUrlError("an address needs a host and no credentials")
    address = host_address(parts.hostname)
    if address is not None and blocked(address):
        raise UnsafeGitUrlError("private addresses are not taken")
    if allowed is not None and parts.hostname.lower() not in {a.lower() for a in allowed}:
        raise UnsafeGitUrlError("the host isn't allowed")
    return url


# Ranges of addresses that are not public (first, last).
PRIVATE = [
    (network[0], network[-1])
    for network in map(
        ipaddress.IPv4Network,
        (
            "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
            "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
        ),
    )
]


PUBLIC = tuple(ipaddress.IPv4Address(a) for a in ("192.0.0.9", "192.0.0.10"))  # within them, yet public


def spelled_address(host: Column) -> Column:
    """The IPv4 address, as a number, that a host spells in any notation that resolvers take, or null.

    One to four parts, each decimal, octal (0...) or hexadecimal (0x...); the last one fills the bytes that are left.
    """
    whole = r"^(?:0[xX][0-9a-fA-F]{1,8}|[0-9]{1,12})$"

    def number(part: Column) -> Column:
        low = F.lower(part)
        value = (
            F.when(low.startswith("0x"), F.conv(F.substring(low, 3, 20), 16, 10))
            .when(low.rlike("^0[0-7]+$"), F.conv(low, 8, 10))
            .when(low.rlike("^(?:0|[1-9][0-9]*)$"), low)
        )
        return F.when(part.rlike(whole), value.cast("bigint"))

    def address(parts: Column) -> Column:
        n, last = F.size(parts), F.element_at(parts, -1)
        head = F.aggregate(F.slice(parts, 1, n - 1), F.lit(0).cast("bigint"), lambda a, x: F.when(x <= 255, a * 256 + x))
        room = F.when(n == 1, F.lit(1 << 32)).when(n == 2, F.lit(1 << 24)).when(n == 3, F.lit(1 << 16)).otherwise(F.lit(1 << 8)).cast("bigint")
        return F.when((n <= 4) & (last < room), head * room + last)

    parts = F.transform(F.split(host, r"\."), number)
    return F.get(F.transform(F.array(parts), address), F.lit(0))


# Ranges of 128-bit addresses that are not public (prefix, bits), and the public ones within them.
PRIVATE6 = (
    "::/8", "64:ff9b:1::/48", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/3", "6000::/3", "8000::/3", "a000::/3",
    "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
)
PUBLIC6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spelled_groups(host: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address as text (RFC 4291: groups, one ``::``, a dotted IPv4 address at the end), or
    null. A zone (``%eth0``) is left off."""
    none = F.array().cast("array<string>")

    def undotted(text: Column) -> Column:
        """With the two groups that a dotted address at the end stands for."""

        def pairs(parts: Column) -> Column:
            pair = lambda i: F.lower(F.hex(F.get(parts, F.lit(i)) * 256 + F.get(parts, F.lit(i + 1))))
            return F.when(F.forall(parts, lambda x: F.coalesce(x <= 255, F.lit(False))), F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), pair(0), F.lit(":"), pair(2)))

        dotted = F.split(F.regexp_extract(text, r":([0-9]+(?:\.[0-9]+){3})$", 1), r"\.")
        parts = F.transform(dotted, lambda x: F.when(x.rlike("^(?:0|[1-9][0-9]{0,2})$"), x.cast("int")))
        return F.when(text.contains("."), _let(parts, pairs)).otherwise(text)

    def groups(plain: Column) -> Column:
        def filled(x: Column) -> Column:
            missing = 8 - F.size(x["left"]) - F.size(x["right"])
            zeros = F.when(x["halves"] == 2, F.array_repeat(F.lit("0"), missing)).otherwise(none)
            whole = F.when(x["halves"] == 2, missing >= 1).otherwise((x["halves"] == 1) & (missing == 0))
            return F.when(whole, F.transform(F.concat(x["left"], zeros, x["right"]), lambda g: F.conv(g, 16, 10).cast("int")))

        half = lambda i: F.coalesce(F.filter(F.split(F.get(F.split(plain, "::"), F.lit(i)), ":"), lambda g: g != ""), none)
        shape = plain.rlike("^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$") & plain.contains(":")
        return F.when(shape, _let(F.struct(half(0).alias("left"), half(1).alias("right"), F.size(F.split(plain, "::")).alias("halves")), filled))

    return _let(_let(F.lower(F.regexp_replace(host, "%.+$", "")), undotted), groups)


def _within(groups: Column, network: str) -> Column:
    """Whether the first bits of an address are those of a network."""
    known = ipaddress.IPv6Network(network)
    first, bits, out = int(known[0]), known.prefixlen, F.lit(True)
    for i in range(8):
        some = min(16, max(0, bits - 16 * i))
        if some:
            mask = (0xFFFF << (16 - some)) & 0xFFFF
            out = out & (F.get(groups, F.lit(i)).bitwiseAND(F.lit(mask)) == (first >> (112 - 16 * i) & mask))
    return out


def private_number(number: Column) -> Column:
    """Whether an IPv4 address, as a number, is not public."""
    private = F.lit(False)
    for first, last in PRIVATE:
        private = private | number.between(int(first), int(last))
    return private & ~number.isin(*[int(a) for a in PUBLIC])


def private_groups(groups: Column) -> Column:
    """Whether an IPv6 address, as eight groups, is not public; mapped IPv4 addresses (::ffff:0:0/96) never are."""
    inside = F.lit(False)
    for network in PRIVATE6:
        inside = inside | _within(groups, network)
    for network in PUBLIC6:
        inside = inside & ~_within(groups, network)
    return inside


def looks_clonable(url: Column, allowed: list[str] | None = None) -> Column:
    """The check of an address for whole columns, without a look at name servers; ``allowed`` are the only hosts that pass, if any
    are given."""
    hosts = sorted({a.lower() for a in allowed or ()})

    def judged(x: Column) -> Column:
        bracketed = x["bracket"] != ""
        private = F.when(bracketed, _let(spelled_groups(x["bracket"]), private_groups)).otherwise(F.coalesce(_let(spelled_address(x["host"]), private_number), F.lit(False)))
        whole = bracketed | ~x["place"].rlike(r"[\[\]]")
        host = F.when(bracketed, F.lower(x["bracket"])).otherwise(x["host"])
        fine = whole & (host != "") & ~x["place"].contains("@") & ~private
        return fine & host.isin(hosts) if hosts else fine

    def parts(clean: Column) -> Column:
        def split(place: Column) -> Column:
            return _let(F.struct(place.alias("place"), F.regexp_extract(place, r"^\[([^\[\]]*)\][^\[\]]*$", 1).alias("bracket"), F.lower(F.substring_index(place, ":", 1)).alias("host")), judged)

        sane = (F.length(clean) <= MOST_CHARS) & ~clean.rlike(r"[\x00\r\n\t ]")
        return sane & _let(F.regexp_extract(clean, r"(?i)^https://([^/?#]*)", 1), split)

    return F.coalesce(_let(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), parts), F.lit(False))
