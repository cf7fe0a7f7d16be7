"""URL, host and address expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docwarden import terms
from docwarden.functions.text import java_quote

URL = r"(?iU)https?://[^\s\"'<>]+"
UNSAFE_URI = r"(?iU)(?-U:\b)(?:data|javascript|vbscript|ftp|file|gopher|telnet|ldap):[^\s\"'<>]+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
IPV4_LIKE = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
BRACKETED = r"\[([0-9A-Fa-f:]+)\]"
#: (network, prefix length) of the IPv4 addresses that are private, loopback, link-local, multicast, reserved or unspecified
_PRIVATE = (
    (0x00000000, 8), (0x0A000000, 8), (0x7F000000, 8), (0xA9FE0000, 16), (0xAC100000, 12), (0xC0000000, 24), (0xC00000AA, 31),
    (0xC0000200, 24), (0xC0A80000, 16), (0xC6120000, 15), (0xC6336400, 24), (0xCB007100, 24), (0xE0000000, 4), (0xF0000000, 4),
)
#: addresses within the above that are public after all
_EXCEPTIONS = ((0xC0000009, 32), (0xC000000A, 32))


def clean_url(url: Column) -> Column:
    """Without the punctuation that prose puts behind a URL."""
    return F.regexp_replace(url, r"[)`*.,;:!?\]]+$", "")


def host_of(url: Column) -> Column:
    """Host in lower case without brackets; empty if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]+\]|[^:/?#]*)", 1)
    return F.lower(F.regexp_replace(found, r"^\[|\]$", ""))


def path_of(url: Column) -> Column:
    """Path of a URL, without parameters, query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)", 1)


def is_ipv4(text: Column) -> Column:
    return text.rlike(_IPV4)


def is_address(host: Column) -> Column:
    """IPv4, or what can only be IPv6 in a URL's host."""
    return is_ipv4(host) | F.contains(host, F.lit(":"))


def ipv4_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + F.coalesce(p.try_cast("long"), F.lit(0)))


def _within(number: Column, networks: Sequence[tuple[int, int]]) -> Column:
    found = F.lit(False)
    for network, bits in networks:
        found = found | number.between(network, network + (1 << (32 - bits)) - 1)
    return found


def is_private_ipv4(text: Column) -> Column:
    """Not reachable from the public Internet, by the address registries."""
    number = ipv4_number(text)
    return _within(number, _PRIVATE) & ~_within(number, _EXCEPTIONS)


def is_global_ipv4(text: Column) -> Column:
    """Public for a remote endpoint: shared address space isn't, multicast is."""
    number = ipv4_number(text)
    closed = [x for x in _PRIVATE if x != (0xE0000000, 4)] + [(0x64400000, 10)]
    return ~(_within(number, closed) & ~_within(number, _EXCEPTIONS))


def in_domains(host: Column, domains: Sequence[str], *, strict: bool = False) -> Column:
    """Whether the host is one of the domains or, unless strict, below one."""
    if not domains:
        return F.lit(False)
    if strict:
        return host.isin(*domains)
    return host.rlike(r"^(?:.*\.)?(?:" + "|".join(java_quote(d) for d in domains) + ")$")


def is_denied(host: Column, domains: Sequence[str]) -> Column:
    return F.lit(True) if "*" in domains else in_domains(host, domains)


def is_local_host(host: Column) -> Column:
    """Local, reserved and example hosts."""
    found = host.isin(*terms.LOCAL_HOSTS, *terms.RESERVED_HOSTS)
    for ending in terms.LOCAL_ENDINGS:
        found = found | F.endswith(host, F.lit(ending))
    return found


def is_mcp_path(url: Column) -> Column:
    path = F.lower(path_of(url))
    return F.endswith(path, F.lit("/mcp")) | F.contains(path, F.lit("/mcp/"))


def urls_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


