"""Host keys, sheet names and a safety test for URLs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts with a common key, blocked names and suffixes, and non-public IPv4 ranges.
HOST_ALIASES = {"s.1688.com": "1688.com", "detail.1688.com": "1688.com", "www.1688.com": "1688.com"}
BLOCKED_HOSTS = ("localhost", "metadata.google.internal", "metadata.google.com", "instance-data")
BLOCKED_SUFFIXES = (".local", ".localhost", ".internal", ".lan")
BLOCKED_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
_SHEET_PREFIX = "取数"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_host(c: Column | str) -> Column:
    """Lower-case host without user info, port and brackets; empty when there is none."""
    authority = F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(authority, r"^.*@", "")
    v6 = F.regexp_extract(host, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(v6 != "", v6).otherwise(F.regexp_replace(host, r":\d*$", "")))


def _cut(c: Column, limit: int | None) -> Column:
    return F.substring(c, 1, limit) if limit else c


def host_key(c: Column | str, limit: int | None = None) -> Column:
    """Folder name of a host.  With ``limit`` long names are cut, and hosts that begin alike may share one."""
    aliases = F.create_map(*[F.lit(x) for kv in HOST_ALIASES.items() for x in kv])
    host = _let(F.replace(url_host(c), F.lit("www."), F.lit("")), lambda h: F.coalesce(aliases[h], h))
    key = F.btrim(F.regexp_replace(host, r"[^a-z0-9._-]+", "_"), F.lit("._"))
    return _cut(_let(key, lambda k: F.when(k == "", "unknown").otherwise(k)), limit)


def sheet_name_from_url(c: Column | str, limit: int | None = None) -> Column:
    """Name for a sheet; spreadsheet programs want a ``limit`` (28 leaves room for a number)."""
    host = F.replace(url_host(c), F.lit("www."), F.lit(""))
    host = F.btrim(F.regexp_replace(host, r"[^A-Za-z0-9一-鿿._-]+", "_"), F.lit("._"))
    host = F.when(host == "", _SHEET_PREFIX).otherwise(host)
    return _cut(F.concat(F.lit(_SHEET_PREFIX + "_"), host), limit)


def _ipv4_number(host: Column) -> Column:
    """Dotted or plain-integer IPv4 as a number, else NULL."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    parts = F.split(host, "\\.")
    dotted = sum((F.get(parts, F.lit(i)).try_cast("long") * F.lit(1 << s) for i, s in enumerate((24, 16, 8, 0))), F.lit(0).cast("long"))
    plain = F.when(host.rlike(r"^\d{1,20}$"), host.try_cast("decimal(20,0)"))
    return F.when(host.rlike(rf"^{octet}(\.{octet}){{3}}$"), dotted).when(plain <= (1 << 32) - 1, plain.cast("long"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, which keeps the expression tree small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ipv4_blocked(n: Column) -> Column:
    ranges = []
    for block in BLOCKED_IPV4:
        base, bits = block.split("/")
        low = sum(int(p) << s for p, s in zip(base.split("."), (24, 16, 8, 0)))
        ranges.append(F.struct(F.lit(low).cast("long").alias("a"), F.lit(low + (1 << (32 - int(bits))) - 1).cast("long").alias("b")))
    return _let(n, lambda v: F.exists(F.array(*ranges), lambda r: (v >= r["a"]) & (v <= r["b"])))


def _ipv6_blocked(host: Column) -> Column:
    """Only the global unicast block 2000::/3 is public, less its special-purpose parts."""
    groups = F.split(host, ":")
    first = F.conv(F.get(groups, F.lit(0)), 16, 10).try_cast("int")
    second = F.coalesce(F.conv(F.get(groups, F.lit(1)), 16, 10).try_cast("int"), F.lit(0))
    special = (first == 0x2002) | ((first == 0x2001) & ((second <= 0x1FF) | (second == 0xDB8))) | (
        (first == 0x3FFF) & (second <= 0xFFF)
    )
    return F.coalesce(~first.between(0x2000, 0x3FFF) | special, F.lit(True))


def url_is_safe(c: Column | str) -> Column:
    """http(s) URL without user info whose host is no local, private or reserved address."""
    raw = F.btrim(F.coalesce(_col(c), F.lit("")))
    authority = F.regexp_extract(raw, r"(?i)^https?://([^/?#]*)", 1)
    shaped = raw.rlike(r"(?i)^https?://[^\s<>\"')]+$") & raw.rlike(r"(?i)^https?://[^/?#]")
    public = _let(F.btrim(url_host(raw), F.lit(".")), _public_host)
    return F.coalesce(shaped & ~authority.contains("@") & public, F.lit(False))


def _public_host(host: Column) -> Column:
    named = host.isin(*BLOCKED_HOSTS) | host.rlike("(" + "|".join(s.replace(".", "\\.") for s in BLOCKED_SUFFIXES) + ")$")
    v4 = F.coalesce(_ipv4_blocked(_ipv4_number(host)), F.lit(False))
    blocked = F.when(host.contains(":"), _ipv6_blocked(host)).otherwise(v4)
    return (host != "") & ~named & ~blocked
