"""URL rules: parts, tracking parameters, domains and safety."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import strip

# Query parameters that only track visits.
TRACKING_PREFIX = "utm_"
TRACKING_WORDS = ("ref", "fbclid", "gclid")

# Hosts that are never fetched.
BLOCKED_HOSTS = (
    "localhost",
    "127.0.0.1",
    "0.0.0.0",
    "::1",
    "metadata.google.internal",
    "169.254.169.254",
    "instance-data",
)
BLOCKED_SUFFIXES = (".local", ".internal")

# IPv4 blocks that are private, reserved or multicast, as
# (network, prefix length).
CLOSED_IPV4 = (
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("224.0.0.0", 4),
    ("240.0.0.0", 4),
)
# Single addresses open inside a closed IPv4 block.
OPEN_IPV4 = ("192.0.0.9", "192.0.0.10")

# Fixed value: a dotted IPv4 address without leading zeros.
IPV4 = (
    r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}"
    r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
)
# Fixed value: a public IPv6 address written without a dotted tail starts with a
# group of 2000 to 3fff (or fec0 to feff).
GLOBAL_IPV6 = r"^([23][0-9a-f]{3}|fe[c-f][0-9a-f])(:|$)"
# Closed ranges inside that block.
CLOSED_IPV6 = (
    r"^2001:0*([01]?[0-9a-f]{0,2})(:|$)",
    r"^2001:0*db8:",
    r"^2002:",
)
# Registered ranges open inside 2001::/23.
OPEN_IPV6 = (
    r"^2001:0*1::0*[12]$",
    r"^2001:0*3:",
    r"^2001:0*4:0*112:",
    r"^2001:0*2[0-9a-f]:",
    r"^2001:0*3[0-9a-f]:",
)
IPV6_GROUPS = r"^([0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row.

    Keeps long rules readable for the code generator, which would otherwise repeat
    the value wherever it is used.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_scheme(c: Column) -> Column:
    """Stripped URL, ``https://`` put in front where no web scheme is written."""
    text = strip(c)
    return F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    """Lower-case host part with port and user, as written after ``//``."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_text(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encode(c: Column) -> Column:
    # The two characters on which form encoders differ.
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(url: Column) -> Column:
    """Query parameters with a value, decoded, as ``array<struct<key, value>>``."""
    written = F.filter(F.split(query_text(url), "&"), lambda p: p.rlike("^[^=]*=."))
    return F.transform(
        written,
        lambda p: F.struct(
            _decode(F.regexp_extract(p, "^([^=]*)=", 1)).alias("key"),
            _decode(F.regexp_extract(p, "^[^=]*=(?s)(.*)$", 1)).alias("value"),
        ),
    )


def _pair_text(p: Column) -> Column:
    return F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))


def _assemble(url: Column, new_path: Column, query: Column) -> Column:
    # ";parameters" belong to the last path segment and keep their place.
    last = F.regexp_extract(path(url), r";[^/]+$", 0)
    return F.concat(
        scheme(url),
        F.lit("://"),
        authority(url),
        new_path,
        last,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def _bare_path(url: Column) -> Column:
    return F.regexp_replace(path(url), r";[^/]*$", "")


def _drop(pairs: Column, unwanted: Callable[[Column], Column]) -> Column:
    return F.filter(pairs, lambda p: ~unwanted(F.lower(p["key"])))


def clean_url(c: Column) -> Column:
    """URL in one spelling: scheme and host lower, no tracking, no trailing slash."""

    def cleaned(url: Column) -> Column:
        kept = _drop(
            query_pairs(url),
            lambda k: k.startswith(TRACKING_PREFIX) | k.isin(list(TRACKING_WORDS)),
        )
        query = F.array_join(F.transform(kept, _pair_text), "&")
        return _let(query, lambda q: _assemble(url, F.regexp_replace(_bare_path(url), "/+$", ""), q))

    url = with_scheme(c)
    return F.when((strip(c) == "") | _odd_brackets(url), c).otherwise(_let(url, cleaned))


def is_url(c: Column) -> Column:
    """True where a URL field has a host; null for null."""
    url = with_scheme(c)
    return (authority(url) != "") & ~_odd_brackets(url)


def checked_url(c: Column) -> Column:
    """URL of a declared URL field; null where it has no host.

    Repeated parameters are put next to each other, in the order in which their
    names appear first. A path of one slash stays.
    """

    def grouped(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
        return F.flatten(F.transform(names, lambda n: F.filter(pairs, lambda p: p["key"] == n)))

    def normalised(url: Column) -> Column:
        kept = _drop(query_pairs(url), lambda k: k.startswith(TRACKING_PREFIX))
        query = F.array_join(F.transform(_let(kept, grouped), _pair_text), "&")
        bare = _bare_path(url)
        new_path = F.when(bare == "/", bare).otherwise(F.regexp_replace(bare, "/+$", ""))
        return _let(query, lambda q: _assemble(url, new_path, q))

    return F.when(is_url(c), _let(with_scheme(c), normalised))


def _odd_brackets(url: Column) -> Column:
    host = authority(url)
    return host.contains("[") != host.contains("]")


def domain(c: Column) -> Column:
    """Host part with port, without a leading ``www.``; null where there is none."""
    url = with_scheme(c)
    host = F.regexp_replace(authority(url), r"^www\.", "")
    return F.when((c != "") & (host != "") & ~_odd_brackets(url), host)


def has_web_scheme(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://")


def _host(url: Column) -> Column:
    """Host name alone: no user, no port, no brackets, no dots at the ends."""
    net = F.regexp_replace(authority(url), "^.*@", "")
    name = F.when(net.startswith("["), F.regexp_extract(net, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_replace(net, ":.*$", "")
    )
    return F.btrim(name, F.lit("."))


def _number(text: str) -> int:
    total = 0
    for part in text.split("."):
        total = total * 256 + int(part)
    return total


def _ipv4_number(host: Column) -> Column:
    return F.aggregate(
        F.split(host, r"\."), F.lit(0).cast("long"), lambda total, part: total * 256 + part.try_cast("long")
    )


def _closed_number(number: Column, host: Column) -> Column:
    """Inside a closed block, by the address as a number."""
    closed = F.lit(False)
    for network, bits in CLOSED_IPV4:
        first = _number(network)
        closed = closed | number.between(first, first + (1 << (32 - bits)) - 1)
    return closed & ~host.isin(list(OPEN_IPV4))


def _closed_ipv6(host: Column) -> Column:
    """Closed or malformed. The library never resolves names, it reads text."""
    double = host.contains("::")
    colons = F.length(host) - F.length(F.replace(host, F.lit(":"), F.lit("")))
    shape = (
        host.rlike(IPV6_GROUPS)
        & ~host.contains(":::")
        & ~host.rlike("::.*::")
        & F.when(double, colons <= 7).otherwise(colons == 7)
        & ~host.rlike("(^:[^:]|[^:]:$)")
    )
    closed = ~host.rlike(GLOBAL_IPV6) | host.rlike("|".join(CLOSED_IPV6))
    return ~shape | (closed & ~host.rlike("|".join(OPEN_IPV6)))


def url_safety(c: Column) -> Column:
    """``struct<is_safe, reason>``: whether a URL may be fetched.

    Only http and https to public hosts pass. Everything runs as JVM
    expressions; IPv6 is judged by its leading groups. The URL is taken apart once
    and bound, so the rule stays small where a filter pulls it down.
    """
    url = strip(c)
    parts = F.struct(
        F.coalesce(url, F.lit("")).alias("url"),
        F.coalesce(scheme(url), F.lit("")).alias("scheme"),
        F.coalesce(_host(url), F.lit("")).alias("host"),
        F.coalesce(authority(url).contains("["), F.lit(False)).alias("bracketed"),
    )
    return _let(_let(parts, _refusal), lambda why: F.struct(why.isNull().alias("is_safe"), why.alias("reason")))


def _refusal(p: Column) -> Column:
    """Why a URL is refused, null when it is not.

    Fixed values: the texts are part of the result and stored with a source.
    """
    host = p["host"]
    closed = F.when(host.rlike(IPV4), _let(_ipv4_number(host), lambda n: _closed_number(n, host)))
    internal = host.rlike("(" + "|".join(s.replace(".", r"\.") for s in BLOCKED_SUFFIXES) + ")$")
    return (
        F.when(p["url"] == "", F.lit("URL is empty or invalid"))
        .when(
            ~p["scheme"].isin("http", "https"),
            F.concat(F.lit("Unsupported URL scheme: "), p["scheme"], F.lit(". Only HTTP/HTTPS permitted.")),
        )
        .when(host == "", F.lit("Missing hostname in URL"))
        .when(host.isin(list(BLOCKED_HOSTS)), F.concat(F.lit("Blocked target host: "), host))
        .when(internal, F.concat(F.lit("Internal domains are prohibited: "), host))
        .when(
            F.when(p["bracketed"], _closed_ipv6(host)).otherwise(closed),
            F.concat(F.lit("Access to private/loopback IP "), host, F.lit(" is blocked")),
        )
    )
