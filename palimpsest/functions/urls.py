"""URLs as column expressions: finding them in text, a canonical form, sites, and which addresses are refused."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Limits and parameter names of the rules. Fixed values.
MAX_URL_CHARS, MAX_HOST_CHARS = 2048, 253
TRACKING = r"(?i)^(utm_.*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|ref_src|spm|_hsenc|_hsmi)$"
YOUTUBE = ("youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be", "youtube-nocookie.com")
VIMEO = ("vimeo.com", "player.vimeo.com")
# How a URL begins in running text, and the paths that show one video. Fixed values.
URL_IN_TEXT = r"(?i)\b(?:[a-z][a-z0-9+.-]{1,15}://|www\.)[^\s<>\"'`]+"
TUBE_PATH = r"^/(watch|shorts/|live/|embed/|v/)"
VIMEO_PATH = r"^/(?:video/|channels/[^/]+/|groups/[^/]+/videos/)?\d+"
# IPv4 ranges by the rule that refuses them, first hit first. Fixed values.
REFUSED_V4: tuple[tuple[str, str], ...] = (
    ("loopback", "127.0.0.0/8"), ("reserved_address", "0.0.0.0/32"), ("link_local", "169.254.0.0/16"), ("multicast", "224.0.0.0/4"),
    ("carrier_grade_nat", "100.64.0.0/10"), ("private_address", "10.0.0.0/8"), ("private_address", "172.16.0.0/12"),
    ("private_address", "192.168.0.0/16"), ("reserved_address", "0.0.0.0/8"), ("reserved_address", "192.0.0.0/24"),
    ("reserved_address", "192.0.2.0/24"), ("reserved_address", "198.18.0.0/15"), ("reserved_address", "198.51.100.0/24"),
    ("reserved_address", "203.0.113.0/24"), ("reserved_address", "240.0.0.0/4"),
)
# IPv6 ranges that wrap or tunnel IPv4, or are private. Fixed values.
REFUSED_V6: tuple[tuple[str, str], ...] = (
    ("private_address", "fc00::/7"), ("reserved_address", "64:ff9b::/96"), ("reserved_address", "64:ff9b:1::/48"),
    ("reserved_address", "2002::/16"), ("reserved_address", "2001::/32"), ("reserved_address", "::/96"),
)


def _part(url: Column, group: int) -> Column:
    """Scheme (1), authority (2), path (3), query (4) of a URL; empty where it has none."""
    return F.regexp_extract(F.trim(url), r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", group)


def find_urls(text: Column) -> Column:
    """The URLs of a text in order, each once, without the punctuation after them; ``www.`` links get ``https://``.

    A closing bracket stays if one inside the URL opens it. One character of the trailing run of punctuation is
    dropped a step, so the fold is as long as that run.
    """
    found = F.regexp_extract_all(text, F.lit(URL_IN_TEXT), F.lit(0))
    many = lambda u, ch: F.length(u) - F.length(F.replace(u, F.lit(ch), F.lit("")))

    def trim(u: Column) -> Column:
        last = lambda x: F.substring(x, -1, 1)
        loose = lambda x: last(x).isin(*".,;:!?'\"}>") | ((last(x) == ")") & (many(x, ")") > many(x, "("))) | ((last(x) == "]") & (many(x, "]") > many(x, "[")))
        run = F.length(F.regexp_extract(u, r"[.,;:!?'\"}>)\]]*$", 0))
        cut = F.aggregate(F.sequence(F.lit(0), run), u, lambda x, _: F.when(loose(x), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))
        return F.when(F.lower(cut).startswith("www."), F.concat(F.lit("https://"), cut)).otherwise(cut)

    return F.array_distinct(F.filter(F.transform(found, trim), lambda u: u != ""))


def host(url: Column) -> Column:
    """The host in lower case, without credentials and port; brackets of an IPv6 literal are taken off."""
    at = F.regexp_replace(_part(url, 2), "^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(at, r":\d*$", ""), r"^\[|\]$", ""))


def site(name: Column) -> Column:
    return F.regexp_replace(F.rtrim(F.lower(name), F.lit(".")), r"^www\.", "")


def _percent(text: Column, safe: str, space: str) -> Column:
    """Percent-encoding with the characters of ``safe`` left as they are."""
    out = F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("+"), F.lit(space))
    for ch in safe:
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return out


def canonical(url: Column) -> Column:
    """One spelling of a link: https for http, no ``www.``, default port, fragment or tracking, parameters in order."""
    scheme, name = F.lower(_part(url, 1)), site(host(url))
    port = F.regexp_extract(_part(url, 2), r":(\d+)$", 1)
    plus = F.replace(_part(url, 3), F.lit("+"), F.lit("%2B"))
    path = _percent(F.coalesce(F.try_url_decode(plus), plus), "/:@!$&'()*+,;=~", "%20")
    path = F.when(F.rtrim(path, F.lit("/")) == "", "/").otherwise(F.rtrim(path, F.lit("/")))
    text = lambda s: F.coalesce(F.try_url_decode(s), s)
    pairs = F.transform(F.filter(F.split(_part(url, 4), "&"), lambda p: p != ""), lambda p: F.struct(
        text(F.substring_index(p, "=", 1)).alias("k"), text(F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_percent(p["k"], "~", "+"), F.lit("="), _percent(p["v"], "~", "+"))), "&")
    return F.concat(
        F.when(scheme.isin("", "http", "https"), "https").otherwise(scheme), F.lit("://"), name,
        F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def video_site(url: Column) -> Column:
    """``youtube`` or ``vimeo`` for a link to a video of theirs, else null."""
    name, path = site(host(url)), _part(url, 3)
    tube = name.isin(*YOUTUBE) & (((name == "youtu.be") & (F.trim(path, F.lit("/")) != "")) | path.rlike(TUBE_PATH))
    return F.when(tube, "youtube").when(name.isin(*VIMEO) & path.rlike(VIMEO_PATH), "vimeo")


def ipv4_number(name: Column) -> Column:
    """The 32-bit address that a host spells (dotted, short, hex, octal or one number), else null."""
    parts = F.split(F.rtrim(name, F.lit(".")), r"\.")
    one = lambda p: (
        F.when(p.rlike("^0[xX][0-9a-fA-F]{0,15}$"), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 20)), 16, 10))
        .when(p.rlike("^0[0-7]{1,20}$"), F.conv(p, 8, 10)).when(p.rlike("^(0|[1-9][0-9]{0,17})$"), p).try_cast("decimal(20,0)"))
    n, k = F.transform(parts, one), F.size(parts)
    head, last = F.slice(n, 1, k - 1), F.element_at(n, -1)
    fine = (k <= 4) & ~F.exists(n, lambda x: x.isNull()) & ~F.exists(head, lambda x: x > 255) & (last < F.pow(F.lit(256.0), 5 - k))
    places = F.array(*[F.lit(256 ** (3 - j)) for j in range(4)])
    shifted = F.transform(head, lambda x, i: x.cast("bigint") * F.get(places, i))
    return F.when(fine, F.aggregate(shifted, last.cast("bigint"), lambda a, x: a + x))


def dotted(n: Column) -> Column:
    byte = lambda s: (F.shiftrightunsigned(n, s) % 256).cast("string")
    return F.when(n.isNotNull(), F.concat_ws(".", byte(24), byte(16), byte(8), byte(0)))


def refused_v4(n: Column) -> Column:
    """The rule that refuses an IPv4 address, null for a public one."""
    nets = [(rule, ipaddress.ip_network(net)) for rule, net in REFUSED_V4]

    def first(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for rule, r in reversed(nets):
            out = F.when(x.between(int(r[0]), int(r[-1])), rule).otherwise(out)
        return out

    return F.get(F.transform(F.array(n), first), F.lit(0))


@F.pandas_udf(StringType())
def _refused_v6(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    nets = [(rule, ipaddress.ip_network(n)) for rule, n in REFUSED_V6]

    def rule(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            a = ipaddress.IPv6Address(text)
        except ValueError:
            return "bad_url"
        if a.ipv4_mapped is not None:
            return next((r for r, n in REFUSED_V4 if a.ipv4_mapped in ipaddress.ip_network(n)), None)
        tests = (a.is_loopback, "loopback"), (a.is_unspecified, "reserved_address"), (a.is_link_local, "link_local"), (a.is_multicast, "multicast")
        return next((r for hit, r in tests if hit), None) or next((r for r, n in nets if a in n), None) or (None if a.is_global else "reserved_address")

    for batch in batches:
        yield batch.map(rule)


def refusal(url: Column) -> Column:
    """The rule by which a URL may not be requested, null if it may: length, characters, scheme, credentials, host, port, address.

    Only http and https on ports 80 and 443 without credentials, to a name or a public address in any spelling.
    """
    scheme, at, name = F.lower(_part(url, 1)), _part(url, 2), host(url)
    port = F.regexp_extract(at, r":(\d*)$", 1)
    n = ipv4_number(name)
    bare = F.rtrim(name, F.lit("."))
    v6 = name.contains(":") | at.contains("[")
    number_like = F.substring_index(bare, ".", -1).rlike("^(0x[0-9a-f]*|[0-9]+)$")
    return (
        F.when(F.length(url) > MAX_URL_CHARS, "url_too_long").when(url.isNull() | url.rlike(r"[\x00-\x1f\x7f]"), "bad_url")
        .when(~scheme.isin("http", "https"), "scheme").when(at.contains("@"), "credentials").when((name == "") | name.contains("%"), "bad_url")
        .when((port != "") & ~port.isin("80", "443"), "port").when(v6, _refused_v6(F.when(v6, name))).when(n.isNotNull(), refused_v4(n))
        .when(number_like | (F.length(name) > MAX_HOST_CHARS), "bad_url").when((bare == "localhost") | bare.endswith(".localhost"), "loopback")
        .when(~bare.rlike(r"^[\p{L}\p{N}._-]+$"), "bad_url"))
