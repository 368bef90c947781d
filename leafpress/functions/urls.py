"""URL and address functions as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)"


def fixed(url: Column, own_host: str = "r.example.com") -> Column:
    """Without the service's own prefix and repeated schemes."""
    bare = F.regexp_replace(url, rf"^(?:https?://)?{own_host.replace('.', chr(92) + '.')}/", "")
    return F.regexp_replace(bare, r"^(?:view-source:|https?://)+(?=https?://)|^view-source:", "")


def digest(url: Column) -> Column:
    """Key of a page: md5 of the lower-case URL without its fragment, unless that starts with a slash."""
    return F.md5(F.lower(F.regexp_replace(url, r"#([^/].*)?$", "")))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def host(url: Column) -> Column:
    """Lower-case host without login and port; empty for URLs without one."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _URL, 2), r"^.*@", ""), r":\d*$", ""))


def origin(url: Column) -> Column:
    found = F.regexp_extract(url, _URL, 0)
    return F.lower(F.regexp_replace(found, r"://[^/?#]*@", "://"))


def path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, _URL, ""), r"[?#].*$", "")


def domain_digest(url: Column) -> Column:
    """Key of a page's folder: md5 of origin and parent path."""
    return F.md5(F.lower(F.concat(origin(url), F.regexp_replace(path(url), r"[^/]*$", ""))))


def registered_domain(name: Column) -> Column:
    """The last two labels: an estimate, as no list of public suffixes is at hand."""
    return F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)


def absolute(href: Column, base: Column) -> Column:
    """Absolute form of an origin-relative reference; absolute ones stay. Not percent-encoded."""
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href)).otherwise(F.concat(F.regexp_extract(base, _URL, 0), href))


def decoded(url: Column) -> Column:
    """Percent-decoded, or as it was if it can't be. A plus sign stays one."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def object_url(data_url: Column, base: Column) -> Column:
    return F.concat(F.lit("blob:"), origin(base), F.lit("/"), F.md5(data_url))


def data_url_parts(url: Column) -> Column:
    """Media type and bytes of a base64 data URL; null for any other URL."""
    pattern = r"(?s)^data:([^;,]*)(?:;[^,]*)?;base64,(.*)$"
    return F.when(url.rlike(pattern), F.struct(F.regexp_extract(url, pattern, 1).alias("type"), F.unbase64(F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\s", "")).alias("body")))


def file_name(disposition: Column, url: Column) -> Column:
    """From a Content-Disposition header, else the last part of the path."""
    named = F.regexp_extract(disposition, r'filename="([^"]*)"', 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.regexp_extract(path(url), r"([^/]*)$", 1))


#: Types by file name ending.
TYPES = {
    "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "txt": "text/plain", "md": "text/markdown", "json": "application/json", "xml": "text/xml", "csv": "text/csv",
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt": "application/vnd.ms-powerpoint", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
}


def content_type(name: Column, given: Column) -> Column:
    """The given type, unless it is missing or says nothing; then by the name's ending."""
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    by_name = F.element_at(table, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))
    return F.coalesce(F.when(~given.isin("", "application/octet-stream", "binary/octet-stream"), given), by_name, given)


# Addresses

#: Ranges that aren't public.
PRIVATE_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4")
PRIVATE_V6 = ("::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32")


def ipv4_number(ip: Column) -> Column:
    """A dotted quad as a long; null for anything else."""
    parts = F.split(ip, r"\.")
    number = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    ok = ip.rlike(r"^(\d{1,3})(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p.try_cast("int") <= 255)
    return F.when(ok, number)


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftrightunsigned(number, 8 * (3 - i)).bitwiseAND(F.lit(255)).cast("string") for i in range(4)])


def cidr_bounds(cidr: str) -> tuple[int, int]:
    import ipaddress

    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def in_cidrs(number: Column, cidrs: Sequence[str]) -> Column:
    tests = [number.between(*cidr_bounds(c)) for c in cidrs]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def is_nonpublic_v4(ip: Column) -> Column:
    return F.coalesce(in_cidrs(ipv4_number(ip), PRIVATE_V4), F.lit(False))


def is_nonpublic(ip: str | None) -> bool | None:
    """For one address of either kind; mapped addresses count as what they map. Null for what isn't an address."""
    import ipaddress

    try:
        found = ipaddress.ip_address((ip or "").strip("[]"))
    except ValueError:
        return None
    if found.version == 6 and found.ipv4_mapped:
        found = found.ipv4_mapped
    return any(found in ipaddress.ip_network(c) for c in (PRIVATE_V4 if found.version == 4 else PRIVATE_V6))


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), of)[0]


def host_number(name: Column) -> Column:
    """The IPv4 address that a host names in any of the forms that browsers take: one to four parts, each decimal, octal (0..) or
    hexadecimal (0x..), the last one filling what is left. Null for a name, -1 for numbers that are no address."""
    part = r"(?:[0-9]+|0[xX][0-9a-fA-F]*)"
    value = lambda p: F.when(p.rlike(r"^0[xX]$"), F.lit("0")).when(p.rlike(r"^0[xX]"), F.conv(F.substr(p, F.lit(3)), 16, 10)).when(p.rlike(r"^0[0-7]+$"), F.conv(p, 8, 10)).otherwise(p).try_cast("double")

    def whole(each: Column) -> Column:
        n, last = F.size(each), F.element_at(each, -1)
        rest = F.pow(F.lit(256.0), 5 - n)
        before = F.slice(each, 1, n - 1)
        fits = (n <= 4) & F.forall(before, lambda x: x <= 255) & (last < rest)
        return F.when(fits, (F.aggregate(before, F.lit(0.0), lambda a, x: a * 256 + x) * rest + last).cast("long")).otherwise(F.lit(-1).cast("long"))

    # Numbers up to 2^32 are whole in a double; longer ones are no address.
    parts = F.split(F.regexp_replace(name, r"\.$", ""), r"\.")
    return F.when(name.rlike(rf"(?:^|\.){part}\.?$"), F.when(name.rlike(rf"^{part}(?:\.{part})*\.?$"), _let(F.transform(parts, value), whole)).otherwise(F.lit(-1).cast("long")))


def ipv6_hex(name: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address in brackets; null for anything else."""
    bare = F.regexp_extract(F.lower(name), r"^\[([0-9a-f:.]*)(?:%[^\]]*)?\]$", 1)
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")

    def without_quad(text: Column) -> Column:
        quad = F.split(F.regexp_extract(text, r"(?:^|:)([0-9]+(?:\.[0-9]+){3})$", 1), r"\.")
        pair = lambda i: F.concat(*[F.lpad(F.hex(F.element_at(quad, k).cast("int")), 2, "0") for k in (i, i + 1)])
        return F.when(text.contains("."), F.when((F.size(quad) == 4) & F.forall(quad, lambda p: p.try_cast("int") <= 255), F.concat(F.regexp_replace(text, r"[0-9.]*$", ""), F.lower(pair(1)), F.lit(":"), F.lower(pair(3))))).otherwise(text)

    def filled(sides: Column) -> Column:
        left, right = groups(sides[0]), F.when(F.size(sides) > 1, groups(F.try_element_at(sides, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        fits = F.when(F.size(sides) == 2, missing > 0).otherwise((F.size(sides) == 1) & (missing == 0))
        return F.when(fits, F.concat(left, F.array_repeat(F.lit("0"), missing), right))

    whole = lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))
    return F.when(F.startswith(name, F.lit("[")), _let(F.nullif(bare, F.lit("")), lambda t: _let(F.split(without_quad(t), "::"), lambda sides: _let(filled(sides), whole))))


def is_nonpublic_host(name: Column) -> Column:
    """Whether a host is an address that isn't public, in any form. An address mapped into IPv6 counts as what it maps; numbers
    that are no address lead nowhere and count as a name; brackets without an IPv6 address aren't public."""

    def six(digits: Column) -> Column:
        inside = F.lit(False)
        for low, high in map(cidr_bounds, PRIVATE_V6):
            inside = inside | digits.between(f"{low:032x}", f"{high:032x}")
        mapped = F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")
        return F.when(digits.startswith("0" * 20 + "ffff"), _let(mapped, lambda x: in_cidrs(x, PRIVATE_V4))).otherwise(inside)

    four = _let(host_number(name), lambda x: in_cidrs(x, PRIVATE_V4))
    return F.when(name.startswith("["), F.coalesce(_let(ipv6_hex(name), six), F.lit(True))).otherwise(F.coalesce(four, F.lit(False)))


def safe_to_fetch(url: Column, own_hosts: Sequence[str] = ()) -> Column:
    """Scheme, no local host, no private address in any form, not the service itself."""
    safe = _let(host(url), lambda name: ~name.isin("localhost", "", *own_hosts) & ~is_nonpublic_host(name))
    return F.coalesce((scheme(url).isin("http", "https") & safe) | F.lower(url).startswith("blob:"), F.lit(False))


def target(path_url: Column, body_url: Column, html: Column, own_hosts: Sequence[str] = (), own_host: str = "r.example.com") -> Column:
    """The page that a request means: the URL of its path, else of its body, else one made of the digest of the HTML it posts.
    Without a scheme, http is meant. Null where nothing is given or the service itself is meant."""
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    given = fixed(F.coalesce(some(path_url), some(body_url)), own_host)
    whole = F.when(given.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), given).otherwise(F.concat(F.lit("http://"), given))
    posted = F.concat(F.lit("blob:"), F.sha2(html, 256))
    return F.when(given.isNotNull(), F.when(~host(whole).isin(*(own_hosts or ("",))), whole)).otherwise(posted)


def normalised(url: Column) -> Column:
    """One form of a URL: scheme and host in lower case, no default port, no fragment, no dot segments, an empty path as a slash,
    white space and control characters out. www, a trailing slash and the query's order stay."""
    dots, dot = ("..", "%2e%2e", ".%2e", "%2e."), (".", "%2e")

    def without_dots(segments: Column) -> Column:
        kept = F.aggregate(segments, F.array().cast("array<string>"), lambda a, x: F.when(F.lower(x).isin(*dots), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(F.lower(x).isin(*dot), a).otherwise(F.array_append(a, x)))
        slash = F.when(F.lower(F.element_at(segments, -1)).isin(*dots, *dot), F.lit("/")).otherwise(F.lit(""))
        return _let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(F.size(k) > 0, slash).otherwise(F.lit(""))))

    def of(bare: Column) -> Column:
        authority = F.regexp_extract(bare, _URL, 2)
        port, login = F.regexp_extract(authority, r":(\d+)$", 1), F.regexp_extract(authority, r"^(.*@)", 1)
        usual = F.when(scheme(bare) == "https", "443").when(scheme(bare) == "http", "80").otherwise("")
        query = F.regexp_extract(bare, r"^[^?#]*(\?[^#]*)", 1)
        tidy = F.replace(F.concat(_let(F.slice(F.split(path(bare), "/"), 2, 1 << 20), without_dots), query), F.lit(" "), F.lit("%20"))
        return F.when(authority != "", F.concat(scheme(bare), F.lit("://"), login, host(bare), F.when((port != "") & (port != usual), F.concat(F.lit(":"), port)).otherwise(F.lit("")), tidy)).otherwise(bare)

    return _let(F.regexp_replace(F.regexp_replace(url, r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), of)
