"""URL resolution in plain Python: the common subset of the WHATWG rules (relative references, default ports, dot segments,
lower-case schemes and hosts, percent-encoding of what may not stand in a path, query or fragment). Not covered: IDNA beyond what
Python's codec knows, IPv4 number forms."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
_scheme = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
_PATH, _QUERY, _FRAGMENT = "/%:@!$&'()*+,;=-._~|[]\\^", "/?%:@!$&()*+,;=-._~|[]{}`\\^", "/?%:@!$&'()*+,;=-._~|[]{}#\\^"


def resolve(reference: str, base: str | None = None) -> str | None:
    """The absolute URL of reference, or None where it has none."""
    reference = re.sub(r"[\t\n\r]", "", reference.strip("\x00\x01\x02\x03\x04\x05\x06\x07\x08\t\n\x0b\x0c\r\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d\x1e\x1f "))
    m = _scheme.match(reference)
    if m and m[0][:-1].lower() not in PORTS and m[0].lower() != "file:":
        return m[0].lower() + reference[m.end() :]
    if not m:
        if not base or not re.match(r"(?i)(https?|ftp|file|wss?)://", base):
            return None
    try:
        parts = urlsplit(urljoin(base, reference) if base else reference)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return None
    if not host and parts.scheme != "file":
        return None
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    if ":" in host:
        host = f"[{host}]"
    login = parts.netloc.rpartition("@")[0]
    netloc = (f"{login}@" if login else "") + host + (f":{port}" if port is not None and port != PORTS.get(parts.scheme) else "")
    path = _dots(parts.path.replace("\\", "/")) if parts.scheme in PORTS else parts.path
    return urlunsplit((parts.scheme, netloc, quote(path, _PATH) or "/", quote(parts.query, _QUERY), quote(parts.fragment, _FRAGMENT)))


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p.lower() in ("..", ".%2e", "%2e.", "%2e%2e"):
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif p.lower() in (".", "%2e"):
            if last:
                out.append("")
        else:
            out.append(p)
    return "/".join(out)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "") if re.match(r"(?i)[a-z][a-z0-9+.\-]*://", url or "") else ""
    except ValueError:
        return ""


def origin_of(url: str | None) -> str:
    m = re.match(r"(?i)([a-z][a-z0-9+.\-]*)://([^/?#]*)", url or "")
    return f"{m[1].lower()}://{m[2].rpartition('@')[2].lower()}" if m else ""
