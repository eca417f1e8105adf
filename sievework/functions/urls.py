"""Web addresses: one normal form, joining, and keys. The normal form needs a function of its own; keys are expressions."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote, urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

PORTS = {"http": "80", "https": "443"}
#: Characters that stay as they are in a path and in a query.
PATH_SAFE = "/:@!$&'()*+,;=-._~%|[]^\\"
QUERY_SAFE = PATH_SAFE.replace("'", "") + "?`{}"


def normal(url: str) -> str | None:
    """``url`` with scheme and host in lower case, the default port dropped, a path, dot segments resolved, and the rest percent-encoded."""
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return None
    if p.scheme.lower() not in PORTS or not host:
        return None
    try:
        host = host if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None
    if re.search(r"[\s<>\^`{|}%]", host):
        return None
    where = f"[{host}]" if ":" in host else host
    where += f":{port}" if port is not None and str(port) != PORTS[p.scheme.lower()] else ""
    user = f"{p.username or ''}{':' + p.password if p.password else ''}@" if p.username or p.password else ""
    parts: list[str] = []
    segments = p.path.replace("\\", "/").split("/")[1:]
    for i, s in enumerate(segments):
        dots = s.lower().replace("%2e", ".")
        if dots == "..":
            parts = parts[:-1]
        elif dots != ".":
            parts.append(s)
            continue
        if i == len(segments) - 1:
            parts.append("")
    path = quote("/" + "/".join(parts), safe=PATH_SAFE)
    query = "?" + quote(p.query, safe=QUERY_SAFE) if p.query else ""
    return f"{p.scheme.lower()}://{user}{where}{path}{query}" + ("#" + quote(p.fragment, safe=QUERY_SAFE + "#") if p.fragment else "")


def bare(url: str) -> str:
    return url.partition("#")[0]


def join(base: str, href: str | None) -> str | None:
    """Where a link goes: None for an empty one, a fragment or another scheme. ``www.`` without a scheme is a site."""
    href = re.sub(r"[\t\n\r]", "", href or "").strip()
    if not href or href.startswith("#"):
        return None
    try:
        return normal(f"https://{href}" if href[:4].lower() == "www." else urljoin(base, href))
    except ValueError:
        return None


def key(url: Column) -> Column:
    """A page's key: no fragment, no slashes at the end."""
    return F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"/+$", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1))


def site(url: Column) -> Column:
    """Scheme and host without ``www.``."""
    return F.concat(F.lower(F.regexp_extract(url, r"^([a-zA-Z]+://)", 1)), F.regexp_replace(host(url), r"^www\.", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def segments(url: Column) -> Column:
    return F.array_remove(F.split(path(url), "/"), "")


def depth(url: Column) -> Column:
    return F.size(segments(url))


def directory(url: Column) -> Column:
    """Host and path up to its last slash, a slash at the end apart."""
    return F.concat(host(url), F.regexp_replace(F.regexp_replace(path(url), "/+$", ""), "[^/]*$", ""))


def registrable(name: Column) -> Column:
    """The domain that one buys: a host's public suffix and one label; null for an address, a single label and a suffix itself."""
    from . import registry
    from .batch import by_batch

    rules = registry.suffixes()
    return by_batch(lambda h: registry.domain(h, rules))(F.regexp_replace(name, r":[0-9]*$", ""))


def same_registrable(a: Column, b: Column) -> Column:
    """Of hosts: the same registrable domain, or the same host where they have none."""
    x, y = registrable(a), registrable(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a == b)


def page_slot(url: Column) -> Column:
    """struct(slot, page): the address without its page number, other parameters sorted, and the number; page is null without exactly one number."""
    pairs = F.array_remove(F.split(query(url), "&"), "")
    is_page = lambda p: p.rlike(r"(?i)^[^=]*paged?=[0-9]+$")
    in_query = F.filter(pairs, is_page)
    rest = F.array_sort(F.filter(pairs, lambda p: ~is_page(p)))
    in_path = F.regexp_extract(path(url), r"(?i)/page/([0-9]+)/?$", 1)
    numbers = F.size(in_query) + F.when(in_path != "", 1).otherwise(0)
    clean = F.regexp_replace(F.regexp_replace(path(url), r"(?i)/page/[0-9]+/?$", ""), "/+$", "")
    number = F.when(F.size(in_query) == 1, F.regexp_extract(F.get(in_query, F.lit(0)), r"=([0-9]+)$", 1)).otherwise(in_path)
    return F.struct(F.concat(site(url), clean, F.lit("?"), F.concat_ws("&", rest)).alias("slot"), F.when(numbers == 1, number.try_cast("bigint")).alias("page"))


def percent(text: str) -> str:
    """Everything but letters, digits and ``_.~`` percent-encoded."""
    return quote(text, safe="_.~").replace("-", "%2D")


def unpercent(text: str) -> str:
    return unquote(text)
