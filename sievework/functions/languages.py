"""Language tags: the registry's spelling and checks, the locale an address names, and how tags relate to a reader's.

Tags are kept in lower case (``zh-hant-tw``). :func:`canonical`, :func:`path_tag` and :func:`url_locale` need the registry and are
functions over Arrow batches; what is worked out from their results are expressions.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import registry
from .batch import by_batch

TAG = re.compile(r"([a-z]{2,3})(?:-([a-z]{4}))?(?:-([a-z]{2}|[0-9]{3}))?((?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*)(?:-x(?:-[a-z0-9]{1,8})+)?")
#: Languages that sites put in their paths, without codes that rather name a country's market.
PATH_COPIES = ("bg", "cs", "da", "de", "el", "en", "es", "fa", "fi", "fr", "he", "hi", "hr", "hu", "id", "it", "ja", "ko", "lt", "lv", "ms", "nb", "nl", "nn", "no", "pl", "pt", "ro", "ru", "sk", "sl", "sr", "sv", "th", "tr", "ur", "vi", "zh")


def registered(tag: str | None, known: dict[str, frozenset[str]]) -> str | None:
    """The tag in lower case with ``-`` between subtags, if the registry lists all of them."""
    m = TAG.fullmatch((tag or "").replace("_", "-").lower())
    if m is None or m[1] not in known["language"] or m[2] and m[2] not in known["script"] or m[3] and m[3] not in known["region"]:
        return None
    return m[0] if all(v in known["variant"] for v in m[4].split("-")[1:]) else None


def region_of(text: str, known: dict[str, frozenset[str]]) -> str | None:
    """A registered region that is no code for private use."""
    code = text.lower()
    return code if code in known["region"] and not (len(code) == 2 and code[0] in "xq") else None


def locale_of(text: str, known: dict[str, frozenset[str]]) -> tuple[str, str | None] | None:
    """(language, region) that one part of a path names: a language of two letters, alone or with a region."""
    language, cut, region = text.replace("_", "-").partition("-")
    if len(language) != 2 or registered(language, known) is None or cut and region_of(region, known) is None:
        return None
    return language.lower(), region.lower() if cut else None


Locale = tuple[str | None, str | None]


def locale_of_parts(parts: list[str], known: dict[str, frozenset[str]]) -> Locale:
    """(language, region) that the first one or two parts name: together in either order, or the first that names something."""
    own = [locale_of(p, known) for p in parts[:2]]
    if own and own[0] and own[0][1]:
        return own[0]
    if len(own) == 2:
        bare = [x and x[1] is None for x in own]
        pairs = {(own[k][0], region_of(parts[1 - k], known)) for k in (0, 1) if bare[k] and region_of(parts[1 - k], known)}
        if pairs:
            return pairs.pop() if len(pairs) == 1 else (None, None)  # that reads both ways is neither
    return next((x for x in own if x), None) or (None, region_of(parts[0], known) if parts else None)


def path_parts(url: str | None) -> list[str]:
    try:
        return [p for p in urlsplit(url or "").path.split("/") if p]
    except ValueError:
        return []


def locale_of_file(name: str, known: dict[str, frozenset[str]]) -> Locale:
    """The first two neighbouring parts of a file's name that name a language and a region together."""
    parts = [p for p in re.split(r"[-_.]", name) if p]
    found = (locale_of_parts([a, b], known) for a, b in zip(parts, parts[1:], strict=False))
    return next((x for x in found if x[0] and x[1]), (None, None))


def locale_of_url(url: str | None, known: dict[str, frozenset[str]]) -> Locale:
    parts = path_parts(url)
    path, file = locale_of_parts(parts, known), locale_of_file(parts[-1], known) if parts else (None, None)
    return file[0] or path[0], file[1] or path[1]


def canonical(tag: Column) -> Column:
    """A registered tag in lower case (en_US -> en-us, zh-Hant-TW -> zh-hant-tw); null for anything else."""
    known = registry.subtags()
    return by_batch(lambda t: registered(t, known))(F.trim(tag))


def path_tag(url: Column) -> Column:
    """The language that an address's path names, with its region where it names one."""
    known = registry.subtags()

    def tag(u):
        language, region = locale_of_parts(path_parts(u), known)
        return None if language is None else f"{language}-{region}" if region else language

    return by_batch(tag)(url)


def url_locale(url: Column) -> Column:
    """struct<language, region>, both or either null: what an address's path and file name name."""
    known = registry.subtags()
    both = by_batch(lambda u: "{}|{}".format(*(x or "" for x in locale_of_url(u, known))))(url)
    return F.struct(F.nullif(F.substring_index(both, "|", 1), F.lit("")).alias("language"), F.nullif(F.substring_index(both, "|", -1), F.lit("")).alias("region"))


def path_copy(url: Column) -> Column:
    """The language segment, lower case, that an address's path begins with, of those that sites write their copies under."""
    first = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*/+([^/?#]*)", 1))
    return F.when(F.substring_index(first, "-", 1).isin(*PATH_COPIES) & first.rlike("^[a-z]{2}(-[a-z]{2})?$"), first)


def page_tag(url: Column, declared: Column) -> Column:
    """What a page's sitemap declares (canonical), else what its path names."""
    return F.coalesce(declared, path_tag(url))


def language(tag: Column) -> Column:
    """The primary language of a canonical tag."""
    return F.substring_index(tag, "-", 1)


def region(tag: Column) -> Column:
    """The region of a canonical tag; null without."""
    return F.nullif(F.regexp_extract(tag, r"^[a-z]{2,3}(?:-[a-z]{4})?-([a-z]{2}|[0-9]{3})(?:-|$)", 1), F.lit(""))


def lookup(table: dict[str, str], value: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), value)


def likely_region(lang: Column) -> Column:
    return lookup(registry.likely_regions(), lang)


def likely_language(code: Column) -> Column:
    return lookup(registry.likely_languages(), F.lower(code))


def relation(tag: Column, own: Column) -> Column:
    """Of canonical tags: 0 the same tag, 1 the same language, 2 unknown, 3 another language."""
    return F.when(tag.isNull() | own.isNull(), 2).when(tag == own, 0).when(language(tag) == language(own), 1).otherwise(3)


def market(tag: Column, country: str | None) -> Column:
    """0 the country's region, 1 no region or no country asked for, 2 another region."""
    if not country:
        return F.lit(1)
    r = region(tag)
    return F.when(r.isNull(), 1).when(r == country.lower(), 0).otherwise(2)


def place(tag: Column, own: Column, country: str | None) -> Column:
    """The order in which a site's pages are read: own language (its market, then its tag) from 0 to 5, undeclared 6, other languages 7."""
    r = relation(tag, own)
    return F.when(r <= 1, market(tag, country) * 2 + r).when(r == 2, 6).otherwise(7)


def market_rank(locale: Column, country: str | None, languages: list[str]) -> Column:
    """Of a :func:`url_locale`: 0 the country in one of the run's languages, 1 the country, 2 anything else."""
    there = F.coalesce(locale["region"] == (country or "").lower(), F.lit(False))
    spoken = F.coalesce(locale["language"].isin(*languages), F.lit(False)) if languages else F.lit(False)
    return F.when(there & spoken, 0).when(there, 1).otherwise(2)
