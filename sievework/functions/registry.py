"""Tables that come with Spark's own libraries, read once on the driver: registered language tags, likely subtags, public suffixes.

ICU's data lists what the IANA registry does (languages, scripts, regions, variants) and CLDR's likely subtags; the HTTP client
has the Public Suffix List. They are bounded (some 9,000 entries each) and go to workers with the functions that use them.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession

BUNDLE = ("com/ibm/icu/impl/data/icudata", "supplementalData")


def spread_out(entry: str) -> list[str]:
    """``aaa~c`` is aaa, aab, aac: the last character runs up to the one behind the tilde."""
    first, tilde, last = entry.partition("~")
    return [first[:-1] + chr(c) for c in range(ord(first[-1]), ord(last) + 1)] if tilde else [first]


def jvm():
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("a Spark session has to be active: its libraries hold the tables")
    return spark._jvm


@lru_cache(maxsize=1)
def subtags() -> dict[str, frozenset[str]]:
    """kind (language, script, region, variant) -> its registered subtags in lower case."""
    j = jvm()
    data = j.com.ibm.icu.util.UResourceBundle.getBundleInstance(*BUNDLE, j.Thread.currentThread().getContextClassLoader()).get("idValidity")
    out = {}
    for kind in ("language", "script", "region", "variant"):
        table, found = data.get(kind), set()
        for i in range(table.getSize()):
            part = table.get(i)
            entries = [part.getString()] if part.getType() == 0 else list(part.getStringArray())  # one string, or an array of them
            found.update(x.lower() for e in entries for x in spread_out(e))
        out[kind] = frozenset(found)
    return out


def maximised(tag: str) -> tuple[str, str]:
    """(language, region) of the tag with its likely subtags."""
    u = jvm().com.ibm.icu.util.ULocale
    full = u.addLikelySubtags(u(tag))
    return full.getLanguage(), full.getCountry().lower()


@lru_cache(maxsize=1)
def likely_regions() -> dict[str, str]:
    """language -> its likely region, for the languages that CLDR covers."""
    covered = {x.getLanguage() for x in jvm().com.ibm.icu.util.ULocale.getAvailableLocales()}
    found = {lang: maximised(lang)[1] for lang in sorted(covered) if lang}
    return {k: v for k, v in found.items() if v}


@lru_cache(maxsize=1)
def likely_languages() -> dict[str, str]:
    """region -> its likely language. English is what the data gives where it names none, so a region whose likely language is English has none."""
    countries = sorted(r for r in subtags()["region"] if len(r) == 2)
    found = {r: maximised(f"und_{r.upper()}")[0] for r in countries}
    return {k: v for k, v in found.items() if v not in ("", "und", "en")}


@lru_cache(maxsize=1)
def suffixes() -> frozenset[str]:
    """The rules of the Public Suffix List: suffixes, ``*.`` wildcards and ``!`` exceptions, in ASCII."""
    j = jvm()
    stream = j.Thread.currentThread().getContextClassLoader().getResourceAsStream("mozilla/public-suffix-list.txt")
    text = j.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    out = set()
    for line in text.splitlines():
        rule = line.split()[0] if line.strip() and not line.startswith("//") else ""
        if rule:
            out.add(rule)
            if not rule.isascii():
                mark = rule[: len(rule) - len(rule.lstrip("!*."))]
                out.add(mark + rule[len(mark) :].encode("idna").decode())
    return frozenset(out)


def domain(host: str | None, rules: frozenset[str]) -> str | None:
    """A host's public suffix and one label before it; None for an address, a suffix itself and a single label."""
    labels = (host or "").rstrip(".").split(".")
    if len(labels) < 2 or not all(labels) or host.startswith("[") or all(x.isdigit() for x in labels) and len(labels) == 4:
        return None
    size = 1  # of the suffix; a top label that no rule knows is one
    for n in range(1, len(labels) + 1):
        tail = labels[-n:]
        if "!" + ".".join(tail) in rules:
            size = n - 1
            break
        if ".".join(tail) in rules or n > 1 and "*." + ".".join(tail[1:]) in rules:
            size = n
    return ".".join(labels[-size - 1 :]) if size < len(labels) else None
