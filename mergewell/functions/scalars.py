"""Normalizers: native expressions over a column, null for what cannot be normalized."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that results must equal.
SKILL_ALIASES = {
    "py": "Python",
    "python3": "Python",
    "python 3": "Python",
    "js": "JavaScript",
    "javascript": "JavaScript",
    "node": "Node.js",
    "nodejs": "Node.js",
    "node js": "Node.js",
    "node.js": "Node.js",
}
COUNTRY_ALIASES = {
    "usa": "United States",
    "us": "United States",
    "u.s.": "United States",
    "u.s.a.": "United States",
    "united states": "United States",
    "united states of america": "United States",
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "great britain": "United Kingdom",
    "britain": "United Kingdom",
    "england": "United Kingdom",
    "united kingdom": "United Kingdom",
    "india": "India",
    "in": "India",
    "canada": "Canada",
    "ca": "Canada",
}
LINK_HOSTS = ("linkedin.com", "leetcode.com", "hackerrank.com", "github.com")
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "x.com", "twitter.com", "youtube.com")
SOURCE_TYPES = ("csv", "json", "github", "linkedin", "resume", "manual", "other")
YEAR_MONTH_FORMATS = ("yyyy-M", "M/yyyy", "MMM yyyy", "MMMM yyyy")
FULL_DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "M-d-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")

#: Calling code, trunk prefix and national number by region; a rule table, not a numbering plan.
PHONE_PLANS = {
    "US": ("1", "1?", "[2-9][0-9]{2}[2-9][0-9]{6}"),
    "GB": ("44", "0?", "[1-9][0-9]{8,9}"),
    "IN": ("91", "0?", "[6-9][0-9]{9}"),
    "DE": ("49", "0?", "[1-9][0-9]{6,11}"),
    "FR": ("33", "0?", "[1-9][0-9]{8}"),
    "ES": ("34", "", "[6-9][0-9]{8}"),
    "AU": ("61", "0?", "[2-478][0-9]{8}"),
    "SG": ("65", "", "[3689][0-9]{7}"),
    "JP": ("81", "0?", "[1-9][0-9]{8,9}"),
}


def _lookup(mapping: Mapping[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def strip_ws(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def none_if_blank(c: Column) -> Column:
    return F.nullif(strip_ws(c), F.lit(""))


def fold(c: Column) -> Column:
    """Lower case for caseless comparison."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip_ws(F.regexp_replace(c, r"\s+", " "))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def distinct_by(items: Column, key) -> Column:
    """Ordered distinct by a key; the first of equal keys stays.  Items and keys are worked out once, equal keys found by sorting."""

    def leads(numbered: Column) -> Column:
        marked = F.transform(numbered, lambda x, j: F.struct(x["i"].alias("i"), ((j == 0) | ~x["k"].eqNullSafe(F.get(numbered, j - 1)["k"])).alias("first")))
        return F.array_sort(F.transform(F.filter(marked, lambda x: x["first"]), lambda x: x["i"]))

    def firsts(own: Column, keys: Column) -> Column:
        numbered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        some = F.transform(let(numbered, leads), lambda i: F.get(own, i))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), own).otherwise(some)

    return let(items, lambda own: let(F.transform(own, key), lambda keys: firsts(own, keys)))


def dedup_ci(items: Column) -> Column:
    """Ordered distinct without regard to case; the first spelling stays."""
    return distinct_by(items, fold)


def json_text(c: Column) -> Column:
    """A string as a JSON text, quoted; null stays null."""
    whole = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def base_name(path: Column) -> Column:
    """A path's last part."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def email(c: Column) -> Column:
    """Lower-cased address, or null if it is malformed; the pattern is a fixed value."""
    v = F.lower(strip_ws(c))
    shape = v.rlike(r"^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9-]+(\.[a-z0-9-]+)+$")
    local, domain = F.split_part(v, F.lit("@"), F.lit(1)), F.split_part(v, F.lit("@"), F.lit(2))
    bad = local.rlike(r"^\.|\.$|\.\.") | domain.rlike(r"(^|\.)-|-(\.|$)")
    return F.when(shape & ~bad, v)


def phone(c: Column, region: str = "US") -> Column:
    """E.164 by the rule table, or null; ``region`` reads numbers without a calling code."""
    v = strip_ws(c)
    digits = F.regexp_replace(v, r"[^0-9]", "")
    clean = v.rlike(r"^\+?[0-9\s().\-/]+$")
    out = F.lit(None).cast("string")
    for code, trunk, national in reversed(PHONE_PLANS.values()):
        pattern = f"^{code}{trunk if trunk == '0?' else ''}({national})$"
        out = F.when(v.startswith("+") & digits.rlike(pattern), F.concat(F.lit(f"+{code}"), F.regexp_extract(digits, pattern, 1))).otherwise(out)
    code, trunk, national = PHONE_PLANS[region.upper()]
    own = f"^{trunk}({national})$"
    out = F.when(~v.startswith("+"), F.when(digits.rlike(own), F.concat(F.lit(f"+{code}"), F.regexp_extract(digits, own, 1)))).otherwise(out)
    return F.when(clean, out)


def phone_key(c: Column) -> Column:
    """E.164 where possible, else the digits, else null."""
    return F.coalesce(phone(c), F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit("")))


def skill_key(c: Column) -> Column:
    return strip_ws(F.regexp_replace(fold(squeeze(c)), r"[\s._-]+", " "))


def skill(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """The name that an alias stands for; an unknown skill squeezed; null for a blank."""
    table = dict(SKILL_ALIASES)
    table.update(aliases or {})
    import re

    keyed = {re.sub(r"[\s._-]+", " ", " ".join(k.split()).casefold()).strip(): v.strip() for k, v in table.items() if k.strip() and v.strip()}
    cleaned = F.nullif(squeeze(c), F.lit(""))
    return F.coalesce(_lookup(keyed, skill_key(c)), cleaned)


def skills(items: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """All skills of a list, ordered and distinct."""
    return dedup_ci(F.filter(F.transform(items, lambda x: skill(x, aliases)), lambda x: x.isNotNull()))


def location(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """struct(city, region, country, raw), or null for a blank."""
    raw = none_if_blank(c)
    parts = F.filter(F.transform(F.split(raw, ","), strip_ws), lambda x: x != "")
    country = _lookup(COUNTRY_ALIASES | dict(aliases or {}), fold(squeeze(F.get(parts, F.size(parts) - 1))))
    rest = F.when(country.isNull(), parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    region = F.when(F.size(rest) >= 2, F.array_join(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), ", "))
    return F.when(F.size(parts) > 0, F.struct(F.get(rest, 0).alias("city"), region.alias("region"), country.alias("country"), raw.alias("raw")))


def _schemed(c: Column) -> Column:
    v = strip_ws(c)
    return F.when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), v).otherwise(F.concat(F.lit("https://"), v))


def _host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def link(c: Column) -> Column:
    """struct(category, url) of an http(s) link, a scheme added where there is none; else null."""
    url = _schemed(c)
    host = F.regexp_replace(fold(_host(url)), r"^www\.", "")
    category = F.when(host.isin(*SOCIAL_HOSTS), "other").otherwise("portfolio")
    for name in reversed(LINK_HOSTS):
        category = F.when(host.contains(name), name.split(".")[0]).otherwise(category)
    good = (strip_ws(c) != "") & ~strip_ws(c).rlike(r"\s") & url.rlike("(?i)^https?:") & (_host(url) != "")
    return F.when(good, F.struct(category.alias("category"), url.alias("url")))


def url_key(c: Column) -> Column:
    """Host without ``www.`` and path without a closing slash, in lower case; null without a host."""
    v = strip_ws(c)
    url = F.when(F.lower(v).startswith("www."), F.concat(F.lit("https://"), v)).otherwise(v)
    host = F.regexp_replace(fold(_host(url)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.when(host != "", F.concat(host, fold(path)))


def date(c: Column) -> Column:
    """ISO text of the given precision (YYYY, YYYY-MM or YYYY-MM-DD), or null."""
    v = strip_ws(c)
    year = F.when(v.rlike("^[0-9]{4}$") & v.try_cast("int").between(1900, 2100), v)
    title = F.initcap(v)
    shaped = {
        "yyyy-M": r"^[0-9]{4}-[0-9]{1,2}$", "M/yyyy": r"^[0-9]{1,2}/[0-9]{4}$", "MMM yyyy": r"^[A-Za-z]{3} [0-9]{4}$", "MMMM yyyy": r"^[A-Za-z]{3,} [0-9]{4}$",
        "yyyy-M-d": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "M/d/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
        "d-M-yyyy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "M-d-yyyy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "MMM d, yyyy": r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$",
        "MMMM d, yyyy": r"^[A-Za-z]{3,} [0-9]{1,2}, [0-9]{4}$", "d MMM yyyy": r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", "d MMMM yyyy": r"^[0-9]{1,2} [A-Za-z]{3,} [0-9]{4}$",
    }
    read = lambda f: F.when(title.rlike(shaped[f]), F.try_to_timestamp(title, F.lit(f)))
    months = [F.date_format(read(f), "yyyy-MM") for f in YEAR_MONTH_FORMATS]
    days = [F.date_format(read(f), "yyyy-MM-dd") for f in FULL_DATE_FORMATS]
    return F.coalesce(year, *months, *days)


def name_key(c: Column) -> Column:
    """Letters and digits of a name in lower case, words one space apart."""
    return squeeze(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "))


def file_key(c: Column) -> Column:
    """A path's last part, caseless."""
    return F.nullif(fold(base_name(strip_ws(c))), F.lit(""))


def json_key(c: Column) -> Column:
    """Sorted-key JSON in lower case, to tell objects apart."""
    return F.lower(F.to_json(F.try_parse_json(c)))


def source_type(label: Column) -> Column:
    out = F.lit("other")
    for kind in reversed(SOURCE_TYPES):
        out = F.when(fold(label).contains(kind), kind).otherwise(out)
    return out


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
