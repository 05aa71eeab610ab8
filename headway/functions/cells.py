"""Cells of text tables as typed values: patterns and conversions, as columns.

Each parser takes a text column and returns the typed column, null where the text is not valid.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Generic top-level domains accepted in hosts by default, beside the country codes; the whole list is a parameter.
GENERIC_TLDS = (
    "aero app art asia audio auto bank bar beer berlin best bike bio biz blog build business buzz cafe camp capital car care cars cash cat center charity chat city "
    "cloud club coach codes college com community company computer consulting cool coop country courses credit cruises dance data date deals delivery design dev "
    "digital direct directory discount earth eco edu education email energy engineering equipment estate eus events exchange expert express family fan farm fashion "
    "film finance fit flights foundation fun fund games garden global gmbh gov green group guide guru hamburg health help holiday host house inc info ink institute "
    "int international investments jobs koeln land law legal life limited link live london ltd management map market marketing media mil mobi money moscow museum "
    "name net network news ngo nyc one online ong org page paris park parking partners photos plus post press pro pub quebec report rest review rocks run school "
    "science services shop site social software solutions space store studio support swiss systems taxi team tech technology tel tickets tips tokyo tools top tours "
    "town trade train training transport travel university"
).split() + "vegas ventures video vip wales watch web website wien wiki work works world xyz zone".split()
#: Country domains that are no ISO codes, or are of none any more.
MORE_COUNTRIES = ("ac", "eu", "su", "uk", "tp", "an")


def _jvm():
    from pyspark.sql import SparkSession

    return SparkSession.active()._jvm


@cache
def currencies() -> dict[str, int]:
    """Currency codes, past ones too, with their fraction digits (-1 for metals and the like), as the JVM lists them."""
    found = _jvm().java.util.Currency.getAvailableCurrencies().toArray()
    return {c.getCurrencyCode(): c.getDefaultFractionDigits() for c in found}


@cache
def zone_names() -> tuple[str, ...]:
    """Names of time zones, as the JVM lists them."""
    return tuple(sorted(_jvm().java.time.ZoneId.getAvailableZoneIds().toArray()))


def listed_domains() -> set[str]:
    """Top-level domains of the public suffix list that comes with the JVM, in ASCII form; none where it has no list."""
    java = _jvm().java
    path = java.lang.System.getProperty("java.home") + "/lib/security/public_suffix_list.dat"
    if not java.io.File(path).exists():
        return set()
    archive = java.util.zip.ZipFile(path)
    try:
        names = archive.stream().map(java.util.function.Function.identity()).toArray()
        return {str(java.net.IDN.toASCII(e.getName())).lower() for e in names}
    finally:
        archive.close()


@cache
def tlds() -> tuple[str, ...]:
    """Top-level domains: those that the JVM lists, the codes of countries, and GENERIC_TLDS."""
    countries = [str(c).lower() for c in _jvm().java.util.Locale.getISOCountries()]
    return tuple(sorted({*listed_domains(), *GENERIC_TLDS, *MORE_COUNTRIES, *countries, "arpa"}))


def fraction_digits(currency: Column) -> Column:
    """Digits after the point of a currency's amounts; null for unknown codes and those without any rule."""
    by_digits: dict[int, list[str]] = {}
    for code, digits in currencies().items():
        by_digits.setdefault(digits, []).append(code)
    out = F.lit(None).cast("int")
    for digits, codes in sorted(by_digits.items()):
        if digits >= 0:
            out = F.when(currency.isin(sorted(codes)), digits).otherwise(out)
    return out


def java_trim(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.btrim(c, F.lit("".join(map(chr, range(0x21)))))


def to_date(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{8}$"), F.try_to_date(c, "yyyyMMdd"))


def to_seconds(c: Column) -> Column:
    """H:MM:SS with one to three hour digits; hours may pass 24."""
    part = lambda i: F.regexp_extract(c, "^([0-9]{1,3}):([0-5][0-9]):([0-5][0-9])$", i).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def to_color(c: Column) -> Column:
    return F.when(c.rlike("^[0-9A-Fa-f]{6}$"), F.conv(c, 16, 10).try_cast("int"))


def to_int(c: Column) -> Column:
    return F.when(c.rlike("^[+-]?[0-9]+$"), c.try_cast("int"))


def to_double(c: Column) -> Column:
    """Decimal literals with exponent and an f or d suffix, NaN and Infinity."""
    number = F.regexp_replace(c, "[fFdD]$", "")
    plain = c.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?$")
    return F.when(plain, number.try_cast("double")).when(c.isin("NaN", "+NaN", "-NaN"), F.lit(float("nan"))).when(c.rlike("^\\+?Infinity$"), F.lit(float("inf"))).when(c == "-Infinity", F.lit(float("-inf")))


def to_decimal(c: Column) -> Column:
    return F.when(c.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), c)


def to_currency(c: Column) -> Column:
    return F.when(c.isin(sorted(currencies())), c)


def to_language(c: Column) -> Column:
    """Well-formed tags: language, then script, region and variants."""
    return F.when(c.rlike("^(?i:[a-z]{2,3}(-[a-z]{3}){0,3}|[a-z]{4,8})(?i:-[a-z]{4})?(?i:-([a-z]{2}|[0-9]{3}))?(?i:-([a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(?i:-[a-wyz0-9](-[a-z0-9]{2,8})+)*(?i:-x(-[a-z0-9]{1,8})+)?$"), c)


def to_timezone(c: Column) -> Column:
    """Names of zones as they are; offsets, with or without UTC, GMT or UT before, as ±HH:MM (and :SS, if any).

    An offset is ±h, ±hh, ±hhmm, ±hh:mm, ±hhmmss or ±hh:mm:ss, of at most 18 hours. One of zero is Z, or the name before it.
    """
    shape = "^(UTC|GMT|UT)?([+-])(?:([0-9])|([0-9]{2})(?:([0-9]{2})([0-9]{2})?|:([0-9]{2})(?::([0-9]{2}))?)?)$"
    found = lambda i: F.regexp_extract(c, shape, i)
    number = lambda *groups: F.coalesce(F.concat(*map(found, groups)).try_cast("int"), F.lit(0))
    hours, minutes, seconds = number(3, 4), number(5, 7), number(6, 8)
    total = hours * 3600 + minutes * 60 + seconds
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    late = F.when(seconds > 0, F.concat(F.lit(":"), two(seconds))).otherwise(F.lit(""))
    offset = F.concat(found(1), found(2), two(hours), F.lit(":"), two(minutes), late)
    zero = F.when(found(1) == "", F.lit("Z")).otherwise(found(1))
    fine = c.rlike(shape) & (minutes < 60) & (seconds < 60) & (total <= 18 * 3600)
    return F.when(fine, F.when(total == 0, zero).otherwise(offset)).when(c.isin("Z", "UTC", "GMT", "UT", *zone_names()), c)


def valid_host(host: Column, domains: tuple[str, ...] | None = None) -> Column:
    """Labels of at most 63 and names of at most 253 characters below a known domain, or an IPv4 address.

    domains: the top-level domains accepted; None: tlds(). A dot may follow the name.
    """
    last = F.lower(F.substring_index(F.rtrim(host, F.lit(".")), ".", -1))
    known = last.isin(*(tlds() if domains is None else domains))
    label = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    name = host.rlike(f"^({label}\\.)+[A-Za-z]([A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?[.]?$") & (F.length(host) <= 253) & known
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return name | host.rlike(f"^({octet}\\.){{3}}{octet}$")


def to_url(c: Column, domains: tuple[str, ...] | None = None) -> Column:
    """http, https and ftp with a valid host and port; no empty segments, no climb above the root, no blanks in the query."""
    part = lambda i: F.regexp_extract(c, "^(?i:https?|ftp)://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]+))?([^?#]*)(\\?[^#]*)?(#.*)?$", i)
    host, port, path, query = (part(i) for i in (1, 2, 3, 4))
    port_ok = (port == "") | (port.try_cast("int") <= 65535)
    path_ok = ((path == "") | path.startswith("/")) & ~path.contains("//") & ~path.rlike("[\\s<>\"{}|\\\\^`]") & ~path.rlike("^/\\.\\.(/|$)")
    return F.when((host != "") & valid_host(host, domains) & port_ok & path_ok & ~query.rlike("\\s"), c)


def to_email(c: Column, domains: tuple[str, ...] | None = None) -> Column:
    local, host = F.regexp_extract(c, "^([^@]+)@([^@]+)$", 1), F.regexp_extract(c, "^([^@]+)@([^@]+)$", 2)
    fine = local.rlike("^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*$") & (F.length(local) <= 64)
    return F.when(fine & valid_host(host, domains), c)


def mixed_case_missing(c: Column) -> Column:
    """Whether a name should have mixed case and has not."""
    tokens = F.filter(F.split(c, "[^\\p{L}\\p{N}]+"), lambda t: F.length(t) > 0)
    digit = lambda t: t.rlike("\\p{N}")
    words = F.filter(tokens, lambda t: (F.length(t) > 1) & ~digit(t))
    mixed = lambda t: (F.lower(t) != t) & (F.upper(t) != t)
    one = F.when(F.size(words) == 1, F.exists(words, lambda t: F.lower(t) == t)).otherwise(F.lit(False))
    return F.when(F.size(tokens) <= 1, one).otherwise((F.size(words) >= 2) & ~F.exists(words, mixed))
