"""URL, date and keyword expressions for the feed jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path pieces of listing pages.
LISTING_PATHS = [
    "/tag/", "/tags/", "/category/", "/topic/", "/topics/", "/author/", "/page/", "/product/",
    "/search/",
]
# Hosts and file types that never hold an article.
MEDIA_HOSTS = [
    "i.redd.it", "v.redd.it", "i.imgur.com", "preview.redd.it", "www.reddit.com", "reddit.com",
    "redd.it", "youtu.be",
]
MEDIA_HOST_SUFFIXES = ["youtube.com", "github.com", "hub.docker.com"]
MEDIA_TYPES = [".jpg", ".jpeg", ".png", ".gif", ".gifv", ".webp", ".mp4", ".mov"]
URL_IN_TEXT = r"https?://[^\s)\]>\"]+"

# Date shapes.
DATE_SHAPES = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9:+Z.-]+)?"
    r"|[0-9]{1,2}\s+[A-Za-z]{3,9}\.?\s+[0-9]{4}"
    r"|[A-Za-z]{3,9}\.?\s+[0-9]{1,2},?\s+[0-9]{4}"
    r"|[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{4}"
    r"|[0-9]{4}[/.\-][0-9]{2}[/.\-][0-9]{2}"
)


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def is_article_url(url: Column, base: Column, strict: bool = False) -> Column:
    """Same host, a path beyond ``/``, no fragment; strict also bars listing paths."""
    ok = (
        (host(url) == host(base))
        & (F.length(F.rtrim(path(url), F.lit("/"))) > 1)
        & ~url.contains("#")
    )
    if strict:
        ok = ok & ~path(url).rlike("|".join(LISTING_PATHS))
    return F.coalesce(ok, F.lit(False))


def is_media_url(url: Column) -> Column:
    h = F.lower(F.coalesce(host(url), F.lit("")))
    suffix = "(^|\\.)(" + "|".join(s.replace(".", "\\.") for s in MEDIA_HOST_SUFFIXES) + ")$"
    types = "(" + "|".join(t.replace(".", "\\.") for t in MEDIA_TYPES) + ")$"
    return h.isin(MEDIA_HOSTS) | h.rlike(suffix) | F.lower(path(url)).rlike(types)


def first_article_url(link: Column, is_self: Column, text: Column) -> Column:
    """The post's own link if it is external, else the first external URL in its text."""
    found = F.filter(F.regexp_extract_all(text, F.lit(URL_IN_TEXT), F.lit(0)), lambda u: ~is_media_url(u))
    return F.when(~is_self & ~is_media_url(link), link).otherwise(F.get(found, F.lit(0)))


def short_name(url: Column) -> Column:
    """First host label and last path part, as slugs."""
    label = F.element_at(F.split(F.replace(host(url), F.lit("www."), F.lit("")), "\\."), 1)
    label = F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), F.lit("-"))
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    last = F.substring(F.btrim(F.regexp_replace(F.lower(last), "[^a-z0-9]+", "-"), F.lit("-")), 1, 20)
    return F.concat(label, F.lit("-"), F.coalesce(last, F.lit("page")))


def clean_title(title: Column) -> Column:
    """Leading date and leading capitalised category words removed."""
    t = F.regexp_replace(title, f"^(?:{DATE_SHAPES})\\s*", "")
    t = F.regexp_replace(t, r"^[A-Z][a-z]{2,20}(?:\s+[A-Z][a-z]{2,20}){0,2}\s+(?=[A-Z])", "")
    return F.trim(t)


# The months in order, by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_CLOCK = (
    r"(?:(?:T| )([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?(?: ?([AaPp])[Mm])?"
    r"(?: ?(Z|[+-][0-9]{2}(?::?[0-9]{2})?))?)?$"
)
_YEAR_FIRST = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})" + _CLOCK
_YEAR_LAST = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})" + _CLOCK
_DAY_MONTH = r"^([0-9]{1,2})[ -]([A-Za-z]{3,9})[ -]([0-9]{4})" + _CLOCK
_MONTH_DAY = r"^([A-Za-z]{3,9}) ([0-9]{1,2}) ([0-9]{4})" + _CLOCK


def _month_number(name: Column) -> Column:
    at = F.array_position(literal_array(list(MONTHS)), F.lower(F.left(name, F.lit(3))))
    return F.when(at > 0, at.cast("string"))


def parse_date(raw: Column) -> Column:
    """UTC timestamp of a raw date, null if it cannot be read; no zone means UTC.

    Year first, year last (the month before the day, unless it cannot be one), or a month's name;
    separated by dashes, slashes, dots or blanks; with or without a time of day to the minute,
    second or fraction, AM or PM, and an offset in any usual form.
    """
    t = F.regexp_replace(F.trim(raw), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*[.,]?\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?<=[A-Za-z])\.|,(?![0-9])", ""), r"\s*(?:GMT|UTC)$", "Z")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(t, pattern, k)

    def moment(pattern: str, year: Column, month: Column, day: Column) -> Column:
        hour, half = part(pattern, 4), F.lower(part(pattern, 8))
        h = F.when(hour == "", "0").otherwise(hour).cast("int")
        h = F.when(half == "p", h % 12 + 12).when(half == "a", h % 12).otherwise(h)

        def two(x: Column) -> Column:
            return F.lpad(x.cast("string"), 2, "0")

        offset = part(pattern, 9)
        digits = F.rpad(F.regexp_replace(offset, "[^0-9]", ""), 4, "0")
        zone = F.when((offset == "") | (offset == "Z"), "Z").otherwise(
            F.concat(F.left(offset, F.lit(1)), F.left(digits, F.lit(2)), F.lit(":"), F.right(digits, F.lit(2)))
        )
        text = F.concat(
            year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), two(h), F.lit(":"), F.lpad(part(pattern, 5), 2, "0"),
            F.lit(":"), F.lpad(part(pattern, 6), 2, "0"), F.lit("."), F.rpad(part(pattern, 7), 6, "0"), zone,
        )
        return F.when(t.rlike(pattern), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSXXX")))

    first, second = part(_YEAR_LAST, 1), part(_YEAR_LAST, 2)
    swapped = F.try_to_number(first, F.lit("99")) > 12
    return F.coalesce(
        moment(_YEAR_FIRST, part(_YEAR_FIRST, 1), part(_YEAR_FIRST, 2), part(_YEAR_FIRST, 3)),
        moment(_YEAR_LAST, part(_YEAR_LAST, 3), F.when(swapped, second).otherwise(first), F.when(swapped, first).otherwise(second)),
        moment(_DAY_MONTH, part(_DAY_MONTH, 3), _month_number(part(_DAY_MONTH, 2)), part(_DAY_MONTH, 1)),
        moment(_MONTH_DAY, part(_MONTH_DAY, 3), _month_number(part(_MONTH_DAY, 1)), part(_MONTH_DAY, 2)),
    )


def url_date_text(url: Column) -> Column:
    pattern = r"/([0-9]{4})[/\-]([0-9]{2})[/\-]([0-9]{2})[/\-]?"
    return F.concat_ws("-", *[F.regexp_extract(url, pattern, i) for i in (1, 2, 3)])


def text_date_text(text: Column) -> Column:
    return F.regexp_extract(text, f"(?<![0-9])({DATE_SHAPES})(?![0-9])", 1)


def url_date(url: Column) -> Column:
    """Date in a ``/yyyy/mm/dd`` path."""
    return parse_date(url_date_text(url))


def text_date(text: Column) -> Column:
    """First date-like stretch of a text."""
    return parse_date(text_date_text(text))


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def first_hit(text: Column, needles: list[str]) -> Column:
    """First listed needle contained in ``text``, else null."""
    return F.get(F.filter(literal_array(needles), lambda k: F.contains(text, k)), F.lit(0))
