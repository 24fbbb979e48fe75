"""Column expressions over words, phrases, titles and URLs (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glue words left out of content overlap.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "it", "its", "was", "were", "is", "are",
    "am", "be", "been", "to", "of", "in", "on", "at", "so", "that", "this", "these",
    "those", "with", "as", "for", "i",
]

# Punctuation classes.
TERMINAL = "[.!?]$"
CLAUSE = "[,;:]$"


def norm_token(word: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(word), "[^a-z0-9]", "")


def norm_phrase(text: Column) -> Column:
    """Lower case, punctuation stripped, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""), " +", " "))


def norm_phrase_hyphen(text: Column) -> Column:
    """Lower case; apostrophes vanish, any other separator splits."""
    return F.trim(
        F.regexp_replace(F.replace(F.lower(text), F.lit("'"), F.lit("")), "[^a-z0-9]+", " ")
    )


def norm_phrase_strip(text: Column) -> Column:
    """Lower case, punctuation stripped, inner blanks kept."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))


def strip_edges(word: Column) -> Column:
    """Comparable core: no punctuation at either edge, lower case."""
    return F.lower(F.btrim(word, F.lit(".,!?;:…\"'")))


def strip_tail(word: Column) -> Column:
    """Lower case, no punctuation at the end."""
    return F.rtrim(F.lower(F.trim(word)), F.lit(".,!?;:'\""))


def ends_sentence(word: Column) -> Column:
    """Terminal punctuation, an ellipsis not counting."""
    return word.rlike(TERMINAL) & ~word.endswith("...")


def trails_off(word: Column) -> Column:
    return word.endswith("...") | word.endswith("…")


def starts_upper(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def boundary_after(
    word: Column, next_word: Column, gap_ms: Column, pause_ms: int, clause: bool = False
) -> Column:
    """A sentence (or clause) ends between two words. False when there is no next word and no
    closing punctuation."""
    hit = word.rlike(TERMINAL)
    if clause:
        hit = hit | word.rlike(CLAUSE)
    return hit | F.coalesce(starts_upper(next_word) & (gap_ms >= pause_ms), F.lit(False))


def is_content(token: Column) -> Column:
    return (token != "") & ~token.isin(STOP_WORDS)


def clock(ms: Column) -> Column:
    """``M:SS.mmm`` from a minute up, else ``S.mmms``."""
    minutes = F.floor(ms / 60000)
    rest = ms - minutes * 60000
    over = F.format_string("%d:%02d.%03d", minutes, F.floor(rest / 1000), rest % 1000)
    under = F.format_string("%d.%03ds", F.floor(ms / 1000), ms % 1000)
    return F.when(ms >= 60000, over).otherwise(under)


def parse_clock(text: Column) -> Column:
    """Milliseconds from ``[M:]S.mmm[s]``; null if it is neither."""
    pattern = r"^(?:([0-9]+):)?([0-9]+)\.([0-9]{3})s?$"
    minutes = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.when(
        text.rlike(pattern),
        F.coalesce(minutes.cast("long"), F.lit(0)) * 60000
        + F.regexp_extract(text, pattern, 2).cast("long") * 1000
        + F.regexp_extract(text, pattern, 3).cast("long"),
    )


def safe_slug(text: Column) -> Column:
    """ASCII only, lower case, words joined by single hyphens."""
    ascii_only = F.lower(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.btrim(F.regexp_replace(ascii_only, "[^a-z0-9]+", "-"), F.lit("-"))


def hash_key(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)
