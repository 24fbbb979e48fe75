"""Quality rules by distribution divergence. Native expressions only.

Each document becomes two histograms: its word characters by class, and its words by common word. Per
language, the histograms of all documents of that language that pass the base rules and are long
enough are summed to a reference. A document's distance to a language is the Jensen-Shannon distance
(base 2, 0 to 1) of each histogram to that language's; it is held against the nearest language, so a
wrong or missing language tag does no harm. Documents below a minimum length are not held against a
histogram they cannot fill.

One pass over the texts writes a row of counts per document; references are sums over those rows, at
most one per language of ``COMMON_WORDS``. Texts are never shuffled, and repeated word windows are
found inside the row: equal counts of windows and distinct windows settle most documents, and only the
others sort their windows.

Defined results: a null text has no words and fails the base rules; repeated rows are judged one by
one and each counts in its reference; a corpus without a reference has distance null and keeps what
passes the base rules. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wordloom.llm.common import keep, words

#: Common words by language. Fixed values.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "was", "this"),
    "de": ("der", "die", "und", "das", "von", "zu", "den", "mit", "ist", "für", "ein", "auf"),
    "fr": ("de", "la", "le", "et", "les", "des", "un", "une", "que", "en", "du", "dans"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "para"),
}
ALL_COMMON = tuple(dict.fromkeys(w for group in COMMON_WORDS.values() for w in group))
CLASSES = ("lower", "upper", "digit", "symbol", "other")
SYMBOLS = "[#*$%&|<>]"

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Least words for a document to be held against the histogram of classes, of common words, and to
#: count in a reference.
CLASS_MIN_WORDS = 20
COMMON_MIN_WORDS = 50
REFERENCE_MIN_WORDS = 80
#: Largest distances to the nearest language, for endless texts; a text of n words may be further off
#: by the noise of a small sample, which falls with the root of n.
MAX_CLASS_DISTANCE, CLASS_NOISE = 0.2, 1.1
MAX_COMMON_DISTANCE, COMMON_NOISE = 0.11, 1.7


def _bind(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def repeated_words(w: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of ``size`` words that occur twice or more."""

    def of_windows(h: Column) -> Column:
        def of_places(p: Column) -> Column:  # sorted starts of repeated windows
            n = F.size(p)
            reach = F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.when(i == n - 1, F.lit(size)).otherwise(
                    F.least(F.lit(size), F.get(p, i + 1) - F.get(p, i))
                ),
            )
            return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

        def places(s: Column) -> Column:  # (hash, start), sorted
            n = F.size(s)
            twin = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"])),
            )
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        heavy = _bind(_bind(F.sort_array(pairs), places), of_places)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(heavy)

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    windows = _bind(
        hashed,
        lambda v: F.transform(
            F.sequence(F.lit(0), F.size(v) - size), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(size)])
        ),
    )
    return F.when(F.size(w) < size, F.lit(0)).otherwise(_bind(windows, of_windows))


def document_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: the base counts, ``classes`` and ``common`` (array<double>), ``_lang``."""
    t = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(
        F.col(id_col),
        F.col(lang).cast("string").alias("_lang"),
        words(F.col(text)).alias("_w"),
        # what is left of the text without lower-case letters and white space: a small part of prose
        F.regexp_replace(t, r"[\p{Ll} \t-\r]+", "").alias("_rest"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\t-\\r ]")).alias("_lines"),
    )
    # as written, with a capital, in capitals: cheaper than lower-casing every word
    forms = sorted({f for w in ALL_COMMON for f in (w, w.capitalize(), w.upper())})
    listed = F.filter("_w", lambda x: x.isin(*forms))
    second = first.select(
        id_col,
        "_lang",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.char_length("_rest").cast("long").alias("_n_rest"),
        F.regexp_replace("_rest", r"[\p{Lu}]+", "").alias("_rest"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        # "|the||of|": a common word's count is what its removal shortens
        F.concat(F.lit("|"), F.lower(F.array_join(listed, "||")), F.lit("|")).alias("_listed"),
    )
    n_symbols = F.char_length("_rest") - F.char_length(F.regexp_replace("_rest", SYMBOLS, ""))
    n_digits = F.char_length("_rest") - F.char_length(F.regexp_replace("_rest", r"\p{Nd}", ""))
    third = second.select(
        id_col,
        "_lang",
        "n_words",
        "word_chars",
        n_symbols.cast("long").alias("n_symbols"),
        n_digits.cast("long").alias("_digits"),
        F.char_length("_rest").cast("long").alias("_n_rest2"),
        "_n_rest",
        "n_dup_lines",
        "n_repeat_words",
        F.array(
            *[
                ((F.char_length("_listed") - F.char_length(F.replace("_listed", F.lit(f"|{w}|"), F.lit("")))) / (len(w) + 2))
                for w in ALL_COMMON
            ]
        ).alias("_common"),
    )
    others = F.col("n_words") - F.aggregate("_common", F.lit(0.0), lambda a, x: a + x)
    classes = [
        F.col("word_chars") - F.col("_n_rest"),
        F.col("_n_rest") - F.col("_n_rest2"),
        F.col("_digits"),
        F.col("n_symbols"),
        F.col("_n_rest2") - F.col("_digits") - F.col("n_symbols"),
    ]
    return third.select(
        id_col,
        "_lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"),
        F.array(*[c.cast("double") for c in classes]).alias("classes"),
        F.concat("_common", F.array(others)).alias("common"),
    )


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def language_references(counts: DataFrame) -> list[Row]:
    """Summed histograms of each listed language: at most ``len(COMMON_WORDS)`` rows."""
    n = len(ALL_COMMON) + 1
    return (
        counts.where(
            F.col("_lang").isin(*COMMON_WORDS)
            & ~F.col("base_failed")
            & (F.col("n_words") >= REFERENCE_MIN_WORDS)
        )
        .groupBy("_lang")
        .agg(
            F.array(*[F.sum(F.get("classes", F.lit(i))) for i in range(len(CLASSES))]).alias("classes"),
            F.array(*[F.sum(F.get("common", F.lit(i))) for i in range(n)]).alias("common"),
        )
        .orderBy("_lang")
        .collect()
    )


def js_distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram to a reference; null for an empty one."""
    whole = sum(reference) or 1.0
    q = F.array(*[F.lit(float(x) / whole) for x in reference])
    mass = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        left = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
        return left + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    def distance(p: Column) -> Column:
        terms = F.zip_with(p, q, term)
        return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))

    shares = _bind(mass, lambda m: F.transform(counts, lambda c: c / m))
    return F.when(mass > 0, _bind(shares, distance))


def _nearest(counts: Column, references: list[list[float]]) -> Column:
    if not references:
        return F.lit(None).cast("double")
    return F.array_min(F.array(*[js_distance(counts, r) for r in references]))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts, base_failed, class_distance, common_distance, kept."""
    counts = keep(document_counts(docs, id_col, text, lang), "quality-counts")
    refs = language_references(counts)
    judged = counts.withColumn("class_distance", _nearest(F.col("classes"), [r["classes"] for r in refs])).withColumn(
        "common_distance", _nearest(F.col("common"), [r["common"] for r in refs])
    )

    def beyond(distance: str, least: int, most: float, noise: float) -> Column:
        n = F.col("n_words")
        return (n >= least) & (F.coalesce(distance, F.lit(0.0)) > most + noise / F.sqrt(n))

    far = beyond("class_distance", CLASS_MIN_WORDS, MAX_CLASS_DISTANCE, CLASS_NOISE) | beyond(
        "common_distance", COMMON_MIN_WORDS, MAX_COMMON_DISTANCE, COMMON_NOISE
    )
    return judged.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "class_distance",
        "common_distance",
        (~F.col("base_failed") & ~far).alias("kept"),
    )
