"""Readers and writers of transcript files: hand-off documents, cut lists, word and gap lines,
envelopes, scripts, sidecar lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import text as tx

EDL_ITEM = "struct<source_clip:string,start:double,end:double,keep:boolean,reason:string>"
WORD_ITEM = "struct<word:string,start:double,end:double,source_clip:string>"
HANDOFF = f"source_clips array<string>, edl array<{EDL_ITEM}>, words array<{WORD_ITEM}>"

SIDECARS = {
    "overlays": (
        "type string, start double, end double, source_clip string, name string, path string, kind string, "
        "clip_start double, beats array<double>, layout string, motion map<string,string>"
    ),
    "videos": (
        "id string, title string, subtitle string, scrim boolean, start double, end double, caption string, "
        "filename string, of string, style string, motion string, flip boolean, trim array<bigint>"
    ),
    "tracks": "track string, path string, start double, end double, gain_db double, source_start double, slow_pct double",
    "sounds": "sound string, at double, source_clip string, gain_db double",
}
# What a missing key means.
SIDECAR_DEFAULTS = {
    "overlays": {"start": 0.0, "end": 0.0, "clip_start": 0.0},
    "videos": {"start": 0.0, "end": 0.0},
    "tracks": {"start": 0.0, "end": -1.0, "gain_db": 0.0, "source_start": 0.0, "slow_pct": 0.0},
    "sounds": {"gain_db": 0.0},
}


def _ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def read_handoff(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cut-list rows and word rows of all hand-off documents under ``path``. Positions are those in
    the document."""
    docs = spark.read.schema(HANDOFF).json(path, multiLine=multi_line)
    edl = docs.select(F.posexplode("edl").alias("seq", "e")).select(
        F.col("e.source_clip").alias("clip_id"), "seq", _ms(F.col("e.start")).alias("start_ms"),
        _ms(F.col("e.end")).alias("end_ms"), "e.keep", "e.reason",
    )
    words = docs.select(F.posexplode("words").alias("pos", "w")).select(
        F.col("w.source_clip").alias("clip_id"), F.col("pos").cast("long").alias("pos"), "w.word",
        _ms(F.col("w.start")).alias("start_ms"), _ms(F.col("w.end")).alias("end_ms"),
    )
    return edl, words


def handoff_documents(edl: DataFrame, words: DataFrame) -> DataFrame:
    """One document per clip. The format holds a clip in one document, so a clip is one row here."""
    e = edl.groupBy("clip_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "keep", "reason", "clip_id"))),
            lambda x: F.struct(
                x["clip_id"].alias("source_clip"), (x["start_ms"] / 1000).alias("start"), (x["end_ms"] / 1000).alias("end"),
                x["keep"].alias("keep"), x["reason"].alias("reason"),
            ),
        ).alias("edl")
    )
    w = words.groupBy("clip_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "word", "start_ms", "end_ms", "clip_id"))),
            lambda x: F.struct(
                x["word"].alias("word"), (x["start_ms"] / 1000).alias("start"), (x["end_ms"] / 1000).alias("end"),
                x["clip_id"].alias("source_clip"),
            ),
        ).alias("words")
    )
    return e.join(w, "clip_id").select(F.array("clip_id").alias("source_clips"), "edl", "words")


def read_edl(spark: SparkSession, path: str) -> DataFrame:
    """A saved cut list; a missing path is an error."""
    return spark.read.schema("source_clip string, start double, end double, keep boolean, reason string").json(path).select(
        F.col("source_clip").alias("clip_id"), _ms(F.col("start")).alias("start_ms"), _ms(F.col("end")).alias("end_ms"), "keep", "reason"
    )


def write_edl(edl: DataFrame, path: str) -> None:
    edl.select(
        F.col("clip_id").alias("source_clip"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "keep", "reason"
    ).write.mode("overwrite").json(path)


_WORD_LINE = r"""^\s*([0-9:.]+)s?\s*→\s*([0-9:.]+)s?\s+(?:'(.*)'|"(.*)")\s+conf=([0-9.]+)"""


def parse_word_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """``2.140s → 2.561s 'word' conf=0.85`` lines; other lines are skipped."""
    v = F.col(line)
    word = F.coalesce(
        F.nullif(F.regexp_extract(v, _WORD_LINE, 3), F.lit("")), F.regexp_extract(v, _WORD_LINE, 4)
    )
    return lines.where(v.rlike(_WORD_LINE)).select(
        *[c for c in lines.columns if c != line],
        tx.parse_clock(F.regexp_extract(v, _WORD_LINE, 1)).alias("start_ms"),
        tx.parse_clock(F.regexp_extract(v, _WORD_LINE, 2)).alias("end_ms"),
        word.alias("word"),
        F.regexp_extract(v, _WORD_LINE, 5).cast("double").alias("confidence"),
        v.contains("[OUTTAKE]").alias("outtake"),
    )


def word_line(word: Column, start_ms: Column, end_ms: Column, confidence: Column) -> Column:
    quote = F.when(F.contains(word, F.lit("'")), F.lit('"')).otherwise(F.lit("'"))
    return F.concat(
        tx.clock(start_ms), F.lit(" → "), tx.clock(end_ms), F.lit("     "), quote, word, quote,
        F.lit(" conf="), F.format_string("%.2f", confidence),
    )


def parse_gap_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Six fields per line: start, end, effective start, speech end, type, decision; # comments."""
    f = F.split(F.trim(F.col(line)), r"\s+")
    rows = lines.where(~F.trim(F.col(line)).startswith("#") & (F.size(f) == 6))
    return rows.select(
        *[c for c in lines.columns if c != line],
        *[_ms(F.get(f, F.lit(i)).cast("double")).alias(n) for i, n in enumerate(("start_ms", "end_ms", "effective_ms", "speech_end_ms"))],
        F.get(f, F.lit(4)).alias("gap_type"),
        (F.get(f, F.lit(5)) == "cut").alias("cut"),
    )


def parse_envelope(runs: Column) -> Column:
    """``S11 .113 S33`` to one flag per 10 ms frame (S is speech)."""
    parts = F.regexp_extract_all(runs, F.lit(r"([S.])([0-9]+)"), F.lit(0))
    return F.flatten(
        F.transform(parts, lambda p: F.array_repeat(p.startswith("S"), F.substring(p, F.lit(2), F.char_length(p)).cast("int")))
    )


def script_sections(scripts: DataFrame) -> DataFrame:
    """Lines of each script with the heading they stand under; headings and blanks go. ``text`` is
    one input row, so its lines are numbered and scanned within that row."""
    lines = scripts.select("slug", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    line = F.trim("raw")
    heading = F.when(line.rlike(r"^\*\*.+\*\*$"), F.rtrim(F.regexp_extract(line, r"^\*\*(.+?)\*\*$", 1), F.lit(":")))
    w = Window.partitionBy("slug").orderBy("line_no")
    return (
        lines.select("slug", F.col("line_no").cast("long").alias("line_no"), line.alias("text"), F.last(heading, ignorenulls=True).over(w).alias("section"), heading.isNotNull().alias("_h"))
        .where("not _h and section is not null and text <> ''")
        .drop("_h")
    )


def spoken_lines(sections: DataFrame) -> DataFrame:
    """Lines of the sections that are spoken once, markers removed."""
    return sections.where(F.col("section").isin("SCRIPT", "CONCLUSION", "CTA")).withColumn(
        "text", F.regexp_replace("text", r"^\[cut-[0-9]+\]\s*", "")
    )


def marked_lines(sections: DataFrame) -> DataFrame:
    """Removable lines ``[cut-N]`` of the script section with their unit."""
    m = r"^\[cut-([0-9]+)\]\s*"
    return sections.where((F.col("section") == "SCRIPT") & F.col("text").rlike(m)).select(
        "slug", "line_no", F.regexp_extract("text", m, 1).cast("long").alias("unit"), F.regexp_replace("text", m, "").alias("text")
    )


def read_sidecar(spark: SparkSession, path: str, kind: str, multi_line: bool = True) -> DataFrame:
    """Overlay, video, track or sound lists; missing keys take their defaults."""
    df = spark.read.schema(SIDECARS[kind]).json(path, multiLine=multi_line)
    return with_defaults(df, kind)


def with_defaults(df: DataFrame, kind: str) -> DataFrame:
    fixed = SIDECAR_DEFAULTS[kind]
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in fixed:
            c = F.coalesce(c, F.lit(fixed[f.name]))
        elif f.dataType.simpleString() == "string":
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


def write_reports(spark: SparkSession, path: str, **tables: DataFrame) -> None:
    """One table per report (flags, sentences, timeline, summary)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
