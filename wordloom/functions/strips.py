"""Source rows as strips: one row per source text, its words and times as arrays.

A text is one input row, so whatever depends only on the words before it in the same text is an
array beside the words. Nothing is shuffled for it; rows of single words are exploded at the end,
with the columns that are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import text as tx


@F.arrow_udf(T.ArrayType(T.LongType()))
def sums_before(values: pa.Array) -> pa.Array:
    """Per list: the sum of the values before each one."""
    at, flat = list_parts(values)
    run = np.concatenate([[0], np.cumsum(flat.to_numpy(zero_copy_only=False))]).astype(np.int64)
    before = run[:-1] - np.repeat(run[at[:-1]], np.diff(at))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(before, pa.int64()))


def list_parts(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column; a null list is empty."""
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), values.flatten()


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\r\\f]+"), lambda x: x != "")


def spoken_ms(word: Column, i: Column) -> Column:
    """How long a word lasts on the test timeline."""
    return (60 * F.char_length(word)).cast("long")


def pause_ms(word: Column, i: Column) -> Column:
    """The pause after a word, by its end and its place in the text."""
    return (
        F.when(word.rlike(tx.TERMINAL), 700)
        .when(word.rlike(tx.CLAUSE), 300)
        .when(i % 101 == 57, 2300)
        .when(i % 23 == 11, 650)
        .otherwise(20 + (13 * i) % 90)
    ).cast("long")


def confidence(word: Column, i: Column) -> Column:
    """How surely a word was heard on the test timeline."""
    return ((7 * F.char_length(word) + 13 * i) % 100).cast("double") / 100


def outside_runs(t: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which times lie in no run of the spans (in order of their starts). Spans at most 1 ms apart are one run; the
    last ms of a run is outside."""
    if not len(s):
        return np.ones(len(t), bool)
    top = np.maximum.accumulate(e)
    first = np.flatnonzero(np.concatenate([[True], s[1:] > top[:-1] + 1]))
    stop = top[np.concatenate([first[1:], [len(s)]]) - 1]
    k = np.searchsorted(s[first], t, "right") - 1
    return (k < 0) | (t >= stop[k] - 1)


_TOKEN = T.StructType().add("at_ms", "long").add("i", "integer").add("text", "string").add("line", "long").add("closes", "boolean")


@F.arrow_udf(T.ArrayType(_TOKEN))
def played_tokens(words: pa.Array, starts: pa.Array, cut_s: pa.Array, cut_e: pa.Array, mark_at: pa.Array, marks: pa.Array) -> pa.Array:
    """Per text: its words outside the cuts, and the marks before the words of the same time. ``i`` is the word's place,
    null for a mark; ``closes``: a line ends behind it; ``line`` counts the lines begun after the first token.
    Cuts are in order of start; all times are below 2 ** 39 ms."""
    at, word = list_parts(words)
    lists = [list_parts(x) for x in (starts, cut_s, cut_e, mark_at)]
    t, s, e, m = (x.to_numpy(zero_copy_only=False).astype(np.int64) + _apart(a) for a, x in lists)
    kept = np.flatnonzero(outside_runs(t, s, e))
    place = (np.arange(len(t)) - np.repeat(at[:-1], np.diff(at)))[kept]
    closes = pc.match_substring_regex(pc.utf8_rtrim(word, characters="'\"”’)"), pattern="[.!?]$")
    closes = np.concatenate([np.ones(len(m), bool), closes.to_numpy(zero_copy_only=False).astype(bool)[kept]])
    time, is_mark = np.concatenate([m, t[kept]]), np.arange(len(m) + len(kept)) < len(m)
    order = np.argsort(time, kind="stable")
    time, is_mark, closes = time[order], is_mark[order], closes[order]
    ends = np.searchsorted(time, (np.arange(len(words) + 1, dtype=np.int64) << 40) - (1 << 39))
    begins = np.concatenate([[False], closes[:-1]]) | is_mark
    begun = np.concatenate([[0], np.cumsum(begins)])
    line = begun[1:] - np.repeat(begun[np.minimum(ends[:-1], len(time) - 1) + 1] if len(time) else ends[:-1], np.diff(ends))
    text = pa.concat_arrays([list_parts(marks)[1], word.take(pa.array(kept))]).take(pa.array(order))
    index = pa.array(np.concatenate([np.zeros(len(m), np.int64), place])[order].astype(np.int32), mask=is_mark)
    own = time - np.repeat(np.arange(len(words), dtype=np.int64) << 40, np.diff(ends))
    fields = [pa.array(own), index, text, pa.array(line.astype(np.int64)), pa.array(closes)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, _TOKEN.names))


def _apart(at: np.ndarray) -> np.ndarray:
    """Per value of a list column: what moves the rows' times clear of each other."""
    return np.repeat(np.arange(len(at) - 1, dtype=np.int64) << 40, np.diff(at))


def word_strips(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column ``text``) with its ``words`` and their ``starts`` from the text's own zero."""
    steps = F.transform("words", lambda w, i: spoken_ms(w, i) + pause_ms(w, i))
    return rows.withColumn("words", words_of(F.col("text"))).withColumn("starts", sums_before(steps)).drop("text")


def shifted(values: str, by: int) -> Column:
    """The array moved so that each place holds the value ``by`` places later (earlier if negative)."""
    if by > 0:
        return F.slice(values, F.lit(by + 1), F.size(values))
    return F.concat(F.array_repeat(F.get(values, F.lit(-1)), -by), values)  # get: null outside
