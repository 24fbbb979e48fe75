"""Periodic runs of words, by Kruskal's scheme over common prefixes.

Each text's suffixes (of words) are ordered by prefix doubling, many texts in one array; texts share no word
number, so nothing meets across texts. Neighbours in that order are edges, weighted by their common
prefix. Taking edges by decreasing weight, a union-find unites suffix classes; each class keeps its
positions in order. Positions i < j that become neighbours by a union at weight w have exactly w words in
common, so the stretch i .. j + w has period j - i. It seeds a run when j - i is within w and long enough,
and is one when the word before i differs from that before j. A shorter period of the stretch would have
put a position between i and j into the class before, so j - i is the least period, and each run is
found once, at its own start.

A run must hold ``least_words`` words and ``least_turns`` periods; an edge too light for any run is left out.
A class keeps its positions in blocks, so that a union costs about the root of its size for each
position of the smaller class. Nothing is shuffled; a group of texts holds about ``GROUP`` words, a longer text
is a group of its own, whose memory is some 100 bytes a word and 4 more for each doubling.

Defined results: null and empty texts have no runs; repeated rows are judged one by one; an empty table gives
an empty result. Columns of other names do not enter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GROUP = 200_000
BLOCK = 512


def refine(rank: np.ndarray, at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Ranks after one more doubling; ``at``: positions whose class is not settled, ``following``: the ranks
    of what follows them. A class is known by its first place in the order."""
    own = rank[at]
    order = np.argsort(own << 32 | following, kind="stable")
    own, following, at = own[order], following[order], at[order]
    new_class = np.ones(len(at), bool)
    new_class[1:] = own[1:] != own[:-1]
    new_part = new_class.copy()
    new_part[1:] |= following[1:] != following[:-1]
    place = np.arange(len(at))
    first = place[new_class][np.cumsum(new_class) - 1]
    head = place[new_part][np.cumsum(new_part) - 1]
    out = rank.copy()
    out[at] = own + head - first
    return out


def suffix_order(words: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order that share ``least`` words or more: earlier, later, words shared.

    ``words``: numbers from 0, none shared between texts; ``ends``: per position the end of its text.
    """
    n = len(words)
    counts = np.bincount(words)
    rank = (np.cumsum(counts) - counts)[words]
    levels, step = [rank.astype(np.uint32)], 1
    at = np.flatnonzero(counts[words] > 1)
    while len(at):
        # past the end of a text comes 0; ranks there are shifted by one
        inside = at + step < ends[at]
        following = np.where(inside, rank[np.minimum(at + step, n - 1)] + 1, 0)
        rank = refine(rank, at, following)
        step *= 2
        size = np.bincount(rank[at], minlength=1)
        at = at[size[rank[at]] > 1]
        levels.append(rank.astype(np.uint32))
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    left, right = order[:-1], order[1:]
    # cheap cut first: most neighbours part within the first few words
    for k, level in enumerate(levels):
        if 1 << k <= least:
            same = level[left] == level[right]
            left, right = left[same], right[same]
    shared = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + shared, right + shared
        inside = (a < ends[left]) & (b < ends[right])
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        shared[same] += 1 << k
    enough = shared >= least
    return left[enough], right[enough], shared[enough]


class _Places:
    """An ordered set of positions, in blocks of bounded length."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, place: int):
        self.blocks, self.firsts, self.size = [[place]], [place], 1

    def add(self, place: int) -> None:
        b = max(bisect_left(self.firsts, place) - 1, 0)
        block = self.blocks[b]
        block.insert(bisect_left(block, place), place)
        self.firsts[b] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts[b : b + 1] = [block[0], block[BLOCK]]

    def around(self, place: int) -> tuple[int | None, int | None]:
        """The members before and after a member."""
        b = bisect_left(self.firsts, place + 1) - 1
        block = self.blocks[b]
        i = bisect_left(block, place)
        before = block[i - 1] if i else (self.blocks[b - 1][-1] if b else None)
        after = block[i + 1] if i + 1 < len(block) else (self.firsts[b + 1] if b + 1 < len(self.firsts) else None)
        return before, after

    def __iter__(self):
        for block in self.blocks:
            yield from block


def new_neighbours(left: np.ndarray, right: np.ndarray, shared: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """i, j, w: positions i < j that become neighbours in their class when edges of weight w are taken."""
    root: dict[int, int] = {}
    classes: dict[int, _Places] = {}

    def find(x: int) -> int:
        top = root.setdefault(x, x)
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    falling = np.argsort(-shared, kind="stable")
    for a, b, w in zip(left[falling].tolist(), right[falling].tolist(), shared[falling].tolist(), strict=True):
        a, b = find(a), find(b)
        large, small = classes.get(a) or _Places(a), classes.get(b) or _Places(b)
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        root[b] = a
        moved = list(small)
        if len(moved) == 1:
            place = moved[0]
            large.add(place)
            before, after = large.around(place)
            if before is not None:
                yield before, place, w
            if after is not None:
                yield place, after, w
        else:
            for place in moved:
                large.add(place)
            own = set(moved)
            for place in moved:
                before, after = large.around(place)
                if before is not None and before not in own:
                    yield before, place, w
                if after is not None and after not in own:
                    yield place, after, w
        classes.pop(b, None)
        classes[a] = large


def runs_of(texts: list[list[str]], least_words: int, least_turns: int) -> list[list[tuple[int, int, int]]]:
    """Per text its runs (start, length, period), by start, then period."""
    numbers: list[int] = []
    base = 0
    for words in texts:
        known: dict[str, int] = {}
        numbers.extend([known.setdefault(w, base + len(known)) for w in words])
        base += len(known)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not numbers:
        return found
    lengths = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(lengths)
    ends = np.repeat(stops, lengths)
    # the least common prefix of a run's first two turns, over all periods
    least = min(max(least_words - q, (least_turns - 1) * q) for q in range(1, least_words + 1))
    edges = suffix_order(np.array(numbers, np.int64), ends, max(least, 1))
    starts = stops - lengths
    for i, j, w in new_neighbours(*edges):
        period = j - i
        if w < max(least_words - period, (least_turns - 1) * period):
            continue
        text = int(np.searchsorted(stops, i, side="right"))
        start = int(starts[text])
        if i == start or numbers[i - 1] != numbers[j - 1]:
            found[text].append((i - start, period + w, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def _kept(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    if not runs:
        return words
    step = [0] * (len(words) + 1)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    depth, out = 0, []
    for word, change in zip(words, step, strict=False):
        depth += change
        if not depth:
            out.append(word)
    return out


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = 6, least_turns: int = 4
) -> DataFrame:
    """Per row: id, ``runs`` (start, length, period of each, by start, then period) and ``collapsed``, the
    words that no run repeats (all but those behind a run's first period), joined by a blank."""
    if least_words < 2 or least_turns < 2:
        raise ValueError("a run holds two words and two periods at least")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = rows.select("_id").schema.add("runs", T.ArrayType(run)).add("collapsed", "string")
    fields = [pa.field(c, pa.int64()) for c in run.names]

    def emit(ids: list[pa.Array], texts: list[list[str]]) -> pa.RecordBatch:
        found = runs_of(texts, least_words, least_turns)
        flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
        offsets = np.cumsum([0, *[len(runs) for runs in found]]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=fields)
        collapsed = [" ".join(_kept(words, runs)) for words, runs in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(collapsed, pa.string())],
            names=["_id", "runs", "collapsed"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for k in range(batch.num_rows):
                words = WORD.findall(batch.column(1)[k].as_py() or "")
                ids.append(batch.column(0).slice(k, 1))
                texts.append(words)
                held += len(words)
                if held >= GROUP:
                    yield emit(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield emit(ids, texts)

    return rows.mapInArrow(work, schema).withColumnRenamed("_id", id_col)
