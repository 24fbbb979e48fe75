"""A bidirectional FM-index over word numbers, for one shard of texts.

The shard's pieces of text stand in one array, each closed by 0. Sorting its suffixes gives the
Burrows-Wheeler transform; the array read backwards gives the other one. A phrase is an interval in
both orders: rows that start with it, and rows that start with it read backwards. The symbols that the
transform holds in an interval are the words next to the phrase on one side, so one pass over an
interval yields all its extensions to that side with their counts. In that order the new interval is
found by rank, in the other it is the part of the old one behind the lesser symbols.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from wordloom.llm.runs import refine


def _order(pieces: np.ndarray) -> np.ndarray:
    """Suffixes of an array of pieces in order. A closing 0 is below all words, and an earlier below a later one."""
    closing = pieces == 0
    counts = np.bincount(pieces)
    counts[0] = closing.sum()
    rank = (np.cumsum(counts) - counts)[pieces]
    rank[closing] = np.arange(counts[0])
    at = np.flatnonzero((counts[pieces] > 1) & ~closing)
    step = 1
    while len(at):
        # a class that is not settled has no closing 0 within ``step``, so there is something at ``at + step``
        rank = refine(rank, at, rank[at + step])
        step *= 2
        size = np.bincount(rank[at])
        at = at[size[rank[at]] > 1]
    order = np.empty(len(pieces), np.int64)
    order[rank] = np.arange(len(pieces))
    return order


def transforms(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transforms of the pieces (each closed by 0) and of the pieces read backwards."""
    backward = np.append(pieces[:-1][::-1], 0)
    return tuple(x[_order(x) - 1].astype(np.uint32) for x in (pieces, backward))


class Extensions(NamedTuple):
    """Phrases longer by a word: the phrase they come from, occurrences, and both intervals' first rows."""

    owner: np.ndarray
    count: np.ndarray
    here: np.ndarray
    there: np.ndarray


def extend(transform: np.ndarray, here: np.ndarray, there: np.ndarray, count: np.ndarray) -> Extensions:
    """All extensions of phrases whose intervals start at ``here`` in the order of ``transform``, and at
    ``there`` in the other; none overlap."""
    total = int(count.sum())
    owner = np.repeat(np.arange(len(here)), count)
    first = np.cumsum(count) - count
    rows = np.arange(total) - np.repeat(first - here, count)
    symbol = transform[rows].astype(np.int64)
    by = np.argsort(owner << 32 | symbol, kind="stable")
    owner, symbol, rows = owner[by], symbol[by], rows[by]
    new = np.ones(total, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, total))
    owner, symbol, rows = owner[at], symbol[at], rows[at]
    other = there[owner] + at - first[owner]
    # the row of a symbol: how many lesser symbols there are, and equal ones above
    ranked = np.empty(len(transform), np.int64)
    ranked[np.argsort(transform, kind="stable")] = np.arange(len(transform))
    word = symbol > 0
    return Extensions(owner[word], counts[word], ranked[rows[word]], other[word])


def holder(starts: np.ndarray, count: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the interval that holds it, and whether there is one. ``starts`` ascend."""
    at = np.searchsorted(starts, rows, side="right") - 1
    safe = np.maximum(at, 0)
    return safe, (at >= 0) & (rows < starts[safe] + count[safe]) if len(starts) else np.zeros(len(rows), bool)
