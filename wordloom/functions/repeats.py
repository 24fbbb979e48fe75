"""Repeated stretches inside one text, over token codes (0: no letters or digits)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wordloom.functions.strips import list_parts


def seeds(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of a shared n-gram or of one with two neighbours swapped: each with the next and the last."""
    size = len(code) - n + 1
    none = np.empty(0, np.int64)
    if size <= 0:
        return none, none
    grams = np.stack([code[k : k + size] for k in range(n)])
    at = np.flatnonzero((grams != 0).all(axis=0))
    orders = [list(range(n))]
    for k in range(n - 1):
        o = list(range(n))
        o[k], o[k + 1] = o[k + 1], o[k]
        orders.append(o)
    parts = np.concatenate([grams[o][:, at] for o in orders], axis=1)
    pos = np.tile(at, len(orders))
    key, base = parts[0], int(code.max()) + 1
    for p in parts[1:]:
        if int(key.max(initial=0)) >= (2**62) // base:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + p
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    new = np.ones(len(key), bool)  # a key once per place
    new[1:] = (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
    key, pos = key[new], pos[new]
    same = key[1:] == key[:-1]
    ends = np.flatnonzero(np.append(~same, True)) if len(key) else none
    run = np.concatenate([[0], np.cumsum(~same)]) if len(key) else none
    i = pos[:-1][same]
    pairs = np.concatenate([i, i]), np.concatenate([pos[1:][same], pos[ends][run[:-1][same]] if len(key) else none])
    far = pairs[1] >= pairs[0] + n
    both = np.unique(pairs[0][far] * np.int64(len(code)) + pairs[1][far])
    return both // len(code), both % len(code)


def _walk(code, a, b, most, step, stop_at_blank=False):
    """From each place pair outwards, up to ``most`` words, to the first two unequal ones in a row:
    words used (the first of the two included), equal ones, and the last equal one's distance."""
    used, ones, far = most.copy(), np.zeros_like(a), np.zeros_like(a)
    live, missed, k = np.arange(len(a)), np.zeros(len(a), bool), 0
    while len(live):
        over = k >= most[live]
        if stop_at_blank:
            x = code[np.maximum(a[live] + step * k, 0)]
            over = over | (x == 0)
        used[live[over]] = k
        live, missed = live[~over], missed[~over]
        hit = code[a[live] + step * k] == code[b[live] + step * k]
        ones[live[hit]] += 1
        far[live[hit]] = k + 1
        closed = ~hit & missed
        used[live[closed]] = k
        live, missed = live[~closed], ~hit[~closed]
        k += 1
    return used, ones, far


def extended(code: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal words of each pair grown both ways, one unequal word at a time allowed, and how far back it grew."""
    used, ones, _ = _walk(code, i + n, j + n, len(code) - j - n, 1)
    room = np.maximum(np.minimum(i, j - i - n - used), 0)
    _, before, back = _walk(code, i - 1, j - 1, room, -1, stop_at_blank=True)
    return n + ones + before, back


def head_seen(code: np.ndarray, content: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Per word: the latest place, in earlier takes, of any content word its take holds before it; -1 if none."""
    pos = np.flatnonzero(content)
    order = np.lexsort((pos, code[pos]))
    p = pos[order]
    seen = np.full(len(code), -1, np.int64)
    if len(p):
        first = np.ones(len(p), bool)  # of a token in a take
        first[1:] = (code[p][1:] != code[p][:-1]) | (take[p][1:] != take[p][:-1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
        prior = start > 0
        ok = np.zeros(len(p), bool)
        ok[prior] = code[p][start[prior] - 1] == code[p][prior]
        seen[p[ok]] = p[start[ok] - 1]
    high = np.int64(len(code) + 1)
    upto = np.maximum.accumulate(seen + take * high)  # later takes lie above all earlier ones
    before = np.full(len(code), -1, np.int64)
    inner = np.flatnonzero(take[1:] == take[:-1]) + 1
    before[inner] = upto[inner - 1] - take[inner] * high
    return before


def _take_columns(f: dict[str, np.ndarray], i, j, ci, cj) -> dict[str, np.ndarray]:
    """What the rules ask of the two places that a pair begins at."""
    n = len(f["start"])
    gap = np.zeros(n, np.int64)
    gap[1:] = f["start"][1:] - f["end"][:-1]
    after_end = np.concatenate([[False], f["ends"][:-1]])
    rest = np.arange(n) > 0
    edge = rest & ((gap >= f["take_ms"]) | after_end)
    stops = np.cumsum(rest & ((gap >= f["stop_ms"]) | after_end))
    trails = np.cumsum(f["trail"]) - f["trail"]
    take = np.cumsum(edge)
    take0 = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    said = np.cumsum(f["content"]) - f["content"]
    seen = head_seen(f["code"], f["content"], take)
    return {
        "cut_start_ms": f["start"][ci], "cut_end_ms": f["start"][cj], "prev_gap_ms": gap[cj],
        "stops_i": stops[ci], "stops_j": stops[cj], "trails_i": trails[ci], "trails_j": trails[cj],
        "fb": take0[ci], "kb": take0[cj], "head_words": (said - said[take0])[cj], "head_seen": seen[cj],
    }


SEEDS = ("i", "j")
PAIRS = (
    *SEEDS, "match_len", "ci", "cj", "cut_start_ms", "cut_end_ms", "prev_gap_ms", "stops_i", "stops_j",
    "trails_i", "trails_j", "fb", "kb", "head_words", "head_seen",
)
#: Pairs that leave a task at once.
ROWS = 1 << 16


def pairs_of(n: int, take_ms: int, stop_ms: int, judged: bool):
    """Arrow function: clip_id, tok (and start, end, ends, trail, content if ``judged``) to rows of pairs."""
    names = PAIRS if judged else SEEDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, toks = list_parts(batch["tok"])
            words = toks.dictionary_encode()
            blank = pc.equal(words.dictionary, "").to_numpy(zero_copy_only=False)
            code = np.where(blank, 0, np.arange(1, len(blank) + 1))[words.indices.to_numpy(zero_copy_only=False)]
            whole = {"code": code.astype(np.int64)}
            if judged:
                for c in ("start", "end", "ends", "trail", "content"):
                    whole[c] = list_parts(batch[c])[1].to_numpy(zero_copy_only=False)
            for row, (a, b) in enumerate(zip(at[:-1], at[1:])):
                f = {c: v[a:b] for c, v in whole.items()}
                # small codes, so that keys fit: the codes of a batch may be many
                f["code"] = _ranked(f["code"])
                i, j = seeds(f["code"], n)
                if not len(i):
                    continue
                out = {"i": i, "j": j}
                if judged:
                    got, back = extended(f["code"], i, j, n)
                    out |= {"match_len": got, "ci": i - back, "cj": j - back}
                    out |= _take_columns(f | {"take_ms": take_ms, "stop_ms": stop_ms}, i, j, i - back, j - back)
                for x in range(0, len(i), ROWS):
                    part = [pa.array(out[c][x : x + ROWS], pa.int64()) for c in names]
                    clip = pa.repeat(batch["clip_id"][row], len(part[0]))
                    yield pa.RecordBatch.from_arrays([clip, *part], ["clip_id", *names])

    return run


def _ranked(code: np.ndarray) -> np.ndarray:
    values, rank = np.unique(code, return_inverse=True)
    return rank if len(values) and values[0] == 0 else rank + 1
