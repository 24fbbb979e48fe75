"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wordloom.llm import queries
from wordloom.llm.common import documents
from wordloom.llm.runs import BLOCK, new_neighbours, periodic_runs, runs_of, suffix_order

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least_words=6, least_turns=4):
    """Every maximal stretch of every period, without those that a shorter period explains."""
    out = []
    for q in range(1, len(words) // least_turns + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            stretch = words[s : s + length]
            least = next(p for p in range(1, q + 1) if all(stretch[k] == stretch[k + p] for k in range(length - p)))
            if length >= max(least_words, least_turns * q) and least == q:
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def texts(rng):
    yield []
    yield ["a"]
    yield ["a"] * 5
    yield ["a"] * 6
    yield ["a"] * (3 * BLOCK)
    yield list("abab") * 3 + ["a"]
    yield (list("aab") * 4 + ["c"]) * 5
    yield list("abcd") * 40 + list("abcd"[::-1]) * 40
    for _ in range(150):
        letters = "ab" if rng.random() < 0.5 else "abcde"
        words = []
        while len(words) < rng.randint(1, 120):
            turn = [rng.choice(letters) for _ in range(rng.randint(1, 7))]
            words += turn * rng.choice([1, 1, 2, 4, 5, 9]) + turn[: rng.randint(0, len(turn))]
        yield words


def test_runs_of_many_texts_match_brute_force():
    rng = random.Random(3)
    many = list(texts(rng))
    assert runs_of(many, 6, 4) == [brute_runs(t) for t in many]
    assert runs_of(many, 4, 2) == [brute_runs(t, 4, 2) for t in many]
    assert sum(map(len, map(brute_runs, many))) > 200


def test_neighbours_share_exactly_the_weight_at_which_they_meet():
    rng = random.Random(4)
    words = np.array([rng.randint(0, 1) for _ in range(400)])
    ends = np.full(len(words), len(words))
    seen = set()
    for i, j, w in new_neighbours(*suffix_order(words, ends, 2)):
        assert (i, j) not in seen and i < j
        seen.add((i, j))
        assert (words[i : i + w] == words[j : j + w]).all() and (j + w == len(words) or words[i + w] != words[j + w])
    assert seen


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, " \n"), (None, "x " * 9), (4, "x " * 9), (4, "x " * 9)]])
def test_defined_results(spark, rows):
    got = periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        full = r.doc_id in (None, 4)
        assert [tuple(x) for x in r.runs] == ([(0, 9, 1)] if full else []) and r.collapsed == ("x" if full else "")


def test_a_very_long_text(spark):
    words = ["a"] * 150_000 + [f"w{i}" for i in range(100_000)] + ["x", "y", "z"] * 50_000
    got = periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")).first()
    assert [tuple(r) for r in got.runs] == [(0, 150_000, 1), (250_000, 150_000, 3)]
    assert got.collapsed == " ".join(["a", *words[150_000:250_000], "x", "y", "z"])


def test_query_matches_brute_force(spark):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    rows = documents(spark, SF).select("doc_id", "text").collect()
    changed = 0
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        runs, r = brute_runs_fast(words), got.pop(doc_id)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, k, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(kept_words(words, runs)))
        if not runs:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
            continue
        best = runs[0]
        for x in runs[1:]:
            if x[1] * best[2] > best[1] * x[2]:
                best = x
        assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
    assert not got and changed >= 10


def brute_runs_fast(words):
    """``brute_runs`` with the comparison of all words at a distance done at once."""
    names = {}
    x = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    out = []
    for q in range(1, len(x) // 4 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edges = np.flatnonzero(np.diff(same.astype(np.int8)))
        for s, e in zip(edges[::2], edges[1::2], strict=True):
            length = int(e - s) + q
            if length >= max(6, 4 * q):
                part = x[s : s + length]
                if not any((part[:-p] == part[p:]).all() for p in range(1, q)):
                    out.append((int(s), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))
