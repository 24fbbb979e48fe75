"""Collocations against brute force, the index against plain scans."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from wordloom.llm import collocations as co
from wordloom.llm.common import documents
from wordloom.llm.word_index import extend, transforms

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, count string, id string"


def brute(rows, least=30, longest=4, top=2000, covered=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        got = []
        for p, a in cand.items():
            if p in most and 100 * most[p] >= covered * a:
                continue
            cuts = [(2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))]
            s, _, l, r = min(cuts)
            got.append((s, a, " ".join(p), l, r))
        got.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(got[:top])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_extensions_match_a_scan():
    rng = random.Random(1)
    pieces = np.array([x for _ in range(200) for x in [*[rng.randint(1, 4) for _ in range(rng.randint(1, 9))], 0]])
    forward, backward = transforms(pieces)
    text = [tuple(map(int, p.split())) for p in " ".join(map(str, pieces)).split(" 0")]
    rows = sorted(range(len(pieces)), key=lambda i: [(x, 0) if x else (0, j) for j, x in enumerate(pieces[i:].tolist(), i)])
    assert [int(pieces[i - 1]) for i in rows] == forward.tolist()
    counts = np.bincount(pieces)
    starts = (np.cumsum(counts) - counts)[1:]
    level = {(w + 1,): (int(starts[w]), int(starts[w]), int(counts[w + 1])) for w in range(4)}
    for right in (True, False, True, False):
        phrases = sorted(level, key=lambda p: level[p][1 if right else 0])
        row, back, count = (np.array([level[p][k] for p in phrases]) for k in range(3))
        here, there = (back, row) if right else (row, back)
        new = extend(backward if right else forward, here, there, count)
        longer = {}
        for k in range(len(new.owner)):
            at = (new.there[k], new.here[k]) if right else (new.here[k], new.there[k])
            start = rows[at[0]]
            p = tuple(pieces[start : start + len(phrases[0]) + 1].tolist())
            assert phrases[new.owner[k]] == (p[:-1] if right else p[1:])
            longer[p] = (int(at[0]), int(at[1]), int(new.count[k]))
        size = len(phrases[0]) + 1
        want = Counter(p[i : i + size] for p in text for i in range(len(p) - size + 1))
        assert {p: c for p, (_, _, c) in longer.items()} == want
        level = longer


def test_matches_brute_force_over_many_small_shards(spark, monkeypatch):
    monkeypatch.setattr(co, "SHARD_WORDS", 700)
    monkeypatch.setattr(co, "CHUNK", 50)
    rng = random.Random(2)
    rows = []
    for i in range(300):
        words = [rng.choice(["The", "cat", "sat", "on", "a", "mat", "é", "New", "York", "x-y"]) for _ in range(rng.randint(0, 60))]
        for at in range(0, len(words), 7):
            words[at : at + 1] = ["new", "York", "city"] if rng.random() < 0.6 else ["of,", "the\tend.", "\x0b"]
        rows.append((rng.choice(["en", "en", "en", None, "de"]), " ".join(words)))
    rows += [("en", None), ("en", ""), (None, None), ("fr", " . ;; \n"), ("und", "new york city " * 40), ("it", "a " * 3000)]
    rows += [rows[0]] * 5
    docs = spark.createDataFrame([(i, t, lang, "c", "i") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(6)
    want = brute(rows)
    assert got(co.collocations(docs)) == want and len({r[0] for r in want}) >= 3
    assert got(co.collocations(docs, least=2, longest=3, top=5, covered=100)) == brute(rows, 2, 3, 5, 100)
    assert got(co.collocations(docs.limit(0))) == []


def test_a_very_long_text_is_cut_without_losing_a_phrase(spark):
    text = " ".join(f"w{i % 700} of the" for i in range(300_000))
    docs = spark.createDataFrame([(1, text, "en", "", "")], SCHEMA)
    assert got(co.collocations(docs)) == brute([("en", text)])


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**18
    row = spark.createDataFrame([(big, [big, 5 * 10**18], [big + 1, big])], "a bigint, heads array<bigint>, tails array<bigint>")
    cut = row.select(co._least_cut().alias("c")).first()["c"]
    assert tuple(cut) == min((2_000_000 * big // (x + y), k, x, y) for k, x, y in ((1, big, big + 1), (2, 5 * 10**18, big)))


def test_query_matches_brute_force(spark):
    rows = [(r.lang, r.text) for r in documents(spark, SF).select("lang", "text").collect()]
    from wordloom.llm.queries import op12_word_index

    assert got(op12_word_index(spark, SF)) == brute(rows)
