"""Aligned spoken tokens go back to the words they were expanded from."""

import random

import pytest

from wordloom.operators import repair as rp

SPOKEN = {"12": ["twelve"], "21": ["twenty", "one"], "340": ["three", "hundred", "forty"]}


def walk(words, aligned, min_conf):
    """The plain walk: one pointer over the aligned tokens of a clip."""
    out, at = [], 0
    for pos, word, start, end, conf in words:
        parts, taken = SPOKEN.get(word, [word]), []
        for part in parts:
            if at < len(aligned) and aligned[at][0] == part:
                taken.append(aligned[at])
                at += 1
        if taken and (len(parts) > 1 or taken[0][3] >= min_conf):
            out.append((pos, taken[0][1], taken[-1][2], round(sum(t[3] for t in taken) / len(taken), 6), True))
        else:
            out.append((pos, start, end, conf, False))
    return out


def clip(rng, vocabulary, n, drop, foreign):
    words = [(i, rng.choice(vocabulary), 100 * i, 100 * i + 90, 0.5) for i in range(n)]
    aligned = []
    for _, word, start, _, _ in words:
        for k, part in enumerate(SPOKEN.get(word, [word])):
            if rng.random() >= drop:
                aligned.append((part, start + 7 + 20 * k, start + 20 + 20 * k, rng.choice([0.1, 0.3, 0.9])))
            if rng.random() < foreign:
                aligned.append((rng.choice(["never", *vocabulary[:3]]), start, start + 1, 0.9))
    return words, aligned


@pytest.mark.parametrize("min_conf", [0.0, 0.25])
def test_like_the_plain_walk(spark, min_conf):
    rng = random.Random(5)
    many, few = [f"w{i}" for i in range(40)] + list(SPOKEN), ["a", "b", "21", "340"]
    clips = {}
    for c in range(24):
        clips[f"c{c:02}"] = clip(rng, few if c % 3 == 0 else many, rng.choice([1, 9, 40]), rng.choice([0, 0.1, 0.5]), rng.choice([0, 0, 0.05]))
    clips["empty"] = (clips["c01"][0], [])
    words = spark.createDataFrame([(c, *w) for c, (ws, _) in clips.items() for w in ws], "clip_id string, pos bigint, word string, start_ms bigint, end_ms bigint, conf double")
    aligned = spark.createDataFrame([(c, j, *a) for c, (_, al) in clips.items() for j, a in enumerate(al)], "clip_id string, j bigint, token string, start_ms bigint, end_ms bigint, conf double")
    got = {}
    for r in rp.collapse_spoken(words, aligned, min_conf).orderBy("clip_id", "pos").collect():
        got.setdefault(r.clip_id, []).append((r.pos, r.start_ms, r.end_ms, round(r.conf, 6), r.aligned))
    assert got == {c: walk(*pair, min_conf) for c, pair in clips.items()}
    assert any(not row[-1] for rows in got.values() for row in rows)
