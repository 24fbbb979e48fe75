"""Interval algebra: worked examples and random comparison with small restatements."""

import random

import pytest

from wordloom.operators import intervals as iv
from wordloom.operators import timeline as tl
from wordloom.operators.repair import enforce_order, merge_labelled


def spans(spark, rows):
    return spark.createDataFrame([("c", a, b) for a, b in rows], "clip_id string, start_ms bigint, end_ms bigint")


def edl(spark, rows):
    return spark.createDataFrame(
        [("c", a, b, k, "speech" if k else "silence") for a, b, k in rows],
        "clip_id string, start_ms bigint, end_ms bigint, keep boolean, reason string",
    )


def pairs(df):
    return sorted((r.start_ms, r.end_ms) for r in df.collect())


def random_spans(seed, n=60):
    rng = random.Random(seed)
    return [(s, s + rng.randint(1, 900)) for s in (rng.randint(0, 8000) for _ in range(n))]


@pytest.mark.parametrize("touch", [1])
def test_coalesce(spark, touch):
    data = random_spans(touch)
    out = []
    for s, e in sorted(data):
        if out and s <= out[-1][1] + touch:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    assert pairs(iv.coalesce_spans(spans(spark, data), touch)) == [tuple(x) for x in out]


@pytest.mark.parametrize("seed", [1])
def test_merge_to_first_end(spark, seed):
    data = random_spans(seed)
    out = []
    for s, e in sorted(data):
        if out and s < out[-1][1]:
            out[-1][1] = min(out[-1][1], e)
        else:
            out.append([s, e])
    assert pairs(iv.merge_to_first_end(spans(spark, data))) == [tuple(x) for x in out]


def test_output_time(spark):
    e = edl(spark, [(0, 10000, True), (10000, 20000, False), (20000, 30000, True)])
    want = {0: 0, 10000: 10000, 10500: 10000, 15000: 10000, 19900: 10000, 20000: 10000, 30000: 20000}
    p = spark.createDataFrame([("c", t) for t in want], "clip_id string, t bigint")
    assert {r.t: r.o for r in iv.to_output_time(p, e, "t", "o").collect()} == want


def test_words_in_cuts(spark, timed):
    e = edl(spark, [(0, 2000, True), (2000, 4000, False), (4000, 6000, True)])
    w = timed([("a", 0.5, 0.7), ("b", 2.5, 2.7), ("c", 3.5, 3.7), ("d", 4.5, 4.7)])
    assert [r.word for r in tl.retimed_words(w, e).orderBy("out_ms").collect()] == ["a", "d"]


def test_hook_split(spark):
    e = edl(spark, [(0, 3000, True), (3000, 6000, True), (6000, 9000, True), (9000, 30000, True)])
    hooks = spark.createDataFrame(
        [("c", k, 3000 * k, 3000 * k + 3000) for k in range(3)], "clip_id string, hook bigint, start_ms bigint, end_ms bigint"
    )
    one = tl.hook_edl(e, hooks).where("target = 1")
    assert pairs(one.where("keep")) == [(3000, 6000), (9000, 30000)]
    assert pairs(one.where("reason = 'outtake'")) == [(0, 3000), (6000, 9000)]


def test_split_and_wordless(spark, timed):
    e = edl(spark, [(0, 5000, True), (5000, 6000, False), (6000, 9000, True)])
    w = timed([("a", 0.1, 0.4), ("b", 4.0, 4.5), ("c", 6.5, 7.0)])
    r = iv.apply_retakes(e, spans(spark, [(1000, 3900), (7500, 8000)]), w)
    got = sorted((x.start_ms, x.end_ms, x.keep, x.reason, x.wordless) for x in r.collect())
    assert got == [
        (0, 1000, True, "speech", False), (1000, 3900, False, "retake", False), (3900, 5000, True, "speech", False),
        (5000, 6000, False, "silence", False), (6000, 7500, True, "speech", False), (7500, 8000, False, "retake", False),
        (8000, 9000, False, "retake", True),
    ]


def test_label_merge(spark):
    w = spark.createDataFrame(
        [("c", 70760, 77720, "wide+low_conf_word"), ("c", 78220, 88580, "low_conf_word"), ("c", 89581, 89600, "wide")],
        "clip_id string, start_ms bigint, end_ms bigint, label string",
    )
    got = sorted((r.start_ms, r.end_ms, r.label) for r in merge_labelled(w, 1000).collect())
    assert got == [(70760, 88580, "wide+low_conf_word"), (89581, 89600, "wide")]


@pytest.mark.parametrize("seed", range(1))
def test_enforce_order(spark, seed):
    rng = random.Random(seed)
    orig, t = [], 0
    for _ in range(40):
        t += rng.randint(0, 60)
        orig.append((t, t + rng.randint(20, 90)))
        t = orig[-1][1]
    moved = [(s + d, e + d) for (s, e), d in zip(orig, (rng.choice([0, 0, 0, 150, -120]) for _ in orig))]
    result, prev = [], None
    for i, w in enumerate(moved):
        if prev is not None and w[0] < prev:
            w = orig[i]
            for j in range(i - 1, -1, -1):
                if w[0] >= result[j][1]:
                    break
                result[j] = orig[j]
        result.append(w)
        prev = w[1]
    df = spark.createDataFrame(
        [("c", i, *m, *o) for i, (m, o) in enumerate(zip(moved, orig))],
        "clip_id string, pos bigint, start_ms bigint, end_ms bigint, o_start bigint, o_end bigint",
    )
    got = [(r.start_ms, r.end_ms) for r in enforce_order(df).orderBy("pos").collect()]
    assert got == result
