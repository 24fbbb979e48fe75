"""Spans whose edges left the cut list, and runs of spans, beside plain loops."""

import random

import pytest

from tests.test_volume import CLIPS, ENTRIES, cut_list, moved, plain  # noqa: F401
from wordloom.operators import intervals as iv
from wordloom.operators import timeline as tl


def merged(spans, touch):
    runs = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1] + touch:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


@pytest.mark.parametrize("touch", [0, 1, 25])
def test_runs_cross_blocks(spark, touch):
    spark.conf.set("spark.wordloom.block.ms", "90")
    rng = random.Random(touch)
    clips = {f"c{c}": [(s := rng.randrange(2000), s + rng.choice([0, 3, 30, 30, 400])) for _ in range(rng.choice([1, 9, 60]))] for c in range(30)}
    df = spark.createDataFrame([(c, *x) for c, xs in clips.items() for x in xs], "clip_id string, start_ms bigint, end_ms bigint")
    got = sorted((r.clip_id, r.start_ms, r.end_ms) for r in iv.coalesce_spans(df, touch).collect())
    spark.conf.set("spark.wordloom.block.ms", "900")
    assert got == sorted((c, *run) for c, xs in clips.items() for run in merged(xs, touch))


@pytest.mark.parametrize("tol", [1, 2, 4])
def test_like_looking_at_every_edge(spark, tol):
    spark.conf.set("spark.wordloom.block.ms", "20")
    rng = random.Random(tol)
    lists, asked = {}, {}
    for c in range(40):
        at, es = rng.randrange(4), []
        while at < 200:
            end = at + rng.choice([1, 2, 3, 20, 40])
            es.append((at, end, rng.random() < 0.5))
            at = end + rng.choice([0, 0, 0, 0, 1, 2, 3])
        lists[f"c{c}"] = es
        edges = [x for s, e, _ in es for x in (s, e)]
        some = [(rng.choice(edges) + rng.randint(-4, 4), rng.choice(edges) + rng.randint(-4, 4)) for _ in range(30)]
        asked[f"c{c}"] = some + some[:5] + [(s, e) for s, e, k in es if k]
    asked["none"] = [(0, 5)]
    edl = spark.createDataFrame([(c, *e, "x") for c, es in lists.items() for e in es], "clip_id string, start_ms bigint, end_ms bigint, keep boolean, reason string")
    spans = spark.createDataFrame([(c, *x) for c, xs in asked.items() for x in xs], "clip_id string, start_ms bigint, end_ms bigint")
    got = sorted((r.clip_id, r.start_ms, r.end_ms) for r in tl.stale_spans(spans, edl, tol).collect())
    spark.conf.set("spark.wordloom.block.ms", "900")
    want = []
    for c, xs in asked.items():
        es = lists.get(c, [])
        runs, keeps = merged([(s, e) for s, e, k in es if not k], 1), [(s, e) for s, e, k in es if k]
        starts = [e for _, e in runs] + [s for s, _ in keeps[:1]]
        ends = [s for s, _ in runs] + [e for _, e in keeps[-1:]]
        want += [(c, s, e) for s, e in xs if not (any(abs(m - s) < tol for m in starts) and any(abs(m - e) < tol for m in ends))]
    assert got == sorted(want) and len(want) < sum(map(len, asked.values()))


def test_stale_spans_move_each_edge_once(plain):  # noqa: F811
    spans = cut_list(plain).where("keep").selectExpr("clip_id", "start_ms + IF(start_ms % 14000 = 0, 5, 0) AS start_ms", "end_ms")
    rows, n = moved(plain, lambda: tl.stale_spans(spans, cut_list(plain)))
    assert len(rows) == CLIPS * len([t for t in range(0, ENTRIES * 1000, 2000) if t % 14000 == 0])
    assert n <= 3.5 * CLIPS * ENTRIES
