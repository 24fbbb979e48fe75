"""Clips within a block are walked in one row, longer ones by stretches: both like the plain walk, and no token is moved by itself."""

import random

import pytest

from tests.test_spoken_collapse import clip, walk
from tests.test_volume import moved
from wordloom.operators import repair as rp


@pytest.fixture
def blocks(spark):
    old = spark.conf.get("spark.wordloom.block.rows")
    yield lambda n: spark.conf.set("spark.wordloom.block.rows", str(n))
    spark.conf.set("spark.wordloom.block.rows", old)


def frames(spark, clips):
    words = [(c, *w) for c, (ws, _) in clips.items() for w in ws]
    aligned = [(c, j, *a) for c, (_, al) in clips.items() for j, a in enumerate(al)]
    kinds = "start_ms bigint, end_ms bigint, conf double"
    return spark.createDataFrame(words, f"clip_id string, pos bigint, word string, {kinds}"), spark.createDataFrame(aligned, f"clip_id string, j bigint, token string, {kinds}")


@pytest.mark.parametrize("rows", [20, 65536])
def test_like_the_plain_walk(spark, blocks, rows):
    blocks(rows)
    rng = random.Random(rows)
    many, few = [f"w{i}" for i in range(40)] + ["12", "21", "340"], ["a", "b", "21", "340"]
    clips = {f"c{c}": clip(rng, few if c % 3 == 0 else many, rng.choice([1, 9, 19, 40]), rng.choice([0, 0.1, 0.5]), rng.choice([0, 0, 0.05])) for c in range(40)}
    clips["silent"] = (clips["c1"][0], [])
    got = {}
    for r in rp.collapse_spoken(*frames(spark, clips), 0.25).collect():
        got.setdefault(r.clip_id, []).append((r.pos, r.start_ms, r.end_ms, round(r.conf, 6), r.aligned))
    assert {c: sorted(x) for c, x in got.items()} == {c: walk(*pair, 0.25) for c, pair in clips.items()}


def test_clips_move_whole(spark, blocks):
    blocks(65536)
    rng = random.Random(1)
    words, aligned = frames(spark, {f"c{c}": clip(rng, ["a", "b", "c", "21"], 400, 0.1, 0) for c in range(10)})
    rows, n = moved(spark, lambda: rp.collapse_spoken(words, aligned))
    assert len(rows) == 4000 and n <= 500
