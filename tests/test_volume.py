"""Rows that cross a shuffle or are written, in queries over cut lists: a small multiple of the input."""

import random
import time

import pytest

from wordloom.operators import timeline as tl
from wordloom.operators import variants as va

CLIPS, ENTRIES = 10, 200


def moved(spark, df):
    """Rows of ``df``, and how many rows the run shuffled and wrote."""
    gateway = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        time.sleep(1)  # the listener is behind
        none = gateway.jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        stages = [stages.apply(i) for i in range(stages.size())]
        return sum(s.shuffleWriteRecords() + s.outputRecords() for s in stages)

    before = total()
    rows = df().collect()
    return rows, total() - before


@pytest.fixture
def plain(spark):
    """No broadcasts, as with large tables, and one block to a clip."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.wordloom.block.ms": "600000"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in old.items():
        spark.conf.set(n, v)


def cut_list(spark):
    e = spark.range(CLIPS * ENTRIES).selectExpr(f"CAST(id % {CLIPS} AS STRING) AS clip_id", f"id DIV {CLIPS} AS n")
    return e.selectExpr("clip_id", "n * 1000 AS start_ms", "n * 1000 + 1000 AS end_ms", "n % 2 = 0 AS keep", "IF(n % 2 = 0, 'speech', 'silence') AS reason")


def hooks(spark):
    return spark.range(CLIPS * 3).selectExpr(f"CAST(id % {CLIPS} AS STRING) AS clip_id", f"id DIV {CLIPS} AS hook", f"id DIV {CLIPS} * 4000 AS start_ms", f"id DIV {CLIPS} * 4000 + 4000 AS end_ms")


def test_hook_lists_in_one_pass(plain):
    rows, n = moved(plain, lambda: tl.hook_edl(cut_list(plain), hooks(plain)))
    assert len(rows) == 3 * CLIPS * ENTRIES
    kept = [r for r in rows if r.clip_id == "3" and r.target == 1 and r.keep]
    assert sorted(r.start_ms for r in kept)[:5] == [8000, 10000, 12000, 14000, 24000]
    assert n <= 2 * CLIPS * ENTRIES


def test_survival_copies_no_word(plain):
    words = plain.range(CLIPS * 1000).selectExpr(f"CAST(id % {CLIPS} AS STRING) AS clip_id", f"id DIV {CLIPS} * 200 + 50 AS start_ms")
    rows, n = moved(plain, lambda: va.survival(words, cut_list(plain), hooks(plain)).groupBy("clip_id", "target", "alive").count())
    got = {(r.target, r.alive): r["count"] for r in rows if r.clip_id == "3"}
    assert got == {(t, True): 20 + 440 for t in range(3)}
    assert n <= 4 * CLIPS * 1000


def test_trims_split_shared_pieces_once(plain):
    spans = cut_list(plain).where("start_ms % 7000 = 0").selectExpr("clip_id", "start_ms + 300 AS start_ms", "end_ms")
    rows, n = moved(plain, lambda: tl.trim_variants(cut_list(plain), hooks(plain), spans))
    mine = sorted((r.start_ms, r.end_ms, r.reason) for r in rows if r.clip_id == "3" and r.target == 1 and r.start_ms < 16000)
    assert [x for x in mine if x[0] < 2000 or x[0] >= 13000] == [
        (0, 1000, "outtake"), (1000, 2000, "silence"), (13000, 14000, "silence"), (14000, 14300, "speech"), (14300, 15000, "trim"), (15000, 16000, "silence"),
    ]
    assert n <= 6 * CLIPS * ENTRIES


def test_kept_words_placed_in_one_pass(plain):
    """Like looking each word up in the coalesced cuts and adding up the cuts before it."""
    plain.conf.set("spark.wordloom.block.ms", "90")
    rng = random.Random(9)
    cuts, ats = {}, {}
    for c in range(25):
        at, cuts[f"c{c}"] = rng.randrange(4), []
        while at < 300:
            keep, end = rng.random() < 0.5, at + rng.choice([1, 2, 3, 20, 60])
            cuts[f"c{c}"].append((at, end, keep))
            at = end + rng.choice([0, 0, 0, 0, 1, 2])
        ats[f"c{c}"] = range(0, 320, rng.choice([1, 2]))
    edl = plain.createDataFrame([(c, *e, "x") for c, es in cuts.items() for e in es], "clip_id string, start_ms bigint, end_ms bigint, keep boolean, reason string")
    words = plain.createDataFrame([(c, t) for c, ts in ats.items() for t in ts], "clip_id string, start_ms bigint")
    want = set()
    for c, es in cuts.items():
        runs, first = [], min((s for s, _, k in es if k), default=0)
        gone = [(s, e) for s, e, k in es if not k]
        for s, e in gone:
            if runs and s <= runs[-1][1] + 1:
                runs[-1][1] = e
            else:
                runs.append([s, e])
        for t in ats[c]:
            if any(s <= t < e - 1 for s, e in runs):
                continue
            u = next((s for s, e in gone if s <= t < e), t)
            want.add((c, t, max(0, u - first - sum(e - s for s, e in gone if first <= s and e <= u))))
    got = {(r.clip_id, r.start_ms, r._out) for r in tl.placed_kept(words, edl).select("_p.*", "_out").collect()}
    assert got == want
