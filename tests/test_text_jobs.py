"""Fuzzy windows, evidence, feed scoring, calendar, sounds, cues, pages."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from wordloom.functions import evidence as ev
from wordloom.functions import urls as ur
from wordloom.functions.fuzzy import best_windows
from wordloom.functions.markup import article_of
from wordloom.operators import articles as ar
from wordloom.operators import cues as cu
from wordloom.operators import ideas as idl
from wordloom.operators import pages as pg
from wordloom.operators import repair as rp
from wordloom.operators.frames import speech_segments
from wordloom.operators.variants import variant_plan


def norm(s):
    return " ".join(re.sub("[^a-z0-9 ]", "", s.lower()).split())


def test_best_windows_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = ["alpha", "beta", "gam", "delt", "eps.", "zeta,", "Eta", "th", "…"]
    words = [rng.choice(vocab) for _ in range(300)]
    lines = [" ".join(words[40:48]), "gam zeta unknown words here", "th", " ".join(rng.choice(vocab) for _ in range(6))]
    wdf = spark.createDataFrame([("c", i, w) for i, w in enumerate(words)], "clip_id string, idx bigint, word string")
    ldf = spark.createDataFrame([("c", i, t) for i, t in enumerate(lines)], "clip_id string, line_id bigint, text string")
    got = {r.line_id: (round(r.ratio, 9), r.size, r.first_idx) for r in best_windows(ldf, wdf).collect()}
    for i, line in enumerate(lines):
        target = norm(line)
        n = len(target.split())
        best = max(
            (difflib.SequenceMatcher(None, target, norm(" ".join(words[k : k + size]))).ratio(), -abs(size - n), -size, -k)
            for size in {max(1, n - 2), n, n + 2}
            for k in range(0, max(1, len(words) - size + 1))
        )
        assert got[i] == (round(best[0], 9), -best[2], -best[3])


def test_unproven_figures(spark):
    df = spark.createDataFrame([("3.1 times", "about 3"), ("193 ms", "193.6 ms")], "said string, have string")
    out = [r.m for r in df.select(ev.unproven_figures(F.col("said"), F.col("have")).alias("m")).collect()]
    assert out == [["3.1"], []]


def test_weak_word_share(spark):
    df = spark.createDataFrame([("Jev doesn't write.", "Jev and how is it")], "a string, b string")
    assert df.select(ev.word_share(F.col("a"), F.col("b"))).first()[0] < 0.5


def test_scoring(spark):
    a = spark.createDataFrame(
        [(1, "Model training", "a fast kernel", 1), (2, "News", "nothing", 0)], "id int, title string, description string, init_score int"
    )
    cfg = ar.FeedConfig(strong=["kernel"], weak=["train", "fast"], title=["model"])
    rows = {r.id: (r.score, list(r.matched)) for r in ar.scored(a, cfg).collect()}
    assert rows[1] == (3 + 3 + 2 + 1 + 1, ["model (title-only)", "kernel", "train (title, weak)", "~fast"])
    assert rows[2] == (0, [])


def test_booking_order(spark):
    rows = [("s", x, i, None) for i, x in enumerate("abc")] + [("s", x + "2", 10 + i, x) for i, x in enumerate("abc")]
    df = spark.createDataFrame(rows, "slug string, stem string, no bigint, of string")
    seq = [r.stem for r in idl.booking_order(df).orderBy("place").collect()]
    of = {x + "2": x for x in "abc"}
    assert seq[0] in "abc" and len(seq) == 6
    for a, b in zip(seq, seq[1:]):
        assert not (a in of and b in of)
        assert of.get(a) != b and of.get(b) != a


def test_rejection_is_final(spark):
    ideas = spark.createDataFrame([("x",), ("y",), ("z",)], "idea_id string")
    resp = spark.createDataFrame(
        [("x", "delete", 1), ("x", "keep", 2), ("y", "keep", 1)], "idea_id string, action string, arrival bigint"
    )
    assert {r.idea_id: r.status for r in idl.respond(ideas, resp).collect()} == {"x": "rejected", "y": "viewed", "z": "new"}
    assert [r.arrival for r in idl.refused(resp).collect()] == [2]


def test_trims_are_handed_out_in_order(spark):
    df = spark.createDataFrame([("s", [9], [3, 1, 2]), ("t", [3], [1]), ("u", [2, 0, 2], [])], "slug string, counts array<bigint>, units array<bigint>")
    got = {(r.slug, r.hook, r.copy): (r.flip, r.trims) for r in variant_plan(df, "all", True).collect()}
    assert [got["s", 0, c][1] for c in range(9)] == [[], [1, 2, 3], [1], [2], [3], [1, 2], [1, 3], [2, 3], []]
    assert [got["t", 0, c][1] for c in range(3)] == [[], [1], []]
    assert got["u", 2, 1] == (True, []) and len(got) == 16 and not got["s", 0, 0][0]


def test_a_hook_gets_each_trim_set_once_while_it_can(spark):
    df = spark.createDataFrame([("s", [3, 1, 4, 2], [5, 7])], "slug string, counts array<bigint>, units array<bigint>")
    for flip, flips in (("off", {False}), ("alternate", {False, True}), ("copies", {False, True})):
        rows = variant_plan(df, flip, True).collect()
        assert len(rows) == 10 and {r.flip for r in rows} == flips
        for hook in range(4):
            own = [tuple(r.trims) for r in rows if r.hook == hook]
            assert len(set(own)) == len(own)
    rows = variant_plan(df, "alternate", False).orderBy("copy", "hook").collect()
    assert [r.flip for r in rows] == [k % 2 == 1 for k in range(10)] and all(r.trims == [] for r in rows)


def test_every_known_variant_of_a_form_fires(spark):
    forms = ["books", "book"] + [f"alias-{i}" for i in (1, 2)] + [f"maker-{i}" for i in (1, 2)]
    words = spark.createDataFrame([("c", i, "Books", 100 * i) for i in range(14)], "clip_id string, pos bigint, word string, start_ms bigint")
    known = spark.createDataFrame([(f,) for f in forms], "slug string")
    edges = spark.createDataFrame([("c", 0)], "clip_id string, at_ms bigint")
    aliases, makers = {"books": "alias-1", "book": "alias-2"}, {"books": "maker-1", "book": "maker-2"}
    got = cu.entity_cues(words, known, edges, [], [], aliases, makers, 2000).collect()
    assert sorted(r.slug for r in got) == sorted(forms) and cu.most_variants(aliases, makers) == 12


def test_spoken_numbers_of_any_length(spark):
    df = spark.createDataFrame([("12345678901234567890,",), ("000000000000000000042",), ("0",), ("1000000",), ("999999.",)], "word string")
    got = [" ".join(r[0]) for r in df.select(rp.spoken_tokens(F.col("word"))).collect()]
    assert got == [
        "12345678901234567890", "forty two", "zero", "1000000",
        "nine hundred ninety nine thousand nine hundred ninety nine",
    ]


def test_sounds_on_screen_changes(spark):
    ev_rows = [("c", 0, "screenshot", 0), ("c", 0, "heading", 0), ("c", 500, "screenshot", 0), ("c", 1000, "screenshot", 0)]
    events = spark.createDataFrame(ev_rows, "clip_id string, at_ms bigint, kind string, idx bigint")
    none = spark.createDataFrame([], "clip_id string, at_ms bigint, sound string")
    rules = spark.createDataFrame(
        [("heading", 0, ["thud"], False), ("screenshot", 1, ["click"], False)], "kind string, rank int, sounds array<string>, rapid boolean"
    )
    total = spark.createDataFrame([("c", 60000)], "clip_id string, total_ms bigint")
    got = sorted((r.at_ms, r.sound) for r in cu.plan_sounds(events, none, rules, total, 800).collect())
    assert got == [(0, "thud"), (1000, "click")]


@pytest.mark.parametrize("seed", [1])
def test_sound_limiter_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [("c", rng.randint(0, 20000), rng.choice(["a", "b", "r"]), i) for i in range(80)]
    rules = spark.createDataFrame(
        [("a", 0, ["a1", "a2"], False), ("b", 1, ["b1"], False), ("r", 2, ["r1"], True)], "kind string, rank int, sounds array<string>, rapid boolean"
    )
    rank = {"a": 0, "b": 1, "r": 2}
    out, last, turns = [], None, {}
    for _, t, k, i in sorted(rows, key=lambda r: (r[1], rank[r[2]], r[3])):
        if k != "r" and last is not None and t - last < 700:
            continue
        names = {"a": ["a1", "a2"], "b": ["b1"], "r": ["r1"]}[k]
        out.append((t, k, names[turns.get(k, 0) % len(names)]))
        turns[k] = turns.get(k, 0) + 1
        if k != "r":
            last = t
    ev_df = spark.createDataFrame(rows, "clip_id string, at_ms bigint, kind string, idx bigint")
    none = spark.createDataFrame([], "clip_id string, at_ms bigint, sound string")
    total = spark.createDataFrame([("c", 60000)], "clip_id string, total_ms bigint")
    got = sorted((r.at_ms, r.kind, r.sound) for r in cu.plan_sounds(ev_df, none, rules, total, 700).collect())
    assert got == sorted(out)


def test_entity_cues_equal_brute_force(spark):
    rng = random.Random(4)
    text = [rng.choice(["Apples", "Apple", "apple", "Pear's", "Pears", "Fig", "plum", "Apple's"]) for _ in range(60)]
    words = spark.createDataFrame([("c", i, w, i * 1000) for i, w in enumerate(text)], "clip_id string, pos bigint, word string, start_ms bigint")
    known = spark.createDataFrame([("apples",), ("apple",), ("pears",), ("pear",), ("fig",), ("plum",)], "slug string")
    edges = spark.createDataFrame([("c", 25000), ("c", 40500)], "clip_id string, at_ms bigint")
    variants = {"Apples": ["apples", "apple"], "Apple": ["apple"], "apple": ["apple"], "Pear's": ["pears", "pear"], "Pears": ["pears", "pear"], "Fig": ["fig"], "plum": ["plum"], "Apple's": ["apples", "apple"]}
    seen, want, bounds = set(), [], [25000, 40500]
    for i, w in enumerate(text):
        if bounds and i * 1000 >= bounds[0]:
            bounds.pop(0)
            seen = set()
        if not (w[0].isupper() or "plum" in variants[w]):
            continue
        slug = next((s for s in variants[w] if s not in seen), None)
        if slug:
            seen.add(slug)
            want.append((i, slug))
    got = cu.entity_cues(words, known, edges, ["plum"], [], {}, {}, 2000)
    assert sorted((r.pos, r.slug) for r in got.collect()) == want


def test_speech_segments_hysteresis(spark):
    rng = random.Random(9)
    probs = [rng.random() for _ in range(200)]
    on, start, quiet, want = False, 0, 0, []
    for i, p in enumerate(probs):
        if not on:
            if p >= 0.6:
                on, start, quiet = True, i, 0
        elif p >= 0.45:
            quiet = 0
        else:
            quiet += 1
            if quiet >= 3:
                end = i - 2
                if end - start >= 4:
                    want.append((max(0, start - 1), min(200, end + 1)))
                on = False
    if on and 200 - start >= 4:
        want.append((max(0, start - 1), 200))
    df = spark.createDataFrame([("c", i, p) for i, p in enumerate(probs)], "clip_id string, frame_no bigint, prob double")
    got = speech_segments(df, 0.6, 3, 4, 1)
    assert sorted((r.first_frame, r.end_frame) for r in got.collect()) == want


def test_article_from_tree():
    body = "word " * 60
    html = f"<html><title>T</title><nav>menu</nav><article><h1>Head</h1><p>{body}<p>more</article><p>out</p></html>"
    assert article_of(html) == ("Head", "Head " + body.strip() + " more")
    assert article_of("<title>T</title><p>a<p>b") == ("T", "a b")


def test_dates_in_all_usual_shapes(spark):
    day = 1704412800  # 2024-01-05
    want = {
        "2024-01-05T10:00:00.123Z": day + 36000, "2024-01-05 10:00:00": day + 36000, "2024-01-05T10:00:00+0000": day + 36000,
        "2024-01-05T10:00Z": day + 36000, "2024-01-05T10:00:00-05": day + 54000, "2024-01-05T10:20:30+02:00": day + 30030,
        "Sept. 5, 2024": 1725494400, "2024.01.05": day, "2024/1/5": day, "05-01-2024": 1714521600, "1/5/2024": day, "25.12.2024": 1735084800,
        "Fri, 05 Jan 2024 01:02:03 GMT": day + 3723, "5 January 2024": day, "05-Jan-2024": day, "Jan 5, 2024 3:07 PM": day + 54420,
        "January 5 2024 12:00 AM": day, "2024-13-05": None, "2024-02-30": None, "soon": None, "": None, "5 Foo 2024": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "raw string").withColumn("s", F.unix_timestamp(ur.parse_date(F.col("raw"))))
    assert {r.raw: r.s for r in df.collect()} == want


def test_blocks_know_whether_they_open_in_the_article(spark):
    html = "<p>before</p><article><h2>Title</h2><p>in <b>it</b></p><ul><li>one<li>two</ul></article><blockquote>after</blockquote><td>cell</td>"
    got = pg.page_blocks(spark.createDataFrame([(1, html)], "page_id bigint, html string")).orderBy("block").collect()
    assert [(r.text, r.in_article) for r in got] == [
        ("before", False), ("Title", True), ("in it", True), ("one", True), ("two", True), ("after", False), ("cell", False),
    ]
