"""Strip forms of the take operators against the forms over word tables."""

import random
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F

from wordloom.functions import strips as st
from wordloom.operators import retakes as rt
from wordloom.params import SHIPPED
from wordloom.plans import QUERIES
from wordloom.plans.workspace import text_words, timed_words


def _rows(df):
    return Counter(map(tuple, df.collect()))


def _texts(spark):
    """Texts that repeat, trail off and re-say themselves, with odd spacing; one empty, one null."""
    rnd = random.Random(5)
    vocab = ["We", "cut", "the", "tape...", "again.", "and", "then", "Go", "home…", "--", "blue", "cars,", "run!", "x?"]
    rows = [(str(c), " ".join(rnd.choices(vocab, k=rnd.randint(1, 90)))) for c in range(30)]
    rows += [("r", "Go now. We cut... We cut the tape. Blue cars, home... Blue cars, run. Big... Big red")]
    rows += [("e", ""), ("n", None), ("s", " \n one  two\tthree. One two three. ")]
    return spark.createDataFrame(rows, "clip_id string, text string")


@pytest.fixture(scope="module")
def both(spark):
    t = _texts(spark)
    return st.word_strips(t), text_words(t).localCheckpoint()


def test_words_of_turns_and_of_whole_texts(spark):
    t = _texts(spark)
    one = timed_words(t.withColumn("turn", F.lit(0).cast("long")))
    assert _rows(one) == _rows(text_words(t))
    turns = spark.createDataFrame([("c", 0, "A b."), ("c", 1, ""), ("c", 2, "c d")], "clip_id string, turn bigint, text string")
    got = [(r.pos, r.word, r.start_ms, r.end_ms) for r in timed_words(turns).orderBy("pos").collect()]
    assert got == [(0, "A", 0, 60), (1, "b.", 80, 200), (2, "c", 900, 960), (3, "d", 980, 1040)]


def test_overlapping_sentences(both):
    strips, words = both
    cols = ["clip_id", "sent", "sent2", "inter", "start_ms", "end_ms"]
    old = _rows(rt.overlapping_sentences(words, SHIPPED).select(*cols))
    assert old and _rows(rt.overlapping_strip_sentences(strips, SHIPPED).select(*cols)) == old


def test_aborted_restarts(both):
    strips, words = both
    old = _rows(rt.aborted_restarts(rt.take_facts(words, SHIPPED), SHIPPED))
    assert old and _rows(rt.aborted_strip_restarts(strips, SHIPPED)) == old


def test_literal_repeats(both):
    strips, words = both
    cols = ["clip_id", "i", "j", "cut_len", "match_len", "ci", "cj", "cut_start_ms", "cut_end_ms", "kept", "skip_reason"]
    facts = rt.take_facts(words, SHIPPED)
    old = _rows(rt.judged_pairs(facts, SHIPPED).select(*cols))
    assert len({r[-1] for r in old}) > 2 and _rows(rt.strip_pairs(strips, SHIPPED).select(*cols)) == old
    seeds = _rows(rt.seed_pairs(facts, 3).select("clip_id", "i", "j"))
    assert _rows(rt.strip_pairs(strips, SHIPPED, judged=False)) == seeds


def test_take_facts(both):
    strips, words = both
    light = rt.strip_take_facts(strips, SHIPPED)
    assert _rows(light) == _rows(rt.take_facts(words, SHIPPED).select(*light.columns))


def test_no_word_of_a_document_is_shuffled(spark):
    def exchanges(name):
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange hash")

    assert exchanges("f14_swap_variants") == exchanges("d13_aborted_restarts") == 0
    assert exchanges("j13_ngram_seed_pairs") == exchanges("d11_literal_repeats") == 0
    assert exchanges("a03_sentence_content_words") == 1
