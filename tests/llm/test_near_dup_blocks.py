import random

from wordloom.llm import near_dups
from wordloom.llm.shingles import shingle_set


def test_copies_about_the_threshold(spark, monkeypatch):
    """Near copies of one text, some below the threshold to all others: the components are exact, and no step
    makes a row for each pair."""
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(220)]
    texts = []
    for i in range(90):
        t = list(base)
        for k in rng.sample(range(0, 220, 6), rng.choice([0, 1, 2, 5, 6, 7])):
            t[k] = f"y{k}"
        texts.append(" ".join(t))
    sets = [set(shingle_set(t.encode()).tolist()) for t in texts]
    root = list(range(90))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(90):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    made = []
    block_links = near_dups._block_links
    monkeypatch.setattr(near_dups, "_block_links", lambda blocks, percent: made.append(blocks.count()) or block_links(blocks, percent))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(df).collect()}
    assert got == {i: top(i) for i in range(90)}
    assert 10 < len(set(got.values())) < 80 and len(made) == 1 and 90 < made[0] < 90 * 90 / 4, made
