"""Pipeline stages against brute force."""

import hashlib
import random
from collections import Counter

from corpus_pipeline import bpe_tokens, line_dedup, minhash_dedup
from test_llm_exact import shingles
from wordloom.llm import bpe
from wordloom.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_minhash_dedup_links_from_80_percent(spark):
    rng = random.Random(11)
    texts, near = [], 0
    for pair in range(60):
        words = [f"p{pair}w{i}" for i in range(400)]
        copy = list(words)
        # each change takes five of the 396 shingles from both texts: 6 to 10 changes give 0.86 to 0.77
        for at in rng.sample(range(10, 390, 10), 6 + pair % 5):
            copy[at] = f"x{rng.randint(0, 10**9)}"
        texts += [" ".join(words), " ".join(copy)]
        near += 0.81 <= similarity(*texts[-2:]) <= 0.84
    assert near >= 20
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    got = {r.doc_id for r in minhash_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").select("doc_id").collect()}
    gone = {i + 1 for i in range(0, len(texts), 2) if similarity(texts[i], texts[i + 1]) >= 0.8}
    assert got == set(range(len(texts))) - gone and 0 < len(gone) < 60


def lines_left(rows):
    """The texts without the lines on at least 5 pages and over 5 % of the pages of their source."""
    pages, seen = Counter(), Counter()
    for _, text, _, source, _ in rows:
        pages[source] += 1
        seen.update({(source, x.strip()) for x in text.split("\n") if x.strip()})
    bad = {(s, x) for (s, x), n in seen.items() if n >= 5 and n > 0.05 * pages[s]}
    return {d: "\n".join(x for x in text.split("\n") if (s, x.strip()) not in bad) for d, text, _, s, _ in rows}


def test_line_dedup_drops_what_is_boilerplate_on_every_page(spark):
    rng = random.Random(12)
    lines = [f"menu {i}" for i in range(6)]
    texts = [f"own line {i}\n{lines[i % 6]}\nmore of {i}" for i in range(60)]
    # pages of boilerplate lines only, combined differently, and copies of one of them
    texts += ["\n".join(rng.sample(lines, 1 + i % 5)) for i in range(20)] + ["menu 1\n menu 2"] * 3
    # near copies with a line of their own, on over 5 % of the pages
    body = "\n".join(f"shared line {i} of the body" for i in range(20))
    texts += [f"{body}\ncopy {i}" for i in range(8)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)] + [(1000 + i, "menu 1", "en", "b", 6) for i in range(4)]
    want = lines_left(rows)
    got = line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert sum(not t for t in want.values()) == 23


def test_bpe_tokens_are_those_of_the_two_steps(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHARACTERS", 300)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    texts = [None, "", "Some words, some more", "word " * 500, "x" * 1000, "Ünï cödé 漢字 😀"] * 4
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in bpe_tokens(spark, docs, "").collect()}
    path = tokenizer_path()
    for r in bpe.decode_ids(bpe.encode_texts(docs, path), path).collect():
        row = got.pop(r.doc_id)
        assert bytes(row.ids) == bytes(r.ids) and row.n_tokens == len(r.ids) // 4
        assert row.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert not got
