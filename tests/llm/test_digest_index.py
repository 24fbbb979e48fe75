"""The digest index against a dictionary of texts."""

import hashlib
import uuid
from collections import defaultdict

from wordloom.llm import queries
from wordloom.llm.common import documents, scratch
from wordloom.llm.digest_index import DigestIndex, digest_rows, exact_duplicates

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, n_rows bigint, digest string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def expected(rows):
    """Text to (greatest id, null below all, number of rows)."""
    of = defaultdict(list)
    for i, t in rows:
        of[t or ""].append(i)
    return {t: (max(ids, key=lambda i: (i is not None, i or 0)), len(ids)) for t, ids in of.items()}


def check(got, rows):
    want = expected(rows)
    names = {hashlib.sha256(t.encode()).digest(): t for t in want}
    kept = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        text = names[bytes(r.digest)]
        assert (r.keep_id, r.group_size) == want[text]
        assert not r.kept or r.id == r.keep_id
        kept[text] += r.kept
    assert set(kept.values()) <= {1}


def test_ties_nulls_repeated_rows_and_hot_texts(spark):
    rows = [(i, f"t{i % 40}") for i in range(300)] + [(1000 + i, "hot") for i in range(700)] + [(-i, None) for i in range(5)]
    rows += [(50, ""), (50, ""), (None, "t1"), (None, "only null"), (None, "only null"), (None, None), (2**63 - 1, "t2"), (-(2**63), "t2")]
    docs = table(spark, rows).repartition(5)
    check(exact_duplicates(docs, scratch(spark, "i"), 4).collect(), rows)
    check(exact_duplicates(docs, scratch(spark, "i"), 3, batches=1).collect(), rows)
    assert exact_duplicates(docs.limit(0), scratch(spark, "i"), 4).collect() == []


def test_an_opened_index_takes_new_batches_and_repeats_none(spark):
    path = scratch(spark, f"kept-{uuid.uuid4().hex}")
    first = digest_rows(table(spark, [(5, "a"), (4, "a"), (9, "b")]))
    later = digest_rows(table(spark, [(7, "a"), (1, "c"), (2, "c")]))
    for rows, batch in ((first, 0), (later, 1), (later, 1)):
        index = DigestIndex(spark, path, 4)
        index.add(rows, batch)
        index.close()
    index = DigestIndex(spark, path)
    assert index.buckets == 4
    plan = index.fresh(1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    # what came first stays, although a later row has a greater id
    got = {(r.id): (r.keep_id, r.group_size, r.kept) for r in index.judge(later).collect()}
    assert got == {7: (5, 3, False), 1: (2, 2, False), 2: (2, 2, True)}
    assert spark.table(index.entries).count() == 3
    index.close()


def test_query_matches_a_dictionary(spark):
    rows = [tuple(r) for r in documents(spark, SF).select("doc_id", "text").collect()]
    want = expected(rows)
    texts = dict(rows)
    for r in queries.op13_digest_index(spark, SF).collect():
        text = texts[r.doc_id] or ""
        assert (r.keep_id, r.group_size) == want[text] and r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
