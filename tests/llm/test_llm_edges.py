"""Nulls in any column, empty and long texts, ties and repeated rows, empty tables, clashing extra
columns: every operator and every pipeline stage gives its defined result."""

import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from wordloom.llm import queries
from wordloom.llm.common import documents

SF = "/root/testdata/sf0.001"
OPS = sorted(queries.QUERIES)
#: Names that operators use for results or inside.
CLASHES = ["component_id", "kept", "shard", "slot", "score", "rule", "digest", "n_words", "key", "_id", "_text", "features", "n_lines", "_host", "ids", "host"]


def odd_documents(spark):
    long = "the " * 30_000 + "of the and " * 3
    rows = [
        (0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, " \n\t ", None, None, None), (3, "one two", "xx", "a", 7),
        (None, "a text without an id, of some words, said here once more", "en", "a", 55),
        (None, None, None, None, None), (5, long, "en", "b", len(long)), (6, "x" * 200_000, "de", "b", 200_000),
        (7, long, "en", "b", len(long)), (8, "same text " * 20, "en", "a", 200), (8, "same text " * 20, "en", "a", 200),
        (9, "same text " * 20, "en", "a", 200), (8, "another text of the same id with other words in it", "en", "c", 50),
        (-4, "Ünï cödé 漢字 😀 ́ | | # text", "fr", "a", 20), (10, "a\n\nb\n\na\n", "es", "a", 8),
    ]
    own = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return own.unionByName(documents(spark, SF).where("doc_id between 100 and 130"))


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """One folder of odd tables with extra columns, one of empty tables."""
    odd, empty = tmp_path_factory.mktemp("odd"), tmp_path_factory.mktemp("empty")
    for name in ("documents", "pages", "benchmark", "labels"):
        table = documents(spark, SF, name)
        if name == "documents":
            table = odd_documents(spark)
        elif name == "pages":
            more = [(None, None, None), (1, "http://a.org/", None), (2, None, "x"), (2, None, "x"), (3, "://", "x" * 300_000), (None, "u", "y" * 200), (None, "u", "y" * 200)]
            table = table.unionByName(spark.createDataFrame(more, table.schema))
        elif name == "benchmark":
            more = [(None, "a null item of five or more words"), (1, None), (2, ""), (3, "one two"), (3, "one two")]
            table = table.unionByName(spark.createDataFrame(more, table.schema))
        elif name == "labels":
            more = [(None, 1, 0), (5, None, None), (8, 1, 0), (8, 0, 0), (8, 0, 0), (999, 1, 1)]
            table = table.unionByName(spark.createDataFrame(more, table.schema))
        table.limit(0).write.parquet(f"{empty}/{name}.parquet")
        table.withColumns({c: F.lit(f"extra {c}") for c in CLASHES}).write.parquet(f"{odd}/{name}.parquet")
    yield str(odd), str(empty)
    shutil.rmtree(odd)
    shutil.rmtree(empty)


@pytest.mark.parametrize("name", OPS)
def test_odd_rows(spark, folders, name):
    got = queries.QUERIES[name](spark, folders[0])
    rows = got.collect()
    table, key = ("pages", "page_id") if name.split("_")[0] in ("op8", "op10") else ("documents", "doc_id")
    if not name.startswith(("op5_", "op12_")):  # one row per input row, repeated rows and null ids included
        assert sorted(map(str, (r[key] for r in rows))) == sorted(str(r[0]) for r in documents(spark, folders[0], table).select(key).collect())
    by = {}
    for r in rows if not name.startswith("op12_") else []:
        by.setdefault(r[key], []).append(r)
    if name.startswith("op1_"):
        for i in (0, 1, 2):
            assert (by[i][0].n_shingles, by[i][0].component_id, by[i][0].kept) == (0, i, True)
        assert by[7][0].component_id == 5 and by[9][0].component_id == 8
        assert all(r.component_id is None and not r.kept for r in by[None])
    elif name.startswith("op3_"):
        assert by[0][0].n_tokens == by[1][0].n_tokens == by[2][0].n_tokens == 0
    elif name.startswith("op6_"):
        assert by[7][0].n_removed == by[7][0].n_bytes and by[9][0].n_removed == by[9][0].n_bytes
        assert all(r.n_removed == 0 for r in by[8] if r.n_bytes == 200) and all(r.n_removed == 0 for r in by[None])
    elif name.startswith("op7_"):
        assert not any(r.kept for i in (0, 1, 2, 3, 5) for r in by[i])
    elif name.startswith("op8_"):
        assert all(r.intact for r in rows) and [r.record_type for r in by[None]].count("response") == len(by[None])
    elif name.startswith("op9_"):
        assert all(0 <= r.score <= 1 for r in rows)
    elif name.startswith("op11_"):
        assert all(r.n_runs == 0 for i in (0, 1, 2, 3, 6) for r in by[i]) and by[5][0].n_runs >= 1
    elif name.startswith("op12_"):
        assert {r.lang for r in rows} <= {"en", "de", "fr", "es", "xx", "und"} and any(r.phrase == "the the the the" for r in rows)
    elif name.startswith("op13_"):
        assert [r.kept for r in by[8] if r.keep_id == 9] == [False, False] and by[9][0].kept
        assert by[None][0].keep_id in (None, 1, 0) and sum(r.kept for i in (0, 1) for r in by[i]) == 1
    elif name.startswith("op2_"):
        assert len({r.shard for r in by[8]}) == 1 and len({(r.shard, r.slot) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, folders, name):
    assert queries.QUERIES[name](spark, folders[1]).count() == 0


@pytest.mark.parametrize("which", [0, 1])
@pytest.mark.parametrize("stage", [name for name, _ in cp.STAGES])
def test_stages(spark, folders, stage, which):
    docs = documents(spark, folders[which])
    got = dict(cp.STAGES)[stage](spark, docs, folders[which])
    rows = got.collect()
    if stage != cp.STAGES[-1][0]:
        assert tuple(got.columns) == cp.COLUMNS
        known = {(r.doc_id, r.n_chars) for r in docs.select("doc_id", "n_chars").collect()}
        if stage != "line_dedup":
            assert {(r.doc_id, r.n_chars) for r in rows} <= known
    if which:
        assert not rows
    elif stage == "minhash_dedup":
        ids = [r.doc_id for r in rows]
        assert 7 not in ids and 9 not in ids and {0, 1, 2, 5, 8} <= set(ids) and ids.count(None) == 2
    elif stage == "line_dedup":
        assert len(rows) == docs.count()
    elif stage == "bpe_tokens":
        assert len(rows) == docs.count()


def test_the_pipeline_runs_its_stages_in_order(spark):
    kept = [r.doc_id for r in cp.run(spark, SF).select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and set(kept) < {r.doc_id for r in documents(spark, SF).select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in documents(spark, SF, "labels").collect()}
    assert not [d for d in kept if labels.get(d) == 0]
