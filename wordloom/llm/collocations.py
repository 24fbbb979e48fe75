"""Phrase collocations from FM-indexes of shards.

Texts are dealt into shards of one language and about ``SHARD_WORDS`` words; each shard is indexed once, over its
own word numbers, and stored. Phrases then grow by a word a round, to the right and to the left in turn:
every shard extends the phrases that are frequent in the corpus, the shards' counts are summed by (phrase
without its last word, phrase without its first), and what is frequent goes back to its shards for the next
round. A phrase can only be frequent if both its parts are, so nothing is lost, and rare phrases of one
round never enter the next. Each shard counts a phrase in one row, so no phrase, however common, holds more than
one row per shard; a round shuffles one row per phrase and shard, and each shard's transform once.

A phrase is named by its least (shard, row); names are exact, no hash stands for a word.

Score of a cut: ``floor(SCALE * a / (l + r))`` for the counts of the phrase and both parts; the least cut
counts. A longer candidate that holds a phrase is never more frequent than the one longer by a word between
them, so only extensions by one word are looked at to drop contained phrases.

Defined results: null texts are empty, a null language is ``und``; repeated rows count as often as they stand;
languages without candidates and empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import keep, shuffles_dropped
from wordloom.llm.word_index import extend, holder, transforms

SHARD_WORDS = 4_000_000
#: Words of all languages that a task holds before it closes its shards.
TASK_WORDS = 8_000_000
CHUNK = 4 << 20
#: Ways to deal the rows of one prefix or suffix.
DEALS = 8
SCALE = 2_000_000
LANGUAGE = "und"
#: A name is shard * ROWS + row.
ROWS = 1 << 27
SHARDS_OF_TASK = 1 << 14

STOPS = b".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

INDEX = "shard bigint, lang string, word array<string>, count array<bigint>, start array<bigint>, forward binary, backward binary"
COUNTED = "shard bigint, row bigint, back bigint, count bigint, prefix bigint, suffix bigint"


class _Numbers(dict):
    """Words to numbers from 1, in the order they come; stops are 0."""

    def __init__(self):
        super().__init__((STOPS[i : i + 1], 0) for i in range(len(STOPS)))

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - len(STOPS) + 1
        return number


class _Shard:
    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers(), [], 0

    def add(self, text: str) -> None:
        data = text.encode().translate(LOWER)
        at = 0
        while at < len(data):
            cut = data.find(b" ", at + CHUNK) if at + CHUNK < len(data) else -1
            end = len(data) if cut < 0 else cut
            tokens = TOKEN.findall(data, at, end)
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens)))
            self.size += len(tokens)
            at = end
        self.parts.append(np.zeros(1, np.int32))

    def row(self, shard: int, lang: str) -> pa.RecordBatch | None:
        pieces = np.concatenate(self.parts).astype(np.int64)
        pieces = pieces[np.append(pieces[1:] != 0, True) | (pieces != 0)]  # one 0 between pieces
        words = [w for w, i in self.numbers.items() if i]
        if not words:
            return None
        if len(pieces) >= ROWS:
            raise ValueError(f"a text holds more than {ROWS} words")
        counts = np.bincount(pieces, minlength=len(words) + 1)
        starts = np.cumsum(counts) - counts
        both = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in transforms(pieces)]
        lists = [pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts[1:]), pa.array(starts[1:])]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in lists]
        columns = [pa.array([shard]), pa.array([lang], pa.string()), *lists, *[pa.array([b], pa.binary()) for b in both]]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "word", "count", "start", "forward", "backward"])


def index_shards(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per shard: its words with their counts and first rows, and both transforms."""
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(LANGUAGE)).alias("_lang"), F.coalesce(text, F.lit("")).alias("_text")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        open_shards: dict[str, _Shard] = {}

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            if made == SHARDS_OF_TASK:
                raise ValueError("too many shards in one task: use smaller partitions")
            row = open_shards.pop(lang).row(task * SHARDS_OF_TASK + made, lang)
            if row is not None:
                made += 1
                yield row

        for batch in batches:
            for one, text in zip(batch.column(0), batch.column(1), strict=True):
                one = one.as_py()
                shard = open_shards.setdefault(one, _Shard())
                shard.add(text.as_py())
                if shard.size >= SHARD_WORDS:
                    yield from close(one)
                elif sum(s.size for s in open_shards.values()) >= TASK_WORDS:
                    for each in list(open_shards):
                        yield from close(each)
        for each in list(open_shards):
            yield from close(each)

    return keep(rows.mapInArrow(work, INDEX), "word-index")


def _frequent(counted: DataFrame, key: list[str], least: int, lead: str | None = None) -> DataFrame:
    """Rows of phrases that occur ``least`` times in all shards, with ``a`` and the phrase's name.

    A shard's rows come sorted by the part that ``lead`` names; they are dealt by that part, in ``DEALS`` ways
    by the other, so that its rows stay together and no part makes a large task.
    """
    if lead is not None:
        other = key[1 - key.index(lead)]
        counted = counted.withColumn("deal", F.col(other) % DEALS).repartition(lead, "deal")
        key = [*key, "deal"]
    same = Window.partitionBy(*key)
    name = F.col("shard") * ROWS + F.col("row")
    named = counted.withColumn("a", F.sum("count").over(same)).withColumn("id", F.min(name).over(same))
    return keep(named.where(F.col("a") >= least).drop("deal"), "frequent")


def _once(frequent: DataFrame) -> DataFrame:
    """One row per phrase."""
    return frequent.where(F.col("id") == F.col("shard") * ROWS + F.col("row"))


def _grow(index: DataFrame, frequent: DataFrame, right: bool) -> DataFrame:
    """Every shard's phrases longer by a word, with both parts frequent."""
    column = "backward" if right else "forward"
    here, there = ("back", "row") if right else ("row", "back")

    def work(shard: pa.Table, phrases: pa.Table) -> pa.Table:
        names = ["shard", "row", "back", "count", "prefix", "suffix"]
        got = [np.zeros(0, np.int64)] * 6
        if shard.num_rows and phrases.num_rows:
            known = {c: phrases[c].to_numpy() for c in ("row", "back", "count", "id")}
            by = np.argsort(known[here])
            known = {c: v[by] for c, v in known.items()}
            size = 4 * int(shard["size"][0].as_py())
            transform = np.frombuffer(pa.decompress(shard["transform"][0].as_py(), size, "zstd"), np.uint32)
            longer = extend(transform, known[here], known[there], known["count"])
            other, held = holder(known[here], known["count"], longer.here)
            longer, other = type(longer)(*[x[held] for x in longer]), other[held]
            ends = {here: longer.here, there: longer.there}
            owner, other = known["id"][longer.owner], known["id"][other]
            prefix, suffix = (owner, other) if right else (other, owner)
            number = np.full(len(owner), shard["shard"][0].as_py(), np.int64)
            got = [number, ends["row"], ends["back"], longer.count, prefix, suffix]
        return pa.Table.from_arrays([pa.array(x.astype(np.int64)) for x in got], names=names)

    # rows of a transform: the words, and a closing 0 for each piece, which come first
    size = F.element_at("start", -1) + F.element_at("count", -1)
    shards = index.select("shard", size.alias("size"), F.col(column).alias("transform"))
    return shards.groupBy("shard").cogroup(frequent.select("shard", "row", "back", "count", "id").groupBy("shard")).applyInArrow(work, COUNTED)


def _assemble(frequent: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases with their words and the counts of both parts at each cut, from their two parts."""
    prefix = shorter.select(F.col("id").alias("prefix"), "lang", "words", F.col("heads").alias("h"), F.col("a").alias("pa"))
    suffix = shorter.select(F.col("id").alias("suffix"), F.col("words").alias("w"), F.col("tails").alias("t"), F.col("a").alias("sa"))
    joined = _once(frequent).select("id", "a", "prefix", "suffix").join(prefix, "prefix").join(suffix, "suffix")
    return keep(
        joined.select(
            "id", "a", "prefix", "suffix", "lang",
            F.concat("words", F.slice("w", -1, 1)).alias("words"),
            F.concat("h", F.array("pa")).alias("heads"),
            F.concat(F.array("sa"), "t").alias("tails"),
        ),
        "phrases",
    )


def _levels(docs: DataFrame, least: int, longest: int, text: str, lang: str) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language, and the frequent phrases of each length from 2 on."""
    index = index_shards(docs, text, lang)
    entry = F.explode(F.arrays_zip("word", "count", "start")).alias("e")
    each = index.select("shard", "lang", entry).select("shard", "lang", "e.*")
    each = each.select("shard", "lang", "word", "count", F.col("start").alias("row"), F.col("start").alias("back"))
    totals = keep(each.groupBy(F.col("lang").alias("_lang")).agg(F.sum("count").alias("n")), "totals")
    frequent = _frequent(each, ["lang", "word"], least)
    none = F.array().cast("array<bigint>")
    phrases = _once(frequent).select("id", "a", "lang", F.array("word").alias("words"), none.alias("heads"), none.alias("tails"))
    levels = []
    for length in range(2, longest + 1):
        right = length % 2 == 0
        frequent = _frequent(_grow(index, frequent, right), ["prefix", "suffix"], least, "prefix" if right else "suffix")
        phrases = _assemble(frequent, phrases)
        levels.append(phrases)
    return totals, levels


def collocations(
    docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, covered: int = 80, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words."""
    with shuffles_dropped(docs.sparkSession):
        totals, levels = _levels(docs, least, longest, text, lang)
    kept = None
    for k, level in enumerate(levels):
        if k + 1 < len(levels):
            longer = levels[k + 1]
            ends = [longer.select(F.col(part).alias("part"), F.col("a").alias("most")) for part in ("prefix", "suffix")]
            cover = ends[0].unionByName(ends[1]).groupBy("part").agg(F.max("most").alias("most"))
            level = level.join(cover, level["id"] == cover["part"], "left")
            level = level.where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
        level = level.select("lang", "words", "a", "heads", "tails")
        kept = level if kept is None else kept.unionByName(level)
    scored = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", _least_cut().alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, F.col("lang") == F.col("_lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def _least_cut() -> Column:
    """score, k, l, r of the lowest cut; exact beyond 64 bits."""
    return F.expr(
        "array_min(transform(arrays_zip(heads, tails), (x, i) -> struct("
        f"cast(({SCALE} * cast(a as decimal(20, 0))) div cast(x.heads + x.tails as decimal(20, 0)) as bigint) AS score, "
        "i + 1 AS k, x.heads AS l, x.tails AS r)))"
    )
