"""Registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.bpe import decode_ids, encode_texts
from wordloom.llm.classifier import classify, document_vectors, fit, score
from wordloom.llm.collocations import collocations
from wordloom.llm.common import documents, keep, scratch, words
from wordloom.llm.contamination import contained_items
from wordloom.llm.digest_index import exact_duplicates
from wordloom.llm.divergence import judge_quality
from wordloom.llm.near_dups import near_duplicates
from wordloom.llm.runs import periodic_runs
from wordloom.llm.shards import place, slots
from wordloom.llm.site_lines import MIN_PAGES, RATIO, drop_site_lines
from wordloom.llm.suffix_dedup import repeated_passages
from wordloom.llm.urls import HOST_RULES, PATTERN_RULES, judge_urls
from wordloom.llm.warc import round_trip

SHARDS = 24


def tokenizer_path() -> str:
    """The tokenizer file of the box; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(documents(spark, sf_dir), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return slots(placed).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    coded = decode_ids(encode_texts(documents(spark, sf_dir), path), path)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_site_lines(documents(spark, sf_dir)).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op5_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op6_suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


def op7_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(documents(spark, sf_dir))


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op9_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = keep(document_vectors(documents(spark, sf_dir)), "vectors")
    labels = documents(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score(vectors, fit(vectors, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(documents(spark, sf_dir, "pages"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth id, by its CRC, repeats a part of its words to the end of the text."""
    named = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    hit = named.withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    hit = hit.withColumn("a", F.when(n > 0, g % n).cast("int"))
    hit = hit.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    turn = F.slice("w", F.col("a") + 1, F.col("p"))
    rest = n - F.col("a")
    turns = F.flatten(F.array_repeat(turn, F.floor(rest / F.col("p")).cast("int")))
    changed = F.concat(F.slice("w", F.lit(1), F.col("a")), turns, F.slice("w", F.col("a") + 1, rest % F.col("p")))
    return hit.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(documents(spark, sf_dir)))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    # runs stand in the order of start and period, so only a greater exponent takes the place
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.col("best")
    return found.withColumn("best", F.aggregate("runs", F.get("runs", F.lit(0)), better)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op13_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    judged = exact_duplicates(documents(spark, sf_dir), scratch(spark, "digest-index"), buckets)
    return judged.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_shard_tree": op2_shard_tree,
    "op3_word_bpe": op3_word_bpe,
    "op4_site_lines": op4_site_lines,
    "op5_contained_items": op5_contained_items,
    "op6_suffix_columns": op6_suffix_columns,
    "op7_divergence": op7_divergence,
    "op8_warc_chunks": op8_warc_chunks,
    "op9_discriminant": op9_discriminant,
    "op10_url_rules": op10_url_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_word_index": op12_word_index,
    "op13_digest_index": op13_digest_index,
}

_SPACE = r"[\t\n\x0B\f\r ]"
_WORDS = "(SELECT {id}, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})"
_GRAMS = "SELECT DISTINCT {id}, unnest([array_to_string(w[i:i + g - 1], ' ') FOR i IN range(1, len(w) - g + 2)]) AS s FROM {rows}"


def _host_rule_sql() -> str:
    cases = []
    for r in sorted(HOST_RULES, key=lambda r: (len(r.name), r.name), reverse=True):
        host, slash, rest = r.name.partition("/")
        cases.append(f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{slash + rest}') THEN '{r.name}'")
    return f"CASE {' '.join(cases)} END"


def _pattern_sql() -> str:
    ordered = sorted(PATTERN_RULES, key=lambda r: (len(r.name), r.name), reverse=True)
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(url, '')), '{r.pattern}') THEN '{r.name}'" for r in ordered) + " END"


_VERDICTS = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in (*HOST_RULES, *PATTERN_RULES))

ORACLES: dict[str, str] = {
    "op4_site_lines": rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS key FROM l),
seen AS (SELECT source, key, count(DISTINCT doc_id) AS n FROM k WHERE key <> '' GROUP BY ALL),
bad AS (SELECT DISTINCT s.source, s.key FROM seen s JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY ALL) t
  ON s.source IS NOT DISTINCT FROM t.source WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages)
SELECT k.doc_id, k.source, count(*) AS n_lines, count(*) FILTER (b.key IS NOT NULL) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (b.key IS NULL), '') AS text
FROM k LEFT JOIN bad b ON k.source IS NOT DISTINCT FROM b.source AND k.key = b.key GROUP BY ALL
""",
    "op5_contained_items": f"""
WITH iw AS (SELECT *, least(len(w), 5) AS g FROM {_WORDS.format(id="item_id", table="benchmark")} WHERE len(w) > 0),
q AS MATERIALIZED ({_GRAMS.format(id="item_id", rows="iw")}),
dw AS (SELECT * FROM {_WORDS.format(id="doc_id", table="documents")}, (SELECT DISTINCT g FROM iw) WHERE len(w) >= g),
d AS MATERIALIZED ({_GRAMS.format(id="doc_id", rows="dw")})
SELECT doc_id, item_id, count(*) AS n_common, n AS n_item, count(*) / n AS containment
FROM d JOIN q USING (s) JOIN (SELECT item_id, count(*) AS n FROM q GROUP BY ALL) USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n
""",
    "op10_url_rules": rf"""
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN pattern END AS pattern,
  coalesce(CASE coalesce(rule, pattern) {_VERDICTS} END, 'allow') AS verdict
FROM (SELECT *, {_host_rule_sql()} AS rule, {_pattern_sql()} AS pattern FROM (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)))
""",
    "op12_word_index": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, range(1, 5) t(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
inner_ AS (SELECT lang, unnest(flatten([[array_to_string(ws[i:i + m - 1], ' ') FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS phrase, a AS most FROM c),
gone AS (SELECT c.lang, c.phrase FROM c JOIN (SELECT lang, phrase, max(most) AS most FROM inner_ GROUP BY ALL) i USING (lang, phrase) WHERE 100 * most >= 80 * c.a),
cuts AS (SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[j + 1:], ' ')),
best AS (SELECT * FROM cuts WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM gone)
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN n USING (lang) WHERE rank <= 2000
""",
    "op13_digest_index": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
}
