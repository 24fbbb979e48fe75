"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The first query pays for the derived tables it needs (timed words, gaps, cut list), which later
ones read back; ``stage_*`` entries show that cost on its own.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wordloom.plans import QUERIES
from wordloom.plans.workspace import Workspace
from wordloom.session import build_session

HEADLINE = [
    "a01_edl_summary", "w03_sentences", "w05_takes", "w11_low_confidence_runs", "o05_weakest_words",
    "v01_coalesce_spans", "v06_output_time", "v17_kept_inside", "j09_active_word", "j04_words_outside_cuts",
    "d19_article_pipeline", "u05_insert_or_ignore", "f09_relevance_score", "d18_page_article", "d28_booking_order",
    "t05_sessions", "j13_ngram_seed_pairs", "d11_literal_repeats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:] or HEADLINE
    spark = build_session("bench", shared=tempfile.mkdtemp(prefix="spark-"))
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    ws = Workspace.open(spark, sf_dir)
    times: dict[str, float] = {}

    def clock(name, run):
        t0 = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    clock("stage_words", ws.words)
    clock("stage_gaps", ws.gaps)
    clock("stage_cut_list", ws.edl)
    if any(q[:3] in ("j13", "d11", "d14") for q in only):
        clock("stage_take_facts", ws.takes)
    for name in only:
        clock(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    words = ws.words().count()
    cut = times["stage_words"] + times["stage_gaps"] + times["stage_cut_list"]
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "words": words,
                "cut_list_words_per_sec": round(words / cut),
            }
        )
    )


if __name__ == "__main__":
    main()
