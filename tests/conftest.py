import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wordloom.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("BENCH_CPUS", "8")
    s = build_session("tests", shared=tempfile.mkdtemp(prefix="spark-"))
    s.sparkContext.setLogLevel("OFF")
    # small blocks, so that every ordered operator has to hand state from block to block
    s.conf.set("spark.wordloom.block.rows", "7")
    s.conf.set("spark.wordloom.block.ms", "900")
    s.conf.set("spark.sql.shuffle.partitions", "3")
    yield s


@pytest.fixture
def timed(spark):
    """Word rows from (word, start seconds, end seconds[, confidence])."""

    def make(rows, clip="c"):
        data = [
            (clip, i, r[0], round(r[1] * 1000), round(r[2] * 1000), float(r[3]) if len(r) > 3 else 1.0)
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(
            data, "clip_id string, pos bigint, word string, start_ms bigint, end_ms bigint, confidence double"
        )

    return make
