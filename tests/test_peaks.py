"""Sounds lie with their loudest sample on their moment."""

from wordloom.operators import cues as cu


def test_peaks_on_moments(spark):
    played = spark.createDataFrame(
        [("c", 5000, "boom", 0.0), ("c", 100, "boom", -2.0), ("c", 9900, "boom", 0.0), ("c", 700, "gone", 0.0), ("c", 900, "gone", 0.0)],
        "clip_id string, at_ms bigint, sound string, gain_db double",
    )
    library = spark.createDataFrame([("boom", 400, -3.0, 1000)], "sound string, peak_ms bigint, peak_db double, length_ms bigint")
    placed, unknown = cu.align_peaks(played, library, spark.createDataFrame([("c", 10000)], "clip_id string, total_ms bigint"))
    got = {r.at_ms: (r.source_start_ms, r.start_ms, r.end_ms, r.gain_db) for r in placed.collect()}
    assert got == {5000: (0, 4600, 5600, 0.0), 100: (300, 0, 700, -2.0), 9900: (0, 9500, 10000, 0.0)}
    assert [tuple(r) for r in unknown.collect()] == [("c", "gone")]
