"""Block-wise ordered operators equal plain windows, whatever the block size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wordloom.functions import scan as sc


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for key in ("a", "b", "c"):
        for i in range(rng.choice([1, 13, 60])):
            data.append((key, i, rng.choice([None, *range(20)])))
    return spark.createDataFrame(data, "k string, i bigint, v bigint").cache()


def test_scan_matches_windows(rows):
    w = Window.partitionBy("k").orderBy("i")
    up, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    down = w.rowsBetween(0, Window.unboundedFollowing)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("k")
    ops = {
        "lag": (sc.lag("v"), F.lag("v").over(w)),
        "lead": (sc.lead("v"), F.lead("v").over(w)),
        "last": (sc.last("v"), F.last("v", True).over(up)),
        "last_b": (sc.last("v", False), F.last("v", True).over(before)),
        "next": (sc.following("v"), F.first("v", True).over(down)),
        "next_a": (sc.following("v", False), F.first("v", True).over(after)),
        "sum": (sc.running_sum("v"), F.coalesce(F.sum("v").over(up), F.lit(0))),
        "sum_b": (sc.running_sum("v", False), F.coalesce(F.sum("v").over(before), F.lit(0))),
        "max_b": (sc.running_max("v", False), F.max("v").over(before)),
        "smin": (sc.suffix_min("v"), F.min("v").over(down)),
        "tot": (sc.total("max", "v"), F.max("v").over(whole)),
    }
    got = sc.scan(rows, ["k"], ["i"], {n: a for n, (a, _) in ops.items()})
    exp = rows.select("*", *[e.alias(n) for n, (_, e) in ops.items()])
    key = lambda r: (r["k"], r["i"])
    a = sorted(got.select(*exp.columns).collect(), key=key)
    b = sorted(exp.collect(), key=key)
    assert a == b


@pytest.mark.parametrize("offsets", [(1,), (-1,), (2, -3)])
def test_neighbours_match_windows(rows, offsets):
    w = Window.partitionBy("k").orderBy("i")
    got = sc.neighbours(rows, ["k"], "i", {f"o{o}": ("v", o) for o in offsets})
    exp = rows.select("*", *[(F.lead("v", o) if o > 0 else F.lag("v", -o)).over(w).alias(f"o{o}") for o in offsets])
    key = lambda r: (r["k"], r["i"])
    assert sorted(got.collect(), key=key) == sorted(exp.collect(), key=key)
