import numpy as np
from pyspark.sql import functions as F

from pitchgrid.operators.summaries import exact_percentiles
from pitchgrid.plans.extra_queries import box_run_lengths, normalised_output, run_lengths


def test_run_lengths(spark):
    px = spark.createDataFrame([(1, 0), (1, 1), (1, 5), (2, 3), (2, 9)], "m long, at long")
    assert {r.m: r.counts for r in run_lengths(px, "m", "at", 10).collect()} == {1: [0, 2, 3, 1, 4], 2: [3, 1, 5, 1]}


def test_normalised_output(spark):
    raw = spark.createDataFrame([(0.9, [0.1, 0.2, 0.3, 0.4]), (0.4, [0.1, 0.2, 0.3, 0.4]), (0.9, [10.0, 20.0, 30.0, 40.0])], "score double, box array<double>")
    assert [[round(v, 6) for v in r.box] for r in normalised_output(raw, 100, 50).collect()] == [[10, 10, 30, 20], [10, 20, 30, 40]]


def test_box_runs(spark):
    df = spark.createDataFrame([(1, 1, 3, 3), (0, 0, 4, 3), (3, 2, 4, 3)], "a long, b long, c long, d long")
    got = [r.c for r in df.select(box_run_lengths(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 4, 3).alias("c")).collect()]
    assert got[0] == [4, 2, 1, 2, 3] and got[2] == [11, 1] and got[1] == [0, 3, 0, 3, 0, 3, 0, 3] and all(sum(g) == 12 for g in got)


def test_exact_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.random(500)] + [("b", 0.5)] * 40 + [("b", 1.0), ("c", 0.25), ("d", None)]
    got = {r.k: (r.low, r.high) for r in exact_percentiles(spark.createDataFrame(rows, "k string, s double"), "k", "s", {"low": 0.08, "high": 0.92}, 16).collect()}
    for k in "abc":
        v = [s for n, s in rows if n == k]
        assert np.allclose(got[k], np.percentile(v, [8, 92]))
    assert set(got) == set("abc")
