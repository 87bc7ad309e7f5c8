"""Ordered work in stretches of any width gives what one window over the whole key gives."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchgrid.operators import folds, tracking
from pitchgrid.operators.blocks import block_rows, frame_runs, lagged, last_known, with_piece
from tests.test_match import det


def hot(spark, n=300):
    """One key with nearly all rows, frames missing, nulls."""
    rnd = random.Random(4)
    frames = sorted(rnd.sample(range(900), n))
    rows = [("m" if rnd.random() < 0.9 else None, f, rnd.choice([None, 1, 2, 3]), rnd.choice(["a", "a", "b"])) for f in frames]
    return spark.createDataFrame(rows, "k string, f long, v int, s string")


@pytest.mark.parametrize("width", [1, 7, 65_536])
def test_stretches(spark, width):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("f")
    want = df.withColumns({"p": F.lag("v").over(w), "g": F.lag("f").over(w), "z": F.last("v", ignorenulls=True).over(w)})
    got = last_known(lagged(df, ["k"], "f", {"p": "v", "g": "f"}, width), ["k"], "f", F.col("v"), "z", width)
    key = lambda d: sorted(map(str, d.select("k", "f", "p", "g", "z").collect()))
    assert key(got) == key(want)
    runs = frame_runs(df.where("k is not null"), ["k", "s"], "f", {"n": F.count(F.lit(1)), "t": F.sum("v")}, {"n": F.sum("n"), "t": F.sum("t")}, width)
    islands = df.where("k is not null").withColumn("i", F.col("f") - F.row_number().over(Window.partitionBy("k", "s").orderBy("f"))).groupBy("k", "s", "i").agg(F.min("f").alias("start"), F.max("f").alias("end"), F.count(F.lit(1)).alias("n"), F.sum("v").alias("t")).drop("i")
    rows = lambda d: sorted(map(str, d.select("k", "s", "start", "end", "n", "t").collect()))
    assert rows(runs) == rows(islands)
    pieces = with_piece(df, ["k"], "f", 5, width).collect()
    for k in ("m", None):
        last = piece = None
        for r in sorted((r for r in pieces if r.k == k), key=lambda r: r.f):
            piece = r.f if last is None or r.f - last > 5 else piece
            assert r.__piece == piece if hasattr(r, "__piece") else r["__piece"] == piece
            last = r.f
    assert lagged(df.limit(0), ["k"], "f", {"p": "v"}, width).collect() == [] and with_piece(df.limit(0), ["k"], "f", 5, width).collect() == []


@pytest.mark.parametrize("block", [3, 50])
def test_blocks_with_halo(spark, block):
    df = hot(spark).where("k is not null").select("k", "f")
    rows = block_rows(df, "k", "f", 10, block, 4).collect()
    order = {f: i for i, f in enumerate(sorted(r.f for r in df.collect()))}
    want = sorted((f, b, b == i // block) for f, i in order.items() for b in range(max(0, (i - 4) // block), (i + 4) // block + 1))
    assert sorted((r["f"], r["__block"], r["__core"]) for r in rows) == want


def test_pieces_change_no_track(spark):
    """Trackers over pieces number tracks as one walk over the match does."""
    rnd = random.Random(9)
    frames = [f for f in range(200) if f % 60 < 35]
    d = det(spark, *[(rnd.choice(["robots", "ball"]), f, (x := rnd.randrange(300), y := rnd.randrange(200), x + 60, y + 60)) for f in frames for _ in range(2)])
    got = {r.det_seq: r.track_id for r in tracking.tracked(d).collect()}
    rows = sorted(d.collect(), key=lambda r: (r.frame_index, r.det_seq))
    heads, local = {}, {}
    for name in ("robots", "ball"):
        mine = [r for r in rows if r.class_name == name]
        by = {}
        for r in mine:
            by.setdefault(r.frame_index, []).append(r)
        out = tracking.follow([(f, np.array([[r.x1, r.y1, r.x2, r.y2] for r in rs], float)) for f, rs in sorted(by.items())], 0.25, 12)
        for (_, rs), ids in zip(sorted(by.items()), out, strict=True):
            for r, i in zip(rs, ids.tolist(), strict=True):
                local[r.det_seq] = (name, i)
                heads.setdefault((name, i), (r.frame_index, r.det_seq))
    number = {k: n for n, k in enumerate(sorted(heads, key=heads.get), 1)}
    assert got == {s: number[k] for s, k in local.items()}
    with pytest.raises(ValueError, match="unknown tracker"):
        tracking.tracked(d, "other")


def test_cooldown_over_batches(spark):
    """The strongest event of a cooldown stands, also where batches end inside it."""
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), rnd.randrange(3000), rnd.choice([0.1, 0.5, 0.9]), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, frame_index long, confidence double, i long")
    got = sorted((r.k, r.frame_index, r.confidence) for r in folds.cooled(df, ["k"], F.lit(8), ["frame_index", "confidence"], "confidence").collect())
    want = []
    for k in "ab":
        kept = []
        for _, f, c, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if not kept or f - kept[-1][0] >= 8:
                kept.append((f, c))
            elif c > kept[-1][1]:
                kept[-1] = (f, c)
        want += [(k, f, c) for f, c in kept]
    assert got == want


def test_ball_path_in_blocks(spark):
    """The path over blocks is the path over the whole match, and no other path costs less."""
    rnd = random.Random(6)
    frames = sorted(rnd.sample(range(80), 40))
    d = det(spark, *[("ball", f, (x := 5 * f + rnd.uniform(-30, 30), y := rnd.uniform(0, 60), x + rnd.uniform(5, 40), y + rnd.uniform(5, 40)), None, None, rnd.random()) for f in frames for _ in range(rnd.randrange(1, 9))])
    whole = {r.frame_index: (r.det_seq, r.path_cost) for r in tracking.ball_path(d).collect()}
    assert sorted(whole) == frames and len({c for _, c in whole.values()}) == 1
    for block in (1, 2, 7):
        assert {r.frame_index: (r.det_seq, r.path_cost) for r in tracking.ball_path(d, block=block).collect()} == whole
    layers = {}
    for r in d.collect():
        cost = abs(np.log(max((r.x2 - r.x1) * (r.y2 - r.y1), 1.0) / 650.0)) - r.score
        layers.setdefault(r.frame_index, []).append((cost, r.det_seq, r.cx, r.cy))
    best = None
    for f in frames:
        now = sorted(layers[f])[:6]
        if best is None:
            best = [(c, (x, y)) for c, _, x, y in now]
        else:
            reach = 30.0 * max(1, f - last)
            best = [(c + min(b + (d := float(np.hypot(x - p[0], y - p[1]))) / reach + 50.0 * (d > reach) for b, p in best), (x, y)) for c, _, x, y in now]
        last = f
    assert abs(min(c for c, _ in best) - next(iter(whole.values()))[1]) < 1e-5
