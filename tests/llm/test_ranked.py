"""Sampling, runs, overlap, top N: against brute force, with nulls, ties, repeats, hot groups, empty tables and clashing names."""

import math
from collections import defaultdict

import pytest

from pitchgrid.llm.paths import one_spelling
from pitchgrid.llm.runs import collapse_runs, state_runs
from pitchgrid.llm.sampling import frozen_bottom_k, image_key, review_sample
from pitchgrid.llm.splits_overlap import overlap_report, overlapping_images
from pitchgrid.llm.topn import GROUP, items_above, scored, top_detections
from pyspark.sql import functions as F

IMAGES = "image_id long, video string, source_group string, frame_index long, split string, image_path string, ingest_batch int, clip string"


def items(spark, rows):
    return spark.createDataFrame(rows, "k string, g string, b int, __rank string, __n long")


def drawn(df):
    return {r.k for r in frozen_bottom_k(df, ["k"], ["g"], "b", 0.1).collect()}


def test_sample_grows_and_keeps_its_rate(spark, rng):
    rows = [(f"i{i}", rng.choice(["hot"] * 6 + ["a", "b", None]), i % 5, "x", 1) for i in range(900)]
    whole = drawn(items(spark, rows))
    sizes = defaultdict(int)
    for k, g, *_ in rows:
        sizes[g] += 1
    got = defaultdict(int)
    for k, g, *_ in rows:
        got[g] += k in whole
    assert got == {g: math.ceil(round(n * 0.1, 9)) for g, n in sizes.items()}
    before = set()
    for upto in range(5):
        part = [r for r in rows if r[2] <= upto]
        now = drawn(items(spark, part).repartition(1 + upto))
        assert before <= now
        before = now
    assert before == whole
    again = rows + [(k, g, 4, "y", 2) for k, g, b, *_ in rows[:300]]  # late copies change nothing
    assert drawn(items(spark, again[::-1])) == whole
    assert drawn(items(spark, [])) == set()


def test_sample_and_rows_without_a_batch(spark, rng):
    """No delivery without a batch drops what was drawn, and new batches drop nothing drawn from such rows."""
    rows = [(f"i{i}", rng.choice(["a", "b", None]), i % 3, "x", 1) for i in range(200)]
    once = drawn(items(spark, rows))
    again = rows + [(k, rng.choice(["a", None]), None, "y", 2) for k, *_ in rows[:60]]
    assert once <= drawn(items(spark, again)) and len(drawn(items(spark, again))) <= len(once) + 12
    loose = [(f"n{i}", "a", None, "x", 1) for i in range(400)]
    before = drawn(items(spark, rows + loose))
    more = [(f"i{i}", "a", 3, "x", 1) for i in range(200, 500)]
    after = drawn(items(spark, more + loose + [(f"n{i}", "c", None, "x", 1) for i in range(400, 500)] + rows))
    assert once <= before <= after and 20 <= sum(k[0] == "n" for k in before) <= 60
    late = drawn(items(spark, rows + loose + [(f"n{i}", "a", 3, "x", 1) for i in range(400)]))  # named later by a batch
    assert {k for k in before if k[0] == "n"} <= late


def test_images_in_one_spelling(spark):
    rows = [(1, None, "G/v.mp4", 7, "train", "frames/G a/v_f0-9/f7.png", 0, "x"), (2, None, "g\\V.mp4", None, "train", "./Frames//G%20A/V_F0-9/F7.PNG ", 3, "x")]
    df = spark.createDataFrame(rows, IMAGES)
    assert df.select(image_key(one_spelling(F.col("image_path")), F.col("frame_index")).alias("k")).distinct().count() == 1
    assert [r.image_id for r in review_sample(df).collect()] == [1]


STATES = "state_id long, match_id string, frame_index long, state string, confidence double, ingested_at timestamp, start string"


def brute_runs(rows, tolerance=0.05):
    one = {}
    for i, m, f, s, c, t, _ in rows:
        if m is not None and f is not None:
            key = (t is not None, t, i) if t is not None else (False, None, i)
            if (m, f) not in one or key > one[m, f][0]:
                one[m, f] = (key, None if s is None else s.strip().lower().replace("-", "_").replace(" ", "_"), c)
    out, last = [], None
    for (m, f), (_, s, c) in sorted(one.items()):
        if s is None or c is None or math.isnan(c):
            last = None
            continue
        if last and last[0] == m and last[1] == f - 1 and last[2] == s and round(abs(c - last[3]), 9) <= tolerance:
            out[-1][3] = f
        else:
            out.append([m, s, f, f])
        last = (m, f, s, c)
    return sorted(map(tuple, out))


def test_runs(spark, rng):
    from datetime import datetime

    rows = []
    for i in range(700):
        m = rng.choice(["hot"] * 5 + ["b"])
        rows.append((i, m, rng.randrange(400), rng.choice(["in_play"] * 9 + ["In-Play ", "dead ball", None]), rng.choice([0.9, 0.92, 0.95, 0.91, 0.93, None, float("nan")] + [0.94] * 6 + [0.5]), datetime(2025, 1, 1, 0, 0, i % 50), "x"))
    rows += [(1000, None, 1, "in_play", 0.9, None, "x"), (1001, "b", None, "in_play", 0.9, None, "x")]
    df = spark.createDataFrame(rows, STATES)
    got = sorted((r.match_id, r.state, r.start, r.end) for r in state_runs(df).collect())
    assert got == brute_runs(rows)
    for block in (1, 2, 7):
        small = collapse_runs(df.withColumn("state", F.regexp_replace(F.lower(F.trim("state")), "[ -]", "_")), ["match_id"], "frame_index", "state", "confidence", 0.05, [F.col("ingested_at"), F.col("state_id")], block=block)
        assert sorted((r.match_id, r.state, r.start, r.end) for r in small.collect()) == got
    assert all(r.events == r.duration == r.end - r.start + 1 for r in small.collect())
    assert state_runs(spark.createDataFrame([], STATES)).collect() == []


def test_overlap(spark, rng):
    rows, clips = [], ["e 0/a", "e 0/b_f000000-039999", "e1/c"]
    for i in range(260):
        clip, f = rng.choice(clips + clips[:1] * 4), rng.randrange(60) + 500  # 512 is a border of stretches
        folder, name = clip.split("/")
        path = rng.choice([f"frames/{clip}/f{f}.png", f"frames\\{folder}\\{name}\\frame_{f} (1).jpg", f"./Frames//{clip.upper()}/{name}_{f:06d}.PNG", f"/mnt/set/frames/{clip.replace(' ', '%20')}/{f:08d}_aug2.jpeg"])
        rows.append((i, rng.choice([None, clip + ".mp4", clip.upper() + ".MP4"]), "g", rng.choice([None, f]), rng.choice(["train", "Train ", "val", "validation", "TEST", None, "other"]), path, 0, "x"))
    rows += [(999, None, None, None, "train", None, None, None), (998, None, None, None, "val", "nothing", None, None)]
    df = spark.createDataFrame(rows, IMAGES)
    split = lambda s: {"train": "t", "val": "e", "validation": "e", "test": "e"}.get((s or "").strip().lower())
    import re

    known = []
    for i, v, _, f, s, p, *_ in rows:
        if p and "/" in p.replace("\\", "/") and split(s):
            q = re.sub(r"/+", "/", p.replace("\\", "/").replace("%20", " ").lower().strip())
            stem = re.sub(r"(_aug2| \(1\))?\.[a-z]+$", "", q.split("/")[-1])
            known.append((i, split(s), "/".join(q.split("/")[-3:-1]), int(re.search(r"[0-9]+$", stem)[0])))
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for a in known if a[1] == "t" for b in known if b[1] == "e" and a[2] == b[2] and abs(a[3] - b[3]) <= 2)
    assert sorted(map(tuple, overlapping_images(df).collect())) == want and want
    report = overlap_report(df).collect()
    assert sum(r.images for r in report) == sum(k[1] == "e" for k in known)
    ends = lambda b: sorted({a[3] for a in known if a[1] == "t" and a[2] == b[2] and abs(a[3] - b[3]) <= 2})
    evaluated = [ends(k) for k in known if k[1] == "e"]
    assert sum(r.stretches for r in report) == sum(1 for e in evaluated for i, f in enumerate(e) if i == 0 or f != e[i - 1] + 1)
    assert sum(r.near_images for r in report) == len({b[0] for b in known if b[1] == "e" and any(a[1] == "t" and a[2] == b[2] and abs(a[3] - b[3]) <= 2 for a in known)})
    assert overlapping_images(spark.createDataFrame([], IMAGES)).collect() == []
    assert overlapping_images(df.where("lower(trim(split)) = 'train'")).collect() == []


DETS = "det_id long, match_id string, frame_index long, class_name string, score double, box array<double>, rank string"


@pytest.mark.parametrize("n", [1, 3, 5])
def test_top(spark, rng, n):
    rows = []
    for i in range(3000):
        hot = rng.random() < 0.5
        score = rng.choice([None, float("nan"), -0.1, 1.5, 1.0, 0.0, 0.6, 0.6, 0.6]) if rng.random() < 0.3 else round(rng.random(), 3)
        rows.append((i, "m" if hot else rng.choice(["m", "n", None]), 1 if hot else rng.choice([1, 2, 3, None]), rng.choice(["ball", " Ball", "BALL "]) if hot else rng.choice(["ball", "robots", None]), score, rng.choice([None, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0], [float(rng.randrange(9))] * 4]), "x"))
    rows += [(9000 + i, *r[1:]) for i, r in enumerate(rows[:200])]
    rows += [(20000 + i, "tie", 1, "ball", 0.5, [float(i)] * 4, "x") for i in range(600)]
    best = {}
    for i, m, f, c, s, b, _ in rows:
        if s is not None and 0 <= s <= 1:
            k = (m, f, None if c is None else c.strip().lower(), s, None if b is None else tuple(b))
            best[k] = min(best.get(k, i), i)
    groups = defaultdict(list)
    for (m, f, c, s, _), i in best.items():
        groups[m, f, c].append((-s, i))
    want = sorted(i for g in groups.values() for _, i in sorted(g)[:n])
    assert sorted(r.det_id for r in top_detections(spark.createDataFrame(rows, DETS), n).collect()) == want
    assert top_detections(spark.createDataFrame([], DETS), n).collect() == []


def test_histograms_cut_small_and_large_groups(spark, rng):
    """Every group with more filled bins than n loses what lies below the n-th, and nothing that could be ranked."""
    rows = []
    for frame, size in enumerate([1, 3, 4, 5, 17, 60, 200, 900, 256, 257]):
        rows += [(100000 * frame + i, "m", frame, "ball", round(rng.random(), 4), [float(i)] * 4, "x") for i in range(size)]
    rows += [(50_000_000 + i, "m", 3, "ball", 0.9, [1.0] * 4, "x") for i in range(50)]  # copies of one item mislead no threshold
    rows += [(60_000_000 + i, "m", 99, "ball", 0.5, [float(i)] * 4, "x") for i in range(300)]  # one bin: nothing to cut
    df = scored(spark.createDataFrame(rows, DETS))
    for n in (1, 3, 20):
        kept = defaultdict(set)
        for r in items_above(df, GROUP, "score", ["box"], "det_id", n).collect():
            kept[r.frame_index].add(r.det_id)
        for frame in {r[2] for r in rows}:
            items = {}
            for r in rows:
                if r[2] == frame:
                    items[r[4], tuple(r[5])] = min(r[0], items.get((r[4], tuple(r[5])), r[0]))
            bins = sorted({int(s * 62.999999) for s, _ in items}, reverse=True)
            floor = bins[n - 1] if len(bins) > n else -1
            assert kept[frame] == {i for (s, _), i in items.items() if int(s * 62.999999) >= floor}
        if n == 3:
            assert all(len(kept[f]) < 0.5 * size for f, size in ((5, 60), (6, 200), (7, 900), (8, 256)))
