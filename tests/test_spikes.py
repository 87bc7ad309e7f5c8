import json
import math
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

from pitchgrid.operators.spikes import implausible_positions, implausible_speeds, period_of, running_median, season, shot_speed, with_gesd_limit
from pitchgrid.plans.core_queries import p2_found

POS = "path_id long, match_id string, camera_id string, frame_index long, track_id long, field_x_m double, field_y_m double, __bad string"
CAM = "camera_id string, field_length_m double, field_width_m double, field_step_m double"
EV = "event_id long, match_id string, camera_id string, frame_index long, event_type string, metadata string"


def limit(sizes, step=0.0):
    """The largest ordinary size: above a third of them, where sizes first leave a gap of 1.8 and two steps."""
    a = np.sort(np.asarray([s for s in sizes if s > 0]))
    for i in range(len(a) - 1):
        if i + 1 >= len(a) / 3 and a[i + 1] >= 1.8 * a[i] and a[i + 1] - a[i] >= 2 * step:
            return a[i]
    return a[-1] if len(a) else 0


def ordinary(p, step, coarse):
    """Steps of a track without those between two far larger ones and without those of 0 and the first after three equal readings."""
    raw = [float(np.hypot(*(p[i + 1] - p[i]))) for i in range(len(p) - 1)]
    s, out = [max(x, step) for x in raw], []
    for i, x in enumerate(s):
        larger = lambda *d: any(0 <= i + k < len(s) and s[i + k] >= 1.8 * x for k in d)
        if larger(-1) and larger(1, 2) or larger(-2, -1) and larger(1):
            continue
        if not coarse and (raw[i] == 0 or i >= 2 and raw[i - 1] == raw[i - 2] == 0):
            continue
        out.append(x)
    return limit(out, step) if out else step


def brute_positions(rows, cams):
    """The definition of TESTDATA.md, track by track, without any decomposition or test."""
    frames, ids = {}, defaultdict(list)
    for r in sorted(rows, key=lambda r: r["path_id"]):
        key = (r["match_id"], r["track_id"], r["frame_index"])
        if None in key or r["field_x_m"] is None or r["field_y_m"] is None:
            continue
        frames.setdefault(key, (r["field_x_m"], r["field_y_m"], *cams[r["camera_id"]]))
        ids[key].append(r["path_id"])
    tracks, cases = defaultdict(list), set()
    for (m, t, f), v in sorted(frames.items()):
        if not all(math.isfinite(c) and -10 <= c <= top + 10 for c, top in ((v[0], v[2]), (v[1], v[3]))):
            cases.add((m, t, f))
        else:
            tracks[m, t].append((f, v))
    for (m, t), track in tracks.items():
        p, at, step = np.array([v[:2] for _, v in track]), [f for f, _ in track], track[0][1][4]
        big, gaps = ordinary(p, step, step >= 0.05), [b - a for a, b in zip(at, at[1:])]
        usual = max(set(gaps), key=lambda g: (gaps.count(g), -g)) if gaps else 1
        for k in (1, 2, 3):
            for a in range(len(p) - k - 1):
                b = a + k + 1
                if np.hypot(*(p[b] - p[a])) / (at[b] - at[a]) * usual > big:
                    continue
                off = [np.hypot(*(p[i] - p[a] - (p[b] - p[a]) * (at[i] - at[a]) / (at[b] - at[a]))) for i in range(a + 1, b)]
                if min(off) >= 5 * big:
                    cases |= {(m, t, at[i]) for i in range(a + 1, b)}
        a = 0
        for b in range(1, len(p) + 1):
            if b == len(p) or (p[b] != p[a]).any():
                if b - a >= 12 and step < 0.05:
                    cases |= {(m, t, track[j][0]) for j in range(a + 1, b)}
                a = b
    return {i for c in cases for i in ids[c]}


def speed(md):
    try:
        v = json.loads(md).get("speed_px_frame")
        return None if v is None else float(v)
    except (TypeError, ValueError):
        return None


def brute_speeds(rows):
    one, ids = {}, defaultdict(list)
    for r in sorted(rows, key=lambda r: r["event_id"]):
        v = speed(r["metadata"])
        if r["event_type"].strip().lower() == "shot" and v is not None:
            one.setdefault((r["match_id"], r["frame_index"]), (v, r["camera_id"]))
            ids[r["match_id"], r["frame_index"]].append(r["event_id"])
    bad = {k for k, (v, _) in one.items() if not math.isfinite(v) or v < 0 or v > 5000}
    by_cam, by_match, cases = defaultdict(list), defaultdict(list), set(bad)
    for k, (v, c) in sorted(one.items()):
        if k not in bad:
            by_cam[c].append((k, v))
            by_match[k[0]].append((k, v))
    for shots in by_cam.values():
        top = limit([v for _, v in shots])
        cases |= {k for k, v in shots if v >= 4 * top}
    for shots in by_match.values():
        a = 0
        for b in range(1, len(shots) + 1):
            if b == len(shots) or shots[b][1] != shots[a][1]:
                if b - a >= 8:
                    cases |= {k for k, _ in shots[a + 1 : b]}
                a = b
    return {i for c in cases for i in ids[c]}


def test_whole_tables_against_definition(spark, data):
    cams = {r["camera_id"]: (r["field_length_m"], r["field_width_m"], r["field_step_m"]) for r in pq.read_table(f"{data}/cameras.parquet").to_pylist()}
    got = defaultdict(set)
    for r in p2_found(spark, data).collect():
        assert r.record_id not in got[r.record_kind]
        got[r.record_kind].add(r.record_id)
    assert got["field_path"] == brute_positions(pq.read_table(f"{data}/field_path.parquet").to_pylist(), cams)
    assert got["match_events"] == brute_speeds(pq.read_table(f"{data}/match_events.parquet").to_pylist())
    assert got["field_path"] and got["match_events"]


def track(points, camera="fine", first=0):
    return [(first + i, "m", camera, 3 * i, 1, x, y, "x") for i, (x, y) in enumerate(points)]


def found(spark, rows, **sizes):
    cams = spark.createDataFrame([("fine", 2.4, 1.8, 0.0001), ("rough", 2.4, 1.8, 0.05)], CAM)
    return sorted(r.path_id for r in implausible_positions(spark.createDataFrame(rows, POS), cams, **sizes).collect())


def walk(rng, n, step=0.01):
    return np.cumsum(rng.normal(0, step, (n, 2)), axis=0) * 0.4 + [1.2, 0.9]


def test_dense_short_and_gapped(spark):
    """Excursions on a short track, one after another, with a step inside larger than the ordinary, and where frames are missing."""
    short = [(0.5 + 0.01 * i, 0.5) for i in range(8)]
    for i in (3, 4, 5):
        short[i] = (short[i][0], 0.56)
    assert found(spark, track(short)) == [3, 4, 5]
    dense = [(0.5 + 0.002 * (i % 5), 0.5 + 0.002 * (i % 3)) for i in range(600)]
    hit = [i for i in range(4, 595) if i % 7 in (4, 5, 6)]
    hit = [i for i in hit if {i // 7 * 7 + d for d in (4, 5, 6)} <= set(hit)]
    for i in hit:
        dense[i] = (dense[i][0], 0.7)
    assert found(spark, track(dense)) == hit
    inner = [(0.5 + 0.01 * i, 0.5) for i in range(40)]
    inner[20], inner[21] = (0.7, 0.56), (0.71, 0.577)  # the step between them is 1.97 ordinary steps, the excursion 6 to 7.7
    assert found(spark, track(inner)) == [20, 21]
    rows = track([(0.5 + 0.01 * i, 0.5) for i in range(40)])
    rows = [(i, m, c, f + 12 * (i > 20), t, x + 0.04 * (i > 20), y + 0.3 * (i == 20), z) for i, m, c, f, t, x, y, z in rows]
    assert found(spark, rows) == [20]  # five steps of time between the neighbours, five steps of way


def test_random_walks_against_definition(spark):
    """Every row the definition names passes the test of its residual, in one block or many."""
    rng, rows, cams = np.random.default_rng(5), [], {"fine": (2.4, 1.8, 0.0001)}
    for t in range(120):
        p = walk(rng, int(rng.integers(5, 60)))
        for _ in range(int(rng.integers(0, 4))):
            if len(p) > 6:
                i, k = int(rng.integers(1, len(p) - 4)), int(rng.integers(1, 4))
                p[i : i + k] += rng.normal(0, 1, 2) * 0.12
        rows += [(1000 * t + i, "m", "fine", 3 * i, t, float(x), float(y), "x") for i, (x, y) in enumerate(p)]
    one = {}
    names = POS.split(", ")
    want = brute_positions([dict(zip([n.split()[0] for n in names], r, strict=True)) for r in rows], cams)
    assert len(want) > 50
    for sizes in ({}, {"width": 40, "block": 16}):
        one[str(sizes)] = found(spark, rows, **sizes)
        assert want - set(one[str(sizes)]) <= set() or sizes  # blocks of 16 see less of a running median
    got = set(one["{}"])
    assert got <= want and len(want - got) <= 0.02 * len(want)  # but stretches that are the path seen from an excursion


def test_positions(spark):
    path = [(0.5 + 0.01 * i, 0.5 + 0.01 * (i % 3)) for i in range(60)]
    spiked = list(path)
    spiked[20] = (1.9, 1.2)
    spiked[40], spiked[41], spiked[42] = (2.0, 1.0), (2.01, 1.0), (2.0, 1.01)
    assert found(spark, track(spiked)) == [20, 40, 41, 42]
    moved = [(x, y) if i < 30 else (x + 1, y) for i, (x, y) in enumerate(path)]
    assert found(spark, track(moved)) == []
    stuck = path[:20] + [path[20]] * 14 + path[20:]
    assert found(spark, track(stuck)) == list(range(21, 35))  # 15 equal samples with the one that follows
    assert found(spark, track([(0.5, 0.5)] * 30, "rough")) == []
    wild = list(path)
    wild[5], wild[6], wild[7] = (float("nan"), 0.5), (13.0, 0.5), (0.5, None)
    rows = track(wild)
    assert found(spark, rows + [(900, *rows[5][1:])]) == [5, 6, 900]  # a copy of a case is a case
    assert found(spark, []) == []


def test_speeds(spark):
    md = [f'{{"speed_px_frame": {20 + i % 7}.{i}}}' for i in range(40)]
    md[3], md[4], md[5], md[6], md[7] = '{"speed_px_frame": NaN}', '{"speed_px_frame": "-Infinity"}', '{"speed_px_frame": " 90000 "}', '{"speed_px_', None
    md[8], md[9], md[30] = '{"speed_px_frame": -1.5, "a": 1}', "{}", '{"a": "b", "speed_px_frame":"230.5"}'
    rows = [(i, "m", "c", i, " Shot", m) for i, m in enumerate(md)] + [(100 + i, "n", "c", i, "shot", '{"speed_px_frame": 21.5}') for i in range(8)] + [(200, "m", "c", 1, "pass", '{"speed_px_frame": -4}')]
    got = sorted(r.event_id for r in implausible_speeds(spark.createDataFrame(rows, EV)).collect())
    assert got == [3, 4, 5, 8, 30, *range(101, 108)]
    assert implausible_speeds(spark.createDataFrame([], EV)).collect() == []
    values = [r[0] for r in spark.createDataFrame([(m,) for m in md[:10]], "m string").select(shot_speed("m")).collect()]
    assert values[0] == 20.0 and math.isnan(values[3]) and values[4] == -math.inf and values[5] == 90000 and values[6:8] == [None, None] and values[9] is None


def test_parts(spark):
    rng = np.random.default_rng(1)
    x = np.sin(np.arange(200) / 30) + rng.normal(0, 0.01, 200)
    assert np.abs(x - running_median(x)).max() < 0.1 and not season(x).any()
    for period in (7, 10, 24):
        wave = np.tile(rng.normal(0, 1, period), 400 // period)
        line = wave + np.arange(len(wave)) * 0.01 + rng.normal(0, 0.05, len(wave))
        line[50] += 30
        assert period_of(line - running_median(line, 61)) == period
    seasonal = np.tile([0.0, 1, 0, 0, 2, 0, 0, 3, 0, 0], 20) + np.arange(200) * 0.01
    assert np.abs(seasonal - season(seasonal) - np.arange(200) * 0.01)[10:-10].std() < 0.2
    # Table values of the two-sided test at 0.05 (Rosner 1983): n = 25 and 54, first and fifth.
    rows = with_gesd_limit(spark.createDataFrame([(25, 1), (25, 5), (54, 1), (54, 5)], "n int, i int"), "n", "i", "v")
    assert np.allclose([r.v for r in rows.collect()], [2.822, 2.733, 3.158, 3.120], atol=0.03)
