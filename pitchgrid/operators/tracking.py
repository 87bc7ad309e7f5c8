"""Operators whose state runs along the frames of one match and class: trackers, ball path, goal boxes.

Matches and classes are cut where nothing stands for longer than a track is remembered; pieces run in parallel, and
only (frame, box) columns reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.functions.geometry import Box, containment, distance, iou
from pitchgrid.operators.blocks import block_rows, blocked_row_number, runs_of, with_piece
from pitchgrid.sources.detections import BALLS, ROBOTS, is_in


def _iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    size = np.clip(high - low, 0, None)
    inter = size[..., 0] * size[..., 1]
    area = lambda m: np.clip(m[:, 2] - m[:, 0], 0, None) * np.clip(m[:, 3] - m[:, 1], 0, None)
    union = area(a)[:, None] + area(b)[None, :] - inter
    return np.where((inter > 0) & (union > 0), inter / np.where(union > 0, union, 1), 0.0)


def by_frame(pdf: pd.DataFrame) -> list[tuple[int, int, int]]:
    """(frame, first row, end row) of rows sorted by frame."""
    f = pdf["frame_index"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, f[1:] != f[:-1], True]).tolist() if len(f) else [0]
    return [(int(f[a]), a, b) for a, b in zip(cuts, cuts[1:])]


def follow(frames: list[tuple[int, np.ndarray]], threshold: float, max_age: int) -> list[np.ndarray]:
    """Track number of each box, frame by frame: overlaps are taken from the largest down, what is left opens tracks."""
    boxes, last, ids, out, n = np.zeros((0, 4)), np.zeros(0, int), np.zeros(0, int), [], 0
    for frame, now in frames:
        alive = frame - last <= max_age
        boxes, last, ids = boxes[alive], last[alive], ids[alive]
        mine = np.full(len(now), -1)
        if len(boxes) and len(now):
            m = _iou_matrix(now, boxes)
            taken = np.zeros(len(boxes), bool)
            near = np.flatnonzero(m >= threshold)
            for flat in near[np.argsort(-m.ravel()[near], kind="stable")].tolist():
                i, j = divmod(flat, len(boxes))
                if mine[i] < 0 and not taken[j]:
                    mine[i], taken[j] = ids[j], True
                    boxes[j], last[j] = now[i], frame
        fresh = np.flatnonzero(mine < 0)
        mine[fresh] = np.arange(n, n + len(fresh))
        n += len(fresh)
        boxes, last, ids = np.vstack([boxes, now[fresh]]), np.r_[last, np.full(len(fresh), frame)], np.r_[ids, mine[fresh]]
        out.append(mine)
    return out


def track(df: DataFrame, threshold: float = 0.25, max_age: int = 12) -> DataFrame:
    """track_id by greedy IoU per match and class. Matching never crosses classes, so classes run in parallel
    and numbers follow from the order in which tracks begin (frame, det_seq)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_index", "det_seq"], kind="stable")
        at, box = by_frame(pdf), pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        frames = [(f, box[a:b]) for f, a, b in at]
        pdf["local"] = np.concatenate(follow(frames, threshold, max_age)) if frames else []
        return pdf[["match_id", "frame_index", "det_seq", "class_name", "__piece", "local"]]

    cols = ["match_id", "frame_index", "det_seq", "class_name", "x1", "y1", "x2", "y2"]
    return _numbered(with_piece(df.select(*cols), ["match_id", "class_name"], "frame_index", max_age), run)


def _numbered(pieces: DataFrame, run) -> DataFrame:  # noqa: ANN001
    """Tracks of the pieces of a match and class, numbered in the match by how they begin. Pieces that begin within 4,096 frames go
    together, as a walk over them forgets one before the next: groups are fewer, none is longer than its longest piece and 4,096 frames."""
    pieces = pieces.withColumn("__piece", F.floor(F.col("__piece") / 4096))
    local = pieces.groupBy("match_id", "class_name", "__piece").applyInPandas(run, "match_id string, frame_index long, det_seq long, class_name string, __piece long, local long")
    key = ["match_id", "class_name", "__piece", "local"]
    heads = local.groupBy(*key).agg(F.min("frame_index").alias("__f"), F.min(F.struct("frame_index", "det_seq")).alias("__head")).withColumn("__stretch", F.floor(F.col("__f") / 65_536))
    heads = blocked_row_number(heads, ["match_id"], [F.col("__head")], "__stretch", "track_id").select(*key, "track_id")
    return local.join(heads, key).drop("local", "__piece")


def byte_track(df: DataFrame, high: float = 0.5, low: float = 0.1, first: float = 0.2, second: float = 0.5, buffer: int = 30) -> DataFrame:
    """Two-stage association by the published ByteTrack method: boxes of high score meet predicted tracks first,
    those of low score the tracks left over; a constant-velocity filter predicts, assignments are optimal.
    Boxes no track takes get numbers of their own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_index", "det_seq"], kind="stable")
        tracks: list[dict] = []
        n, ids = 0, []
        every, scores = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["score"].to_numpy(float)
        for f, lo, hi in by_frame(pdf):
            box, score = every[lo:hi], scores[lo:hi]
            tracks = [t for t in tracks if f - t["last"] <= buffer]
            mine = np.full(len(box), -1)
            free = set(range(len(tracks)))
            guess = np.array([t["box"] + t["speed"] * (f - t["last"]) for t in tracks]).reshape(-1, 4)
            for part, least in ((np.flatnonzero(score >= high), first), (np.flatnonzero((score >= low) & (score < high)), second)):
                left = sorted(free)
                if len(part) and left:
                    m = _iou_matrix(box[part], guess[left])
                    for i, j in assign(1 - m):
                        if m[i, j] >= least:
                            k, t = part[i], tracks[left[j]]
                            gap = max(1, f - t["last"])
                            t["speed"] = 0.6 * t["speed"] + 0.4 * (box[k] - t["box"]) / gap
                            t["box"], t["last"], mine[k] = box[k], f, t["id"]
                            free.discard(left[j])
            for k in np.flatnonzero(mine < 0):
                mine[k], n = n, n + 1
                if score[k] >= high:
                    tracks.append({"id": mine[k], "box": box[k], "speed": np.zeros(4), "last": f})
            ids.append(mine)
        pdf["local"] = np.concatenate(ids) if ids else []
        return pdf[["match_id", "frame_index", "det_seq", "class_name", "__piece", "local"]]

    cols = ["match_id", "frame_index", "det_seq", "class_name", "score", "x1", "y1", "x2", "y2"]
    return _numbered(with_piece(df.select(*cols), ["match_id", "class_name"], "frame_index", buffer), run)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of rows to columns by shortest augmenting paths."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            reduced = c[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def _cheapest(layers: list[tuple[int, np.ndarray, np.ndarray]], jump: float, penalty: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least cost from each candidate of the first layer (frame, cost, place) to each of the last, without the first's own cost,
    and for every further layer which candidate before it lies on the way, by start."""
    first = len(layers[0][1])
    cost = np.where(np.eye(first, dtype=bool), 0.0, np.inf)
    back = []
    for (f0, _, p0), (f1, c1, p1) in zip(layers, layers[1:]):
        allowed = max(jump, 1e-9) * max(1, f1 - f0)
        d = np.sqrt(((p1[:, None] - p0[None]) ** 2).sum(-1))
        step = cost[:, None, :] + (d / allowed + np.where(d > allowed, penalty, 0.0))[None]
        pick = step.argmin(axis=2)
        back.append(pick)
        cost = c1[None] + np.take_along_axis(step, pick[..., None], axis=2)[..., 0]
    return cost, back


def ball_path(df: DataFrame, preferred_area: float = 650.0, w_area: float = 1.0, w_score: float = 1.0, jump: float = 30.0, penalty: float = 50.0, top: int = 6, block: int = 4096) -> DataFrame:
    """The ball of each frame on the cheapest path: area and score of a candidate, and jumps between frames.

    Candidates are cut to the `top` cheapest of a frame in the JVM. Frames with a ball are cut into blocks of `block` that share their
    border frame. Each block gives the least costs between its first and last candidates, at most top * top numbers;
    these tell a match's border candidates, and between them each block finds its part of the path."""
    area = F.when(F.coalesce("area", F.lit(0.0)) > 0, F.col("area")).otherwise((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    balls = df.where(is_in(BALLS)).withColumn("cost", w_area * F.abs(F.log(F.greatest(area, F.lit(1.0)) / preferred_area)) - w_score * F.col("score"))
    w = Window.partitionBy("match_id", "frame_index").orderBy("cost", "det_seq")
    few = balls.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("match_id", "frame_index", "det_seq", "cx", "cy", "cost", "r")
    frames = few.where("r = 1").select("match_id", "frame_index", F.floor(F.col("frame_index") / 65_536).alias("__stretch"))
    frames = blocked_row_number(frames, ["match_id"], [F.col("frame_index")], "__stretch", "n")
    own = F.floor((F.col("n") - 1) / block)
    blocks = F.when(((F.col("n") - 1) % block == 0) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    rows = few.join(frames, ["match_id", "frame_index"]).withColumn("block", F.explode(blocks)).select("match_id", "block", "frame_index", "n", "det_seq", "cx", "cy", "cost", "r")

    def layers_of(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, np.ndarray, np.ndarray]], list[tuple[int, int, int]]]:
        pdf = pdf.sort_values(["frame_index", "r"])
        c, p, at = pdf["cost"].to_numpy(), pdf[["cx", "cy"]].to_numpy(), by_frame(pdf)
        return pdf, [(f, c[a:b], p[a:b]) for f, a, b in at], at

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, layers, _ = layers_of(pdf)
        cost, _ = _cheapest(layers, jump, penalty)
        i, j = np.indices(cost.shape)
        return pd.DataFrame({"match_id": pdf["match_id"].iloc[0], "block": pdf["block"].iloc[0], "i": i.ravel(), "j": j.ravel(), "cost": cost.ravel(), "first": layers[0][1][i.ravel()]})

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        total, ways, numbers = None, [], []
        for number, g in pdf.sort_values(["block", "i", "j"]).groupby("block", sort=True):
            m = g["cost"].to_numpy().reshape(g["i"].max() + 1, g["j"].max() + 1)
            total = g["first"].to_numpy()[:: m.shape[1]] if total is None else total
            through = total[:, None] + m
            ways.append(through.argmin(axis=0))
            total = through.min(axis=0)
            numbers.append(number)
        at, out = int(total.argmin()), []
        for number, way in zip(reversed(numbers), reversed(ways)):
            out.append((pdf["match_id"].iloc[0], number, int(way[at]), at, number == numbers[-1], float(total.min())))
            at = int(way[at])
        return pd.DataFrame(out, columns=["match_id", "block", "start", "stop", "last", "total"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, layers, at = layers_of(pdf)
        _, back = _cheapest(layers, jump, penalty)
        start, chosen = int(pdf["start"].iloc[0]), [int(pdf["stop"].iloc[0])]
        for pick in reversed(back):
            chosen.append(int(pick[start, chosen[-1]]))
        rows = [a + i for (_, a, _), i in zip(at, reversed(chosen))]
        kept = pdf.iloc[rows if pdf["last"].iloc[0] else rows[:-1]]  # a border frame is the next block's
        return pd.DataFrame({"match_id": kept["match_id"], "frame_index": kept["frame_index"], "det_seq": kept["det_seq"], "path_cost": kept["total"].round(6)})

    costs = rows.groupBy("match_id", "block").applyInPandas(ends, "match_id string, block long, i long, j long, cost double, first double")
    chosen = costs.groupBy("match_id").applyInPandas(borders, "match_id string, block long, start long, stop long, last boolean, total double")
    return rows.join(chosen, ["match_id", "block"]).groupBy("match_id", "block").applyInPandas(walk, "match_id string, frame_index long, det_seq long, path_cost double")


def steady_goals(df: DataFrame, names: tuple[str, ...], alpha: float = 0.25, jump: float = 240.0) -> DataFrame:
    """Goal boxes, the best of a frame and class, smoothed on successive frames; a jump repeats the last box, a gap starts anew."""
    b = ["x1", "y1", "x2", "y2"]
    w = Window.partitionBy("match_id", "class_name", "frame_index").orderBy(F.desc("score"), "det_seq")
    best = df.where(is_in(names)).withColumn("r", F.row_number().over(w)).where("r = 1").select("match_id", "class_name", "frame_index", *b)
    # Runs of successive frames are independent, so a match's goals need no single task.
    run = F.col("frame_index") - F.row_number().over(Window.partitionBy("match_id", "class_name").orderBy("frame_index"))
    rows = best.withColumn("__run", run).groupBy("match_id", "class_name", "__run").agg(F.array_sort(F.collect_list(F.struct("frame_index", *b))).alias("__all"))

    def step(acc, r):  # noqa: ANN001, ANN202
        last = F.try_element_at(acc, F.lit(-1))
        far = F.sqrt(F.pow((r["x1"] + r["x2"] - last["x1"] - last["x2"]) / 2, 2) + F.pow((r["y1"] + r["y2"] - last["y1"] - last["y2"]) / 2, 2)) > jump
        new = [F.when(last.isNull(), r[c]).when(far, last[c]).otherwise(alpha * r[c] + (1 - alpha) * last[c]).alias(c) for c in b]
        return F.concat(acc, F.array(F.struct(r["frame_index"].alias("frame_index"), *new, F.coalesce(far, F.lit(False)).alias("replaced"))))

    empty = F.expr("cast(array() as array<struct<frame_index:bigint,x1:double,y1:double,x2:double,y2:double,replaced:boolean>>)")
    out = rows.select("match_id", "class_name", F.explode(F.aggregate("__all", empty, step)).alias("g"))
    return out.select("match_id", "class_name", "g.frame_index", *[F.round(f"g.{c}", 6).alias(c) for c in b], "g.replaced")


def calibrated_crossings(
    df: DataFrame, line: tuple[tuple[float, float], tuple[float, float]], wall: tuple[tuple[float, float], tuple[float, float]], sign: int = 1, side: str = "left", margin: float = 0.08,
    *, lookback: int = 6, ahead: int = 6, need: int = 3, motion: float = 2.0, reach: int = 24, radius_share: float = 0.75, tolerance: float = 2.0, block: int = 4096,
) -> DataFrame:
    """Of each ball track its first qualifying crossing of a goal line: confirmed at contact with the back wall, or rejected.

    A crossing goes from the outer to the inner side (`sign`) between samples at most 2 frames apart,
    within the line's segment (and margin), by at least `motion`, with a sample outside among the
    `lookback` before and `need` successive ones inside among the `ahead` from it on. Contact is the first of `reach` samples
    on the wall's segment that is nearer to it than radius_share of the ball's radius and the tolerance.
    Rows without a track are one track. Tracks are cut into blocks of `block` samples with a halo, so none has to fit a task.
    """
    if sign not in (-1, 1) or line[0] == line[1] or wall[0] == wall[1] or need < 1:
        raise ValueError("a line has two ends, sign is 1 or -1, need is positive")

    def place(p: np.ndarray, ab) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        (ax, ay), (bx, by) = ab
        dx, dy = bx - ax, by - ay
        x, y = p[:, 0] - ax, p[:, 1] - ay
        return (dx * y - dy * x) / np.hypot(dx, dy), (x * dx + y * dy) / (dx * dx + dy * dy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, ["__key", "__block"]):
            code = [group.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("__key", "__block")]
            cuts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in code], axis=0), True])
            col = {c: group.column(c).to_numpy(zero_copy_only=False) for c in ("frame_index", "x1", "y1", "x2", "y2", "cx", "cy", "__core", "__at")}
            rows, out = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                f, p, core = col["frame_index"][a:b], np.column_stack([col["cx"][a:b], col["cy"][a:b]]), col["__core"][a:b]
                d, along = place(p, line)
                d = sign * d
                off, there = place(p, wall)
                limit = radius_share * np.maximum(col["x2"][a:b] - col["x1"][a:b], col["y2"][a:b] - col["y1"][a:b]) * 0.5 + tolerance
                touch = (np.abs(off) <= limit) & (there >= -margin) & (there <= 1 + margin)
                moved = np.sqrt(((p[1:] - p[:-1]) ** 2).sum(axis=1))
                fits = (np.diff(f) <= 2) & (d[:-1] <= 0) & (d[1:] > 0) & (along[1:] >= -margin) & (along[1:] <= 1 + margin) & (moved >= motion) & core[1:]
                for i in (np.flatnonzero(fits) + 1).tolist():
                    if not (d[max(0, i - lookback) : i] <= 0).any():
                        continue
                    stop = np.flatnonzero((d[i : i + ahead] <= 0) | np.r_[False, np.diff(f[i : i + ahead]) > 2])
                    inside = int(stop[0]) if len(stop) else len(d[i : i + ahead])
                    if inside < need:
                        continue
                    hit = np.flatnonzero(touch[i : i + reach])
                    found = i + int(hit[0]) if len(hit) else None
                    rows.append(a + i)
                    out.append((int(f[i if found is None else found]), found is not None, int(f[i]), inside))
            if rows:
                frames, confirmed, crossing, inside = zip(*out, strict=True)
                take = group.select(["match_id", "track", "__at"]).take(pa.array(rows)).combine_chunks().to_batches()[0]
                yield pa.record_batch([*take.columns, pa.array(frames, pa.int64()), pa.array(confirmed), pa.array(crossing, pa.int64()), pa.array(inside, pa.int64())], names=[*take.schema.names, "frame_index", "confirmed", "crossing_frame", "inside_frames"])

    rows = df.where(is_in(BALLS)).select("match_id", F.coalesce("track_id", F.lit(-1).cast("long")).alias("track"), "frame_index", "det_seq", "x1", "y1", "x2", "y2", "cx", "cy")
    rows = rows.withColumns({"__key": F.concat_ws("/", F.col("track").cast("string"), "match_id"), "__stretch": F.floor(F.col("frame_index") / block)})
    rows = blocked_row_number(rows, ["__key"], [F.col("frame_index"), F.col("det_seq")], "__stretch", "__at")
    found = block_rows(rows, "__key", "__at", block, block, max(lookback, ahead, reach) + 1, ranked=True).mapInArrow(run, "match_id string, track long, __at long, frame_index long, confirmed boolean, crossing_frame long, inside_frames long")
    first = found.groupBy("match_id", "track").agg(F.min(F.struct("__at", "frame_index", "confirmed", "crossing_frame", "inside_frames")).alias("r")).select("match_id", "track", "r.*")
    ok = F.col("confirmed")
    return first.select(
        "match_id", "frame_index", F.when(ok, "goal_confirmed").otherwise("goal_rejected").alias("event_type"), F.when(~ok, "missing_back_wall_contact").alias("rejection_reason"), "crossing_frame",
        F.lit(side).alias("goal_side"), F.col("track").alias("actor"), F.when(ok, F.round(F.least(F.lit(0.95), 0.68 + 0.04 * F.col("inside_frames")), 6)).otherwise(0.7).alias("confidence"), "inside_frames",
    )


def held_tracks(df: DataFrame, hold: int = 12) -> DataFrame:
    """Rows repeated on the frames after a track is lost, up to `hold` or its return; not where a row of the frame stands for them:
    one of their family (robots, balls, the same class) that overlaps by 0.15, contains or lies in them by 0.55 or is within 80 px,
    and for a robot within 140 px of a ball also a robot within 190 px of that ball."""
    seen = df.where("track_id is not null").groupBy("match_id", "class_name", "track_id", "frame_index").agg(F.max_by(F.struct("x1", "y1", "x2", "y2", "cx", "cy", "det_seq"), F.struct("score", -F.col("det_seq"))).alias("b"))
    nxt = F.lead("frame_index").over(Window.partitionBy("match_id", "class_name", "track_id").orderBy("frame_index"))
    last = df.groupBy("match_id").agg(F.max("frame_index").alias("__last"))
    rows = seen.withColumn("__next", nxt).join(last, "match_id")
    stop = F.least(F.col("frame_index") + hold, F.coalesce(F.col("__next") - 1, F.col("__last")))
    rows = rows.where(stop > F.col("frame_index")).withColumn("held_frame", F.explode(F.sequence(F.col("frame_index") + 1, stop)))
    rows = rows.select("match_id", "class_name", "track_id", "held_frame", F.col("frame_index").alias("seen_frame"), "b.*")

    def family(c: str) -> Column:
        return F.when(is_in(ROBOTS, c), "robot").when(is_in(BALLS, c), "ball").otherwise(F.col(c))

    h, k = Box.of(), Box.of("k_")
    now = df.select(F.col("match_id").alias("k_match"), F.col("frame_index").alias("k_frame"), family("class_name").alias("k_family"), *[F.col(c).alias(f"k_{c}") for c in ("x1", "y1", "x2", "y2", "cx", "cy")])
    apart = lambda a, b: distance(F.col(f"{a}cx"), F.col(f"{a}cy"), F.col(f"{b}cx"), F.col(f"{b}cy"))
    here = (F.col("match_id") == F.col("k_match")) & (F.col("held_frame") == F.col("k_frame"))
    same = here & (family("class_name") == F.col("k_family")) & ((iou(h, k) >= 0.15) | (containment(h, k) >= 0.55) | (apart("", "k_") <= 80))
    rows = rows.join(now, same, "left_anti")
    # Balls with a robot near them, once a frame; a held robot near such a ball goes.
    balls = now.where("k_family = 'ball'")
    robots = df.where(is_in(ROBOTS)).select(F.col("match_id").alias("k_match"), F.col("frame_index").alias("k_frame"), F.col("cx").alias("r_cx"), F.col("cy").alias("r_cy"))
    taken = balls.join(robots, ["k_match", "k_frame"]).where(apart("k_", "r_") <= 190).select("k_match", "k_frame", "k_cx", "k_cy").distinct()
    rows = rows.join(taken, here & is_in(ROBOTS) & (apart("", "k_") <= 140), "left_anti")
    return rows.select("match_id", "class_name", "track_id", "held_frame", "seen_frame", "det_seq")


def tracked(df: DataFrame, backend: str = "iou", **options: float) -> DataFrame:
    """track_id by one of the trackers: `iou` or `byte`."""
    trackers = {"iou": track, "byte": byte_track}
    if backend not in trackers:
        raise ValueError(f"unknown tracker {backend}; known: {', '.join(trackers)}")
    return trackers[backend](df, **options)
