"""Problem 2: implausible readings per source, relative to that source's ordinary behaviour."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchgrid.operators.blocks import block_rows, blocked_row_number, runs_of
from pitchgrid.session import checkpointed

BINS = 8  # logarithmic bins to a doubling


def with_gesd_limit(df: DataFrame, n: str, i: str, name: str, alpha: float = 0.05) -> DataFrame:
    """Adds the critical value of the generalised extreme studentised deviate test for the i-th outlier among n.

    Normal quantile by the rational approximation of Abramowitz and Stegun (26.2.23), Student's t by
    the Cornish-Fisher expansion around it; a column a step, so that no expression repeats another.
    """
    c, left = F.col, F.col(n) - F.col(i)
    df = df.withColumn("__q", F.sqrt(-2 * F.log(F.lit(alpha) / (2 * (left + 1)))))
    df = df.withColumn("__z", c("__q") - (2.515517 + 0.802853 * c("__q") + 0.010328 * F.pow("__q", F.lit(2))) / (1 + 1.432788 * c("__q") + 0.189269 * F.pow("__q", F.lit(2)) + 0.001308 * F.pow("__q", F.lit(3))))
    df = df.withColumn("__df", F.greatest(left - 1, F.lit(1)).cast("double"))
    z = lambda k: F.pow("__z", F.lit(k))
    df = df.withColumn("__t", c("__z") + (z(3) + c("__z")) / (4 * c("__df")) + (5 * z(5) + 16 * z(3) + 3 * c("__z")) / (96 * c("__df") * c("__df")))
    return df.withColumn(name, left * c("__t") / F.sqrt((c("__df") + F.pow("__t", F.lit(2))) * (left + 1))).drop("__q", "__z", "__df", "__t")


def running_median(values: np.ndarray, width: int = 15) -> np.ndarray:
    """Median, of each column, of the `width` (odd) rows around each row; near the ends of as many as stand on both sides."""
    n, half = len(values), width // 2
    out = np.array(values, dtype=float)
    middle = lambda part, k: np.partition(part, k, axis=-1)[..., k]
    if n >= width:
        out[half : n - half] = middle(np.lib.stride_tricks.sliding_window_view(values, width, axis=0), half)
    for i in range(1, min(half, (n + 1) // 2)):
        out[i], out[n - 1 - i] = middle(values[: 2 * i + 1].T, i), middle(values[n - 1 - 2 * i :].T, i)
    return out


def period_of(rest: np.ndarray, most: int = 512) -> int:
    """The period at which a detrended series agrees best with itself (0: none), from its own autocorrelation; outliers are clipped."""
    n = len(rest)
    spread = np.median(np.abs(rest))
    if n < 12 or not spread > 0:
        return 0
    x = np.clip(rest, -4 * spread, 4 * spread)
    x = x - x.mean()
    power = np.abs(np.fft.rfft(x, 2 * n)) ** 2
    last = min(most, n // 4)
    corr = np.fft.irfft(power)[: last + 2] / n * (n / np.maximum(1, n - np.arange(last + 2)))
    if corr[0] <= 0 or last < 2:
        return 0
    corr = corr / corr[0]
    inner = np.arange(2, last + 1)
    peaks = inner[(corr[inner] >= corr[inner - 1]) & (corr[inner] >= corr[inner + 1])]
    if not len(peaks):
        return 0
    best = corr[peaks].max()
    return int(peaks[corr[peaks] >= 0.9 * best][0]) if best >= 0.4 else 0


def season(values: np.ndarray, ordinary: float = np.inf) -> np.ndarray:
    """The seasonal part of a series: medians by phase of what a running median leaves, where they take away much of it and
    never change by more than an ordinary step (a regular excursion is no season); else 0."""
    rest = values - running_median(values)
    period = period_of(rest)
    if not period:
        return np.zeros(len(values))
    phase = np.arange(len(values)) % period
    part = np.array([np.median(rest[phase == p]) for p in range(period)])
    if np.abs(np.diff(part, append=part[:1])).max() > ordinary:
        return np.zeros(len(values))
    part = (part - np.median(part))[phase]
    spread = lambda x: np.median(np.abs(x - np.median(x)))
    return part if spread(rest - part) < 0.6 * spread(rest) else np.zeros(len(values))


def _size(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=-1))


def _between(p: np.ndarray, at: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have neighbours `before` and `after` rows away, and how far each lies from the straight path between them."""
    i = np.arange(before, len(p) - after)
    a, b = i - before, i + after
    share = ((at[i] - at[a]) / (at[b] - at[a]))[:, None]
    return i, _size(p[i] - (p[a] + (p[b] - p[a]) * share))


def off_path(p: np.ndarray, at: np.ndarray, longest: int) -> np.ndarray:
    """Residual of each row: its largest distance from a local trend that leaves out the row and up to longest - 1 of its neighbours."""
    out = np.zeros(len(p))
    for k in range(1, longest + 1):
        for j in range(1, k + 1):
            i, d = _between(p, at, j, k - j + 1)
            out[i] = np.maximum(out[i], d)
    return out


def first_gap(sizes: np.ndarray, gap: float, upper: float, floor: float) -> float:
    """The largest ordinary size: above the `upper` share, where sizes first leave a gap, of a factor and of two steps of rounding."""
    s = np.sort(sizes)
    if not len(s):
        return 0.0
    k = max(0, int(np.ceil(upper * len(s))) - 1)
    ends = np.flatnonzero((s[k + 1 :] >= gap * s[k:-1]) & (s[k + 1 :] - s[k:-1] >= 2 * floor))
    return float(s[k + ends[0]] if len(ends) else s[-1])


def excursions(p: np.ndarray, at: np.ndarray, residual: np.ndarray, longest: int, large: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, distance, rate, residual) of every row in every stretch of 1..longest rows between two neighbours: the least distance of the
    stretch from the straight path between them, how far they are apart per unit of `at`, the stretch's least residual.
    Where stretches farther than `large` whose neighbours are within `reach` per unit take turns (both neighbours of one lie in others),
    the path is what lies nearer to the running median."""
    out, n = [], len(p)
    for k in range(1, longest + 1):
        a = np.arange(max(0, n - k - 1))
        b = a + k + 1
        gap = (at[b] - at[a]).astype(float)
        rows = a[:, None] + np.arange(1, k + 1)
        share = ((at[rows] - at[a][:, None]) / gap[:, None])[..., None]
        far = _size(p[rows] - (p[a][:, None] + (p[b] - p[a])[:, None] * share)).min(axis=1)
        out.append((a, k, rows, far, _size(p[b] - p[a]) / gap))
    marked = np.zeros(n, bool)
    for _, _, rows, far, rate in out:
        marked[rows[(far >= large) & (rate <= reach)]] = True
    if marked.any():
        away = _size(p - running_median(p))
    parts = []
    for a, k, rows, far, rate in out:
        fits = ~(marked[a] & marked[a + k + 1])
        if not fits.all():
            fits |= away[rows].min(axis=1) > np.maximum(away[a], away[a + k + 1])
        rest = residual[rows].min(axis=1)
        parts += [(rows[fits, j], far[fits], rate[fits], rest[fits]) for j in range(k)]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def stuck_rows(p: np.ndarray, least: int) -> np.ndarray:
    """Rows after the first of at least `least` equal ones."""
    same = np.r_[False, (p[1:] == p[:-1]).all(axis=1)]
    run = np.cumsum(~same) - 1
    return (np.bincount(run)[run] >= least) & same


def ordinary_steps(p: np.ndarray, loose: np.ndarray, floor: float, gap: float = 1.8) -> tuple[np.ndarray, np.ndarray]:
    """Size of the step into each row, at least floor, and which count: not those between two far larger ones (inside an excursion), nor those of 0 and the first after a run of equal rows (unless loose)."""
    n = len(p)
    raw = np.r_[np.nan, _size(p[1:] - p[:-1])]
    s = np.maximum(raw, floor)
    pad, zero = np.r_[np.nan, np.nan, s, np.nan, np.nan], np.r_[False, False, raw == 0]
    side = lambda *d: np.fmax.reduce([pad[2 + k : 2 + k + n] for k in d])
    larger = lambda *d: np.nan_to_num(side(*d)) >= gap * s
    inside = (larger(-1) & larger(1, 2)) | (larger(-2, -1) & larger(1))
    held = ((raw == 0) | (zero[1 : 1 + n] & zero[:n])) & ~loose
    return s, ~inside & ~held & ~np.isnan(raw)


def binned(v: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(bin, number, least, largest) of the positive values."""
    v = np.sort(v[v > 0])
    if not len(v):
        return []
    b = np.floor(np.log2(v) * BINS).astype(int)
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    end = np.r_[cut[1:], len(v)]
    return [(int(b[i]), int(z - i), float(v[i]), float(v[z - 1])) for i, z in zip(cut, end, strict=True)]


def source_figures(bins: DataFrame, source: str, gap: float, upper: float, alpha: float) -> DataFrame:
    """Per source, from its binned steps, spacings and residuals: __ordinary, __spacing and __limit, the residual from which the test finds outliers."""
    merged = bins.groupBy(source, "kind", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("least").alias("least"))
    w = Window.partitionBy(source, "kind")
    up, down = w.orderBy("bin"), w.orderBy(F.desc("bin"))
    rows = merged.withColumns({"all": F.sum("n").over(w), "upto": F.sum("n").over(up), "next": F.lead("lo").over(up), "above": F.sum("n").over(down) - F.col("n")})
    is_kind = lambda k: F.col("kind") == k
    end = is_kind("step") & (F.col("upto") >= upper * F.col("all")) & (F.col("next") >= gap * F.col("hi")) & (F.col("next") - F.col("hi") >= 2 * F.col("least"))
    half = is_kind("rest") & (2 * F.col("upto") >= F.col("all"))
    rows = rows.withColumns({
        "__gap": F.min(F.when(end, F.col("hi"))).over(Window.partitionBy(source)), "__top": F.max(F.when(is_kind("step"), F.col("hi"))).over(Window.partitionBy(source)),
        "__half": F.min(F.when(half, F.col("lo"))).over(Window.partitionBy(source)), "__floor": F.max("least").over(Window.partitionBy(source)),
    })
    rows = rows.withColumn("__ordinary", F.greatest(F.coalesce("__gap", "__top", F.lit(0.0)), "__floor"))
    deviation = F.greatest(F.least(1.4826 * F.col("__half"), F.col("__ordinary") / 3), 0.29 * F.col("__floor"))
    rows = with_gesd_limit(rows.withColumns({"__deviation": deviation, "__i": F.least(F.col("above") + 1, F.floor(F.col("all") / 2))}), "all", "__i", "__critical", alpha)
    beyond = is_kind("rest") & ((F.col("all") < 5) | (F.col("hi") > F.col("__critical") * F.col("__deviation")))
    return rows.groupBy(source).agg(F.max("__ordinary").alias("__ordinary"), F.max_by(F.when(is_kind("spacing"), F.col("lo")), F.when(is_kind("spacing"), F.struct("n", -F.col("bin")))).alias("__spacing"), F.min(F.when(beyond, F.col("lo"))).alias("__limit"))


def implausible(
    df: DataFrame, source: str, order: str, values: Sequence[str], least: str, *, times: float | None, stuck: int | None, stuck_unless: str | None = None, longest: int = 3,
    path: bool = True, gap: float = 1.8, upper: float = 1 / 3, alpha: float = 0.05, width: int = 65_536, block: int = 65_536, ranked: bool = False,
) -> DataFrame:
    """(source, order) of the rows of df that are spikes or stand in a stuck run.

    df has one row for each (source, order), both not null, order a whole number, with finite values;
    `least` is the least ordinary size. Each source is decomposed: a season, its period taken from the
    source's own autocorrelation, goes where it is marked; a local trend that leaves out the reading
    and its neighbours goes; the residual's size remains. The generalised ESD test runs per source on
    all its residuals with a robust deviation (from their median, never more than a third of the largest
    ordinary step); critical values run up to half of the rows, and the last holds for what lies beyond, as the
    neighbours of an excursion have large residuals too. What is flagged is judged by the exact rule:
    path=True: one to `longest` flagged readings lie `times` the largest ordinary step or more off the
    straight path between their neighbours, and these are no farther apart than ordinary steps reach in
    the time between them; path=False: the value is `times` the largest ordinary value. Separately, rows
    after the first of at least `stuck` equal rows (unless the column stuck_unless is true).

    The largest ordinary step (value) of a source ends where, above its `upper` share, sizes first leave
    a gap of the factor `gap` and of twice `least`; steps inside an excursion and in or out of a stuck run do not count. A residual
    `times` ordinary steps large always lies beyond the test's limit, however the others are spread.

    Sources are worked in blocks of `block` successive readings with a halo, so none has to fit a task;
    steps, spacings and residuals of all blocks meet in logarithmic bins, so the figures are the source's.
    ranked: order already counts the source's rows from 1. Empty input gives no rows.
    """
    values = list(values)
    halo = max(16, (stuck or 0) + 1)
    rows = df.select(source, order, *values, F.col(least).cast("double").alias("__least"), (F.col(stuck_unless) if stuck_unless else F.lit(False)).alias("__loose"))
    cut = block_rows(rows, source, order, width, block, halo, ranked)
    kinds = dict(rows.dtypes)
    names = [source, "kind", order, "bin", "n", "lo", "hi", "least"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for group in runs_of(batches, [source, "__block"]):
            types = types or (group.schema.field(source).type, group.schema.field(order).type)
            name, number = group.column(source).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), group.column("__block").to_numpy()
            ends = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (number[1:] != number[:-1]), True]).tolist()
            points = np.column_stack([np.asarray(group.column(v)) for v in values]).astype(float)
            places, own, loosely, floors = group.column(order).to_numpy(), np.asarray(group.column("__core")), np.asarray(group.column("__loose")), np.asarray(group.column("__least"))
            out: list[tuple] = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                p, at, core, loose = points[a:b], places[a:b], own[a:b], loosely[a:b]
                floor = max(float(floors[a]), 1e-12)
                put = lambda kind, i, *rest: out.append((a, kind, int(at[i]), *rest))  # noqa: B023, E731
                if stuck:
                    for i in np.flatnonzero(stuck_rows(p, stuck) & core & ~loose):
                        put("stuck", i, None, None, None, None, None)
                if times is None:
                    continue
                size, counts = ordinary_steps(p, loose, floor, gap) if path else (p[:, 0], p[:, 0] > 0)
                usual = first_gap(size[counts], gap, upper, floor)
                clean = p - np.column_stack([season(c, usual) for c in p.T])
                if path:
                    between = np.bincount(np.minimum(np.diff(at), 1 << 16)) if len(at) > 1 else np.ones(2)
                    residual = off_path(clean, at, longest)
                    shape = [("step", size[core & counts]), ("spacing", np.diff(at, prepend=at[0])[core])]
                    i, far, rate, rest = excursions(p, at, residual, longest, times * usual, usual / max(1, between.argmax()))
                    some = core[i] & (far >= times * np.maximum(rate, floor))
                    for one in zip(i[some].tolist(), far[some].tolist(), rate[some].tolist(), rest[some].tolist(), strict=True):
                        put("case", one[0], None, None, *one[1:])
                else:
                    level = np.minimum(running_median(clean[:, 0]), np.median(clean[:, 0]))
                    residual = np.abs(clean[:, 0] - level)
                    shape = [("step", np.maximum(p[core, 0], floor))]
                    for i in np.flatnonzero(core & (p[:, 0] >= times * floor)):
                        put("case", i, None, None, float(p[i, 0]), 0.0, float(residual[i]))
                for kind, v in [*shape, ("rest", np.maximum(residual[core], 1e-12))]:
                    for bin_, n, lo, hi in binned(v):
                        out.append((a, kind, None, bin_, n, lo, hi, floor))
            if out:
                first, *cols = zip(*out, strict=True)
                arrays = [group.column(source).take(pa.array(first)).combine_chunks()] + [pa.array(c, t) for c, t in zip(cols, (pa.string(), types[1], pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)]
                yield pa.record_batch(arrays, names=names)

    shape = f"`{source}` {kinds[source]}, kind string, `{order}` {kinds[order]}, bin long, n long, lo double, hi double, least double"
    found = cut.mapInArrow(kernel, shape)
    held = found.where("kind = 'stuck'").select(source, order)
    if times is None:
        return held
    found = checkpointed(found)
    figures = source_figures(found.where("kind not in ('case', 'stuck')"), source, gap, upper, alpha)
    # A case row holds: distance in lo, rate in hi, residual in least.
    cases = found.where("kind = 'case'").join(figures, source)
    fits = (F.col("lo") >= times * F.col("__ordinary")) & (F.col("least") >= F.col("__limit"))
    if path:
        fits = fits & (F.col("hi") * F.coalesce("__spacing", F.lit(1.0)) <= F.col("__ordinary"))
    spikes = cases.where(fits).select(source, order)
    return (spikes.unionByName(found.where("kind = 'stuck'").select(source, order)) if stuck else spikes).distinct()


def implausible_positions(paths: DataFrame, cameras: DataFrame, margin: float = 10.0, times: float = 5.0, stuck: int = 12, coarse: float = 0.05, **sizes: int) -> DataFrame:
    """path_id of the field_path rows whose position cannot be true (see TESTDATA.md, problem 2).

    Copies (same match, track, frame) are judged as one reading, that of the smallest path_id with a
    position, and named all. Null positions, frames, tracks or matches are no cases. A reading of an
    unknown camera is judged without pitch bounds and with a step of 0.
    cameras is a small fixed dimension; Catalyst broadcasts it by its size.
    """
    keys = ["__track", "frame_index"]
    raw = paths.select("path_id", F.struct("match_id", "track_id").alias("__track"), "match_id", "track_id", "frame_index", "camera_id", "field_x_m", "field_y_m")
    raw = raw.where("match_id is not null and track_id is not null and frame_index is not null and field_x_m is not null and field_y_m is not null").drop("match_id", "track_id")
    raw = raw.withColumn("__track", F.concat_ws("/", F.col("__track.track_id").cast("string"), "__track.match_id"))
    dims = cameras.groupBy("camera_id").agg(F.max("field_length_m").alias("__l"), F.max("field_width_m").alias("__w"), F.max("field_step_m").alias("__d"))
    raw = raw.join(dims, "camera_id", "left")
    bad = lambda v, top: F.isnan(v) | (F.abs(v) == float("inf")) | (F.col(v) < -margin) | (F.col(v) > F.col(top) + margin)
    raw = raw.withColumn("__bad", F.coalesce(bad("field_x_m", "__l"), F.lit(False)) | F.coalesce(bad("field_y_m", "__w"), F.lit(False)))
    one = raw.groupBy(*keys).agg(F.max("__bad").alias("__bad"), F.min_by(F.struct("field_x_m", "field_y_m", "__d"), "path_id").alias("__p"))
    one = one.select(*keys, "__bad", "__p.field_x_m", "__p.field_y_m", F.coalesce("__p.__d", F.lit(0.0)).alias("__d"))
    usable = one.where(~F.col("__bad")).withColumn("__coarse", F.col("__d") >= coarse)
    found = implausible(usable, "__track", "frame_index", ["field_x_m", "field_y_m"], "__d", times=times, stuck=stuck, stuck_unless="__coarse", **sizes)
    cases = one.where("__bad").select(*keys).unionByName(found)
    return raw.select("path_id", *keys).join(cases, keys, "left_semi").select("path_id")


def shot_speed(metadata: str) -> Column:
    """speed_px_frame of whole JSON metadata, as a number also where it is a string, NaN or Infinity; else null."""
    whole = F.when(F.trim(F.col(metadata)).rlike(r"^\{[\s\S]*\}$"), F.col(metadata))
    text = F.regexp_extract(whole, r'(?i)"speed_px_frame"\s*:\s*"?\s*([-+]?(?:nan|inf(?:inity)?|[0-9.][0-9.e+-]*))\s*"?\s*[,}]', 1)
    return F.when(text != "", text.try_cast("double"))


def implausible_speeds(events: DataFrame, top: float = 5000.0, times: float = 4.0, stuck: int = 8, **sizes: int) -> DataFrame:
    """event_id of the shots whose speed cannot be true, relative to the ordinary speeds of their camera.

    Copies (same match, event type, frame) are judged as one and named all. Null or cut-off metadata
    and missing keys are no cases; shots of no named camera are judged as those of one camera.
    """
    keys = ["match_id", "frame_index"]
    camera = F.coalesce(F.concat(F.lit("camera "), "camera_id"), F.lit("none")).alias("__camera")
    shots = events.select("event_id", *keys, camera, shot_speed("metadata").alias("__v"), F.lower(F.trim("event_type")).alias("__t"))
    shots = shots.where("__t = 'shot' and match_id is not null and frame_index is not null and __v is not null").drop("__t")
    shots = shots.withColumn("__bad", F.isnan("__v") | (F.abs("__v") == float("inf")) | (F.col("__v") < 0) | (F.col("__v") > top))
    one = shots.groupBy(*keys).agg(F.max("__bad").alias("__bad"), F.min_by(F.struct("__v", "__camera"), "event_id").alias("__p"))
    one = one.select(*keys, "__bad", "__p.__v", "__p.__camera")
    usable = one.where(~F.col("__bad")).withColumn("__d", F.lit(1e-9))
    # A camera's own order: its matches one after another. Ordinals of (match, frame) come from blocks of one match each.
    numbered = usable.withColumn("__match", F.struct("match_id", F.floor(F.col("frame_index") / 4096).alias("b")))
    numbered = blocked_row_number(numbered, ["__camera"], [F.col("frame_index")], "__match", "__at")
    found = implausible(numbered, "__camera", "__at", ["__v"], "__d", times=times, stuck=None, path=False, ranked=True, **sizes)
    hit = numbered.join(found, ["__camera", "__at"], "left_semi").select(*keys)
    held = implausible(usable, "match_id", "frame_index", ["__v"], "__d", times=None, stuck=stuck, **sizes)
    cases = one.where("__bad").select(*keys).unionByName(hit).unionByName(held)
    return shots.select("event_id", *keys).join(cases, keys, "left_semi").select("event_id")
