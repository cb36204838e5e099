"""Signals: ordered multichannel samples keyed by video.

Samples carry ``video_id``, ``idx`` (frame index), ``timestamp`` (seconds) and one double
column per channel. Operators that need places in the series take numbered samples
(``pos``, ``n``), made once by :func:`numbered`.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolake.functions.vectors import norm
from kinolake.operators import ordering as o

KEYS = ("video_id",)
ORDER = ("timestamp", "idx")


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing input columns: {', '.join(missing)}")


# -- shaping --------------------------------------------------------------

def signal_rows(samples: DataFrame, channels: Sequence[str], fitted: Column | None = None) -> DataFrame:
    """Samples with a successful motion fit: keys, time and channels only."""
    require_columns(samples, "video_id", "idx", "timestamp", *channels)
    keep = fitted if fitted is not None else F.col(channels[0]).isNotNull()
    return samples.filter(keep).select("video_id", "idx", "timestamp", *channels)


def videos_without_signal(samples: DataFrame, fitted: Column) -> DataFrame:
    """Reject table: videos whose samples all lack a motion fit."""
    return (samples.groupBy("video_id").agg(F.bool_or(fitted).alias("_any"), F.count("*").alias("samples"))
            .filter(~F.col("_any")).select("video_id", "samples", F.lit("no motion samples").alias("reason")))


def numbered(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
             bucket_seconds: float = o.DAY, longest: int | None = None) -> DataFrame:
    """Samples with their zero-based position ``pos`` and the series length ``n``."""
    rows = o.by_series(df, *keys) if o.fits_one_task(longest) else df
    return o.number_rows(rows, keys, order, o.time_bucket(F.col(order[0]), bucket_seconds), longest=longest)


def time_slice(df: DataFrame, t0: float | None, t1: float | None, closed: bool = False,
               time: str = "timestamp") -> DataFrame:
    """Rows in ``[t0, t1)``, or ``[t0, t1]`` when closed; a null bound is unbounded."""
    if t0 is not None:
        df = df.filter(F.col(time) >= t0)
    if t1 is not None:
        df = df.filter(F.col(time) <= t1 if closed else F.col(time) < t1)
    return df


# -- smoothing and scaling ------------------------------------------------

@lru_cache(maxsize=None)
def smoothing_weights(window: int, degree: int) -> tuple[tuple[float, ...], ...]:
    """Row i: weights that evaluate the least-squares polynomial over the window at place i."""
    x = np.arange(window) - (window - 1) / 2
    basis = np.vander(x, degree + 1)
    return tuple(map(tuple, (basis @ np.linalg.pinv(basis)).tolist()))


def _effective_window(n: Column, window: int, degree: int) -> Column:
    least = degree + 1 if (degree + 1) % 2 == 1 else degree + 2
    return F.greatest(F.least(F.lit(window), F.when(n % 2 == 1, n).otherwise(n - 1)), F.lit(least)).cast("int")


def savgol(df: DataFrame, columns: Sequence[str], window: int = 11, degree: int = 2,
           keys: Sequence[str] = KEYS, chunk_rows: int = o.CHUNK_ROWS, longest: int | None = None) -> DataFrame:
    """Local polynomial smoothing of numbered samples.

    Inner rows are evaluated at the centre of their window; the first and last half
    window use the polynomial of the series' first and last ``window`` samples. Short
    series use the widest odd window that fits; shorter than that they stay unchanged.
    """
    reach, half = window - 1, window // 2
    sizes = [w for w in range(3, window + 1, 2) if w > degree]
    tables = F.create_map(*[x for w in sizes for x in (
        F.lit(w), F.array(*[F.array(*[F.lit(c) for c in row]) for row in smoothing_weights(w, degree)]))])
    pos, n = F.col("pos"), F.col("n")
    chunks, window_rows = o.neighbourhood(df, keys, reach, reach, chunk_rows, longest)
    # inner rows: a fixed sum over neighbours; only samples near the ends of a series are gathered in lists
    centre = smoothing_weights(window, degree)[half]
    near = (pos < window) | (pos >= n - window)
    inner = {f"_in_{c}": functools.reduce(lambda acc, x: acc + x, [F.lit(0.0), *[
        (F.lag(c, half - i) if i < half else F.lead(c, i - half)).over(window_rows) * k for i, k in enumerate(centre)]])
        for c in columns}
    ends = F.collect_list(F.when(near, F.struct(*columns))).over(window_rows.rowsBetween(-reach, reach))
    chunks = o.own_rows(chunks.withColumns(inner | {"_near": ends}))
    w = _effective_window(n, window, degree)
    start = F.greatest(F.least(pos - (w - 1) / 2, n - w), F.lit(0)).cast("int")
    whole = (n >= window) & (pos >= half) & (pos < n - half)
    enough = (n >= F.greatest(w, F.lit(2))) & ~whole
    first = F.greatest(pos - reach, F.lit(0))  # place of the first sample in the list
    first = F.when((n > 2 * window) & (pos >= window), n - window).otherwise(first)
    rows = (chunks.withColumn("_w", w).withColumn("_start", start)
            .withColumn("_weights", F.when(enough, F.element_at(F.element_at(tables, F.col("_w")),
                                                               (pos - F.col("_start")).cast("int") + 1)))
            .withColumn("_near", F.when(enough, F.slice(F.col("_near"), (F.col("_start") - first + 1).cast("int"), F.col("_w")))))

    def weighted(c: str) -> Column:
        products = F.zip_with(F.col("_near"), F.col("_weights"), lambda s, k: s[c] * k)
        edge = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
        return F.coalesce(F.when(whole, F.col(f"_in_{c}")).otherwise(edge), F.col(c))

    smooth = {c: weighted(c) for c in columns}
    return rows.withColumns(smooth).select(*df.columns)


def minmax(df: DataFrame, columns: Sequence[str], mode: str = "guarded", keys: Sequence[str] = KEYS,
           longest: int | None = None) -> DataFrame:
    """Scale each channel of each series to [0, 1].

    ``guarded`` leaves channels with a range up to 1e-8 (and one-row series) unchanged,
    ``zero`` maps a zero range to 0, ``epsilon`` adds 1e-12 to the range.
    """
    stats = {**{f"_lo_{c}": F.min(c) for c in columns}, **{f"_hi_{c}": F.max(c) for c in columns},
             "_rows": F.count(F.lit(1))}
    if o.fits_one_task(longest):
        series = Window.partitionBy(*keys)
        rows = df.withColumns({name: value.over(series) for name, value in stats.items()})
    else:
        limits = df.groupBy(*keys).agg(*[value.alias(name) for name, value in stats.items()])
        rows = df.join(limits, list(keys), "left")
    scaled = {}
    for c in columns:
        shifted, width = F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        if mode == "guarded":
            scaled[c] = F.when((width > 1e-8) & (F.col("_rows") >= 2), shifted / width).otherwise(F.col(c))
        elif mode == "zero":
            scaled[c] = shifted / F.when(width > 0, width).otherwise(1.0)
        elif mode == "epsilon":
            scaled[c] = shifted / (width + 1e-12)
        else:
            raise ValueError(f"unknown scaling mode: {mode}")
    return rows.withColumns(scaled).select(*df.columns)


def median_filter(df: DataFrame, columns: Sequence[str], size: int = 5, keys: Sequence[str] = KEYS,
                  chunk_rows: int = o.CHUNK_ROWS, longest: int | None = None) -> DataFrame:
    """Running median of numbered samples; places outside the series count as zero."""
    half = size // 2
    chunks, window_rows = o.neighbourhood(df, keys, half, half, chunk_rows, longest)
    frame = window_rows.rowsBetween(-half, half)
    chunks = chunks.withColumns({f"_near_{c}": F.collect_list(c).over(frame) for c in columns})
    padding = F.array_repeat(F.lit(0.0), (F.lit(size) - F.size(f"_near_{columns[0]}")).cast("int"))
    out = {c: F.element_at(F.array_sort(F.concat(F.col(f"_near_{c}"), padding)), half + 1) for c in columns}
    return o.own_rows(chunks).withColumns(out).select(*df.columns)


def interpolate_bad(df: DataFrame, columns: Sequence[str], bad: Column, keys: Sequence[str] = KEYS,
                    bucket_rows: int = o.CHUNK_ROWS, longest: int | None = None) -> DataFrame:
    """Replace bad samples by a straight line over row positions between good neighbours.

    Leading and trailing bad samples take the nearest good value. Series with fewer than
    two good samples stay unchanged.
    """
    good = ~bad
    rows = df.withColumn("_ok", good)
    usable = rows.groupBy(*keys).agg(F.count_if("_ok").alias("_good"))
    rows = o.surrounding(rows, keys, ["pos"], o.id_bucket(F.col("pos"), bucket_rows),
                         F.when(F.col("_ok"), F.struct("pos", *columns)), "_p", "_q", longest)
    if o.fits_one_task(longest):
        rows = rows.withColumn("_good", F.count_if("_ok").over(Window.partitionBy(*keys)))
    else:
        rows = rows.join(usable, list(keys), "left")
    p, q = F.col("_p"), F.col("_q")
    share = (F.col("pos") - p["pos"]) / (q["pos"] - p["pos"])
    filled = {}
    for c in columns:
        line = (F.when(p.isNull(), q[c]).when(q.isNull(), p[c])
                .otherwise(p[c] + (q[c] - p[c]) * share))
        filled[c] = F.when(F.col("_ok") | (F.col("_good") < 2), F.col(c)).otherwise(line)
    return rows.withColumns(filled).select(*df.columns)


def direction_encode(df: DataFrame, magnitude: str, coherence: str, direction: str,
                     longest: int | None = None) -> DataFrame:
    """Magnitude, coherence and direction as sine and cosine, scaled per video."""
    wide = df.withColumns({"dir_sin": F.sin(direction), "dir_cos": F.cos(direction)})
    return minmax(wide, [magnitude, coherence, "dir_sin", "dir_cos"], mode="zero", longest=longest)


# -- neighbours -----------------------------------------------------------

def frame_pairs(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS,
                chunk_rows: int = o.CHUNK_ROWS, longest: int | None = None) -> DataFrame:
    """Each numbered sample with its predecessor (``prev_*``, null for the first)."""
    chunks, w = o.neighbourhood(df, keys, 1, 0, chunk_rows, longest)
    return o.own_rows(chunks.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns}))


def difference(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, time: str = "timestamp",
               chunk_rows: int = o.CHUNK_ROWS, longest: int | None = None) -> DataFrame:
    """Per-row change ``d_*`` of numbered samples and time ``step`` to the predecessor.

    Centred differences are halved, ends are one-sided; dividing by a series' time step
    gives its derivative.
    """
    chunks, w = o.neighbourhood(df, keys, 1, 1, chunk_rows, longest)

    def change(c: str) -> Column:
        lag, lead = F.lag(c).over(w), F.lead(c).over(w)
        return (F.when(F.col("n") == 1, F.lit(0.0))
                .when(F.col("pos") == 0, lead - F.col(c))
                .when(F.col("pos") == F.col("n") - 1, F.col(c) - lag)
                .otherwise((lead - lag) / 2.0))
    return o.own_rows(chunks.withColumns(
        {**{f"d_{c}": change(c) for c in columns}, "step": F.col(time) - F.lag(time).over(w)}))


def time_step(df: DataFrame, keys: Sequence[str] = KEYS, longest: int | None = None) -> DataFrame:
    """Exact median of ``step`` per series (1.0 for one-row series) as ``dt``."""
    if o.fits_one_task(longest):
        return df.groupBy(*keys).agg(F.coalesce(F.median("step"), F.lit(1.0)).alias("dt"))
    groups = o.rank_groups(df.filter(F.col("step").isNotNull()), keys, "step")
    medians = groups.groupBy(*keys).agg(o.median_pick("step").alias("_dt"))
    every = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return every.join(medians, list(keys), "left").select(
        *keys, F.coalesce("_dt", F.lit(1.0)).alias("dt"))


def gradient(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS,
             longest: int | None = None) -> DataFrame:
    """Derivative ``v_*`` of numbered samples with the series' median time step."""
    rows = difference(df, columns, keys, longest=longest)
    if o.fits_one_task(longest):
        rows = rows.withColumn("dt", F.coalesce(F.median("step").over(Window.partitionBy(*keys)), F.lit(1.0)))
    else:
        rows = rows.join(time_step(rows, keys), list(keys), "left")
    return rows.withColumns({f"v_{c}": F.try_divide(F.col(f"d_{c}"), F.col("dt")) for c in columns}).drop(
        "step", *[f"d_{c}" for c in columns])


def rank_correlation(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS,
                     longest: int | None = None) -> DataFrame:
    """Spearman correlation of position and value per series and channel (long form).

    Average ranks for ties; series of up to two rows and constant channels give 0. The
    sums run over distinct values, so no row is joined back to its rank.
    """
    long = df.select(*keys, "pos", F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in columns])).alias("_c"))
    long = long.select(*keys, "pos", "_c.channel", "_c.value")
    groups = o.rank_groups(long, [*keys, "channel"], "value", [F.sum("pos").alias("pos_sum")], longest)
    rank = F.col("before") + (F.col("cnt") + 1) / 2.0 - 1.0
    n = F.col("n").cast("double")
    sums = groups.groupBy(*keys, "channel").agg(
        F.max("total").alias("n"), F.sum(rank * F.col("pos_sum")).alias("xy"),
        F.sum(rank * rank * F.col("cnt")).alias("yy"))
    mean = (n - 1) / 2
    xx = n * (n * n - 1) / 12
    cov, var = F.col("xy") - n * mean * mean, F.col("yy") - n * mean * mean
    return sums.select(*keys, "channel", F.when((n > 2) & (var > 0), cov / F.sqrt(xx * var))
                       .otherwise(F.lit(0.0)).alias("monotonicity"))


def cumulative_path(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS,
                    bucket_rows: int = o.CHUNK_ROWS, longest: int | None = None) -> DataFrame:
    """Running sums ``cum_*`` including the current row of numbered samples."""
    names = {f"cum_{c}": F.col(c) for c in columns}
    rows = o.running_total(df, keys, ["pos"], o.id_bucket(F.col("pos"), bucket_rows), names, longest=longest)
    return rows.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(c) for c in columns})


def subsample(df: DataFrame, duration: Column) -> DataFrame:
    """About one numbered sample per second of ``duration``."""
    step = F.greatest(F.lit(1), F.rint(F.col("n") / duration)).cast("long")
    return df.filter(F.col("pos") % step == 0)


def flow_vectors(direction: Column, magnitude: Column, scale: float = 0.35) -> tuple[Column, Column]:
    return F.cos(direction) * magnitude * scale, F.sin(direction) * magnitude * scale


# -- intervals ------------------------------------------------------------

def scene_edges(bounds: DataFrame, extent: DataFrame, keys: Sequence[str] = KEYS,
                longest: int | None = None) -> DataFrame:
    """Consecutive intervals of each video between its start, its boundaries and its end.

    ``bounds`` has ``time``; ``extent`` has one row per video with ``start`` and ``end``.
    """
    edges = bounds.select(*keys, F.col("time").alias("edge"), F.lit(1).alias("_kind"))
    edges = edges.unionByName(extent.select(*keys, F.col("start").alias("edge"), F.lit(0).alias("_kind")))
    edges = edges.unionByName(extent.select(*keys, F.col("end").alias("edge"), F.lit(2).alias("_kind")))
    rows = o.number_rows(edges, keys, ["edge", "_kind"], o.time_bucket(F.col("edge")), longest=longest)
    pairs, w = o.neighbourhood(rows, keys, 0, 1, longest=longest)
    pairs = pairs.withColumn("end_time", F.lead("edge").over(w))
    return (o.own_rows(pairs).filter(F.col("pos") < F.col("n") - 1)
            .select(*keys, F.col("pos").alias("scene_id"), F.col("edge").alias("start_time"), "end_time"))


def frames_to_intervals(frames: DataFrame, intervals: DataFrame, keys: Sequence[str] = KEYS,
                        time: str = "timestamp", start: str = "start_time", end: str = "end_time",
                        closed_last: bool = False) -> DataFrame:
    """Samples with every interval that contains them, ``start <= time < end``.

    ``closed_last`` also takes samples at the end of a series' last interval.
    """
    if not closed_last:
        return o.range_join(frames, intervals, keys, time, start, end)
    last = intervals.groupBy(*keys).agg(F.max(end).alias("_final"))
    final = (F.col(time) == F.col(end)) & (F.col(end) == F.col("_final"))
    inside = (F.col(time) >= F.col(start)) & ((F.col(time) < F.col(end)) | final)
    return o.range_join(frames, intervals.join(last, list(keys)), keys, time, start, end, inside).drop("_final")


def frames_to_spans(frames: DataFrame, spans: DataFrame, keys: Sequence[str] = KEYS, time: str = "timestamp",
                    start: str = "start_time", end: str = "end_time", longest: int | None = None) -> DataFrame:
    """As :func:`frames_to_intervals`, for intervals of a series that do not overlap, such as its scenes.

    Series that fit one task meet their intervals in one sorted pass, so that frames travel once, by series.
    """
    if not o.fits_one_task(longest):
        return frames_to_intervals(frames, spans, keys, time, start, end)
    keyed = functools.reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in keys])
    span = F.struct(*[c for c in spans.columns if c not in keys])
    marks = spans.filter(keyed & (F.col(start) < F.col(end))).select(*keys, F.col(start).alias(time), span.alias("_span"))
    rows = frames.filter(keyed).withColumn("_frame", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    earlier = Window.partitionBy(*keys).orderBy(F.col(time), F.col("_frame").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = o.by_series(rows, *keys).withColumn("_span", F.last("_span", True).over(earlier))
    return rows.filter(F.col("_frame") & (F.col(time) < F.col(f"_span.{end}"))).select(*frames.columns, "_span.*")


def assign_by_boundaries(samples: DataFrame, bounds: DataFrame, keys: Sequence[str] = KEYS,
                         time: str = "timestamp", order: Sequence[str] = ("idx",),
                         longest: int | None = None) -> DataFrame:
    """Segment number of each sample: how many boundaries lie strictly before it."""
    marks = bounds.select(*keys, F.col("time").alias(time), F.lit(1).alias("_mark"))
    rows = samples.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    rows = o.running_total(rows, keys, [time, "_mark", *order], o.time_bucket(F.col(time)),
                           {"segment": F.col("_mark").cast("long")}, longest=longest)
    return rows.filter("_mark = 0").drop("_mark")


def nearest_sample(bounds: DataFrame, samples: DataFrame, keys: Sequence[str] = KEYS,
                   time: str = "timestamp", longest: int | None = None) -> DataFrame:
    """For each boundary ``time`` the sample at the least time distance, the earlier on a tie."""
    points = samples.groupBy(*keys, F.col(time).alias("_t")).agg(F.min("idx").alias("idx"))
    points = points.withColumn("_mark", F.lit(0))
    marks = bounds.select(*keys, F.col("time").alias("_t"), F.lit(None).cast("long").alias("idx"),
                          F.lit(1).alias("_mark"))
    both = points.unionByName(marks)
    sample = F.when(F.col("_mark") == 0, F.struct("_t", "idx"))
    rows = o.surrounding(both, keys, ["_t", "_mark", "idx"], o.time_bucket(F.col("_t")), sample, "_p", "_q", longest)
    p, q, t = F.col("_p"), F.col("_q"), F.col("_t")
    pick = F.when(q.isNull() | (t - p["_t"] <= q["_t"] - t), p).otherwise(q)
    return rows.filter("_mark = 1").select(
        *keys, t.alias("time"), pick["_t"].alias("nearest_time"), pick["idx"].alias("nearest_idx"))


def boundaries_to_times(ends: DataFrame, samples: DataFrame, edge: str = "before",
                        keys: Sequence[str] = KEYS) -> DataFrame:
    """Times of inner boundaries: of the row before the cut, or of the row ``at`` it.

    ``ends`` has exclusive end positions ``end_pos``; the last one, the series length, is
    no inner boundary.
    """
    shift = {"before": 1, "at": 0}[edge]
    points = samples.select(*keys, "pos", "n", F.col("timestamp").alias("time"))
    cuts = ends.select(*keys, "end_pos", (F.col("end_pos") - shift).alias("pos"))
    return (cuts.join(points, [*keys, "pos"]).filter(F.col("end_pos") < F.col("n"))
            .select(*keys, "end_pos", "time"))


def pose_speed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("speed", norm([F.col(c) for c in columns]))
