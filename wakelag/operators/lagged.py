"""Sums over a grid of lags without a row for each lag: binary searches and prefix sums.

An overlap is found where it ends, by a search in the other side's starts and ends, within a slice of time; so the work grows with the
intervals (and lags), not with the pairs of intervals that are near each other. Squares of one instrument are prefix sums over
time, looked up at the windows' edges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window as W, functions as F

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

NS_PER_MS = 1_000_000
#: Nanoseconds of an hour: rows of an instrument are dealt out by it.
HOUR_NS = 3600 * 10**9
#: Slices of time in which overlaps are searched are as wide as the grid of lags, and at least this.
LEAST_SLICE_NS = 60 * 10**9


def floor_div(a: Column, b: int) -> Column:
    """floor(a / b) of whole numbers, also below zero."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def near_pairs(x: DataFrame, y: DataFrame, lags_ms: Sequence[int], width_ns: int | None = None) -> DataFrame:
    """Pairs of intervals that overlap for a lag of X between the least and the greatest, each once: the ids, x_start, x_end, x_ret,
    y_start, y_end, y_ret. x: both instrument ids, start_ns, end_ns, ret; y: y_instrument_id and these.

    An equality join on slices of time as wide as the grid, in whose conditions the range search is. X's interval, widened by the grid,
    is sent to each slice it touches, and so is Y's; the pair counts in the slice where both first are. The pairs grow with the square of
    the intervals in a span of time: `covariances` does without them.
    """
    low, high = lags_ms[0] * NS_PER_MS, lags_ms[-1] * NS_PER_MS
    width = width_ns or max(high - low, LEAST_SLICE_NS)
    first = F.col("start_ns") + low
    spread = lambda a, b: F.explode(F.sequence(floor_div(a, width), floor_div(b, width))).alias("slice")
    one = lambda d, a, *more: d.where("end_ns > start_ns").select(*more, *[F.col(n).alias(f"{a}_{m}") for n, m in (("start_ns", "start"), ("end_ns", "end"), ("ret", "ret"))])
    xs = one(x, "x", "x_instrument_id", "y_instrument_id", spread(first, F.col("end_ns") + high))
    ys = one(y, "y", "y_instrument_id", spread(F.col("start_ns"), F.col("end_ns")))
    both = xs.join(ys, ["y_instrument_id", "slice"])
    near = (F.col("x_start") + low < F.col("y_end")) & (F.col("y_start") < F.col("x_end") + high)
    home = floor_div(F.greatest(F.col("x_start") + low, F.col("y_start")), width)
    return both.where(near & (F.col("slice") == home)).drop("slice")


def slice_sums(lags_ms: Sequence[int], width_ns: int, start_ns: int, end_ns: int, window_ns: int) -> Callable:
    """For the intervals of one pair in one slice of time: n_overlap and cov by window and lag, of the overlaps that end in the slice.

    An overlap ends where X's moved interval or Y's does; there the other side is open. What is open at a time is what has started
    before it less what has ended, so a binary search in starts and ends and their prefix sums finds it, whatever stands between.
    """
    move_ns = NS_PER_MS

    def sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        def side(t: pa.Table, a: str) -> tuple:
            start, end, ret = (t.column(f"{a}_{n}").to_numpy() for n in ("start", "end", "ret"))
            by = np.argsort(end, kind="stable")
            return start[by], end[by], ret[by]

        def added(at: np.ndarray, ret: np.ndarray) -> tuple:
            by = np.argsort(at, kind="stable")
            return at[by], np.concatenate(([0.0], np.cumsum(ret[by])))

        (x_start, x_end, x_ret), (y_start, y_end, y_ret) = side(left, "x"), side(right, "y")
        first, last = max(key[2].as_py() * width_ns, start_ns + 1), min((key[2].as_py() + 1) * width_ns - 1, end_ns)
        out: list[tuple] = []
        if len(x_end) and len(y_end) and first <= last:
            (_, x_ended), (y_starts, y_started), (_, y_ended) = added(x_end, x_ret), added(y_start, y_ret), added(y_end, y_ret)
            own = slice(np.searchsorted(y_end, first), np.searchsorted(y_end, last, "right"))
            for lag in lags_ms:
                move = lag * move_ns
                # X ends, with or before the Y that is open
                part = slice(np.searchsorted(x_end, first - move), np.searchsorted(x_end, last - move, "right"))
                at = x_end[part] + move
                a, b = np.searchsorted(y_starts, at), np.searchsorted(y_end, at)
                ends, ns, covs = [at], [a - b], [x_ret[part] * (y_started[a] - y_ended[b])]
                # Y ends, before the X that is open, of those that end by end_ns
                most = np.searchsorted(x_end, end_ns - move, "right")
                x_starts, x_started = added(x_start[:most], x_ret[:most])
                at = y_end[own] - move
                a, b = np.searchsorted(x_starts, at), np.searchsorted(x_end[:most], at, "right")
                n, ret = np.concatenate([*ns, a - b]), np.concatenate([*covs, y_ret[own] * (x_started[a] - x_ended[b])])
                win = (np.concatenate([*ends, y_end[own]]) - start_ns - 1) // window_ns
                if not n.any():
                    continue
                low = int(win.min())
                counts, total = np.bincount(win - low, n).astype("int64"), np.bincount(win - low, np.where(n > 0, ret, 0.0))
                out += [(low + int(w), lag, int(counts[w]), float(total[w])) for w in np.flatnonzero(counts)]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        made = [pa.array([k.as_py()] * len(out), k.type) for k in key[:2]] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
        return pa.Table.from_arrays(made, ["x_instrument_id", "y_instrument_id", "win", "lag_ms", "n_overlap", "cov"])

    return sums


def covariances(intervals: DataFrame, pairs: DataFrame, lags_ms: Sequence[int], start_ns: int, end_ns: int, window_ns: int, width_ns: int | None = None) -> DataFrame:
    """n_overlap and cov for each pair, window and lag, where there is an overlap. intervals: instrument_id, start_ns, end_ns, ret.

    Shuffled is a row a pair and slice of time that an interval touches: X's moved by any lag, Y's as it is. A slice, as
    wide as the grid, is searched by `slice_sums`: each end of an interval once a lag, however many intervals the grid spans. Slices give
    a row a window and lag.
    """
    lags_ms = sorted(set(lags_ms))
    ids = pairs.select("x_instrument_id", "y_instrument_id").distinct()
    core = intervals.where("end_ns > start_ns").select("instrument_id", "start_ns", "end_ns", F.coalesce(F.col("ret").cast("double"), F.lit(0.0)).alias("ret"))
    low, high = lags_ms[0] * NS_PER_MS, lags_ms[-1] * NS_PER_MS
    width = width_ns or max(high - low, LEAST_SLICE_NS)
    keys = ["x_instrument_id", "y_instrument_id", "slice"]

    def side(d: DataFrame, a: str, least: int, most: int) -> DataFrame:
        reach = F.sequence(floor_div(F.greatest(F.col("start_ns") + least, F.lit(start_ns)), width), floor_div(F.least(F.col("end_ns") + most, F.lit(end_ns)), width))
        d = d.where((F.col("end_ns") + most > start_ns) & (F.col("end_ns") + least <= end_ns))
        return d.withColumnRenamed("instrument_id", f"{a}_instrument_id").join(ids, f"{a}_instrument_id").select(*keys[:2], *[F.col(n).alias(f"{a}_{m}") for n, m in (("start_ns", "start"), ("end_ns", "end"), ("ret", "ret"))], F.explode(reach).alias("slice"))

    x, y = side(core, "x", low, high), side(core, "y", 0, 0)
    shown = ", ".join(f"{n} {t}" for n, t in ids.dtypes) + ", win long, lag_ms long, n_overlap long, cov double"
    found = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(slice_sums(lags_ms, width, start_ns, end_ns, window_ns), shown)
    return found.groupBy(*keys[:2], "win", "lag_ms").agg(F.sum("n_overlap").alias("n_overlap"), F.sum("cov").alias("cov"))


def shifted_squares(intervals: DataFrame, lags_ms: Sequence[int], start_ns: int, end_ns: int, window_ns: int) -> DataFrame:
    """(instrument_id, win, lag_ms, var, n): sum of squared returns and number of the intervals whose end, moved by the lag,
    falls into the window (left open, right closed); windows and lags without any are left out.

    Sums up to a time are carried from hour to hour by a window over one row an hour; the edges of windows, less the lag, stand among the rows of
    their hour and take what has been summed up to them. An instrument is as many tasks as it has hours.
    """
    n_windows, n_lags = -(-(end_ns - start_ns) // window_ns), len(lags_ms)
    hour = lambda at: floor_div(at, HOUR_NS)
    rows = intervals.select("instrument_id", F.col("end_ns").alias("at"), (F.col("ret") * F.col("ret")).alias("square"))
    edge = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_windows + 1) * n_lags - 1).cast("long")))
    edges = rows.select("instrument_id").distinct().select("instrument_id", edge.alias("e"))
    edges = edges.select("instrument_id", floor_div(F.col("e"), n_lags).alias("edge"), F.element_at(F.array(*[F.lit(x).cast("long") for x in lags_ms]), (F.col("e") % n_lags + 1).cast("int")).alias("lag_ms"))
    edges = edges.withColumn("at", F.least(F.lit(start_ns) + F.col("edge") * F.lit(window_ns), F.lit(end_ns)) - F.col("lag_ms") * F.lit(NS_PER_MS))
    # an edge stands behind the rows of its time, since a window is closed there
    both = rows.select("instrument_id", "at", "square", F.lit(1).alias("n"), F.lit(None).cast("long").alias("edge"), F.lit(None).cast("long").alias("lag_ms"))
    both = both.unionByName(edges.select("instrument_id", "at", F.lit(0.0).alias("square"), F.lit(0).alias("n"), "edge", "lag_ms")).withColumn("hour", hour(F.col("at")))
    inside = W.partitionBy("instrument_id", "hour").orderBy("at", F.col("edge").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = both.withColumns({"s": F.sum("square").over(inside), "c": F.sum("n").over(inside)}).where("edge IS NOT NULL")
    totals = both.groupBy("instrument_id", "hour").agg(F.sum("square").alias("square"), F.sum("n").alias("n"))
    before = W.partitionBy("instrument_id").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("instrument_id", "hour", F.coalesce(F.sum("square").over(before), F.lit(0.0)).alias("s0"), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("c0"))
    found = here.join(carried, ["instrument_id", "hour"]).select("instrument_id", "lag_ms", "edge", (F.col("s") + F.col("s0")).alias("s"), (F.col("c") + F.col("c0")).alias("c"))
    back = W.partitionBy("instrument_id", "lag_ms").orderBy("edge")
    out = found.select("instrument_id", (F.col("edge") - 1).alias("win"), "lag_ms", (F.col("s") - F.lag("s").over(back)).alias("var"), (F.col("c") - F.lag("c").over(back)).alias("n"))
    return out.where("win >= 0 AND n > 0")
