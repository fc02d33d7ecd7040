"""Hayashi-Yoshida covariance components by pair, window and lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wakelag.functions import columns as c
from wakelag.operators.lagged import NS_PER_MS, covariances, floor_div, shifted_squares
from wakelag.operators.overlap import sweep
from wakelag.operators.ranked import numbered


def window_of(end: Column, start_ns: int, window_ns: int) -> Column:
    """Index of the left-open, right-closed window that an end after start_ns falls into."""
    return floor_div(end - F.lit(start_ns) - F.lit(1), window_ns)


def with_lags(df: DataFrame, lags_ms: list[int]) -> DataFrame:
    """A row for each lag, start and end moved by it."""
    out = df.withColumn("lag_ms", F.explode(F.array(*[F.lit(x).cast("long") for x in lags_ms])))
    move = F.col("lag_ms") * NS_PER_MS
    return out.withColumns({"start_ns": F.col("start_ns") + move, "end_ns": F.col("end_ns") + move})


def make_pairs(universe: DataFrame, match: str = "equal", a_group: str = "A", b_group: str = "B", skip_self: bool = False, a_market: str | None = None, b_market: str | None = None, most: int = 10_000) -> DataFrame:
    """X of one group (and market type) against Y of another: of the same base asset, or (`any`) all against all.

    universe: exchange, market_type, symbol, base_asset, group, instrument_id; more than `most` instruments raise,
    and so does one without a base asset where pairs need it.
    """
    guard(universe, most, "instruments")
    if match == "equal":
        blank = universe.where(F.col("group").isin(a_group, b_group) & (F.coalesce(c.normal(F.col("base_asset")), F.lit("")) == "")).limit(1).collect()
        if blank:
            raise ValueError(f"an instrument without a base asset: {blank[0].asDict()}")
    of = lambda g: universe.where((F.col("group") == g) & (F.lit(True) if (m := a_market if g == a_group else b_market) is None else F.lower("market_type") == m.lower()))
    one = lambda g, a: of(g).select(*[F.col(n).alias(f"{a}_{n}") for n in ("instrument_id", "exchange", "market_type", "symbol")], c.normal(F.col("base_asset")).alias(f"{a}_base_asset"))
    x, y = one(a_group, "x"), one(b_group, "y")
    if match == "equal":
        out = x.join(y, F.col("x_base_asset") == F.col("y_base_asset"))
    elif match == "any":
        out = x.crossJoin(y)
    else:
        raise ValueError(f"unknown match: {match}")
    if skip_self:
        out = out.where(~((F.col("x_exchange") == F.col("y_exchange")) & (F.col("x_market_type") == F.col("y_market_type")) & (F.col("x_symbol") == F.col("y_symbol"))))
    return out


def pair_shard(pairs: DataFrame, offset: int, limit: int | None, order: Sequence[str] = ("x_instrument_id", "y_instrument_id")) -> DataFrame:
    """Pairs offset + 1 to offset + limit by `order` (an X's pairs together; give the universe's own order as columns), with pair_no."""
    return numbered(pairs, order, "pair_no", offset, limit)


def guard(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, if it has `most` rows or fewer; no more than one row beyond that is counted."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return df


def spine(pairs: DataFrame, keys: list[str], lags_ms: list[int], start_ns: int, end_ns: int, window_ns: int, excluded: DataFrame | None = None) -> DataFrame:
    """pairs x windows x lags, less the windows that an excluded hour touches.

    excluded: instrument_id, from_ns, to_ns. X counts with the largest lag on both sides, Y without.
    """
    n, most = -(-(end_ns - start_ns) // window_ns), max(map(abs, lags_ms), default=0) * NS_PER_MS
    w = pairs.select(*keys).withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    w = w.withColumn("window_start_ns", F.lit(start_ns) + F.col("win") * window_ns).withColumn("window_end_ns", F.least(F.col("window_start_ns") + window_ns, F.lit(end_ns)))
    if excluded is not None:
        for a, around in (("x", most), ("y", 0)):
            span = excluded.select(F.col("instrument_id").alias(f"{a}_instrument_id"), ((F.col("from_ns") - around - start_ns) / window_ns).alias("lo"), ((F.col("to_ns") + around - start_ns) / window_ns).alias("hi"))
            low = F.greatest(F.floor("lo"), F.lit(0)).cast("long")
            high = F.least(F.ceil("hi") - 1, F.lit(n - 1)).cast("long")
            hit = span.where((F.col("hi") > 0) & (F.col("lo") < n)).select(f"{a}_instrument_id", F.explode(F.sequence(low, F.greatest(low, high))).alias("win"))
            w = w.join(hit.distinct(), [f"{a}_instrument_id", "win"], "left_anti")
    return w.withColumn("lag_ms", F.explode(F.array(*[F.lit(x).cast("long") for x in lags_ms])))


def variances(intervals: DataFrame, start_ns: int, end_ns: int, window_ns: int) -> DataFrame:
    """Sum of squared returns and count by instrument and window."""
    d = intervals.where((F.col("end_ns") > start_ns) & (F.col("end_ns") <= end_ns)).withColumn("win", window_of(F.col("end_ns"), start_ns, window_ns))
    return d.groupBy("instrument_id", "win").agg(F.sum(F.col("ret") * F.col("ret")).alias("var"), F.count("*").alias("n"))


def overlaps(intervals: DataFrame, pairs: DataFrame, lags_ms: list[int], start_ns: int, end_ns: int, window_ns: int, join=sweep) -> DataFrame:
    """Overlapping interval pairs of every pair and lag, within the analysis; an overlap belongs to the
    window of its end. Only what starts before the end, ends by it and reaches past the start takes part."""
    keys = ["x_instrument_id", "y_instrument_id", "lag_ms"]
    ids = pairs.select("x_instrument_id", "y_instrument_id")
    core = intervals.select("instrument_id", "start_ns", "end_ns", "ret")
    inside = lambda d: d.where((F.col("end_ns") > start_ns) & (F.col("end_ns") <= end_ns))
    x = inside(with_lags(core, lags_ms)).withColumnRenamed("instrument_id", "x_instrument_id").join(ids, "x_instrument_id")
    y = inside(core).withColumnRenamed("instrument_id", "y_instrument_id").join(ids, "y_instrument_id")
    y = y.withColumn("lag_ms", F.explode(F.array(*[F.lit(v).cast("long") for v in lags_ms])))
    got = join(x, y, keys, window_ns)
    return got.withColumn("win", window_of(F.least("x_end", "y_end"), start_ns, window_ns))


def components(intervals: DataFrame, pairs: DataFrame, lags_ms: list[int], start_ns: int, end_ns: int, window_ns: int, excluded: DataFrame | None = None, most_lags: int | None = None, most_rows: int | None = None) -> DataFrame:
    """A row for each pair, window and lag, also where nothing overlaps: cov, var_x, var_y, counts, corr.

    More than most_lags lags raise, and so do more than most_rows rows, before anything is computed but the number of pairs.

    intervals: instrument_id, start_ns, end_ns, ret. pairs: x_instrument_id, y_instrument_id and what else
    is to be carried along. A positive lag moves X forward, so a peak there says that X leads.
    """
    keys = ["x_instrument_id", "y_instrument_id"]
    by = [*keys, "win", "lag_ms"]
    if most_lags is not None and len(lags_ms) > most_lags:
        raise ValueError(f"{len(lags_ms)} lags, {most_lags} at most")
    if most_rows is not None:
        guard(pairs, most_rows // max(1, len(lags_ms) * -(-(end_ns - start_ns) // window_ns)), f"pairs for {most_rows} rows")
    cov = covariances(intervals, pairs, lags_ms, start_ns, end_ns, window_ns)
    named = lambda d, a: d.withColumnsRenamed({"instrument_id": f"{a}_instrument_id", "var": f"var_{a}", "n": f"n_{a}"})
    x, y = named(shifted_squares(intervals, lags_ms, start_ns, end_ns, window_ns), "x"), named(variances(intervals, start_ns, end_ns, window_ns), "y")
    out = spine(pairs, pairs.columns, lags_ms, start_ns, end_ns, window_ns, excluded)
    out = out.join(cov, by, "left").join(x, ["x_instrument_id", "win", "lag_ms"], "left").join(y, ["y_instrument_id", "win"], "left")
    zero = {n: F.coalesce(n, F.lit(0.0)) for n in ("cov", "var_x", "var_y")} | {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("n_overlap", "n_x", "n_y")}
    out = out.withColumns(zero).withColumn("corr", c.correlation(F.col("cov"), F.col("var_x"), F.col("var_y")))
    return out.withColumn("corr_is_diagnostic", F.lit(True))


def with_cache_identity(components: DataFrame, manifest: dict[str, object], layout: str = "price_mode") -> DataFrame:
    """components with what their cache was made by, for both sides: the columns that `summary.CACHE` names."""
    held = {
        "cache_layout": F.lit(layout), "max_interval_ms": F.lit(manifest.get("max_interval_ms")).cast("double"), "cache_config_version": F.lit(manifest.get("version")).cast("long"),
        "drop_zero_returns": F.lit(manifest.get("drop_zero_returns")).cast("boolean"), "cache_config_hash": F.lit(manifest.get("config_hash")).cast("string"),
    }
    return components.withColumns({f"{a}_{n}": v for n, v in held.items() for a in "xy"})


#: What an instrument's cache says of itself, carried to either side of a pair.
IDENTITY = ("feed", "cache_layout", "max_interval_ms", "cache_config_version", "drop_zero_returns", "cache_config_hash")


def with_pair_identity(pairs: DataFrame, identities: DataFrame, run_id: str, config_hash: str) -> DataFrame:
    """pairs with run_id, config_hash and x_ and y_ of IDENTITY, from a row an instrument (instrument_id, IDENTITY); an instrument without one
    has nulls."""
    out = pairs.withColumns({"run_id": F.lit(run_id), "config_hash": F.lit(config_hash)})
    for a in "xy":
        of = identities.select(F.col("instrument_id").alias(f"{a}_instrument_id"), *[F.col(n).alias(f"{a}_{n}") for n in IDENTITY])
        out = out.join(of, f"{a}_instrument_id", "left")
    return out


def pair_lag_summary(components: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over the windows of each pair and lag, with the correlation of the sums."""
    d = components.groupBy(*keys, "lag_ms").agg(
        F.sum("cov").alias("sum_cov"), F.sum("var_x").alias("sum_var_x"), F.sum("var_y").alias("sum_var_y"), F.sum("n_overlap").alias("total_overlap"),
        F.sum("n_x").alias("total_n_x"), F.sum("n_y").alias("total_n_y"), F.count("*").alias("n_windows"),
    )
    return d.withColumn("agg_corr", c.correlation(F.col("sum_cov"), F.col("sum_var_x"), F.col("sum_var_y")))
