"""Lag profiles and best lags over component rows of any number of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wakelag.functions import columns as c

PAIR = ["x_exchange", "x_market_type", "x_symbol", "x_base_asset", "y_exchange", "y_market_type", "y_symbol", "y_base_asset"]
GROUP = [*PAIR, "price_mode", "config_hash"]
CACHE = [f"{a}_{n}" for n in ("cache_layout", "max_interval_ms", "cache_config_version", "drop_zero_returns", "cache_config_hash") for a in "xy"]
TOTALS = ["sum_cov", "sum_var_x", "sum_var_y", "total_overlap", "total_n_x", "total_n_y", "n_window_rows", "n_nonzero_overlap_windows", "overlap_window_ratio", "n_runs", "n_component_files", "analysis_window_start", "analysis_window_end"]


def lag_summary(components: DataFrame, group: Sequence[str] = GROUP, meta: Sequence[str] = CACHE, file: str = "filename") -> DataFrame:
    """Sums of each group and lag. components: group, meta, lag_ms, window_start, window_end, run_id, file
    and the additive measures."""
    d = components.groupBy(*group, "lag_ms").agg(
        F.sum("cov").alias("sum_cov"), F.sum("var_x").alias("sum_var_x"), F.sum("var_y").alias("sum_var_y"), F.sum("n_overlap").alias("total_overlap"),
        F.sum("n_x").alias("total_n_x"), F.sum("n_y").alias("total_n_y"), F.count("*").alias("n_window_rows"), F.count_distinct("run_id").alias("n_runs"),
        F.count_distinct(file).alias("n_component_files"), F.min("window_start").alias("analysis_window_start"), F.max("window_end").alias("analysis_window_end"),
        F.count_if(F.col("n_overlap") > 0).alias("n_nonzero_overlap_windows"), *[F.min(m).alias(m) for m in meta],
    )
    d = d.withColumn("overlap_window_ratio", c.ratio(F.col("n_nonzero_overlap_windows"), F.col("n_window_rows")))
    d = d.withColumn("agg_corr", c.correlation(F.col("sum_cov"), F.col("sum_var_x"), F.col("sum_var_y")))
    return d.withColumns({"corr_is_diagnostic": F.lit(True), "corr_outside_unit_interval": c.outside_unit(F.col("agg_corr"))})


def eligible(min_overlap: int = 100, min_n_x: int = 0, min_n_y: int = 0, min_window_rows: int = 1, min_abs_lag_ms: int = 0) -> Column:
    return c.all_of(
        F.col("total_overlap") >= min_overlap, F.col("total_n_x") >= min_n_x, F.col("total_n_y") >= min_n_y,
        F.col("n_window_rows") >= min_window_rows, F.abs("lag_ms") >= min_abs_lag_ms, F.col("agg_corr").isNotNull(),
    )


#: Digits to which correlations are compared: sums in another order differ beyond these, and such lags are ties.
DIGITS = 9


def _best(lags: DataFrame, group: Sequence[str], value: Column, where: Column, prefix: str) -> DataFrame:
    """The first lag of each group by value, overlap, nearness to 0, then lag; with the second one and lag
    0 beside it. One window over the group's lags, so no table is joined to itself."""
    part = W.partitionBy(*group)
    order = [value.desc_nulls_last(), F.col("total_overlap").desc(), F.abs("lag_ms").asc(), F.col("lag_ms").asc()]
    d = lags.withColumn("agg_corr", F.round("agg_corr", DIGITS)).withColumn("ok", where)
    at_zero = F.max(F.when(F.col("lag_ms") == 0, F.struct("agg_corr", "total_overlap"))).over(part)
    d = d.withColumn("zero", at_zero).where("ok")
    ranked = part.orderBy(*order)
    second = F.lead(F.struct("lag_ms", "agg_corr", "total_overlap")).over(ranked)
    d = d.withColumn("rank", F.row_number().over(ranked)).withColumn("second", second).where("rank = 1")
    kept = [x for x in TOTALS if x in lags.columns]
    return d.select(
        *group, F.col("lag_ms").alias(f"{prefix}_lag_ms"), F.col("agg_corr").alias(f"{prefix}_agg_corr"), "corr_is_diagnostic", "corr_outside_unit_interval",
        F.col("zero.agg_corr").alias("corr_0_lag"), F.col("zero.total_overlap").alias("overlap_0_lag"), "second", *kept, *[m for m in CACHE if m in lags.columns],
    )


def best_abs(lags: DataFrame, group: Sequence[str] = GROUP, where: Column | None = None) -> DataFrame:
    """The lag of the largest absolute correlation; rows by that, then overlap, the largest first."""
    d = _best(lags, group, F.abs("agg_corr"), eligible() if where is None else where, "best")
    r, z, s = F.col("best_agg_corr"), F.col("corr_0_lag"), F.col("second.agg_corr")
    return d.withColumns(
        {
            "best_is_negative": r < 0, "best_minus_zero_corr": r - z, "best_abs_minus_zero_abs_corr": F.abs(r) - F.abs(z),
            "second_best_lag_ms": F.col("second.lag_ms"), "second_best_agg_corr": s, "second_best_total_overlap": F.col("second.total_overlap"),
            "best_abs_corr_margin": F.abs(r) - F.abs(F.coalesce(s, F.lit(0.0))),
        }
    ).drop("second").orderBy(F.abs("best_agg_corr").desc(), F.col("total_overlap").desc(), *group)


def best_positive(lags: DataFrame, group: Sequence[str] = GROUP, where: Column | None = None) -> DataFrame:
    """The lag of the largest positive correlation; rows by that, then overlap, the largest first."""
    d = _best(lags, group, F.col("agg_corr"), (eligible() if where is None else where) & (F.col("agg_corr") > 0), "best_positive")
    r, s = F.col("best_positive_agg_corr"), F.col("second.agg_corr")
    return d.withColumns(
        {
            "best_positive_minus_zero_corr": r - F.col("corr_0_lag"), "second_best_positive_lag_ms": F.col("second.lag_ms"), "second_best_positive_agg_corr": s,
            "second_best_positive_total_overlap": F.col("second.total_overlap"), "best_positive_corr_margin": r - F.coalesce(s, F.lit(0.0)),
        }
    ).drop("second").orderBy(F.col("best_positive_agg_corr").desc(), F.col("total_overlap").desc(), *group)
