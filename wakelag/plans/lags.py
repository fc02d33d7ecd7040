"""Queries over grids of lags without a row for each lag, and over numbered pairs. Importing it adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wakelag.operators import lagged, leadlag
from wakelag.plans import catalogue as k, view as v
from wakelag.plans.catalogue import long, query, r6


@query(f"""{k._COMP} SELECT xs AS x_symbol, ys AS y_symbol, CAST(win AS BIGINT) AS win, lag_ms, n_overlap, round(cov, 6) AS cov FROM cv""")
def candidate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each end of an interval searched, once a lag, among the intervals of the other side in its slice of time."""
    d = lagged.covariances(k._iv(spark, sf_dir), k._pairs(spark, sf_dir), v.LAGS_MS, v.START_NS, v.END_NS, v.WINDOW_NS)
    return d.select(F.col("x_instrument_id").alias("x_symbol"), F.col("y_instrument_id").alias("y_symbol"), "win", "lag_ms", "n_overlap", r6("cov", "cov"))


@query(f"{k._COMP} SELECT symbol, CAST(win AS BIGINT) AS win, lag_ms, round(var_x, 6) AS var_x, n_x FROM vx")
def shifted_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared returns by shifted windows, from prefix sums at the windows' edges."""
    d = lagged.shifted_squares(k._iv(spark, sf_dir), v.LAGS_MS, v.START_NS, v.END_NS, v.WINDOW_NS)
    return d.select(F.col("instrument_id").alias("symbol"), "win", "lag_ms", r6("var", "var_x"), long("n", "n_x"))


@query(f"""WITH {v.Q}, {v.PAIRS}, o AS (SELECT symbol, min(seq) AS n FROM q GROUP BY symbol), w AS (SELECT xs, ys, row_number() OVER (ORDER BY x.n, y.n) AS pair_no FROM p JOIN o x ON x.symbol = xs JOIN o y ON y.symbol = ys)
 SELECT xs AS x_symbol, ys AS y_symbol, pair_no FROM w WHERE pair_no > 2 AND pair_no <= 9""")
def pair_shard_of_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the order in which the universe has their instruments (here of their first quotes), not by id."""
    first = v.quotes(spark, sf_dir).groupBy("symbol").agg(F.min("seq").alias("n"))
    d = k._pairs(spark, sf_dir)
    for a in "xy":
        d = d.join(first.select(F.col("symbol").alias(f"{a}_symbol"), F.col("n").alias(f"{a}_place")), f"{a}_symbol")
    return leadlag.pair_shard(d, 2, 7, ("x_place", "y_place")).select("x_symbol", "y_symbol", long("pair_no", "pair_no"))
