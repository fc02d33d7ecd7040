"""The driver's query catalogue: each query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wakelag.functions import columns as c
from wakelag.functions.scalars import chunks
from wakelag.operators import latency, leadlag, overlap, quality, quotes, summary, validate
from wakelag.plans import view as v
from wakelag.session import folder, written
from wakelag.sources import catalog, tables

FLAGSHIP = "hy_components"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(x: Column | str, name: str) -> Column:
    return F.round(x if isinstance(x, Column) else F.col(x), 6).alias(name)


def long(x: Column | str, name: str) -> Column:
    return (x if isinstance(x, Column) else F.col(x)).cast("long").alias(name)


def r9(x: Column, name: str) -> Column:
    return F.round(x, 9).alias(name)


# ---- quotes


@query(f"WITH {v.Q}, {v.enriched()} SELECT event_id, price AS mid, micro AS microprice, spread_bps, is_clean FROM e")
def quote_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quotes.enrich(v.quotes(spark, sf_dir))
    micro = c.microprice(*[F.col(n) for n in ("bid_price", "ask_price", "bid_qty", "ask_qty")])
    return q.select("event_id", F.col("price").alias("mid"), micro.alias("microprice"), "spread_bps", "is_clean")


@query(f"""WITH {v.Q}, {v.enriched()} SELECT symbol, count(*) AS total_rows, count(ts) AS valid_timestamp_rows, count(*) FILTER (WHERE bid_price > ask_price) AS crossed_rows,
 count(*) FILTER (WHERE bid_price = ask_price AND bid_price > 0) AS locked_rows, count(*) FILTER (WHERE bid_price <= 0) AS non_positive_bid, count(*) FILTER (WHERE ask_price <= 0) AS non_positive_ask,
 count(*) FILTER (WHERE bid_qty <= 0) AS non_positive_bid_qty, count(*) FILTER (WHERE ask_qty <= 0) AS non_positive_ask_qty, count(*) FILTER (WHERE is_clean) AS clean_rows FROM e GROUP BY symbol""")
def quote_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.flag_counts(quotes.enrich(v.quotes(spark, sf_dir)), v.KEYS)


def _hourly_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.quotes(spark, sf_dir).withColumn("ts", F.col("hour"))


@query(f"WITH {v.Q} SELECT symbol, epoch_us(hour) * 1000 AS ts_ns, seq, round(bid_price, 6) AS bid_price FROM q QUALIFY row_number() OVER (PARTITION BY symbol, hour ORDER BY seq DESC) = 1")
def keep_last_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.keep_last(_hourly_clock(spark, sf_dir), v.KEYS).select("symbol", c.epoch_ns(F.col("ts")).alias("ts_ns"), "seq", r6("bid_price", "bid_price"))


@query(f"""WITH {v.Q}, f AS (SELECT symbol, file, max(jumpy_ts) AS m FROM q GROUP BY ALL), g AS (SELECT *, max(m) OVER (PARTITION BY symbol ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM f),
 w AS (SELECT q.symbol, q.file, jumpy_ts AS ts, coalesce(lag(jumpy_ts) OVER (PARTITION BY q.symbol, q.file ORDER BY seq), carried) AS prev FROM q JOIN g ON q.symbol = g.symbol AND q.file = g.file)
 SELECT symbol, CAST(file AS VARCHAR) AS file, count(*) FILTER (WHERE ts = prev) AS duplicate_ts, count(*) FILTER (WHERE ts < prev) AS backward_ts FROM w GROUP BY ALL""")
def physical_order_dups_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = v.quotes(spark, sf_dir).withColumn("ts", F.col("jumpy_ts"))
    return quotes.physical_order(q, v.KEYS, "file", "seq").withColumn("file", F.col("file").cast("string"))


_GAPS = """SELECT symbol, CAST(file AS VARCHAR) AS file, round(quantile_cont(gap, 0.5) FILTER (WHERE gap > 0), 6) AS gap_p50_ms, round(quantile_cont(gap, 0.9) FILTER (WHERE gap > 0), 6) AS gap_p90_ms,
 round(quantile_cont(gap, 0.95) FILTER (WHERE gap > 0), 6) AS gap_p95_ms, round(quantile_cont(gap, 0.99) FILTER (WHERE gap > 0), 6) AS gap_p99_ms, round(quantile_cont(gap, 0.999) FILTER (WHERE gap > 0), 6) AS gap_p999_ms,
 round(max(gap) FILTER (WHERE gap > 0), 6) AS gap_max_ms, count(*) FILTER (WHERE gap > 0 AND pp > 0 AND price = pp) AS zero_ret_count, count(*) FILTER (WHERE gap > 0 AND pp > 0) AS ret_count"""
_LAGGED = "(epoch_us(ts) - epoch_us(lag(ts) OVER w)) / CAST(1000.0 AS DOUBLE) AS gap, lag(price) OVER w AS pp"


def _gaps(spark: SparkSession, sf_dir: str, excluded: bool) -> DataFrame:
    q = v.quotes(spark, sf_dir)
    q = quality.segments(q, v.KEYS, v.excluded(q) if excluded else None)
    clean = quotes.enrich(q).where("is_clean").select("symbol", "file", "segment", "ts", "price")
    d = quality.gap_stats(clean, v.KEYS, "file")
    return d.select("symbol", F.col("file").cast("string").alias("file"), *[r6(n, n) for n in (*quality.GAPS, "gap_max_ms")], "zero_ret_count", "ret_count")


@query(f"WITH {v.Q}, {v.enriched()}, l AS (SELECT symbol, file, price, {_LAGGED} FROM e WHERE is_clean WINDOW w AS (PARTITION BY symbol ORDER BY ts)) {_GAPS} FROM l GROUP BY symbol, file")
def gap_return_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir, False)


_SEG = """x AS (SELECT DISTINCT symbol, hour FROM q WHERE event_ts IS NULL), s AS (SELECT *, (SELECT count(*) FROM x WHERE x.symbol = q.symbol AND x.hour < q.hour) AS segment FROM q WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.symbol = q.symbol AND x.hour = q.hour))"""


@query(f"WITH {v.Q}, {_SEG}, {v.enriched('e', 's')}, l AS (SELECT symbol, file, price, {_LAGGED} FROM e WHERE is_clean WINDOW w AS (PARTITION BY symbol, segment ORDER BY ts)) {_GAPS} FROM l GROUP BY symbol, file")
def carried_state_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir, True)


# ---- quality


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.file_quality(_hourly_clock(spark, sf_dir), v.KEYS, "file", "seq")


_FQ = f"""{v.Q}, {v.enriched("e", "(SELECT * REPLACE (hour AS ts) FROM q)")}, d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY symbol, file, ts ORDER BY seq DESC) = 1),
 raw AS (SELECT symbol, file, count(*) AS total_rows, count(ts) AS valid, count(*) FILTER (WHERE bid_price > ask_price) AS crossed_rows, count(*) FILTER (WHERE bid_price = ask_price AND bid_price > 0) AS locked_rows FROM e GROUP BY ALL),
 sel AS (SELECT symbol, file, count(*) AS selected_rows, count(*) FILTER (WHERE is_clean) AS clean_rows, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(price, ts) FILTER (WHERE is_clean) AS last_clean_price, quantile_cont(spread_bps, 0.5) FILTER (WHERE spread_bps >= 0) AS spread_bps_p50, quantile_cont(spread_bps, 0.99) FILTER (WHERE spread_bps >= 0) AS spread_bps_p99 FROM d GROUP BY ALL),
 l AS (SELECT symbol, file, price, {_LAGGED} FROM d WHERE is_clean WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 gp AS (SELECT symbol, file, quantile_cont(gap, 0.5) FILTER (WHERE gap > 0) AS gap_p50_ms, quantile_cont(gap, 0.9) FILTER (WHERE gap > 0) AS gap_p90_ms, quantile_cont(gap, 0.99) FILTER (WHERE gap > 0) AS gap_p99_ms, max(gap) FILTER (WHERE gap > 0) AS gap_max_ms,
  count(*) FILTER (WHERE gap > 0 AND pp > 0 AND price = pp) AS zero_ret_count, count(*) FILTER (WHERE gap > 0 AND pp > 0) AS ret_count FROM l GROUP BY ALL),
 fq AS (SELECT raw.*, selected_rows, clean_rows, first_ts, last_ts, last_clean_price, spread_bps_p50, spread_bps_p99, gap_p50_ms, gap_p90_ms, gap_p99_ms, gap_max_ms, coalesce(zero_ret_count, 0) AS zero_ret_count, coalesce(ret_count, 0) AS ret_count,
  valid - selected_rows + CASE WHEN first_ts = max(last_ts) OVER (PARTITION BY raw.symbol ORDER BY raw.file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS duplicate_ts FROM raw JOIN sel USING (symbol, file) LEFT JOIN gp USING (symbol, file))"""


@query(f"""WITH {_FQ} SELECT symbol, CAST(file AS VARCHAR) AS file, total_rows, selected_rows, clean_rows, CAST(duplicate_ts AS BIGINT) AS duplicate_ts, crossed_rows, locked_rows, round(spread_bps_p50, 6) AS spread_bps_p50, round(spread_bps_p99, 6) AS spread_bps_p99,
 round(gap_p50_ms, 6) AS gap_p50_ms, round(gap_p90_ms, 6) AS gap_p90_ms, round(gap_p99_ms, 6) AS gap_p99_ms, zero_ret_count, ret_count, round(last_clean_price, 9) AS last_clean_price FROM fq""")
def file_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _files(spark, sf_dir)
    return d.select("symbol", F.col("file").cast("string").alias("file"), "total_rows", "selected_rows", "clean_rows", long("duplicate_ts", "duplicate_ts"), "crossed_rows", "locked_rows", *[r6(n, n) for n in (*quality.SPREADS, "gap_p50_ms", "gap_p90_ms", "gap_p99_ms")], "zero_ret_count", "ret_count", r9(F.col("last_clean_price"), "last_clean_price"))


def _varied(files: DataFrame) -> DataFrame:
    """Files changed by instrument so that every suggested action comes up."""
    name, quick = F.col("symbol"), F.col("symbol").startswith("U1")
    changed = {n: F.when(quick, F.col(n) / 1e6).otherwise(F.col(n)) for n in ("gap_p50_ms", "gap_p90_ms", "gap_max_ms")}
    p99 = F.when(name == "U1_view", F.col("gap_p99_ms") / 1e6 + 5000).when(quick, F.col("gap_p50_ms") / 1e6).otherwise(F.col("gap_p99_ms"))
    return files.withColumns(
        changed | {"gap_p99_ms": p99, "backward_ts": F.when(name == "U0_error", 3).otherwise(0), "clean_rows": F.when(name == "U2_signup", 0).otherwise(F.col("clean_rows") * 1000),
        "zero_ret_count": F.when(name == "U1_purchase", F.col("ret_count")).otherwise(F.col("zero_ret_count"))}
    )


_VARIED = """fqv AS (SELECT * REPLACE (CASE WHEN symbol LIKE 'U1%' THEN gap_p50_ms / 1e6 ELSE gap_p50_ms END AS gap_p50_ms, CASE WHEN symbol LIKE 'U1%' THEN gap_p90_ms / 1e6 ELSE gap_p90_ms END AS gap_p90_ms, CASE WHEN symbol LIKE 'U1%' THEN gap_max_ms / 1e6 ELSE gap_max_ms END AS gap_max_ms,
 CASE WHEN symbol = 'U1_view' THEN gap_p99_ms / 1e6 + 5000 WHEN symbol LIKE 'U1%' THEN gap_p50_ms / 1e6 ELSE gap_p99_ms END AS gap_p99_ms, CASE WHEN symbol = 'U2_signup' THEN 0 ELSE clean_rows * 1000 END AS clean_rows, CASE WHEN symbol = 'U1_purchase' THEN ret_count ELSE zero_ret_count END AS zero_ret_count),
 CASE WHEN symbol = 'U0_error' THEN 3 ELSE 0 END AS backward_ts FROM fq)"""


@query(f"""WITH {_FQ}, {_VARIED}, i AS (SELECT symbol, count(*) AS n_files_scanned, sum(backward_ts) AS backward_ts, sum(total_rows) AS total_rows, sum(clean_rows) AS clean_rows, sum(duplicate_ts) AS duplicate_ts, median(gap_p50_ms) AS gap_p50_ms, median(gap_p90_ms) AS gap_p90_ms, median(gap_p99_ms) AS gap_p99_ms,
 max(gap_max_ms) AS gap_max_ms, CAST(sum(zero_ret_count) AS DOUBLE) / nullif(sum(ret_count), 0) AS zero_ret_ratio, median(spread_bps_p99) AS spread_bps_p99 FROM fqv WHERE total_rows > 0 GROUP BY symbol)
 SELECT symbol, n_files_scanned, 'receive' AS timestamp_basis, 'ts' AS timestamp_col, 'keep-last' AS duplicate_ts_policy, CAST(total_rows AS BIGINT) AS total_rows, CAST(clean_rows AS BIGINT) AS clean_rows, CAST(duplicate_ts AS BIGINT) AS duplicate_ts, round(gap_p50_ms, 6) AS gap_p50_ms, round(gap_p90_ms, 6) AS gap_p90_ms, round(gap_max_ms, 6) AS gap_max_ms, round(zero_ret_ratio, 6) AS zero_ret_ratio,
 round(greatest(CAST(60000 AS DOUBLE), least(CAST({v.CAP_MS} AS DOUBLE), 3.0 * coalesce(gap_p90_ms, CAST({v.CAP_MS} AS DOUBLE)), coalesce(gap_p99_ms, CAST({v.CAP_MS} AS DOUBLE)))), 6) AS recommended_max_interval_ms,
 round(least(CAST(100 AS DOUBLE), greatest(CAST(10 AS DOUBLE), 3.0 * coalesce(spread_bps_p99, CAST(10 AS DOUBLE)))), 6) AS recommended_max_spread_bps,
 CASE WHEN clean_rows < 100 THEN 'too_few_clean_rows' WHEN backward_ts > 0 THEN 'input_order_problem' WHEN gap_p90_ms >= 500 THEN 'slow_update: stale filtering important' WHEN gap_p99_ms > 5.0 * nullif(gap_p90_ms, 0) THEN 'bursty_or_stale: cap important'
  WHEN CAST(zero_ret_ratio AS DOUBLE) >= 0.9 THEN 'many_zero_returns: check symbol/liquidity' ELSE 'normal' END AS suggested_action FROM i""")
def instrument_quality_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = {"timestamp_basis": F.lit("receive"), "timestamp_col": F.lit("ts"), "duplicate_ts_policy": F.lit("keep-last")}
    d = quality.instrument_quality(_varied(_files(spark, sf_dir)).withColumns(scanned), v.KEYS, 60_000.0, float(v.CAP_MS))
    caps = ("gap_p50_ms", "gap_p90_ms", "gap_max_ms", "zero_ret_ratio", "recommended_max_interval_ms", "recommended_max_spread_bps")
    return d.select("symbol", "n_files_scanned", *scanned, long("total_rows", "total_rows"), long("clean_rows", "clean_rows"), long("duplicate_ts", "duplicate_ts"), *[r6(n, n) for n in caps], "suggested_action")


@query(f"""WITH {v.Q}, h AS (SELECT DISTINCT symbol, file, 'event' || CASE WHEN symbol LIKE '%error' AND day(file) = 7 THEN '2' ELSE '' END AS timestamp_col, CASE WHEN symbol = 'U1_view' AND day(file) = 9 THEN NULL ELSE 'keep-last' END AS duplicate_ts_policy FROM q)
 SELECT symbol, count(DISTINCT timestamp_col) AS n_timestamp_col, count(DISTINCT duplicate_ts_policy) AS n_duplicate_ts_policy, count(*) FILTER (WHERE timestamp_col IS NULL) AS null_timestamp_col, count(*) FILTER (WHERE duplicate_ts_policy IS NULL) AS null_duplicate_ts_policy FROM h GROUP BY symbol
 HAVING n_timestamp_col <> 1 OR n_duplicate_ts_policy <> 1 OR null_timestamp_col > 0 OR null_duplicate_ts_policy > 0""")
def config_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = v.quotes(spark, sf_dir).select("symbol", "file").distinct()
    h = h.withColumn("timestamp_col", F.concat(F.lit("event"), F.when(F.col("symbol").endswith("error") & (F.dayofmonth("file") == 7), "2").otherwise("")))
    h = h.withColumn("duplicate_ts_policy", F.when(~((F.col("symbol") == "U1_view") & (F.dayofmonth("file") == 9)), "keep-last"))
    return validate.varying(h, ["symbol"], ["timestamp_col", "duplicate_ts_policy"])


# ---- intervals

_IV = "SELECT symbol, start_ns, end_ns, round(interval_ms, 6) AS interval_ms, round(ret, 6) AS ret, round(spread_bps, 6) AS spread_bps, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM iv"


def _show(d: DataFrame) -> DataFrame:
    return d.select("symbol", "start_ns", "end_ns", r6("interval_ms", "interval_ms"), r6("ret", "ret"), r6("spread_bps", "spread_bps"), F.col("date").cast("string").alias("date"))


@query(f"WITH {v.Q}, {v.sql_intervals()} {_IV}")
def lag_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(v.intervals(v.quotes(spark, sf_dir)))


@query(f"""WITH {v.Q}, x AS (SELECT DISTINCT symbol, hour FROM q WHERE event_ts IS NULL), k AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.symbol = q.symbol AND x.hour = q.hour)), {v.sql_intervals("iv", "k")}
 {_IV} WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.symbol = iv.symbol AND iv.prev_ts < x.hour + INTERVAL 1 HOUR AND iv.ts > x.hour)""")
def excluded_hour_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = v.quotes(spark, sf_dir)
    return _show(v.intervals(q, excluded=v.excluded(q)))


@query("""WITH f AS (SELECT 'U' || (user_id % 3) || '_' || event_type AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS hour FROM events),
 n AS (SELECT symbol, date, hour, count(*) AS file_count FROM f GROUP BY ALL) SELECT symbol, min(CASE WHEN file_count = 1 THEN date || ' ' || hour END) AS first_hour, max(CASE WHEN file_count = 1 THEN date || ' ' || hour END) AS last_hour,
 count(*) FILTER (WHERE file_count = 1) AS n_hours, count(*) FILTER (WHERE file_count <> 1) AS n_excluded FROM n GROUP BY symbol""")
def abnormal_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = v.quotes(spark, sf_dir)
    path = F.concat(F.lit("r/"), "exchange", F.lit("/"), "market_type", F.lit("/bbo/symbol="), "symbol", F.lit("/date="), F.col("file").cast("string"), F.lit("/hour="), F.date_format("ts", "HH"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".parquet"))
    n = catalog.hour_counts(catalog.parse(q.select(path.alias("path"))))
    bad = catalog.abnormal_hours(n).groupBy("symbol").agg(F.count("*").alias("n_excluded"))
    good = catalog.normal_hours(n).select("symbol", "first_hour", "last_hour", "n_hours")
    names = n.select(F.upper("symbol").alias("symbol")).distinct()
    d = names.join(good, "symbol", "left").join(bad, "symbol", "left").fillna(0, ["n_hours", "n_excluded"])
    lower = F.concat(F.split("symbol", "_")[0], F.lit("_"), F.lower(F.split("symbol", "_")[1]))
    return d.select(lower.alias("symbol"), "first_hour", "last_hour", "n_hours", "n_excluded")


# ---- pairs and overlaps


def _pairs(spark: SparkSession, sf_dir: str, match: str = "equal", **more: object) -> DataFrame:
    return leadlag.make_pairs(written(v.universe(v.quotes(spark, sf_dir)), "universe"), match, **more)  # type: ignore[arg-type]


@query(f"WITH {v.Q}, {v.PAIRS} SELECT xs AS x_symbol, ys AS y_symbol FROM p")
def pair_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("x_symbol", "y_symbol")


@query(f"""WITH {v.Q} SELECT x.symbol AS x_symbol, y.symbol AS y_symbol FROM (SELECT DISTINCT symbol FROM q WHERE "group" = 'A') x, (SELECT DISTINCT symbol FROM q WHERE "group" = 'B') y""")
def pair_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "any").select("x_symbol", "y_symbol")


@query(f"WITH {v.Q}, {v.PAIRS} SELECT xs AS x_symbol, ys AS y_symbol, n AS pair_no FROM (SELECT *, row_number() OVER (ORDER BY xs, ys) AS n FROM p) WHERE n > 3 AND n <= 8")
def pair_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leadlag.pair_shard(_pairs(spark, sf_dir), 3, 5).select("x_symbol", "y_symbol", long("pair_no", "pair_no"))


def _iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals as a table: overlaps and variances read it in several branches."""
    return written(v.intervals(v.quotes(spark, sf_dir)).select(F.col("symbol").alias("instrument_id"), "start_ns", "end_ns", "ret"), "intervals")


_OV = f"""WITH {v.Q}, {v.sql_intervals()}, {v.PAIRS}, {v.OVERLAPS} SELECT xs AS x_symbol, ys AS y_symbol, lag_ms, count(*) AS n_overlap, CAST(sum((least(e, ye_ns) - greatest(s, ys_ns)) // 1000) AS BIGINT) AS shared_us, round(sum(ret * y_ret), 6) AS cov FROM ov GROUP BY ALL"""


def _overlap(spark: SparkSession, sf_dir: str, join: Callable) -> DataFrame:
    d = leadlag.overlaps(_iv(spark, sf_dir), _pairs(spark, sf_dir), v.LAGS_MS, v.START_NS, v.END_NS, v.WINDOW_NS, join)
    shared = F.call_function("div", F.least("x_end", "y_end") - F.greatest("x_start", "y_start"), F.lit(1000))
    return d.groupBy(F.col("x_instrument_id").alias("x_symbol"), F.col("y_instrument_id").alias("y_symbol"), "lag_ms").agg(F.count("*").alias("n_overlap"), F.sum(shared).alias("shared_us"), r6(F.sum(F.col("x_ret") * F.col("y_ret")), "cov"))


@query(_OV)
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir, overlap.sweep)


@query(_OV)
def overlap_join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir, lambda x, y, keys, _: overlap.bucketed(x, y, keys, 3600 * 10**9))


# ---- components and summaries


def _components(spark: SparkSession, sf_dir: str, excluded: DataFrame | None = None) -> DataFrame:
    return leadlag.components(_iv(spark, sf_dir), _pairs(spark, sf_dir), v.LAGS_MS, v.START_NS, v.END_NS, v.WINDOW_NS, excluded)


_COMP = f"WITH {v.Q}, {v.sql_intervals()}, {v.PAIRS}, {v.COMPONENTS}"
_SHOWN = f"SELECT x_symbol, y_symbol, CAST(win AS BIGINT) AS win, lag_ms, round(cov, 6) AS cov, round(var_x, 6) AS var_x, round(var_y, 6) AS var_y, n_overlap, n_x, n_y, round({v.corr('cov', 'var_x', 'var_y')}, 6) AS corr FROM comp"


def _shown(d: DataFrame) -> DataFrame:
    return d.select("x_symbol", "y_symbol", "win", "lag_ms", r6("cov", "cov"), r6("var_x", "var_x"), r6("var_y", "var_y"), "n_overlap", "n_x", "n_y", r6("corr", "corr"))


@query(f"{_COMP} {_SHOWN}")
def hy_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_components(spark, sf_dir))


@query(f"""{_COMP}, x AS (SELECT DISTINCT symbol, epoch_us(hour) * 1000 AS f, epoch_us(hour) * 1000 + 3600000000000 AS t FROM q WHERE event_ts IS NULL AND k < 20)
 {_SHOWN} WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.symbol = comp.x_symbol AND f < least({v.START_NS} + (win + 1) * {v.WINDOW_NS}, {v.END_NS}) + 3600000000000 AND t > {v.START_NS} + win * {v.WINDOW_NS} - 3600000000000)
 AND NOT EXISTS (SELECT 1 FROM x WHERE x.symbol = comp.y_symbol AND f < least({v.START_NS} + (win + 1) * {v.WINDOW_NS}, {v.END_NS}) AND t > {v.START_NS} + win * {v.WINDOW_NS})""")
def hy_excluded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = c.epoch_ns(F.col("hour"))
    x = v.excluded(v.quotes(spark, sf_dir), 20).select(F.col("symbol").alias("instrument_id"), at.alias("from_ns"), (at + F.lit(3600 * 10**9)).alias("to_ns"))
    return _shown(_components(spark, sf_dir, x))


_SUMS = "sum(cov) AS sum_cov, sum(var_x) AS sum_var_x, sum(var_y) AS sum_var_y, CAST(sum(n_overlap) AS BIGINT) AS total_overlap, CAST(sum(n_x) AS BIGINT) AS total_n_x, CAST(sum(n_y) AS BIGINT) AS total_n_y"
_AGG = v.corr("sum_cov", "sum_var_x", "sum_var_y")


@query(f"""{_COMP}, s AS (SELECT x_symbol, y_symbol, lag_ms, {_SUMS}, count(*) AS n_windows FROM comp GROUP BY ALL)
 SELECT x_symbol, y_symbol, lag_ms, round(sum_cov, 6) AS sum_cov, round(sum_var_x, 6) AS sum_var_x, round(sum_var_y, 6) AS sum_var_y, total_overlap, total_n_x, total_n_y, n_windows, round({_AGG}, 6) AS agg_corr FROM s""")
def hy_pair_lag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = leadlag.pair_lag_summary(_components(spark, sf_dir), ["x_symbol", "y_symbol"])
    return d.select("x_symbol", "y_symbol", "lag_ms", *[r6(n, n) for n in ("sum_cov", "sum_var_x", "sum_var_y")], "total_overlap", "total_n_x", "total_n_y", "n_windows", r6("agg_corr", "agg_corr"))


_GROUP = ["x_symbol", "y_symbol"]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component rows as two runs in two files would have left them."""
    d = _components(spark, sf_dir)
    half = (F.col("win") % 2).cast("string")
    at = lambda n: F.timestamp_micros(F.call_function("div", F.col(n), F.lit(1000)))
    return d.withColumns({"run_id": F.concat(F.lit("r"), half), "filename": F.concat(F.lit("f"), half), "window_start": at("window_start_ns"), "window_end": at("window_end_ns")})


def _lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.lag_summary(_runs(spark, sf_dir), _GROUP, ())


_LS = f"""{_COMP}, s AS (SELECT x_symbol, y_symbol, lag_ms, {_SUMS}, count(*) AS n_window_rows, count(DISTINCT win % 2) AS n_runs, count(DISTINCT win % 2) AS n_component_files, count(*) FILTER (WHERE n_overlap > 0) AS n_nonzero_overlap_windows,
 {v.START_NS} + min(win) * {v.WINDOW_NS} AS first_ns FROM comp GROUP BY ALL), ls AS (SELECT *, {_AGG} AS agg_corr, n_nonzero_overlap_windows / CAST(n_window_rows AS DOUBLE) AS overlap_window_ratio FROM s)"""


@query(f"""{_LS} SELECT x_symbol, y_symbol, lag_ms, round(sum_cov, 6) AS sum_cov, total_overlap, n_window_rows, n_runs, n_component_files, n_nonzero_overlap_windows, round(overlap_window_ratio, 6) AS overlap_window_ratio, CAST(first_ns AS BIGINT) AS first_ns,
 round(agg_corr, 6) AS agg_corr, true AS corr_is_diagnostic, abs(agg_corr) > 1 AS corr_outside_unit_interval FROM ls""")
def lag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lags(spark, sf_dir)
    return d.select(*_GROUP, "lag_ms", r6("sum_cov", "sum_cov"), "total_overlap", "n_window_rows", "n_runs", "n_component_files", "n_nonzero_overlap_windows", r6("overlap_window_ratio", "overlap_window_ratio"), c.epoch_ns(F.col("analysis_window_start")).alias("first_ns"), r6("agg_corr", "agg_corr"), "corr_is_diagnostic", "corr_outside_unit_interval")


def _best_sql(value: str, more: str, p: str, second: str) -> str:
    return f"""{_LS}, ok AS (SELECT *, row_number() OVER (PARTITION BY x_symbol, y_symbol ORDER BY {value} DESC NULLS LAST, total_overlap DESC, abs(lag_ms), lag_ms) AS rn FROM (SELECT * REPLACE (round(agg_corr, 9) AS agg_corr) FROM ls) WHERE total_overlap >= 100 AND agg_corr IS NOT NULL {more})
 SELECT r.x_symbol, r.y_symbol, r.lag_ms AS {p}_lag_ms, round(r.agg_corr, 6) AS {p}_agg_corr, round(z.agg_corr, 6) AS corr_0_lag, z.total_overlap AS overlap_0_lag, s.lag_ms AS {second}_lag_ms, round(s.agg_corr, 6) AS {second}_agg_corr, s.total_overlap AS {second}_total_overlap,
 round(r.agg_corr - z.agg_corr, 6) AS {p}_minus_zero_corr, r.total_overlap, r.n_window_rows FROM ok r LEFT JOIN ls z ON z.x_symbol = r.x_symbol AND z.y_symbol = r.y_symbol AND z.lag_ms = 0 LEFT JOIN ok s ON s.x_symbol = r.x_symbol AND s.y_symbol = r.y_symbol AND s.rn = 2 WHERE r.rn = 1"""


def _best(d: DataFrame, p: str, second: str) -> DataFrame:
    return d.select(*_GROUP, f"{p}_lag_ms", r6(f"{p}_agg_corr", f"{p}_agg_corr"), r6("corr_0_lag", "corr_0_lag"), "overlap_0_lag", f"{second}_lag_ms", r6(f"{second}_agg_corr", f"{second}_agg_corr"), f"{second}_total_overlap", r6(f"{p}_minus_zero_corr", f"{p}_minus_zero_corr"), "total_overlap", "n_window_rows")


@query(_best_sql("abs(agg_corr)", "", "best", "second_best"))
def best_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(summary.best_abs(_lags(spark, sf_dir), _GROUP), "best", "second_best")


@query(_best_sql("agg_corr", "AND agg_corr > 0", "best_positive", "second_best_positive"))
def best_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(summary.best_positive(_lags(spark, sf_dir), _GROUP), "best_positive", "second_best_positive")


# ---- checks


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component rows with keys, cache identities and a few faults of each kind."""
    d = written(_runs(spark, sf_dir), "runs")  # read twice
    bad = F.col("x_symbol") == "U1_click"
    d = d.withColumn("n_overlap", F.when(bad & (F.col("win") == 3) & (F.col("lag_ms") == 0), -1).otherwise(F.col("n_overlap")))
    twice = d.where(bad & (F.col("win") == 5))
    d = d.unionByName(twice).where(~((F.col("x_symbol") == "U2_click") & (F.col("lag_ms") == 0) & (F.col("win") != 26)))
    d = d.withColumns({"price_mode": F.lit("mid"), "config_hash": F.lit("h"), "y_base_asset": F.when(F.col("y_symbol") == "U0_error", " u9 ").otherwise(F.lower("y_base_asset"))})
    for a in "xy":
        d = d.withColumns({f"{a}_cache_layout": F.lit("mode"), f"{a}_max_interval_ms": F.lit(float(v.CAP_MS)), f"{a}_cache_config_version": F.lit(4).cast("long"), f"{a}_drop_zero_returns": F.lit(True)})
    d = d.withColumn("filename", F.when(F.col("win") == 7, "f9").otherwise(F.col("filename")))
    return written(d.withColumns({"x_cache_config_hash": F.lit("c"), "y_cache_config_hash": F.when((F.col("y_symbol") == "U0_view") & (F.col("win") == 1), "d").otherwise("c")}), "damaged")


_DAMAGED = f"""{_COMP}, d0 AS (SELECT * REPLACE (CASE WHEN x_symbol = 'U1_click' AND win = 3 AND lag_ms = 0 THEN -1 ELSE n_overlap END AS n_overlap) FROM comp),
 dmg AS (SELECT * FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE x_symbol = 'U1_click' AND win = 5) WHERE NOT (x_symbol = 'U2_click' AND lag_ms = 0 AND win <> 26))"""


@query(f"""{_DAMAGED} SELECT 'invalid' AS problem, count(*) AS n FROM dmg WHERE n_overlap < 0 UNION ALL SELECT 'cross_assets', count(*) FROM dmg WHERE y_symbol = 'U0_error'
 UNION ALL SELECT 'duplicate_keys', count(*) FROM (SELECT x_symbol, y_symbol, win, lag_ms FROM dmg GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'split_runs', count(*) FROM (SELECT win % 2 AS run FROM dmg GROUP BY ALL HAVING count(DISTINCT CASE WHEN win = 7 THEN 'f9' ELSE 'f' || (win % 2) END) > 1) UNION ALL SELECT 'pairs', count(*) FROM (SELECT DISTINCT x_symbol, y_symbol FROM dmg)""")
def component_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _damaged(spark, sf_dir)
    found = {"invalid": validate.invalid_components(d), "cross_assets": validate.cross_assets(d), "duplicate_keys": validate.duplicate_keys(d), "split_runs": validate.split_runs(d), "pairs": d.select(*validate.ID).distinct()}
    out = None
    for name, bad in found.items():
        one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{_DAMAGED}, sides AS (SELECT x_symbol AS symbol, 'c' AS h FROM dmg UNION ALL SELECT y_symbol, CASE WHEN y_symbol = 'U0_view' AND win = 1 THEN 'd' ELSE 'c' END FROM dmg)
 SELECT symbol, count(DISTINCT h) AS n_identities FROM sides GROUP BY symbol HAVING n_identities > 1""")
def cache_identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.inconsistent_caches(_damaged(spark, sf_dir)).select("symbol", "n_identities")


@query(f"""{_DAMAGED}, w AS (SELECT x_symbol, y_symbol, win, count(DISTINCT lag_ms) AS n_lags, CAST(max(CASE WHEN lag_ms = 0 THEN 1 ELSE 0 END) AS INTEGER) AS has_zero FROM dmg GROUP BY ALL HAVING n_lags <> 13 OR has_zero <> 1)
 SELECT x_symbol, y_symbol, min(n_lags) AS n_lags, min(has_zero) AS has_zero, count(*) AS n_windows FROM w GROUP BY ALL""")
def lag_grid_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a window whose lags are not complete, by the fewest lags of such a window, and how many windows."""
    d = validate.incomplete_lags(_damaged(spark, sf_dir), len(v.LAGS_MS), [*_GROUP, "win"])
    return d.groupBy(*_GROUP).agg(F.min("n_lags").alias("n_lags"), F.min("has_zero").alias("has_zero"), F.count("*").alias("n_windows"))


@query(f"{_DAMAGED}, w AS (SELECT x_symbol, y_symbol, lag_ms, count(*) AS n FROM dmg GROUP BY ALL) SELECT x_symbol, y_symbol, min(n) AS min_windows, max(n) AS max_windows FROM w GROUP BY ALL HAVING min_windows <> max_windows")
def uneven_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.uneven_windows(_damaged(spark, sf_dir), _GROUP)


_DAY = 86_400 * 10**9


_HOUR = 3_600 * 10**9


@query(f"""WITH {v.Q}, s AS (SELECT DISTINCT symbol, epoch_us(hour) * 1000 AS a, epoch_us(hour) * 1000 + CASE WHEN hour(hour) % 5 = 0 THEN 2 ELSE 1 END * {_HOUR} AS b FROM q),
 s1 AS (SELECT * FROM s WHERE b > {v.START_NS} AND a < {v.END_NS}), x AS (SELECT DISTINCT symbol, epoch_us(hour) * 1000 AS a, epoch_us(hour) * 1000 + {_HOUR} AS b FROM q WHERE event_ts IS NULL),
 o AS (SELECT *, max(b) OVER (PARTITION BY symbol ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s1),
 t AS (SELECT * FROM s1 UNION ALL SELECT * FROM x UNION ALL SELECT DISTINCT symbol, {v.START_NS}, {v.START_NS} FROM s UNION ALL SELECT DISTINCT symbol, {v.END_NS}, {v.END_NS} FROM s),
 g AS (SELECT *, max(b) OVER (PARTITION BY symbol ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM t)
 SELECT symbol, 'gap' AS problem, far AS from_ns, a AS to_ns FROM g WHERE far < a AND a <= {v.END_NS} AND far >= {v.START_NS} UNION ALL SELECT symbol, 'overlap', a, least(far, b) FROM o WHERE far > a""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one hour, every fifth of two: gaps that no excluded hour fills, and overlaps."""
    q, at = v.quotes(spark, sf_dir), c.epoch_ns(F.col("hour"))
    last = F.when(F.hour("hour") % 5 == 0, 2).otherwise(1).cast("long") * F.lit(_HOUR)
    spans = q.select("symbol", at.alias("start_ns"), (at + last).alias("end_ns")).distinct()
    out = v.excluded(q).select("symbol", at.alias("from_ns"), (at + F.lit(_HOUR)).alias("to_ns"))
    return validate.coverage_gaps(spans, ["symbol"], v.START_NS, v.END_NS, out)


# ---- latency

_HK = ["exchange", "market_type", "symbol", "base_asset", "date"]
_HOURLY = f"""{v.Q}, l AS (SELECT *, CAST(file AS VARCHAR) AS date, CASE WHEN event_ts IS NOT NULL THEN (epoch_us(ts) - epoch_us(event_ts)) / CAST(1000.0 AS DOUBLE) END AS ms FROM q),
 h AS (SELECT exchange, market_type, symbol, base_asset, date, count(*) AS total_rows, count(ms) AS valid_latency_rows, count(*) FILTER (WHERE event_ts IS NULL) AS event_null_or_invalid_rows, count(*) FILTER (WHERE ms < 0) AS negative_latency_rows, count(*) FILTER (WHERE ms = 0) AS zero_latency_rows,
  count(*) FILTER (WHERE ms > 10) AS latency_gt_10ms_rows, count(*) FILTER (WHERE ms > 50) AS latency_gt_50ms_rows, count(*) FILTER (WHERE ms > 100) AS latency_gt_100ms_rows, min(ms) AS latency_min_ms, quantile_cont(ms, 0.01) AS p01, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.9) AS p90, quantile_cont(ms, 0.95) AS p95, quantile_cont(ms, 0.99) AS p99,
  quantile_cont(ms, 0.999) AS p999, avg(ms) AS mean, stddev_pop(ms) AS sd, max(ms) AS latency_max_ms FROM l GROUP BY ALL)"""


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = v.quotes(spark, sf_dir).withColumn("date", F.col("file").cast("string"))
    return latency.hourly(q, _HK, "ts", "event_ts")


@query(f"""WITH {_HOURLY} SELECT exchange, market_type, symbol, date, total_rows, valid_latency_rows, event_null_or_invalid_rows, negative_latency_rows, zero_latency_rows, latency_gt_10ms_rows, latency_gt_50ms_rows, round(latency_min_ms, 6) AS latency_min_ms, round(p01, 6) AS latency_p01_ms, round(p50, 6) AS latency_p50_ms,
 round(p90, 6) AS latency_p90_ms, round(p999, 6) AS latency_p999_ms, round(mean, 6) AS latency_mean_ms, round(sd, 6) AS latency_stddev_ms, round(latency_max_ms, 6) AS latency_max_ms, round(negative_latency_rows / nullif(CAST(valid_latency_rows AS DOUBLE), 0), 6) AS negative_latency_ratio FROM h""")
def latency_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _hours(spark, sf_dir)
    shown = [f"latency_{n}_ms" for n in ("min", "p01", "p50", "p90", "p999", "mean", "stddev", "max")]
    return d.select("exchange", "market_type", "symbol", "date", "total_rows", "valid_latency_rows", "event_null_or_invalid_rows", "negative_latency_rows", "zero_latency_rows", "latency_gt_10ms_rows", "latency_gt_50ms_rows", *[r6(n, n) for n in shown], r6("negative_latency_ratio", "negative_latency_ratio"))


_ROLLED = """count(*) AS n_hours, CAST(sum(total_rows) AS BIGINT) AS total_rows, round(sum(valid_latency_rows) / CAST(sum(total_rows) AS DOUBLE), 6) AS valid_latency_ratio, round(sum(negative_latency_rows) / nullif(CAST(sum(valid_latency_rows) AS DOUBLE), 0), 6) AS negative_latency_ratio,
 round(sum(mean * valid_latency_rows) / nullif(CAST(sum(CASE WHEN mean IS NOT NULL THEN valid_latency_rows END) AS DOUBLE), 0), 6) AS event_weighted_mean_ms, round(median(p50), 6) AS median_hour_p50_ms, round(quantile_cont(p50, 0.1), 6) AS p10_hour_p50_ms, round(quantile_cont(p50, 0.9), 6) AS p90_hour_p50_ms,
 round(median(p99), 6) AS median_hour_p99_ms, round(min(p50), 6) AS min_hour_p50_ms, round(max(p50), 6) AS max_hour_p50_ms"""


def _rolled(level: str, keys: tuple[str, ...]) -> str:
    cols = ", ".join(k if k in keys else f"NULL AS {k}" for k in ("exchange", "market_type", "symbol", "date", "base_asset"))
    return f"SELECT '{level}' AS level, {cols}, {_ROLLED} FROM h GROUP BY {', '.join(keys)}"


@query(f"WITH {_HOURLY} " + " UNION ALL ".join(_rolled(n, k) for n, k in latency.LEVELS.items()))
def latency_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = latency.rollups(_hours(spark, sf_dir))
    shown = ("valid_latency_ratio", "negative_latency_ratio", "event_weighted_mean_ms", "median_hour_p50_ms", "p10_hour_p50_ms", "p90_hour_p50_ms", "median_hour_p99_ms", "min_hour_p50_ms", "max_hour_p50_ms")
    return d.select("level", "exchange", "market_type", "symbol", "date", "base_asset", "n_hours", long("total_rows", "total_rows"), *[r6(n, n) for n in shown])


def _venues(by: str) -> str:
    pairs = " UNION ALL ".join(f"SELECT '{a[0]}/{a[1]} - {b[0]}/{b[1]}' AS comparison, '{a[0]}' AS le, '{a[1]}' AS lm, '{b[0]}' AS re, '{b[1]}' AS rm" for a, b in latency.VENUES)
    join = f" AND l.{by} = r.{by}" if by else ""
    return f"""WITH {_HOURLY}, s AS (SELECT exchange, market_type{", " + by if by else ""}, median(p50) AS p50, median(p90) AS p90, median(p95) AS p95, median(p99) AS p99 FROM h GROUP BY ALL), v AS ({pairs})
 SELECT comparison{f", l.{by}" if by else ""}, {", ".join(f"round(l.{p} - r.{p}, 6) AS median_hour_{p}_ms" for p in ("p50", "p90", "p95", "p99"))} FROM v JOIN s l ON l.exchange = le AND l.market_type = lm JOIN s r ON r.exchange = re AND r.market_type = rm{join}"""


@query(_venues(""))
def venue_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = latency.compare(latency.rollup(_hours(spark, sf_dir), "exchange"))
    return d.select("comparison", *[r6(n, n) for n in latency.COMPARED])


@query(_venues("base_asset"))
def venue_asset_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = latency.compare(latency.rollup(_hours(spark, sf_dir), "exchange_asset"), ["base_asset"])
    return d.select("comparison", "base_asset", *[r6(n, n) for n in latency.COMPARED])


# ---- chunks, sinks, trees


@query(f"WITH {v.Q}, {v.sql_intervals()} SELECT symbol, (end_ns // 10800000000000) * 10800000000000 AS chunk_start_ns, count(*) AS n, round(sum(ret), 6) AS ret FROM iv WHERE end_ns >= {v.START_NS} AND end_ns < {v.END_NS} GROUP BY ALL")
def tumbling_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals by chunks of three hours, which never cross midnight; the chunk list is the driver's."""
    from wakelag.functions.scalars import to_ns

    spans = [(to_ns(a), to_ns(b)) for a, b in chunks(v.START, v.END, 180)]
    table = spark.createDataFrame(spans, "chunk_start_ns long, chunk_end_ns long")
    d = v.intervals(v.quotes(spark, sf_dir)).withColumn("chunk_start_ns", F.col("end_ns") - F.pmod(F.col("end_ns"), F.lit(3 * 3600 * 10**9)))
    return d.join(F.broadcast(table), "chunk_start_ns").groupBy("symbol", "chunk_start_ns").agg(F.count("*").alias("n"), r6(F.sum("ret"), "ret"))


@query()
def approx_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of Spark's sketch, whose values are rows of the input; no SQL engine's sketch is the same."""
    clean = quotes.enrich(v.quotes(spark, sf_dir)).where("is_clean").select("symbol", "file", F.lit(0).alias("segment"), "ts", "price")
    return quality.gap_stats(clean, v.KEYS, "file", exact=False)


@query(f"WITH {v.Q}, {v.sql_intervals()} {_IV}")
def cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "cache")
    q = v.quotes(spark, sf_dir)
    d = v.intervals(q).withColumn("exchange", F.lit("x")).withColumn("market_type", F.lit("perp"))
    tables.write_cache(d, at, {"max_interval_ms": v.CAP_MS, "price_mode": "mid"})
    return _show(tables.read_cache(spark, at, 0, v.END_NS + 10 * _DAY, v.CAP_MS))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(CAST(o_totalprice AS DOUBLE), 2) AS o_totalprice FROM orders")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "orders")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice"))
    tables.write_csv(o, at, one_file=False)
    return tables.csv(spark, at, ", ".join(f"{n} {k}" for n, k in o.dtypes), required=("o_orderkey",))


