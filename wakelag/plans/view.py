"""Best-bid/offer quotes derived from the table events, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from wakelag.functions.scalars import lag_grid, to_ns
from wakelag.operators import intervals as iv

HOUR_MS, MINUTE_MS = 3_600_000, 60_000
CAP_MS, SPREAD_BPS = 6 * HOUR_MS, 100.0
LAGS_MS = lag_grid(60 * MINUTE_MS, 10 * MINUTE_MS)
START, END = datetime(2024, 1, 2), datetime(2024, 1, 29)
START_NS, END_NS, WINDOW_NS = to_ns(START), to_ns(END), 24 * HOUR_MS * 1_000_000
KEYS = ["symbol"]


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    asset = F.concat(F.lit("U"), (F.col("user_id") % 3).cast("string"))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    ts = F.col("ts").cast("timestamp")
    q = e.select(
        "event_id", F.col("event_id").alias("seq"), ts.alias("ts"), asset.alias("base_asset"), F.concat_ws("_", asset, kind).alias("symbol"),
        F.when(kind == "click", "A").otherwise("B").alias("group"),
        F.when(kind.isin("click", "view", "signup"), "binance").otherwise("bybit").alias("exchange"), F.when(kind == "signup", "spot").otherwise("perp").alias("market_type"),
        F.to_date(ts).alias("file"), F.date_trunc("hour", ts).alias("hour"), F.col("value").alias("bid_price"),
        (F.col("value") * (1 + ((F.col("event_id") % 23) - 2) * F.lit(0.0005))).alias("ask_price"),
        (F.col("user_id") % 11).cast("double").alias("bid_qty"), (1 + F.col("event_id") % 7).cast("double").alias("ask_qty"), k.alias("k"),
    )
    event = F.when(F.col("event_id") % 97 != 0, F.timestamp_micros(F.unix_micros("ts") - (F.col("k") - 5) * 1000))
    jumpy = F.when(F.col("event_id") % 97 != 0, F.date_trunc("hour", F.timestamp_micros(F.unix_micros("ts") - (F.col("k") % 3).cast("long") * 3_600_000_000)))
    return q.withColumns({"event_ts": event, "jumpy_ts": jumpy})


def excluded(q: DataFrame, low_k: int = 100) -> DataFrame:
    """Hours of symbols that stand for abnormal ones: those with a quote without an event time (and a k
    below low_k)."""
    return q.where(F.col("event_ts").isNull() & (F.col("k") < low_k)).select("symbol", "hour").distinct()


def intervals(q: DataFrame, **more: object) -> DataFrame:
    return iv.build(q, keys=KEYS, max_interval_ms=CAP_MS, max_spread_bps=SPREAD_BPS, **more)  # type: ignore[arg-type]


def universe(q: DataFrame) -> DataFrame:
    return q.select("exchange", "market_type", "symbol", "base_asset", "group").distinct().withColumn("instrument_id", F.col("symbol"))


#: The same view in DuckDB SQL.
Q = """q AS (SELECT *, CASE WHEN event_id % 97 <> 0 THEN make_timestamp(epoch_us(ts) - (k - 5) * 1000) END AS event_ts,
  CASE WHEN event_id % 97 <> 0 THEN date_trunc('hour', make_timestamp(epoch_us(ts) - CAST(k % 3 AS BIGINT) * 3600000000)) END AS jumpy_ts
 FROM (SELECT event_id, event_id AS seq, ts, 'U' || (user_id % 3) AS base_asset, 'U' || (user_id % 3) || '_' || event_type AS symbol,
  CASE WHEN event_type = 'click' THEN 'A' ELSE 'B' END AS "group", CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'binance' ELSE 'bybit' END AS exchange,
  CASE WHEN event_type = 'signup' THEN 'spot' ELSE 'perp' END AS market_type, CAST(ts AS DATE) AS file, date_trunc('hour', ts) AS hour, value AS bid_price,
  value * (1 + ((event_id % 23) - 2) * CAST(0.0005 AS DOUBLE)) AS ask_price, CAST(user_id % 11 AS DOUBLE) AS bid_qty, CAST(1 + event_id % 7 AS DOUBLE) AS ask_qty,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""

#: Prices and flags of rows of `frm`.
E = """{name} AS (SELECT *, is_valid AND spread_bps BETWEEN 0 AND 100 AS is_clean FROM (SELECT *, (bid_price + ask_price) / CAST(2.0 AS DOUBLE) AS price,
  CASE WHEN bid_qty > 0 AND ask_qty > 0 THEN (bid_price * ask_qty + ask_price * bid_qty) / (bid_qty + ask_qty) END AS micro,
  CASE WHEN bid_price > 0 AND ask_price > 0 THEN CAST(10000.0 AS DOUBLE) * (ask_price - bid_price) / ((bid_price + ask_price) / CAST(2.0 AS DOUBLE)) END AS spread_bps,
  coalesce({ts} IS NOT NULL AND bid_price > 0 AND ask_price > 0 AND bid_qty > 0 AND ask_qty > 0 AND ask_price > bid_price, false) AS is_valid FROM {frm}))"""


def enriched(name: str = "e", frm: str = "q", ts: str = "ts") -> str:
    return E.format(name=name, frm=frm, ts=ts)


def sql_intervals(name: str = "iv", frm: str = "q", where: str = "true") -> str:
    """Intervals of the rows of `frm`."""
    return f"""{enriched(name + "_e", frm)}, {name}_l AS (SELECT *, lag(ts) OVER w AS prev_ts, lag(price) OVER w AS prev_price FROM {name}_e WHERE is_clean AND {where} WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
{name}_r AS (SELECT symbol, base_asset, "group", prev_ts, ts, epoch_us(prev_ts) * 1000 AS start_ns, epoch_us(ts) * 1000 AS end_ns, (epoch_us(ts) - epoch_us(prev_ts)) / CAST(1000.0 AS DOUBLE) AS interval_ms,
  ln(price) - ln(prev_price) AS ret, spread_bps FROM {name}_l WHERE prev_ts IS NOT NULL),
{name} AS (SELECT * FROM {name}_r WHERE interval_ms > 0 AND interval_ms <= {CAP_MS} AND abs(ret) > 1e-14)"""


PAIRS = """p AS (SELECT x.symbol AS xs, y.symbol AS ys FROM (SELECT DISTINCT symbol, base_asset FROM q WHERE "group" = 'A') x
  JOIN (SELECT DISTINCT symbol, base_asset FROM q WHERE "group" = 'B') y USING (base_asset)), lags AS (SELECT unnest(range(-3600000, 3600001, 600000)) AS lag_ms)"""

#: Overlaps by pair and lag, each in the window of its end; then component rows.
OVERLAPS = f"""xl AS (SELECT p.xs, p.ys, lag_ms, start_ns + lag_ms * 1000000 AS s, end_ns + lag_ms * 1000000 AS e, ret FROM iv JOIN p ON iv.symbol = p.xs, lags WHERE end_ns + lag_ms * 1000000 BETWEEN {START_NS + 1} AND {END_NS}),
ov AS (SELECT xl.*, iv.start_ns AS ys_ns, iv.end_ns AS ye_ns, iv.ret AS y_ret, (least(xl.e, iv.end_ns) - {START_NS} - 1) // {WINDOW_NS} AS win FROM xl JOIN iv ON iv.symbol = xl.ys AND greatest(xl.s, iv.start_ns) < least(xl.e, iv.end_ns) AND iv.end_ns BETWEEN {START_NS + 1} AND {END_NS})"""
COMPONENTS = f"""{OVERLAPS}, cv AS (SELECT xs, ys, lag_ms, win, sum(ret * y_ret) AS cov, count(*) AS n_overlap FROM ov GROUP BY ALL),
vx AS (SELECT symbol, lag_ms, (e - {START_NS} - 1) // {WINDOW_NS} AS win, sum(ret * ret) AS var_x, count(*) AS n_x FROM (SELECT symbol, lag_ms, end_ns + lag_ms * 1000000 AS e, ret FROM iv, lags) WHERE e > {START_NS} AND e <= {END_NS} GROUP BY ALL),
vy AS (SELECT symbol, (end_ns - {START_NS} - 1) // {WINDOW_NS} AS win, sum(ret * ret) AS var_y, count(*) AS n_y FROM iv WHERE end_ns > {START_NS} AND end_ns <= {END_NS} GROUP BY ALL),
comp AS (SELECT p.xs AS x_symbol, p.ys AS y_symbol, w.win, lags.lag_ms, coalesce(cov, 0) AS cov, coalesce(var_x, 0) AS var_x, coalesce(var_y, 0) AS var_y, coalesce(n_overlap, 0) AS n_overlap, coalesce(n_x, 0) AS n_x, coalesce(n_y, 0) AS n_y
 FROM p, lags, (SELECT unnest(range(0, {-(-(END_NS - START_NS) // WINDOW_NS)})) AS win) w LEFT JOIN cv ON cv.xs = p.xs AND cv.ys = p.ys AND cv.lag_ms = lags.lag_ms AND cv.win = w.win
 LEFT JOIN vx ON vx.symbol = p.xs AND vx.lag_ms = lags.lag_ms AND vx.win = w.win LEFT JOIN vy ON vy.symbol = p.ys AND vy.win = w.win)"""


def corr(cov: str, x: str, y: str) -> str:
    return f"CASE WHEN {x} > 0 AND {y} > 0 THEN {cov} / (sqrt({x}) * sqrt({y})) END"
