"""Receive-minus-event latency: by hour, rolled up, and between venues."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from wakelag.functions import columns as c

ABOVE_MS = (10, 50, 100, 250, 500, 1000, 5000)
COUNTS = ["total_rows", "valid_latency_rows", "recv_null_or_invalid_rows", "event_null_or_invalid_rows", "negative_latency_rows", "zero_latency_rows", *[f"latency_gt_{n}ms_rows" for n in ABOVE_MS]]
QUANTILES = {"p01": 0.01, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
#: Key sets of the roll-ups.
LEVELS = {
    "daily": ("exchange", "market_type", "symbol", "date"),
    "instrument": ("exchange", "market_type", "symbol"),
    "exchange": ("exchange", "market_type"),
    "exchange_daily": ("exchange", "market_type", "date"),
    "exchange_asset": ("exchange", "market_type", "base_asset"),
}
#: Comparisons: left venue minus right venue.
VENUES = ((("bybit", "perp"), ("binance", "perp")), (("bybit", "perp"), ("binance", "spot")), (("binance", "perp"), ("binance", "spot")))
COMPARED = ("median_hour_p50_ms", "median_hour_p90_ms", "median_hour_p95_ms", "median_hour_p99_ms")


def require_timestamps(df: DataFrame, *names: str) -> None:
    """Raises unless the columns are timestamps; epochs are not guessed at."""
    kinds = dict(df.dtypes)
    for n in names:
        if kinds.get(n) not in ("timestamp", "timestamp_ntz"):
            raise TypeError(f"{n} must be a timestamp, not {kinds.get(n)}")


def hourly(quotes: DataFrame, keys: Sequence[str], receive: str = "receive_ts", event: str = "event_ts", start: datetime | None = None, end: datetime | None = None, exact: bool = True) -> DataFrame:
    """Counts and statistics of each group. Rows without a receive time stay and count as bad; others need
    a receive time in [start, end)."""
    require_timestamps(quotes, receive, event)
    inside = F.lit(True)
    if start is not None:
        inside &= F.col(receive) >= F.lit(start)
    if end is not None:
        inside &= F.col(receive) < F.lit(end)
    d = quotes.where(F.col(receive).isNull() | inside).withColumn("latency_ms", c.latency_ms(F.col(receive), F.col(event)))
    ms = F.col("latency_ms")
    q = F.percentile(ms, F.array(*map(F.lit, QUANTILES.values()))) if exact else F.percentile_approx(ms, list(QUANTILES.values()), 10_000)
    out = d.groupBy(*keys).agg(
        F.min(receive).alias("first_receive_ts"), F.max(receive).alias("last_receive_ts"), F.min(event).alias("first_event_ts"), F.max(event).alias("last_event_ts"),
        F.count("*").alias("total_rows"), F.count(ms).alias("valid_latency_rows"), F.count_if(F.col(receive).isNull()).alias("recv_null_or_invalid_rows"), F.count_if(F.col(event).isNull()).alias("event_null_or_invalid_rows"),
        F.count_if(ms < 0).alias("negative_latency_rows"), F.count_if(ms == 0).alias("zero_latency_rows"), *[F.count_if(ms > n).alias(f"latency_gt_{n}ms_rows") for n in ABOVE_MS],
        F.min(ms).alias("latency_min_ms"), q.alias("q"), F.avg(ms).alias("latency_mean_ms"), F.stddev_pop(ms).alias("latency_stddev_ms"), F.max(ms).alias("latency_max_ms"),
    )
    out = out.withColumns({f"latency_{n}_ms": F.col("q")[i] for i, n in enumerate(QUANTILES)}).drop("q")
    return out.withColumns({f"{n}_ratio": c.ratio(F.col(f"{n}_rows"), F.col("valid_latency_rows")) for n in ("negative_latency", "latency_gt_100ms")})


def _metrics() -> list[Column]:
    v, mean = F.col("valid_latency_rows"), F.col("latency_mean_ms")
    counted = c.finite(mean) & (v > 0)
    ratio = lambda a, b: c.ratio(F.sum(a), F.sum(b))
    p50 = "latency_p50_ms"
    return [
        F.count("*").alias("n_hours"), *[F.sum(n).alias(n) for n in COUNTS],
        ratio("valid_latency_rows", "total_rows").alias("valid_latency_ratio"), ratio("negative_latency_rows", "valid_latency_rows").alias("negative_latency_ratio"), ratio("latency_gt_100ms_rows", "valid_latency_rows").alias("latency_gt_100ms_ratio"),
        c.ratio(F.sum(F.when(counted, mean * v)), F.sum(F.when(counted, v))).alias("event_weighted_mean_ms"),
        *[F.median(f"latency_{n}_ms").alias(f"median_hour_{n}_ms") for n in QUANTILES],
        F.percentile(p50, F.lit(0.1)).alias("p10_hour_p50_ms"), F.percentile(p50, F.lit(0.9)).alias("p90_hour_p50_ms"), F.min(p50).alias("min_hour_p50_ms"), F.max(p50).alias("max_hour_p50_ms"),
    ]


def rollup(hours: DataFrame, level: str | Sequence[str]) -> DataFrame:
    """Every hour of a group counts alike in the medians, by its rows in the weighted mean."""
    keys = LEVELS[level] if isinstance(level, str) else level
    return hours.groupBy(*keys).agg(*_metrics())


def rollups(hours: DataFrame, levels: Sequence[str] = tuple(LEVELS)) -> DataFrame:
    """All levels in one pass by grouping sets: `level`, the keys (null where not of the level), metrics."""
    keys = list(dict.fromkeys(k for n in levels for k in LEVELS[n]))
    sets = [[F.col(k) for k in LEVELS[n]] for n in levels]
    out = hours.groupingSets(sets, *keys).agg(F.grouping_id(*keys).alias("gid"), *_metrics())
    code = {n: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in LEVELS[n]) for n in levels}
    name = F.coalesce(*[F.when(F.col("gid") == v, n) for n, v in code.items()])
    return out.withColumn("level", name).drop("gid")


def compare(summary: DataFrame, by: Sequence[str] = (), venues=VENUES) -> DataFrame:
    """Left venue minus right venue of COMPARED, for each comparison (and each value of `by` that both
    have). summary holds a row a venue; the comparisons are a table of constants."""
    spark = summary.sparkSession
    rows = [(f"{a[0]}/{a[1]} - {b[0]}/{b[1]}", *a, *b) for a, b in venues]
    table = spark.createDataFrame(rows, "comparison string, l_exchange string, l_market_type string, r_exchange string, r_market_type string")
    side = lambda a: summary.select(F.col("exchange").alias(f"{a}_exchange"), F.col("market_type").alias(f"{a}_market_type"), *by, *[F.col(m).alias(f"{a}_{m}") for m in COMPARED])
    d = F.broadcast(table).join(side("l"), ["l_exchange", "l_market_type"]).join(side("r"), ["r_exchange", "r_market_type", *by])
    return d.select("comparison", *by, *[(F.col(f"l_{m}") - F.col(f"r_{m}")).alias(m) for m in COMPARED])


def select_venues(quotes: DataFrame, venues: Sequence[tuple[str, str]]) -> DataFrame:
    """quotes of the named venues only."""
    return quotes.where(F.struct(F.lower("exchange"), F.lower("market_type")).isin([F.struct(F.lit(a), F.lit(b)) for a, b in venues]))
