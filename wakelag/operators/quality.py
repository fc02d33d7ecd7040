"""Quality of quotes by instrument and file, and of instruments over their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wakelag.functions import columns as c
from wakelag.operators.quotes import by_hour, enrich, flag_counts, keep_last, physical_order, with_previous
from wakelag.session import lookup

GAPS = {"gap_p50_ms": 0.5, "gap_p90_ms": 0.9, "gap_p95_ms": 0.95, "gap_p99_ms": 0.99, "gap_p999_ms": 0.999}
SPREADS = {"spread_bps_p50": 0.5, "spread_bps_p99": 0.99}


class PolicyError(ValueError):
    """Input that the chosen policy for duplicate times forbids."""


def levels(value: Column, where: Column, named: dict[str, float], exact: bool) -> list[Column]:
    """Quantiles of the values that `where` admits: exact and interpolated, or of Spark's sketch."""
    v = F.when(where, value)
    got = F.percentile(v, F.array(*map(F.lit, named.values()))) if exact else F.percentile_approx(v, list(named.values()), 10_000)
    return [got[n].alias(k) for n, k in enumerate(named)]


def segments(quotes: DataFrame, keys: list[str], excluded: DataFrame | None, hour: str = "hour") -> DataFrame:
    """quotes without rows of excluded hours, with `segment`: how many excluded hours of the instrument lie
    before the row. State never carries across an excluded hour. excluded: keys and hour, a small table."""
    if excluded is None:
        return quotes.withColumn("segment", F.lit(0))
    spots = lookup(excluded.select(*keys, F.date_trunc("hour", F.col(hour)).alias("__spot")).distinct())
    kept = quotes.withColumn("__spot", F.date_trunc("hour", F.col(hour))).join(spots, [*keys, "__spot"], "left_anti").drop("__spot")
    lists = lookup(spots.groupBy(*keys).agg(F.sort_array(F.collect_set("__spot")).alias("__hours")))
    return kept.join(lists, keys, "left").withColumn("segment", F.coalesce(F.size(F.filter("__hours", lambda h: h < F.col(hour))), F.lit(0))).drop("__hours")


def gap_stats(clean: DataFrame, keys: list[str], file: str, exact: bool = True) -> DataFrame:
    """Gaps between clean rows and unchanged prices for each (keys, file). clean: keys, file, segment, ts,
    price; a file's first row is compared with the segment's last clean row before it."""
    m = with_previous(by_hour(clean, keys), [*keys, "segment"], {"ts": "before_ts", "price": "before"})
    m = m.withColumn("gap", c.elapsed_ms(F.col("before_ts"), F.col("ts")))
    moved = (F.col("gap") > 0) & (F.col("before") > 0)
    return m.groupBy(*keys, file).agg(
        *levels(F.col("gap"), F.col("gap") > 0, GAPS, exact), F.max(F.when(F.col("gap") > 0, F.col("gap"))).alias("gap_max_ms"),
        F.count_if(moved & (F.col("price") == F.col("before"))).alias("zero_ret_count"), F.count_if(moved).alias("ret_count"),
    )


def file_quality(quotes: DataFrame, keys: list[str], file: str, row: str, policy: str = "keep-last", price_mode: str = "mid", max_spread_bps: float = 100.0, excluded: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """One row of statistics for each (keys, file).

    policy keep-last: of a time's rows the last counts, and what goes is reported. policy error: all rows
    count; `check_policy` raises if times repeat or run backward.
    """
    if policy not in ("keep-last", "error"):
        raise ValueError(f"unknown policy: {policy}")
    q = segments(quotes, keys, excluded)
    raw = enrich(q, price_mode, max_spread_bps)
    flags = flag_counts(raw, [*keys, "segment", file]).drop("clean_rows")
    order = physical_order(q, [*keys, "segment"], file, row)
    rows = keep_last(raw, [*keys, file]) if policy == "keep-last" else raw
    selected = rows.groupBy(*keys, "segment", file).agg(
        F.count("*").alias("selected_rows"), F.count_if("is_clean").alias("clean_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        *levels(F.col("spread_bps"), (F.col("spread_bps") >= 0) & c.finite(F.col("spread_bps")), SPREADS, exact),
        F.max(F.when(F.col("is_clean"), F.col("ts"))).alias("last_clean_ts"), F.max_by("price", F.when(F.col("is_clean"), F.col("ts"))).alias("last_clean_price"),
    )
    gaps = gap_stats(rows.where("is_clean").select(*keys, "segment", file, "ts", "price"), [*keys], file, exact)
    out = flags.join(order, [*keys, "segment", file]).join(selected, [*keys, "segment", file], "left").join(gaps, [*keys, file], "left")
    zero = ["selected_rows", "clean_rows", "zero_ret_count", "ret_count"]
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in zero})
    if policy == "keep-last":
        carried = F.max("last_ts").over(W.partitionBy(*keys, "segment").orderBy(file).rowsBetween(W.unboundedPreceding, -1))
        edge = F.coalesce((F.col("first_ts") == carried).cast("long"), F.lit(0))
        out = out.withColumn("duplicate_ts", F.greatest(F.col("valid_timestamp_rows") - F.col("selected_rows"), F.lit(0)) + edge)
    return out.withColumn("deduplicated_rows", F.col("duplicate_ts")).drop("segment")


def check_policy(quality: DataFrame) -> None:
    """Raises if a file of policy `error` has times that repeat or run backward."""
    bad = quality.where("backward_ts > 0 OR duplicate_ts > 0").limit(1).collect()
    if bad:
        raise PolicyError(f"times repeat or run backward: {bad[0].asDict()}")


#: What an instrument's files were scanned by: carried from the files to the instrument.
SCANNED = ("parquet_glob", "timestamp_basis", "timestamp_col", "duplicate_ts_policy", "scan_config_hash", "scan_ts_unit", "scan_price_mode", "scan_max_spread_bps", "scan_start", "scan_end")


def instrument_quality(files: DataFrame, keys: list[str], min_cap_ms: float = 50.0, hard_cap_ms: float = 2000.0, min_spread_bps: float = 10.0, hard_spread_bps: float = 100.0) -> DataFrame:
    """One row an instrument, in order of its keys: sums and medians over its files, recommended caps, suggested
    action, and of SCANNED what the files carry (the smallest value; `validate.varying` tells if there are several)."""
    sums = ["total_rows", "selected_rows", "deduplicated_rows", "clean_rows", "duplicate_ts", "backward_ts", "crossed_rows", "locked_rows", "non_positive_bid", "non_positive_ask", "non_positive_bid_qty", "non_positive_ask_qty"]
    agg = files.where("total_rows > 0").groupBy(*keys).agg(
        *[F.min(n).alias(n) for n in SCANNED if n in files.columns], F.count("*").alias("n_files_scanned"), *[F.sum(n).alias(n) for n in sums], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        *[F.median(n).alias(n) for n in (*GAPS, *SPREADS)], F.max("gap_max_ms").alias("gap_max_ms"), c.ratio(F.sum("zero_ret_count"), F.sum("ret_count")).alias("zero_ret_ratio"),
    )
    return agg.withColumns(
        {
            "recommended_max_interval_ms": c.interval_cap(F.col("gap_p90_ms"), F.col("gap_p99_ms"), min_cap_ms, hard_cap_ms),
            "recommended_max_spread_bps": c.spread_cap(F.col("spread_bps_p99"), min_spread_bps, hard_spread_bps),
            "suggested_action": c.action(F.col("clean_rows"), F.col("backward_ts"), F.col("gap_p90_ms"), F.col("gap_p99_ms"), F.col("zero_ret_ratio")),
        }
    ).orderBy(*keys)
