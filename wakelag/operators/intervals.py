"""Return intervals between an instrument's consecutive valid quotes."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wakelag.functions import columns as c
from wakelag.operators.lagged import HOUR_NS, floor_div
from wakelag.operators.quotes import HOUR, INSTRUMENT, by_hour, keep_last, with_previous
from wakelag.session import lookup

COLUMNS = ("start_ns", "end_ns", "interval_ms", "ret", "spread_bps", "max_interval_ms")


def valid_quote() -> Column:
    """A time, four positive finite numbers, bid below ask."""
    names = ("bid_price", "ask_price", "bid_qty", "ask_qty")
    return c.all_of(F.col("ts").isNotNull(), *[c.finite(F.col(n)) & (F.col(n) > 0) for n in names], F.col("bid_price") < F.col("ask_price"))


def build(quotes: DataFrame, caps: DataFrame | None = None, keys: list[str] = INSTRUMENT, price_mode: str = "mid", policy: str = "keep-last", start: datetime | None = None, end: datetime | None = None, look_back_ms: float = 0.0, min_interval_ms: float = 0.0, max_interval_ms: float = 2000.0, max_spread_bps: float = 100.0, drop_zero: bool = True, excluded: DataFrame | None = None, hour: str = "hour") -> DataFrame:
    """keys, COLUMNS, price_mode and date, an interval a row.

    Duplicates go before the filters, so an unclean last quote hides a clean one of its time. Intervals
    end in [start, end); quotes are read from look_back_ms before start. caps (keys,
    recommended_max_interval_ms, recommended_max_spread_bps) override the two caps. Quotes of excluded
    hours (keys, hour) are left out, and so is any interval that touches one: its ends lie in different
    segments of the instrument.
    """
    from wakelag.operators.quality import segments

    q = quotes
    if start is not None:
        q = q.where(F.col("ts") >= F.lit(start - timedelta(milliseconds=look_back_ms)))
    if end is not None:
        q = q.where(F.col("ts") < F.lit(end))
    q = by_hour(segments(q, keys, excluded, hour).where(F.col("ts").isNotNull()), keys)
    if policy == "keep-last":
        q = keep_last(q, keys)
    bid, ask, bid_qty, ask_qty = (F.col(n) for n in ("bid_price", "ask_price", "bid_qty", "ask_qty"))
    q = q.where(valid_quote()).withColumn("spread_bps", c.spread_bps(bid, ask)).withColumn("price", c.price(price_mode, bid, ask, bid_qty, ask_qty))
    if caps is None:
        q = q.withColumns({"__cap": F.lit(float(max_interval_ms)), "__spread": F.lit(float(max_spread_bps))})
    else:
        q = q.join(lookup(caps).select(*keys, F.col("recommended_max_interval_ms").alias("__cap"), F.col("recommended_max_spread_bps").alias("__spread")), keys)
    q = q.where(F.col("spread_bps").between(F.lit(0.0), F.col("__spread")) & c.finite(F.col("price")) & (F.col("price") > 0))
    q = with_previous(q.select(*keys, "segment", HOUR, "ts", "price", "spread_bps", "__cap"), [*keys, "segment"], {"ts": "__ts", "price": "__price"})
    out = q.where("__ts IS NOT NULL").select(
        *keys, c.epoch_ns(F.col("__ts")).alias("start_ns"), c.epoch_ns(F.col("ts")).alias("end_ns"), c.elapsed_ms(F.col("__ts"), F.col("ts")).alias("interval_ms"),
        c.log_return(F.col("price"), F.col("__price")).alias("ret"), "spread_bps", F.col("__cap").alias("max_interval_ms"), F.lit(price_mode).alias("price_mode"), F.to_date("ts").alias("date"), F.col("__ts").alias("start_ts"), F.col("ts").alias("end_ts"),
    )
    out = out.where((F.col("interval_ms") > min_interval_ms) & (F.col("interval_ms") <= F.col("max_interval_ms")) & c.finite(F.col("ret")))
    if drop_zero:
        out = out.where(F.abs("ret") > 1e-14)
    if start is not None:
        out = out.where(F.col("end_ts") >= F.lit(start))
    return out.drop("start_ts", "end_ts")


def outside_hours(intervals: DataFrame, excluded: DataFrame, keys: list[str], hour: str = "hour") -> DataFrame:
    """Intervals (start_ts, end_ts) that touch no excluded hour of their instrument. An interval names the
    hours it touches, so this is an equality anti join."""
    touched = intervals.withColumn("__hour", F.explode(F.sequence(F.date_trunc("hour", "start_ts"), F.date_trunc("hour", F.expr("end_ts - INTERVAL 1 MICROSECOND")), F.expr("INTERVAL 1 HOUR"))))
    spots = excluded.select(*keys, F.date_trunc("hour", F.col(hour)).alias("__hour")).distinct()
    bad = touched.join(spots, [*keys, "__hour"], "left_semi").select(*keys, "start_ns", "end_ns").distinct()
    return intervals.join(bad, [*keys, "start_ns", "end_ns"], "left_anti")


def disorder(intervals: DataFrame, keys: list[str] = INSTRUMENT) -> DataFrame:
    """Intervals that begin before the one before them ends; empty for a sound cache. A window holds an instrument's hour; what the
    last interval of the hours before left comes from a window over one row an hour."""
    d = intervals.withColumn(HOUR, floor_div(F.col("end_ns"), HOUR_NS))
    lasts = d.groupBy(*keys, HOUR).agg(F.max("end_ns").alias("__last"))
    carried = lasts.select(*keys, HOUR, F.lag("__last").over(W.partitionBy(*keys).orderBy(HOUR)).alias("__carried"))
    inside = F.lag("end_ns").over(W.partitionBy(*keys, HOUR).orderBy("end_ns", "start_ns"))
    d = d.withColumn("before", inside).join(carried, [*keys, HOUR]).withColumn("before", F.coalesce("before", "__carried"))
    return d.where("before > start_ns").select(*intervals.columns, "before")
