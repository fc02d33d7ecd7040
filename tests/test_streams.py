import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakelag.operators import quality, quotes
from wakelag.plans.streams import _dealt, _source
from wakelag.session import folder
from wakelag.sources import tables
from wakelag.streaming import stateful

T = datetime(2024, 1, 1)
NAMES = "symbol string, file string, hour timestamp, ts timestamp, seq long, bid_price double, ask_price double, bid_qty double, ask_qty double, block int"


def rows(seed, n=240):
    """Quotes of two symbols in hourly files of four blocks; times repeat, run back and are missing."""
    rng, out = random.Random(seed), []
    for symbol in "ab":
        for i in range(n):
            hour = T + timedelta(hours=i * 12 // n)
            ts = None if rng.random() < 0.05 else hour + timedelta(milliseconds=rng.choice([i * 100, i * 100, rng.randrange(60_000)]))
            bid = rng.choice([100.0, 101.0, -1.0, float("nan"), 100.5])
            out.append((symbol, str(hour), hour, ts, i, bid, 102.0, 1.0, rng.choice([1.0, 2.0]), i * 4 // n))
    return out


def run(spark, out, at):
    stateful.run_to_end(out, stateful.once_a_batch(f"{at}-out"), f"{at}-state")
    return spark.read.schema(out.schema).parquet(f"{at}-out")


def test_carried_equals_the_batch_forms(spark):
    d, at = spark.createDataFrame(rows(1), NAMES), folder(spark, "stream")
    d.cache()
    out = spark.createDataFrame([("a", T + timedelta(hours=4)), ("b", T + timedelta(hours=7)), ("b", T + timedelta(hours=8))], "symbol string, hour timestamp")
    _dealt(d, F.col("block"), at, range(4))
    live = quality.segments(_source(spark, d, at), ["symbol"], out)
    got = run(spark, stateful.carried(quotes.enrich(live), ["symbol"]), at)
    kept = quality.segments(d, ["symbol"], out)
    order = quotes.physical_order(kept, ["symbol", "segment"], "file", "seq").drop("segment")
    counted = got.groupBy("symbol", "file").agg(F.count_if("repeats").alias("duplicate_ts"), F.count_if("back").alias("backward_ts"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, order.collect()))


def test_gaps_over_a_restart(spark):
    """Gaps of clean rows in order of time, over batches of which one is lost and repeated."""
    d, at = spark.createDataFrame(rows(2), NAMES), folder(spark, "stream")

    d = quotes.keep_last(quotes.enrich(d), ["symbol"]).where("is_clean").select("symbol", "file", "hour", "ts", "seq", "price", "is_clean", "block").withColumn("segment", F.lit(0)).cache()
    _dealt(d, F.col("block"), at, range(2))
    out = stateful.carried(_source(spark, d, at).withColumn("place", F.unix_micros("ts")), ["symbol"], "place")
    seen, sink = [], stateful.once_a_batch(f"{at}-out")

    def noted(df, batch):
        seen.append(batch)
        sink(df, batch)

    stateful.run_to_end(out, noted, f"{at}-state")
    tables.remove(spark, f"{at}-state/commits/1")
    _dealt(d, F.col("block"), at, range(2, 4))
    stateful.run_to_end(out, noted, f"{at}-state")
    assert seen == [0, 1, 1, 2, 3]
    got = stateful.gap_levels(spark.read.schema(out.schema).parquet(f"{at}-out"), ["symbol"])
    names = ["symbol", "file", *quality.GAPS, "gap_max_ms", "zero_ret_count", "ret_count"]
    want = quality.gap_stats(d, ["symbol"], "file")
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))


@pytest.mark.parametrize("seed", [3])
def test_keep_last_equals_the_batch_form(spark, seed):
    """Ties of sequence go to values; nulls rank last and what is no number first, as in the batch form. The latest rows wait for the watermark."""
    rng = random.Random(seed)
    made = [("ab"[n % 2], T + timedelta(minutes=5 * rng.randrange(40)), rng.choice([None, "1", "2", "x"]), rng.choice([1.0, None, float("nan"), 2.0]), float(n), n % 3) for n in range(300)]
    made.append(("a", T + timedelta(days=3), "1", 1.0, 0.0, 3))  # moves the watermark on
    d = spark.createDataFrame(made, "symbol string, ts timestamp, seq string, bid_price double, ask_price double, block int")
    at = folder(spark, "stream")
    _dealt(d, F.col("block"), at, range(4))
    got = run(spark, stateful.keep_last(_source(spark, d, at), ["symbol"], late="1 day"), at)
    want = quotes.keep_last(d, ["symbol"]).where(F.col("ts") < F.lit(T + timedelta(days=1)))
    names = ["symbol", "ts", "bid_price", "ask_price"]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))
