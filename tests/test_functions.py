from datetime import datetime

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from wakelag.functions import clock, columns as c, scalars as s


def test_times():
    t = s.parse_time("2026-07-01T09:00:00.000123+02:00")
    assert t == datetime(2026, 7, 1, 7, 0, 0, 123) and s.parse_time("2026-07-01") == datetime(2026, 7, 1)
    assert s.from_ns(s.to_ns(t) + 999) == t
    assert s.floor_hour(t).minute == 0 and s.next_midnight(t) == datetime(2026, 7, 2)
    assert [str(d) for d in s.dates_between(s.to_ns(datetime(2026, 7, 1, 23)), s.to_ns(datetime(2026, 7, 2)))] == ["2026-07-01"]


@given(st.datetimes(datetime(1900, 1, 1), datetime(2200, 1, 1)))
def test_ns_round_trip(t):
    assert s.from_ns(s.to_ns(t)) == t


def test_windows_chunks_and_lags():
    a, b = datetime(2026, 7, 1, 22), datetime(2026, 7, 2, 3)
    assert s.windows(a, b, 2)[-1] == (datetime(2026, 7, 2, 2), b)
    assert s.chunks(a, b, 180)[0] == (a, datetime(2026, 7, 2))
    assert s.lag_grid(20, 10) == [-20, -10, 0, 10, 20]
    with pytest.raises(ValueError):
        s.lag_grid(25, 10)


def test_span_names():
    old = "mid_chunk_start=20260715T000000_chunk_end=20260715T010000.parquet"
    new = "mid_chunk_start=20260715T000000.123000_chunk_end=20260715T010000.456000.parquet"
    assert s.parse_span(old) == (s.to_ns(datetime(2026, 7, 15)), s.to_ns(datetime(2026, 7, 15, 1)))
    assert s.parse_span(new) == (s.to_ns(datetime(2026, 7, 15, 0, 0, 0, 123000)), s.to_ns(datetime(2026, 7, 15, 1, 0, 0, 456000)))
    assert s.parse_span("other.parquet") is None
    for name in (old, new):
        a, b = s.parse_span(name)
        assert s.span_name("mid", s.from_ns(a), s.from_ns(b)) == name


def test_numbers():
    assert s.positive("1.5") == 1.5 and s.positive("-1") is None and s.positive("nan") is None and s.positive(None) is None
    assert s.parse_size("8GB") == 8 << 30 and s.parse_size("512 mb") == 512 << 20 and s.parse_size("1KiB") == 1024
    assert s.parse_size("1.5KB") == 1536 and s.parse_size("0.3B") == 1 and s.parse_size(" 10 tib ") == 10 << 40
    for bad in ("512", "8G", "GB", "-1MB", "1XB", "1BB"):
        with pytest.raises(ValueError):
            s.parse_size(bad)
    assert s.version("3.2.0") == (3, 2, 0) and s.version("x") == (0, 0, 0) and s.version("3.2.0-rc1") == (3, 2, 0) and s.version("3.2") == (0, 0, 0) and s.version(None) == (0, 0, 0)
    assert s.bytes_hash(b"") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert s.quantile([10, 30], 0.1) == 12 and s.quantile([], 0.5) is None
    assert s.config_hash({"a": 1, "b": 2}) == s.config_hash({"b": 2, "a": 1})
    assert s.parse_venues("Bybit/perp, binance/spot") == [("binance", "spot"), ("bybit", "perp")]
    with pytest.raises(ValueError):
        s.parse_venues("binance")


def test_clocks_never_fall_back():
    assert clock.resolve_clock(["recv_time_us", "recv_time"], "receive") == "recv_time_us"
    assert clock.resolve_clock(["x"], "custom", "x") == "x"
    for columns, basis in ((["event_time"], "receive"), (["recv_time_us"], "event"), (["event_time"], "transaction"), (["a"], "custom")):
        with pytest.raises(ValueError):
            clock.resolve_clock(columns, basis)


def test_duplicate_order():
    names = clock.dedup_names(["recv_time_us", "event_time", "update_id", "cross_seq", "bid_price"])
    assert names == ["cross_seq", "update_id", "event_time", "recv_time_us", "bid_price"]


def test_every_column_ranks_duplicates_in_its_place(spark):
    """Of two rows of one time the one with the larger value of the first column that differs stays."""
    from wakelag.operators.quotes import keep_last

    names = clock.dedup_names([*clock.SEQUENCES, *clock.DEDUP, "recv_ts", "event_ts"])
    assert names[-11:] == ["transaction_time", "event_time", "T", "E", "recv_time_us", "recv_time_ns", "recv_time", "bid_price", "ask_price", "bid_qty", "ask_qty"]
    for n, name in enumerate(names):
        rows = [("old", 1, *[5] * n, 1, *[9] * (len(names) - n - 1)), ("new", 1, *[5] * n, 2, *[3] * (len(names) - n - 1))]
        d = spark.createDataFrame(rows, ["mark", "ts", *names])
        assert [r["mark"] for r in keep_last(d.withColumn("k", F.lit(1)), ["k"]).collect()] == ["new"], name


def test_columns(spark):
    d = spark.createDataFrame([(100.0, 100.02, 1.0, 3.0), (5.0, 5.0, 0.0, 1.0), (None, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0)], "b double, a double, bq double, aq double")
    b, a, bq, aq = (F.col(x) for x in ("b", "a", "bq", "aq"))
    r = d.select(c.mid(b, a).alias("mid"), c.microprice(b, a, bq, aq).alias("micro"), c.spread_bps(b, a).alias("s"), c.finite(b).alias("f")).collect()
    assert r[0]["mid"] == pytest.approx(100.01) and r[0]["micro"] == pytest.approx((100 * 3 + 100.02) / 4) and r[0]["s"] == pytest.approx(1.9998, abs=1e-4)
    assert [x["f"] for x in r] == [True, True, False, False, True]
    assert r[1]["micro"] is None and r[4]["s"] is None and r[2]["mid"] is None


def test_units(spark):
    d = spark.createDataFrame([(1_700_000_000_123_456_789, 1_700_000_000_123_456, 1_700_000_000_123, -1)], "ns long, us long, ms long, neg long")
    r = d.select(*[c.micros(c.timestamp(F.col(u), u)).alias(u) for u in ("ns", "us", "ms")], c.micros(c.timestamp(F.col("neg"), "ns")).alias("neg")).first()
    assert (r["ns"], r["us"], r["ms"], r["neg"]) == (1_700_000_000_123_456, 1_700_000_000_123_456, 1_700_000_000_123_000, -1)
    t = spark.createDataFrame([("2026-07-01 00:00:00",), ("no time",)], "t string").select(c.timestamp(F.col("t"), "timestamp", strict=False).alias("t")).collect()
    assert t[1]["t"] is None and t[0]["t"] is not None


def test_caps_and_actions(spark):
    rows = [(None, None, None), (100.0, 5000.0, 2.0), (10.0, 20.0, 50.0), (1e6, 1e6, 1.0)]
    d = spark.createDataFrame(rows, "p90 double, p99 double, s double")
    r = d.select(c.interval_cap(F.col("p90"), F.col("p99")).alias("i"), c.spread_cap(F.col("s")).alias("s")).collect()
    assert [x["i"] for x in r] == [2000.0, 300.0, 50.0, 2000.0] and [x["s"] for x in r] == [30.0, 10.0, 100.0, 10.0]
    acts = [(50, 0, 1.0, 1.0, 0.0), (200, 1, 1.0, 1.0, 0.0), (200, 0, 500.0, 1.0, 0.0), (200, 0, 1.0, 6.0, 0.0), (200, 0, 1.0, 1.0, 0.95), (200, 0, 0.0, 6.0, 0.1)]
    d = spark.createDataFrame(acts, "n long, b long, p90 double, p99 double, z double")
    got = [r[0] for r in d.select(c.action(*[F.col(x) for x in ("n", "b", "p90", "p99", "z")])).collect()]
    assert [x.split(":")[0] for x in got] == ["too_few_clean_rows", "input_order_problem", "slow_update", "bursty_or_stale", "many_zero_returns", "normal"]
