from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakelag.operators import latency, validate
from wakelag.sources import catalog, tables


def write(spark, root, exchange, market, symbol, hour="09", file="data.parquet", **more):
    import pathlib

    import pyarrow as pa
    import pyarrow.parquet as pq

    at = pathlib.Path(root) / exchange / market / "bbo" / f"symbol={symbol}" / "date=2026-07-01" / f"hour={hour}"
    at.mkdir(parents=True, exist_ok=True)
    t = datetime(2026, 7, 1, int(hour))
    cols = {"recv_time_us": t, "event_time": t, "symbol": symbol, "bid_price": 1.0, "ask_price": 1.1, "bid_qty": 1.0, "ask_qty": 1.0} | more
    pq.write_table(pa.Table.from_pylist([cols]), at / file)


def test_universe_of_the_transaction_clock(spark, tmp_path):
    t = datetime(2026, 7, 1, 9)
    write(spark, tmp_path, "binance", "perp", "SOLUSDT", transaction_time=t)
    write(spark, tmp_path, "binance", "spot", "SOLUSDT")
    write(spark, tmp_path, "bybit", "perp", "SOLUSDT", transaction_time=t)
    u = catalog.universe(spark, str(tmp_path), "transaction")
    assert u["universe"].count() == 2 and u["pairs"].count() == 1
    assert [tuple(r) for r in u["ignored_instruments"].collect()] == [("binance", "spot", "SOLUSDT", "missing_transaction_timestamp")]
    assert {r["group"] for r in u["universe"].collect()} == {"A", "B"}


def test_excluded_hours_and_unknown_instruments(spark, tmp_path):
    write(spark, tmp_path, "binance", "perp", "SOLUSDT", "09")
    write(spark, tmp_path, "binance", "perp", "SOLUSDT", "10")
    write(spark, tmp_path, "binance", "perp", "SOLUSDT", "10", "more.parquet")
    write(spark, tmp_path, "bybit", "perp", "SOLUSDT", "11")
    write(spark, tmp_path, "bybit", "perp", "SOLUSDT", "11", "more.parquet")
    write(spark, tmp_path, "bybit", "perp", "NOPE", "09")
    u = catalog.universe(spark, str(tmp_path))
    r = u["universe"].collect()
    assert len(r) == 1 and (r[0]["first_hour"], r[0]["last_hour"], r[0]["n_hours"]) == ("2026-07-01 09", "2026-07-01 09", 1)
    assert sorted((x["exchange"], x["hour"], x["file_count"]) for x in u["excluded_hours"].collect()) == [("binance", "10", 2), ("bybit", "11", 2)]
    assert u["ignored_instruments"].first()["reason"] == "not_in_target_instruments"
    assert catalog.universe(spark, str(tmp_path), exchanges=["BYBIT"])["universe"].count() == 0


def test_inventory(spark):
    w = catalog.whitelist(spark).withColumn("group", F.when((F.col("exchange") == "binance") & (F.col("market_type") == "perp"), "A").otherwise("B"))
    u = w.withColumns({"instrument_id": F.concat_ws("_", "exchange", "market_type", "symbol")})
    assert u.count() == 35 and u.where("group = 'A'").count() == 12 and catalog.pairs(u).count() == 43


def test_paths(spark):
    rows = [("r/Binance/Perp/bbo/symbol=ethusdt/date=2026-07-01/hour=9/data.parquet",), ("r/a/b/bbo/symbol=S/date=2026-07-01/hour=24/d.parquet",), ("r/other.parquet",)]
    d = catalog.parse(spark.createDataFrame(rows, "path string")).orderBy("exchange").collect()
    assert len(d) == 2 and d[0]["at"] is None and (d[1]["exchange"], d[1]["symbol"], d[1]["at"]) == ("binance", "ETHUSDT", datetime(2026, 7, 1, 9))
    c = catalog.parse(spark.createDataFrame(rows, "path string"))
    assert catalog.in_range(c, datetime(2026, 7, 1, 9, 59), datetime(2026, 7, 1, 10)).count() == 2
    assert catalog.in_range(c, datetime(2026, 7, 1, 10), None, keep_unknown=False).count() == 0
    b = catalog.date_bounds(c).first()
    assert (b["start_date"], b["end_date"]) == (date(2026, 7, 1), date(2026, 7, 2))


def intervals(spark):
    rows = [("binance", "perp", s, "mid", date(2026, 7, d), n * 10, n * 10 + 10, 0.1) for s in "AB" for d in (1, 2) for n in range(3)]
    return spark.createDataFrame(rows, "exchange string, market_type string, symbol string, price_mode string, date date, start_ns long, end_ns long, ret double")


def test_cache_round_trip_and_refusals(spark, tmp_path):
    at, config = str(tmp_path / "cache"), {"max_interval_ms": 2000}
    tables.write_cache(intervals(spark), at, config)
    tables.write_cache(intervals(spark), at, config)  # the same settings: partitions are replaced
    whole = (date(2026, 7, 1), date(2026, 7, 3))
    assert tables.read_cache(spark, at, 0, 30, 1, dates=whole).count() == 12
    assert tables.read_cache(spark, at, 10, 20, 1, dates=(date(2026, 7, 1), date(2026, 7, 1))).count() == 2
    with pytest.raises(validate.IntegrityError):
        tables.write_cache(intervals(spark), at, {"max_interval_ms": 1})
    with pytest.raises(ValueError):
        tables.read_cache(spark, at, 0, 30, 1, dates=whole, most=5)
    ask = spark.createDataFrame([("binance", "perp", "C")], "exchange string, market_type string, symbol string")
    with pytest.raises(tables.MissingCacheError):
        tables.read_cache(spark, at, 0, 30, 1, dates=whole, instruments=ask)
    assert tables.read_cache(spark, at, 0, 30, 1, dates=whole, instruments=ask, missing="empty").count() == 0
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("")
    with pytest.raises(validate.IntegrityError):
        tables.write_cache(intervals(spark), str(tmp_path / "other"), config)


def test_tables(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string")
    done = tables.publish(spark, {"t": d}, str(tmp_path / "out"), {"x": 1})
    assert tables.read_json(spark, str(tmp_path / "out/SUCCESS.json"))["config_hash"] == done["config_hash"] and done["rows"] == {"t": 2}
    back = tables.csv(spark, str(tmp_path / "out/t.csv"), "n long, s string, gone double", required=("n",))
    assert sorted(map(tuple, back.collect())) == [(1, "a", None), (2, None, None)]
    with pytest.raises(ValueError):
        tables.csv(spark, str(tmp_path / "out/t.csv"), "n long", required=("z",))
    with pytest.raises(ValueError):
        tables.csv(spark, str(tmp_path / "out/t.csv"), "n long", most=1)
    with pytest.raises(ValueError):
        tables.parquet(spark, [])
    (tmp_path / "bom.csv").write_text("﻿n,s\n1,\n", encoding="utf-8")
    assert [tuple(r) for r in tables.csv(spark, str(tmp_path / "bom.csv"), "n long, s string").collect()] == [(1, None)]
    f = tables.footers(catalog.files(spark, str(tmp_path / "out/t.parquet")))
    assert {tuple(r["columns"]) for r in f.collect()} == {("n", "s")} and tables.schema_problems(f, ["n", "q"]).count() == f.count()
    assert tables.in_file_order(tables.parquet(spark, str(tmp_path / "out/t.parquet"))).where("file_path like '%parquet'").count() == 2
    tables.check_resume(spark, str(tmp_path / "run.json"), {"a": 1})
    with pytest.raises(validate.IntegrityError):
        tables.check_resume(spark, str(tmp_path / "run.json"), {"a": 2})


def test_excluded_hours_are_loaded(spark, tmp_path):
    head, at = "exchange,market_type,feed,symbol,date,hour\n", tmp_path / "excluded_hours.csv"
    assert tables.excluded_hours(spark, str(tmp_path / "universe.csv")) is None
    with pytest.raises(FileNotFoundError):
        tables.excluded_hours(spark, str(tmp_path / "universe.csv"), str(at))
    at.write_text(head + "binance,perp,bbo,S,2026-07-01,9\nbinance,perp,bbo,S,2026-07-01,09\n")
    assert [r["hour"] for r in tables.excluded_hours(spark, str(tmp_path / "universe.csv")).collect()] == [datetime(2026, 7, 1, 9)]
    for bad in ("b,p,f,S,2026-07-01,24", "b,p,f,S,nodate,1", "b,p,f,S,2026-07-01,"):
        (tmp_path / "bad.csv").write_text(head + bad + "\n")
        with pytest.raises(ValueError):
            tables.excluded_hours(spark, "x/universe.csv", str(tmp_path / "bad.csv"))


def test_components_and_json(spark, tmp_path):
    with pytest.raises(Exception):
        tables.components(spark, str(tmp_path / "none"))
    for n in range(3):
        spark.range(2).coalesce(1).write.parquet(str(tmp_path / "c" / str(n)))
    assert tables.components(spark, str(tmp_path / "c")).count() == 6
    with pytest.raises(validate.IntegrityError):
        tables.components(spark, str(tmp_path / "c"), most=2)
    at = str(tmp_path / "x.json")
    for n in (1, 2):
        tables.write_json(spark, {"n": n}, at)
        assert tables.read_json(spark, at) == {"n": n} and not (tmp_path / "x.json.partial").exists()
    (tmp_path / "f").write_bytes(b"abc")
    assert tables.hash_of_file(spark, str(tmp_path / "f")).startswith("ba7816bf")
    assert catalog.task_config("r", "o")["instrument_filter"] == {"target_count": 35}


def test_a_correlation_must_follow_from_its_parts(spark):
    t = datetime(2026, 7, 1)
    names = "run_id string, config_hash string, window_start timestamp, window_end timestamp, lag_ms long, cov double, var_x double, var_y double, n_overlap long, n_x long, n_y long, corr double, corr_is_diagnostic boolean"
    rows = [("r", "h", t, t + timedelta(hours=1), 0, 1.0, 4.0, 1.0, 1, 1, 1, corr, True) for corr in (0.5, 0.6, None)]
    bad = validate.invalid_components(spark.createDataFrame(rows, names)).collect()
    assert [r["corr"] for r in bad] == [0.6, None]


def test_cached_returns_are_finite_and_end_in_time(spark, tmp_path):
    at = str(tmp_path / "cache")
    d = intervals(spark).withColumn("ret", F.when(F.col("start_ns") == 0, float("nan")).when(F.col("start_ns") == 10, float("inf")).otherwise(F.col("ret")))
    tables.write_cache(d, at, {"max_interval_ms": 2000})
    whole = (date(2026, 7, 1), date(2026, 7, 3))
    assert tables.read_cache(spark, at, 0, 30, 1, dates=whole).count() == 4
    assert tables.read_cache(spark, at, 0, 30, 1, dates=whole, max_end_ns=29).count() == 0


def test_latency_hour(spark):
    t = datetime(2026, 7, 1, 9)
    ms = lambda n: t + timedelta(milliseconds=n)
    rows = [(ms(10), ms(0)), (ms(1020), ms(1000)), (ms(1995), ms(2000)), (ms(3000), None), (None, ms(1))]
    d = spark.createDataFrame([("i", *r) for r in rows], "i string, receive_ts timestamp, event_ts timestamp")
    r = latency.hourly(d.where("receive_ts IS NOT NULL"), ["i"], start=t, end=t + timedelta(hours=1)).first()
    assert (r["total_rows"], r["valid_latency_rows"], r["event_null_or_invalid_rows"], r["negative_latency_rows"], r["latency_min_ms"], r["latency_p50_ms"], r["latency_max_ms"]) == (4, 3, 1, 1, -5, 10, 20)
    r = latency.hourly(d, ["i"], start=t + timedelta(seconds=1)).first()
    assert (r["total_rows"], r["recv_null_or_invalid_rows"]) == (4, 1)  # a row without a receive time stays
    with pytest.raises(TypeError):
        latency.hourly(d.withColumn("event_ts", F.lit(1)), ["i"])


def test_latency_summary(spark):
    names = [*latency.COUNTS, "latency_mean_ms", *[f"latency_{q}_ms" for q in latency.QUANTILES]]
    row = lambda n, m, neg, gt: {**{k: 0 for k in latency.COUNTS}, "total_rows": n, "valid_latency_rows": n, "negative_latency_rows": neg, "latency_gt_100ms_rows": gt, "latency_mean_ms": float(m), **{f"latency_{q}_ms": float(m) for q in latency.QUANTILES}}
    d = spark.createDataFrame([(("e", "m") + tuple(row(*x)[k] for k in names)) for x in ((100, 10, 0, 0), (300, 30, 30, 60))], ["exchange", "market_type", *names])
    r = latency.rollup(d, "exchange").first()
    assert (r["n_hours"], r["total_rows"], r["event_weighted_mean_ms"], r["median_hour_p50_ms"]) == (2, 400, 25, 20)
    assert r["negative_latency_ratio"] == pytest.approx(0.075) and r["latency_gt_100ms_ratio"] == pytest.approx(0.15) and r["p10_hour_p50_ms"] == pytest.approx(12)


def test_venues(spark):
    t = datetime(2026, 7, 1, 9)
    rows = [(e, m, "ETH", t + timedelta(milliseconds=n), t) for e, m, n in (("binance", "perp", 10), ("binance", "spot", 30), ("bybit", "perp", 80))]
    q = spark.createDataFrame(rows, "exchange string, market_type string, base_asset string, receive_ts timestamp, event_ts timestamp")
    h = latency.hourly(q, ["exchange", "market_type", "base_asset"])
    got = {r["comparison"]: r["median_hour_p50_ms"] for r in latency.compare(latency.rollup(h, "exchange")).collect()}
    assert got == {"bybit/perp - binance/perp": 70, "bybit/perp - binance/spot": 50, "binance/perp - binance/spot": -20}
    assert latency.select_venues(q, [("bybit", "perp")]).count() == 1


def test_coverage(spark):
    d = lambda *rows: spark.createDataFrame([("i", a, b) for a, b in rows], "k string, start_ns long, end_ns long")
    probe = lambda x, e=None: sorted((r["problem"], r["from_ns"], r["to_ns"]) for r in validate.coverage_gaps(x, ["k"], 0, 100, e).collect())
    assert probe(d((0, 50), (50, 100))) == []
    assert probe(d((0, 40), (50, 100))) == [("gap", 40, 50)]
    assert probe(d((10, 60), (50, 90))) == [("gap", 0, 10), ("gap", 90, 100), ("overlap", 50, 60)]
    assert probe(d((0, 50), (0, 50), (50, 100))) == [("overlap", 0, 50)]
    out = spark.createDataFrame([("i", 35, 55)], "k string, from_ns long, to_ns long")
    assert probe(d((0, 40), (50, 100)), out) == []


def test_checks(spark):
    d = spark.createDataFrame([("f1", "r1", "h"), ("f1", "r1", "h"), ("f2", "r1", "h")], "filename string, run_id string, config_hash string")
    m = spark.createDataFrame([("f1", 2, "r1", "h"), ("f2", 2, "r1", "h"), ("f3", 0, "r", "h")], "filename string, rows long, run_id string, config_hash string")
    assert sorted(r["filename"] for r in validate.marker_mismatch(d, m).collect()) == ["f2", "f3"]
    assert validate.split_runs(d).count() == 1 and validate.one_config(d, "config_hash").count() == 0 and validate.one_config(d, "filename").count() == 1
    assert not validate.enforce(d, "rows", "warn") and validate.enforce(d.limit(0), "rows") and validate.enforce(d, "rows", "off")
    with pytest.raises(validate.IntegrityError):
        validate.enforce(d, "rows")
    good = {"status": "complete", "script_version": "3.2.1", "components": "/x/a.parquet"}
    assert validate.marker_problems(good, "a.parquet") == [] and len(validate.marker_problems({}, "a.parquet")) == 3
    assert validate.shared_value([good, good], "status") == "complete"
    with pytest.raises(validate.IntegrityError):
        validate.shared_value([good, {}], "status")
    modes = spark.createDataFrame([("mid",), ("microprice",)], "price_mode string")
    assert validate.mixed_modes(modes, "mid").count() == 1 and validate.mixed_modes(modes.limit(1), "mid").count() == 0
    u = spark.createDataFrame([("e", "m", "S", "g"), ("e", "m", "T", "g")], "exchange string, market_type string, symbol string, parquet_glob string")
    q = spark.createDataFrame([("e", "m", "S", "g", "mid")], "exchange string, market_type string, symbol string, parquet_glob string, scan_price_mode string")
    assert [r["symbol"] for r in validate.quality_mismatch(q, u, {"scan_price_mode": "mid"}).collect()] == ["T"]
    assert validate.quality_mismatch(q, u, {"scan_price_mode": "microprice"}).count() == 2


def test_streaming_gaps_equal_batch(spark, tmp_path):
    from wakelag.streaming import carried

    t = datetime(2026, 7, 1)
    rows = [("A" if n % 3 else "B", t + timedelta(seconds=n), 100.0 + n % 7) for n in range(60)]
    schema = "symbol string, ts timestamp, price double"
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = carried.gaps(s, ["symbol"]).writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["symbol"], r["start_ns"], r["end_ns"], round(r["ret"], 9)) for r in spark.table("gaps").collect())
    import math

    want, last = [], {}
    for k, at, p in rows:
        ns = int((at - datetime(1970, 1, 1)).total_seconds()) * 10**9
        if k in last:
            want.append((k, last[k][0], ns, round(math.log(p) - math.log(last[k][1]), 9)))
        last[k] = (ns, p)
    assert got == sorted(want)


def test_streaming_gaps_keep_quotes_of_one_time(spark, tmp_path):
    import math

    from wakelag.streaming import carried

    t = datetime(2026, 7, 1)
    at = lambda n: int((t - datetime(1970, 1, 1)).total_seconds() + n) * 10**9
    schema = "symbol string, ts timestamp, price double, seq long"
    # the second batch goes on at the first one's last time; its row of an earlier time is too late
    batches = [[(0, 8.0, 3), (0, 2.0, 1), (0, 4.0, 2), (5, 1.0, 4)], [(5, 3.0, 6), (5, 6.0, 5), (1, 7.0, 9)]]
    for batch in batches:
        spark.createDataFrame([("A", t + timedelta(seconds=n), p, s) for n, p, s in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = carried.gaps(s, ["symbol"], ["seq"]).writeStream.format("memory").queryName("tied").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["start_ns"], r["end_ns"], round(r["ret"], 9)) for r in spark.table("tied").collect())
    steps = [(0, 2, 0, 4), (0, 4, 0, 8), (0, 8, 5, 1), (5, 1, 5, 6), (5, 6, 5, 3)]
    assert got == sorted((at(a), at(b), round(math.log(y / x), 9)) for a, x, b, y in steps)
