from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakelag.functions.scalars import to_ns
from wakelag.operators import control
from wakelag.operators.validate import IntegrityError
from wakelag.sources import layouts, ledger
from wakelag.sources.tables import MissingCacheError

KEYS = ["exchange", "market_type", "symbol"]


def listed(spark, *paths):
    return spark.createDataFrame([(f"/c/exchange=x/market_type=perp/symbol={p}",) for p in paths], "path string")


def universe(spark, *names):
    return spark.createDataFrame([("x", "perp", n) for n in names], "exchange string, market_type string, symbol string")


def test_layouts(spark):
    files = listed(spark, "A/price_mode=mid/date=2024-01-01/a.parquet", "A/date=2024-01-01/a.parquet", "B/b.parquet", "C/date=2024-01-01/a.parquet", "C/c.parquet", "D/price_mode=micro/date=2024-01-01/a.parquet", "E/price_mode=mid/a.parquet", "E/price_mode=mid/date=2024-01-01/a.parquet")
    notes = listed(spark, f"F/{layouts.MANIFEST}", f"B/price_mode=mid/{layouts.MANIFEST}")
    got = {r["symbol"]: r for r in layouts.resolve(files, notes, universe(spark, *"ABCDEFG"), "mid").collect()}
    assert {s: (r["layout"], r["dated"], r["shadowed"], r["problem"]) for s, r in got.items()} == {
        "A": (layouts.BY_MODE, True, True, None), "B": (layouts.BY_MODE, False, True, None), "C": (None, None, False, "mixed_legacy"), "D": (None, None, False, "no_cache"),
        "E": (None, None, False, "mixed_by_mode"), "F": (layouts.LEGACY, False, False, None), "G": (None, None, False, "no_cache"),
    }
    assert got["D"]["other_modes"] == ["micro"] and got["G"]["other_modes"] == [] and got["B"]["manifest"].endswith(f"mid/{layouts.MANIFEST}")
    with pytest.raises(IntegrityError):
        layouts.require_sound(layouts.resolve(files, notes, universe(spark, "C"), "mid"))


def test_dates_and_files_that_a_range_needs(spark):
    day = to_ns(datetime(2024, 1, 2))
    hour = 3600 * 10**9
    assert layouts.dates_needed(day, day + hour, hour) == (date(2024, 1, 2), date(2024, 1, 2))
    assert layouts.dates_needed(day, day + 24 * hour, 1) == (date(2024, 1, 2), date(2024, 1, 3))
    assert layouts.dates_needed(day, day + 24 * hour, hour, day + 24 * hour - 1) == (date(2024, 1, 2), date(2024, 1, 2)) and layouts.dates_needed(day, day, 1) is None
    files = listed(spark, "A/price_mode=mid/date=2024-01-01/a.parquet", "A/price_mode=mid/date=2024-01-03/a.parquet", "A/price_mode=mid/date=2024-01-03/b.parquet", "A/price_mode=micro/date=2024-01-02/a.parquet", "A/date=2024-01-02/a.parquet", "B/b.parquet", "B/c.parquet")
    found = layouts.resolve(files, listed(spark, f"F/{layouts.MANIFEST}"), universe(spark, "A", "B", "F"), "mid")
    need, gone = layouts.needed(found, files, "mid", date(2024, 1, 2), date(2024, 1, 3))
    assert sorted(r["path"][-28:] for r in need.collect()) == sorted(p[-28:] for p in ("/mid/date=2024-01-03/a.parquet", "/mid/date=2024-01-03/b.parquet", "/c/exchange=x/market_type=perp/symbol=B/b.parquet", "/c/exchange=x/market_type=perp/symbol=B/c.parquet"))
    assert sorted((r["symbol"], str(r["date"])) for r in gone.collect()) == [("A", "2024-01-02"), ("F", "None")]
    with pytest.raises(MissingCacheError):
        layouts.handle_missing(gone, "error")
    layouts.handle_missing(gone, "warn")
    layouts.handle_missing(gone, "empty")
    with pytest.raises(ValueError):
        layouts.handle_missing(gone, "else")
    with pytest.raises(IntegrityError):
        layouts.guard_files(need, 1)


def test_footers_keep_files_shut(spark, tmp_path):
    for n in range(4):
        spark.createDataFrame([(10 * n, 10 * n + 5, 0.1)], "start_ns long, end_ns long, ret double").coalesce(1).write.parquet(f"{tmp_path}/exchange=x/market_type=perp/symbol=A/price_mode=mid/date=2024-01-0{n + 1}")
    spark.createDataFrame([], "start_ns long, end_ns long, ret double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/exchange=x/market_type=perp/symbol=A/price_mode=mid/date=2024-01-01")
    at = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(str(tmp_path)).select("path")
    z = layouts.zones(at).cache()
    assert sorted((r["rows"], r["low_start_ns"], r["high_end_ns"]) for r in z.where("rows > 0").collect()) == [(1, 10 * n, 10 * n + 5) for n in range(4)]
    assert z.where(layouts.meets(14, 21)).count() == 2 and z.where(layouts.meets(15, 20)).count() == 0


def test_versions_compare_by_their_numbers(spark):
    d = spark.createDataFrame([("3.10.0",), ("3.2",), ("3.1.9",), ("x",), (None,)], "t string")
    assert [r[0] for r in d.select(control.version_key(F.col("t")) >= F.array(F.lit(3), F.lit(2), F.lit(0))).collect()] == [True, True, False, False, False]


def test_excluded_hours_of_a_manifest(spark):
    d = spark.createDataFrame([("m", ["2024-01-01T05:00:00Z", "2024-01-01T05:00:00Z", "2024-01-01 06:00:00", "2024-01-01T05:00:01Z", "no time"])], "path string, excluded_hours_utc array<string>")
    got = {r["said"]: (r["from_ns"], r["to_ns"]) for r in control.excluded_ranges(d).collect()}
    at = to_ns(datetime(2024, 1, 1, 5))
    assert got == {"2024-01-01T05:00:00Z": (at, at + control.HOUR_NS), "2024-01-01 06:00:00": (at + control.HOUR_NS, at + 2 * control.HOUR_NS), "2024-01-01T05:00:01Z": (None, None), "no time": (None, None)}


def test_ledger_counts_what_was_meant(spark, tmp_path):
    """Chunks without rows are sound; a row changed in place shows; spans come back from the names."""
    root, t = str(tmp_path), datetime(2024, 1, 1)
    spans = [(t + timedelta(hours=n), t + timedelta(hours=n + 1)) for n in range(3)]
    d = spark.createDataFrame([(to_ns(t) + n, None if n == 1 else float(n)) for n in range(3)] + [(to_ns(t + timedelta(hours=1)), 5.0)], "end_ns long, ret double")
    assert ledger.states(spark, root, d).count() == 0 and ledger.rest(spark, root, d, "mid", spans) == spans
    ledger.write_chunks(d, root, "mid", spans)
    state = lambda: sorted(r["state"] for r in ledger.states(spark, root, d).collect())
    assert state() == ["sound"] * 3 and ledger.sound_rows(spark, root, d).count() == 4
    assert sorted(map(tuple, ledger.sound_spans(spark, root, d).collect())) == [(to_ns(a), to_ns(b)) for a, b in spans]
    name = ledger.span_name("mid", *spans[0])
    ledger.drop_chunks(spark, root, [name])
    d.where(F.col("end_ns") < to_ns(spans[0][1])).withColumn("ret", F.col("ret") + 1).withColumn("chunk", F.lit(name)).write.mode("append").partitionBy("chunk").parquet(f"{root}/chunks")
    assert state() == ["sound", "sound", "torn"] and ledger.rest(spark, root, d, "mid", spans) == spans[:1] and ledger.sound_rows(spark, root, d).count() == 1
    ledger.write_chunks(d, root, "mid", spans[:1])
    assert state() == ["sound"] * 3


def test_reconcile_refuses_where_it_is_told_to(spark):
    catalog = spark.createDataFrame([("a", 1), ("a", 2)], "symbol string, hour int")
    partial = spark.createDataFrame([("a", 1, 5)], "symbol string, hour int, n int")
    got = ledger.reconcile(partial, catalog, ["symbol", "hour"], [("n", "long"), ("m", "string")], strict=True)
    assert [tuple(r) for r in got["kept"].collect()] == [("a", 1, 5, None)] and [tuple(r) for r in got["rest"].collect()] == [("a", 2)]
    with pytest.raises(IntegrityError):
        ledger.reconcile(partial.unionByName(partial), catalog, ["symbol", "hour"], [("n", "long")], strict=True)
