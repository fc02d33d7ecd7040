import os

import duckdb
import pytest

import __spark_entry__ as entry
from wakelag.plans import catalogue
from wakelag.session import written

SF = "/root/testdata/sf0.01"  # as the driver compares


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    return sorted(str(tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF)
    if name not in catalogue.oracle_sql():
        assert got.columns and got.count() >= 0
        return
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, got.collect())) == plain(want)


def test_lag_grid_is_checked_in_every_window(spark, monkeypatch):
    from pyspark.sql import functions as F

    runs, bad = catalogue._runs(spark, SF), "U0_click"
    lost = runs.where(~((F.col("x_symbol") == bad) & (F.col("lag_ms") == 600_000) & (F.col("win") == 23)))
    monkeypatch.setattr(catalogue, "_runs", lambda *_: lost)
    got = [r for r in catalogue.lag_grid_complete(spark, SF).collect() if r["x_symbol"] == bad]
    assert got and all((r["n_lags"], r["has_zero"], r["n_windows"]) == (12, 1, 1) for r in got)


@pytest.mark.parametrize("of", ["component_files", "lag_grid_complete", "cache_identity_check", "uneven_windows", "component_integrity"])
def test_components_are_computed_once(spark, monkeypatch, of):
    from pyspark.sql import functions as F

    from wakelag.plans import inventory

    rows, made = catalogue._runs(spark, SF).localCheckpoint(), spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: (made.add(1), x)[1], "long").asNondeterministic()
    monkeypatch.setattr(catalogue, "_runs", lambda *_: rows.withColumn("n_x", counted("n_x")))
    assert getattr(inventory if of == "component_files" else catalogue, of)(spark, SF).count()
    assert made.value == rows.count()


@pytest.mark.parametrize("of", ["cache_identity_check", "best_abs", "uneven_windows", "component_integrity"])
def test_intervals_read_their_quotes_once(spark, monkeypatch, of):
    scans = []

    def seen(df, what):
        if what == "intervals":
            df.collect()
            scans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan parquet"))
        return written(df, what)

    monkeypatch.setattr(catalogue, "written", seen)
    getattr(catalogue, of)(spark, SF)
    assert scans == [1]


def test_best_lags_of_busier_quotes(spark, tmp_path):
    """Six times the events in the same month: six times the rows, where pairs of intervals near each other would be 36 times as many."""
    from pyspark.sql import functions as F

    from tests.test_leadlag import most_rows

    e = spark.read.parquet(f"{SF}/events.parquet")
    for n in (1, 6):
        moved = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000 + F.col("k") * 7_919_023_757) % 2_592_000_000_000)
        copies = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"event_id": F.col("event_id") + F.col("k") * 10_000, "ts": moved.cast("timestamp_ntz")})
        copies.drop("k").write.parquet(f"{tmp_path}/{n}/events.parquet")
    few, many = (most_rows(catalogue.best_abs(spark, f"{tmp_path}/{n}")) for n in (1, 6))
    assert many <= 8 * few


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from wakelag.plans import view

    plan = view.quotes(spark, SF).where(F.col("bid_price") > 1.0).select("bid_price")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,1.0)" in plan and "props" not in plan.split("ReadSchema")[1]
