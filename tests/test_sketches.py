import random

from pyspark.sql import functions as F

from wakelag.operators import leadlag, sketches

NAMED = {"p01": 0.01, "p50": 0.5, "p999": 0.999}


def test_ranks_of_merged_sketches(spark):
    """Many unlike files, merged over two levels; groups without numbers have no sketch, and one value is its own quantile."""
    rng = random.Random(5)
    rows = [("a", f"f{n % 40}", rng.gauss(n % 40, 1 + n % 7)) for n in range(20_000)] + [("a", "f1", None), ("a", "f2", float("nan"))]
    rows += [("b", "f0", 7.0)] * 50 + [("c", "f0", None), ("c", "f1", float("nan"))]
    d = spark.createDataFrame(rows, "symbol string, file string, v double").repartition(6)
    held = sketches.sketched(d, ["symbol", "file"], F.col("v"))
    assert held.where("sketch IS NULL").count() == 2
    top = sketches.merged(sketches.merged(held, ["symbol", "file"]), ["symbol"])
    found = sketches.quantiles(top, NAMED).cache()
    got = {r["symbol"]: r for r in found.collect()}
    assert set(got) == {"a", "b"} and got["a"]["n"] == 20_000 and [got["b"][q] for q in NAMED] == [7.0] * 3
    off = sketches.rank_errors(d, ["symbol"], F.col("v"), found, NAMED).collect()
    assert all(r[q] <= sketches.RANK_ERROR for r in off for q in NAMED) and len(off) == 2
    wrong = found.withColumns({q: F.lit(1e9) for q in NAMED})
    assert all(r["p50"] == 0.5 for r in sketches.rank_errors(d, ["symbol"], F.col("v"), wrong, NAMED).collect())


def test_pairs_are_numbered_by_ranges(spark):
    rows = [(f"x{(7 * n) % 50}", f"y{n % 20}", (3 * n) % 50, n) for n in range(1000)]
    d = spark.createDataFrame(rows, "x_instrument_id string, y_instrument_id string, xn int, yn int").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = leadlag.pair_shard(d, 100, 300, ("xn", "yn"))
        assert "SinglePartition" not in got._jdf.queryExecution().toString()
        want = sorted(rows, key=lambda r: r[2:])[100:400]
        assert [(r["pair_no"], r["xn"], r["yn"]) for r in got.orderBy("pair_no").collect()] == [(101 + n, *r[2:]) for n, r in enumerate(want)]
        assert leadlag.pair_shard(d, 990, None, ("xn", "yn")).count() == 10 and leadlag.pair_shard(d, 2000, 5).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
