import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakelag.operators import intervals, lagged, leadlag, overlap, quality, quotes, summary

MS = 1_000_000


def brute(xs, ys, lag, a, e, w):
    """Components of one pair and lag by window, by looking at all pairs of intervals."""
    out = {}
    for n in range(-(-(e - a) // w)):
        lo, hi = a + n * w, min(a + (n + 1) * w, e)
        cov = cnt = 0
        for s, t, r in xs:
            for u, v, q in ys:
                s2, t2 = s + lag, t + lag
                end = min(t2, v)
                if t2 <= e and v <= e and max(s2, u) < end and lo < end <= hi:
                    cov, cnt = cov + r * q, cnt + 1
        x = [r for s, t, r in xs if lo < t + lag <= hi]
        y = [r for s, t, r in ys if lo < t <= hi]
        out[n] = (round(cov, 9), round(sum(r * r for r in x), 9), round(sum(r * r for r in y), 9), cnt, len(x), len(y))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "instrument_id string, start_ns long, end_ns long, ret double")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "x_instrument_id string, y_instrument_id string")


def test_synchronous_intervals_have_unit_correlation(spark):
    rows = [(i, s, t, r) for i in "xy" for s, t, r in ((0, 10 * MS, 1.0), (10 * MS, 20 * MS, 2.0))]
    r = leadlag.components(frame(spark, rows), pairs(spark, [("x", "y")]), [0], 0, 20 * MS, 20 * MS).collect()
    assert len(r) == 1
    assert (r[0]["cov"], r[0]["var_x"], r[0]["var_y"], r[0]["n_overlap"], r[0]["n_x"], r[0]["n_y"]) == (5, 5, 5, 2, 2, 2) and r[0]["corr"] == pytest.approx(1)


def random_intervals(seed):
    rng, data = random.Random(seed), {}
    for i in ("x", "y", "z"):
        at, out = rng.randrange(-60, 20), []
        while at < 420:
            at += rng.choice([0, 0, 0, 3, 11])
            to = at + rng.choice([1, 2, 5, 17, 40, 150])
            out.append((at * MS, to * MS, round(rng.uniform(-1, 1), 3)))
            at = to
        data[i] = out
    return data, [(i, *r) for i, x in data.items() for r in x]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("lags", [[-20, -10, 0, 10, 20], [-150, -7, 0, 1, 40], [0], list(range(-30, 31))], ids=["even", "uneven", "zero", "many"])
def test_random_intervals_against_all_pairs(spark, seed, lags):
    data, rows = random_intervals(seed)
    a, e, w = 0, 390 * MS, 100 * MS
    d = leadlag.components(frame(spark, rows), pairs(spark, [("x", "y"), ("x", "z")]), lags, a, e, w)
    got = {(r["y_instrument_id"], r["lag_ms"], r["win"]): (round(r["cov"], 9), round(r["var_x"], 9), round(r["var_y"], 9), r["n_overlap"], r["n_x"], r["n_y"]) for r in d.collect()}
    want = {(y, lag, n): v for y in "yz" for lag in lags for n, v in brute(data["x"], data[y], lag * MS, a, e, w).items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-8), k


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("how", ["sweep", "bucketed", "lagged"])
def test_joins_of_overlaps_agree(spark, seed, how):
    """Each overlap found once, whatever the slices are as wide as."""
    data, rows = random_intervals(seed)
    a, e, w, lags = 0, 390 * MS, 100 * MS, [-20, -10, 0, 10, 20]
    asked = frame(spark, rows), pairs(spark, [("x", "y"), ("x", "z")]), lags, a, e, w
    if how == "lagged":
        d = lagged.covariances(*asked, width_ns=7 * MS)
    else:
        d = leadlag.overlaps(*asked, overlap.sweep if how == "sweep" else lambda x, y, k, _: overlap.bucketed(x, y, k, 7 * MS))
        d = d.groupBy("y_instrument_id", "lag_ms", "win").agg(F.sum(F.col("x_ret") * F.col("y_ret")).alias("cov"), F.count("*").alias("n_overlap"))
    got = {(r["y_instrument_id"], r["lag_ms"], r["win"]): (r["cov"], r["n_overlap"]) for r in d.collect()}
    want = {(y, lag, n): (v[0], v[3]) for y in "yz" for lag in lags for n, v in brute(data["x"], data[y], lag * MS, a, e, w).items() if v[3]}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-8), k


def test_plans_have_no_row_for_each_lag(spark):
    """The rows that a plan makes before its sums do not depend on the number of lags."""
    _, rows = random_intervals(1)
    made = []
    for lags in ([-20, 0, 20], list(range(-20, 21))):
        x = frame(spark, [(r[0], *r[1:]) for r in rows if r[0] == "x"]).withColumnRenamed("instrument_id", "x_instrument_id").withColumn("y_instrument_id", F.lit("y"))
        y = frame(spark, [r for r in rows if r[0] == "y"]).withColumnRenamed("instrument_id", "y_instrument_id")
        made.append(lagged.near_pairs(x, y, lags).count())
    assert made[0] == made[1]


def most_rows(df):
    """The most rows that any operator of df's plan gave out."""
    df.collect()

    def walk(p):
        name = p.getClass().getSimpleName()
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        found = p.metrics().get("numOutputRows")
        return max([found.get().value() if found.isDefined() else 0, *map(walk, inner)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_work_grows_with_intervals_not_with_pairs_near_each_other(spark):
    """Twice as many intervals in the same time: twice as many rows, where all that are near each other would be four times as many."""
    made = []
    for n in (600, 1200):
        step = 3_600_000 // n * MS
        rows = frame(spark, [(i, k * step, (k + 1) * step, 0.1) for i in "xy" for k in range(n)])
        asked = rows, pairs(spark, [("x", "y")]), [-600_000, 0, 600_000], 0, 3_600_000 * MS, 3_600_000 * MS
        assert {r["lag_ms"]: r["n_overlap"] for r in lagged.covariances(*asked).collect()} == {-600_000: n - n // 6, 0: n, 600_000: n - n // 6}
        made.append(most_rows(lagged.covariances(*asked)))
    assert made[1] <= 2.2 * made[0]


@pytest.mark.parametrize("seed", range(2))
def test_intervals_that_overlap_within_an_instrument(spark, seed):
    rng = random.Random(seed)
    data = {i: [(s, s + rng.choice([1, 9, 70, 200]) * MS, round(rng.uniform(-1, 1), 3)) for s in (rng.randrange(-60, 400) * MS for _ in range(40))] for i in "xy"}
    a, e, w, lags = 0, 390 * MS, 100 * MS, [-30, 0, 7]
    d = lagged.covariances(frame(spark, [(i, *r) for i, x in data.items() for r in x]), pairs(spark, [("x", "y")]), lags, a, e, w, 50 * MS)
    got = {(r["lag_ms"], r["win"]): (r["cov"], r["n_overlap"]) for r in d.collect()}
    want = {(lag, n): (v[0], v[3]) for lag in lags for n, v in brute(data["x"], data["y"], lag * MS, a, e, w).items() if v[3]}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-8), k


def test_boundaries(spark):
    one = lambda x, y, **k: leadlag.components(frame(spark, [("x", *x), ("y", *y)]), pairs(spark, [("x", "y")]), [0], 0, 40, 20, **k).orderBy("win").collect()
    assert [r["n_overlap"] for r in one((0, 10, 1.0), (10, 20, 1.0))] == [0, 0]  # touching
    assert [r["n_overlap"] for r in one((5, 20, 1.0), (15, 30, 1.0))] == [1, 0]  # an end on the edge is the earlier window's
    assert [r["n_overlap"] for r in one((5, 41, 1.0), (15, 30, 1.0))] == [0, 0]  # X ends after the horizon
    assert [r["n_overlap"] for r in one((-30, 10, 1.0), (-5, 8, 1.0))] == [1, 0]  # a start before the analysis counts


def test_excluded_windows_leave_the_spine(spark):
    p = pairs(spark, [("x", "y")])
    bad = lambda i, a, b: spark.createDataFrame([(i, a, b)], "instrument_id string, from_ns long, to_ns long")
    wins = lambda b: sorted({r["win"] for r in leadlag.spine(p, ["x_instrument_id", "y_instrument_id"], [-1, 0, 1], 0, 40 * MS, 10 * MS, b).collect()})
    assert wins(None) == [0, 1, 2, 3]
    assert wins(bad("x", 11 * MS, 12 * MS)) == [0, 2, 3]
    assert wins(bad("x", 10 * MS, 12 * MS)) == [2, 3]  # X looks one lag around
    assert wins(bad("y", 10 * MS, 12 * MS)) == [0, 2, 3]  # Y does not
    assert wins(bad("y", 39 * MS, 90 * MS)) == [0, 1, 2] and wins(bad("y", 40 * MS, 90 * MS)) == [0, 1, 2, 3] and wins(bad("z", 0, 99 * MS)) == [0, 1, 2, 3]


def quote_rows(spark):
    t = datetime(2026, 7, 1, 9)
    rows = [(t, 1, 100.0, 100.02), (t, 2, 101.0, 101.02), (t + timedelta(milliseconds=10), 3, 103.0, 103.02)]
    return spark.createDataFrame([("binance", "perp", "ETHUSDT", "f", n, a, u, b, 1.0, k, 1.0) for n, (a, u, b, k) in enumerate(rows)], "exchange string, market_type string, symbol string, file string, row long, ts timestamp, update_id long, bid_price double, bid_qty double, ask_price double, ask_qty double")


def test_keep_last_in_quality_and_intervals(spark):
    import math

    q = quote_rows(spark)
    r = quality.file_quality(q, quotes.INSTRUMENT, "file", "row", max_spread_bps=10.0).first()
    assert (r["total_rows"], r["selected_rows"], r["deduplicated_rows"], r["duplicate_ts"], r["clean_rows"], r["ret_count"]) == (3, 2, 1, 1, 2, 1)
    i = intervals.build(q, max_spread_bps=10.0).collect()
    assert len(i) == 1 and i[0]["interval_ms"] == 10.0 and i[0]["ret"] == pytest.approx(math.log(103.01) - math.log(101.01), abs=1e-12)


def test_error_policy(spark):
    d = quality.file_quality(quote_rows(spark), quotes.INSTRUMENT, "file", "row", policy="error")
    assert d.first()["duplicate_ts"] == 1
    with pytest.raises(quality.PolicyError):
        quality.check_policy(d)


def test_rows_before_are_found_across_hours(spark):
    rng = random.Random(2)
    t, rows = datetime(2026, 7, 1), []
    for k in "AB":
        rows += [(k, t + timedelta(minutes=m), float(m)) for m in sorted(rng.sample(range(6000), 90))]
    d = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    got = sorted((r["k"], r["v"], r["w"]) for r in quotes.with_previous(quotes.by_hour(d, ["k"]), ["k"], {"v": "w"}).collect())
    assert got == [(k, b, a if k == j else None) for (j, _, a), (k, _, b) in zip([("", t, 0.0), *rows], rows)]
    plan = intervals.build(quote_rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(exchange" in plan and f"{quotes.HOUR}" in plan


def test_unclean_last_quote_hides_a_clean_one(spark):
    q = quote_rows(spark).withColumn("ask_price", F.when(F.col("update_id") == 2, 90.0).otherwise(F.col("ask_price")))
    assert intervals.build(q).count() == 0


def test_intervals_avoid_excluded_hours(spark):
    t = datetime(2026, 7, 1, 9, 59, 59)
    rows = [("b", "p", "S", t + timedelta(minutes=m), 100.0 + n, 1.0, 100.01 + n, 1.0) for n, m in enumerate((0, 1, 61, 62))]
    q = spark.createDataFrame(rows, "exchange string, market_type string, symbol string, ts timestamp, bid_price double, bid_qty double, ask_price double, ask_qty double").withColumn("hour", F.date_trunc("hour", "ts"))
    x = spark.createDataFrame([("b", "p", "S", datetime(2026, 7, 1, 10))], "exchange string, market_type string, symbol string, hour timestamp")
    assert intervals.build(q, max_interval_ms=1e9).count() == 3
    got = intervals.build(q, max_interval_ms=1e9, excluded=x).collect()
    assert [round(r["interval_ms"]) for r in got] == [60_000]  # from 11:00:59 to 11:01:59; the one across 10:00-11:00 is gone


def lag_rows(spark, rows):
    d = spark.createDataFrame([("p", lag, corr, n) for lag, corr, n in rows], "pair string, lag_ms long, agg_corr double, total_overlap long")
    return d.withColumns({"total_n_x": F.lit(1000), "total_n_y": F.lit(1000), "n_window_rows": F.lit(5), "corr_is_diagnostic": F.lit(True), "corr_outside_unit_interval": F.abs("agg_corr") > 1})


def test_best_lags(spark):
    d = lag_rows(spark, [(-10, 0.5, 200), (0, 0.1, 300), (10, -0.6, 200), (20, 0.9, 5), (30, None, 400)])
    a, p = summary.best_abs(d, ["pair"]).first(), summary.best_positive(d, ["pair"]).first()
    assert (a["best_lag_ms"], a["best_is_negative"], a["second_best_lag_ms"]) == (10, True, -10)
    assert a["best_abs_corr_margin"] == pytest.approx(0.1) and a["best_abs_minus_zero_abs_corr"] == pytest.approx(0.5)
    assert (p["best_positive_lag_ms"], p["second_best_positive_lag_ms"], p["corr_0_lag"]) == (-10, 0, 0.1)
    tie = summary.best_abs(lag_rows(spark, [(10, 0.5, 200), (-10, 0.5, 200)]), ["pair"]).first()
    assert tie["best_lag_ms"] == -10 and tie["corr_0_lag"] is None


def test_pairs(spark):
    u = spark.createDataFrame([("a1", "binance", "perp", "X", "eth ", "A"), ("b1", "bybit", "perp", "Y", "ETH", "B"), ("b2", "binance", "perp", "X", "ETH", "B"), ("b3", "bybit", "perp", "Z", "SOL", "B")], "instrument_id string, exchange string, market_type string, symbol string, base_asset string, group string")
    assert leadlag.make_pairs(u).count() == 2 and leadlag.make_pairs(u, skip_self=True).count() == 1 and leadlag.make_pairs(u, "any").count() == 3
    assert [r["y_instrument_id"] for r in leadlag.pair_shard(leadlag.make_pairs(u, "any"), 1, 1).collect()] == ["b2"]
    with pytest.raises(ValueError):
        leadlag.guard(u, 3, "instruments")
    with pytest.raises(ValueError):
        leadlag.make_pairs(u, most=3)
    with pytest.raises(ValueError):
        leadlag.make_pairs(u.withColumn("base_asset", F.lit(" ")))
    assert leadlag.make_pairs(u, b_market="spot").count() == 0
