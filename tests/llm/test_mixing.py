from collections import defaultdict

import duckdb
import pytest

from wakelag.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def highest_quotients(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        best = max((i for i in range(len(weights)) if weights[i] > 0), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("weights,seats", [([5.0, 3.0, 1.0], 7), ([1.0, 1.0, 1.0, 1.0], 2), ([100.0, 1.0, 1.0], 50), ([0.0, 2.0, 3.0], 11), ([7.5], 4), ([1.0, 2.0], 0), ([49.0, 25.0, 14.0, 7.0, 3.0, 2.0], 37)])
def test_apportionment_is_by_highest_quotients(spark, weights, seats):
    d = spark.createDataFrame([(n, w, seats) for n, w in enumerate(weights)], "i long, w double, s long")
    from pyspark.sql import functions as F

    got = {r["i"]: r["q"] for r in mixing.apportion(d, [], [F.col("i")], "w", "s", "q").collect()}
    assert [got[n] for n in range(len(weights))] == highest_quotients(weights, seats)


def test_targets_and_limits(docs, none):
    rows = mixing.mix(docs, block=1).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    assert abs(sum(x[0]["target"] for x in by.values()) - total) < 1e-6 * total
    for s, x in by.items():
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 2, s
        assert x[0]["target"] <= 3 * x[0]["source_size"] + 1e-9
    assert mixing.mix(none).count() == 0
    again = mixing.mix(docs, block=1).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("sizes", [{"a": [3], "b": [2], "c": [1]}, {"a": [1, 1, 1], "b": [5, 5, 5, 5], None: [2]}, {"a": [40] * 30, "b": [7] * 3, "c": [300]}, {"a": [0], "b": [0, 0]}])
def test_small_tables_come_near_their_targets(spark, sizes):
    rows = [(n, " ".join("w" * k), s) for n, (s, k) in enumerate((s, k) for s, x in sizes.items() for k in x)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(1.0, 0.05 * mine[0]["target"]), (s, mine)


def test_many_rows_of_one_id_and_many_sources(spark, monkeypatch):
    """Rows that repeat are cut up; both ways of joining sources give the same; the SQL says so too."""
    rows = [(5, "a b c", "x")] * 700 + [(None, "w " * (n % 9), "x") for n in range(300)] + [(n, "t " * (n % 5), f"s{n % 40}") for n in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    few = sorted(map(str, mixing.mix(d, shard_rows=32).collect()))
    monkeypatch.setattr(mixing.with_source, "__defaults__", (3,))
    assert sorted(map(str, mixing.mix(d.repartition(2), shard_rows=32).collect())) == few and len(few) == len(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    got = mixing.mix(d, shard_rows=32)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({mixing.oracle(shard_rows=32)})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op7_mixing(spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()['op7_mixing']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_plan_is_native(spark):
    plan = queries.op7_mixing(spark, SF)._jdf.queryExecution().toString() + queries.op3_secret_scan(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "MapInArrow", "Pandas", "ArrowEval"))
