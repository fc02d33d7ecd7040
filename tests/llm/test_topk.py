import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wakelag.llm import queries, topk


def brute(rows, ids, k):
    good = [(i, np.floor(256 * np.array(v, dtype=np.float64))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({i: v for i, v in good if i in ids}.items()):
        found = sorted((-int(a @ b), i) for i, b in good if i != q and len(b) == len(a))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("spread", [0.01, 1.0, 1000.0])
def test_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    rows = [(n, [float(x) for x in rng.normal(0, spread, 4).round(2)]) for n in range(200)]
    rows += [(n, rows[7][1]) for n in range(200, 260)]  # ties
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0]), (302, [1.0, float("nan"), 1.0, 1.0]), (303, [float("inf")] * 4), (None, [1.0] * 4), (350, [1.0, 2.0]), (351, [2.0, 1.0]), (400, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1)).repartition(5)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(d, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, range(0, 1000, 50), 5)
    many = topk.top_k(d, F.col("vec_id") % 50 == 0, query_bytes=64)  # several blocks of queries
    assert sorted(map(tuple, many.collect())) == brute(rows, range(0, 1000, 50), 5)


@pytest.mark.parametrize("buckets", [4, 64, 1024])
def test_refining_down_to_single_scores(spark, monkeypatch, buckets):
    monkeypatch.setattr(topk, "BUCKETS", buckets)
    rng = np.random.default_rng(buckets)
    rows = [(n, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for n in range(3000)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(map(tuple, topk.top_k(d, F.col("vec_id") % 50 == 0).collect())) == brute(rows, range(0, 3000, 50), 5)


def test_few_and_none(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(d, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 1, 32768), (0, 2, 2, -65536)]
    assert topk.top_k(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_large_numbers(spark):
    d = spark.createDataFrame([(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 1.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(d, F.col("vec_id") == 0).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2]


def test_scores_up_to_the_range_of_a_long(spark):
    """Products near 2**63 keep their order; the smallest differences count; huge but orthogonal vectors take part."""
    big = float((1 << 45) + 8)
    rows = [(0, [2.0, 0.0]), (1, [big, 0.0]), (2, [big - 4, 0.0]), (3, [-big, 5.0]), (4, [0.0, 1e301]), (5, [big, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(d, F.col("vec_id") == 0, scale=256.0).orderBy("rank").collect()
    whole = lambda x: int(np.floor(256 * x))
    want = sorted(((-sum(whole(a) * whole(b) for a, b in zip(rows[0][1], v)), i) for i, v in rows[1:]))
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, -s) for s, i in want] and want[0][0] < -(1 << 62)


def test_scores_beyond_a_long_raise(spark):
    for x, y in ((1e301, 1.0), (3e9, 3e9)):
        d = spark.createDataFrame([(0, [x]), (1, [y])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond the range of a long"):
            topk.top_k(d, F.col("vec_id") == 0).collect()


def test_a_block_is_bounded_in_histograms(spark):
    rng = np.random.default_rng(1)
    rows = [(n, [float(np.float32(x)) for x in rng.normal(0, 1, 2)]) for n in range(300)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(d, F.col("vec_id") % 50 == 0, histogram_bytes=2 * 8 * topk.BUCKETS)
    assert sorted(map(tuple, got.collect())) == brute(rows, range(0, 300, 50), 5)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, queries.op4_top_k(spark, sf).collect())) == sorted(con.execute(queries.oracle_sql()["op4_top_k"]).fetchall())
