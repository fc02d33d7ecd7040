import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from wakelag.llm import jaccard as J
from wakelag.llm.components import components


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(n, links):
    up = {i: i for i in n}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in n}


def brute(rows, k, percent):
    s = {i: sets_of(t, k) for i, t in rows if i is not None}
    ids = sorted(s)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    return {i: (len(s[i]), g) for i, g in groups(ids, links).items()}


def test_edges(docs, none):
    rows = J.join(docs, size=3, percent=90).collect()
    want = brute([(r[0], r[1]) for r in ROWS], 3, 90)
    assert len(rows) == len(ROWS)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] > 0
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert J.join(none).count() == 0


@pytest.mark.parametrize("k,percent,seed,step", [(3, 90, 0, 4_000_000), (5, 80, 1, 4_000_000), (2, 60, 2, 4_000_000), (5, 80, 3, 40), (2, 60, 4, 7)])
def test_brute_force_on_edited_copies(spark, monkeypatch, k, percent, seed, step):
    monkeypatch.setattr(J, "TILE_SHINGLES", 600)
    monkeypatch.setattr(J, "TILE", 8)
    monkeypatch.setattr(J, "HOST", 3)
    monkeypatch.setattr(J, "STEP", step)
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz")
    shared, rows = [word() for _ in range(60)], []
    for n in range(12):
        base = [word() for _ in range(rng.choice([1, 3, 9, 12, 25, 60, 150, 400]))]
        base = shared + base if n % 3 == 0 else base
        for _ in range(rng.choice([1, 2, 10, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t) if rng.random() < 0.9 else "  ".join(t).upper()))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join(d, size=k, percent=percent).collect()}
    assert got == brute(rows, k, percent)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 9))
def test_bitmaps_never_lose_a_pair(shared, a, b, seed):
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 1 << 63, shared + a + b, dtype=np.uint64))
    x, y = h[: shared + a], np.concatenate([h[:shared], h[shared + a :]])
    room = J.rooms(np.array([len(x)]), np.array([len(y)]), [J.bitmap(np.sort(x))], [J.bitmap(np.sort(y))])[0]
    assert room >= len(np.intersect1d(x, y))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 120), st.integers(0, 30), st.sampled_from([60, 80, 90]), st.integers(0, 99))
def test_prefixes_share_a_shingle(n, edits, percent, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
    y = np.unique(np.concatenate([x[rng.permutation(len(x))[: max(0, len(x) - edits)]], rng.integers(0, 1 << 60, edits, dtype=np.uint64)]))
    often = np.sort(rng.permutation(x)[: len(x) // 2])
    common = (often, rng.permutation(len(often)))
    i = len(np.intersect1d(x, y))
    if 100 * i >= percent * (len(x) + len(y) - i) and not np.array_equal(x, y):
        assert len(np.intersect1d(J.prefix(x, percent, common), J.prefix(y, percent, common)))


@pytest.mark.parametrize("percent", [60, 80, 90, 99])
def test_sets_that_may_link_stand_in_neighbouring_bands(spark, percent):
    rows = [(n, m) for n in range(1, 400) for m in (n, max(n, n * 100 // percent))]
    d = spark.createDataFrame(rows, "n long, m long").select((J.band(F.col("m"), percent) - J.band(F.col("n"), percent)).alias("d"))
    assert {r["d"] for r in d.distinct().collect()} <= {0, 1}


@pytest.mark.parametrize("chunk,parts", [(2_000_000, 1), (2_000_000, 7), (1, 5)])
def test_components(spark, monkeypatch, chunk, parts):
    from wakelag.llm import components as module

    monkeypatch.setattr(module, "CHUNK", chunk)
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(n, n + 1) for n in range(1000, 1100)] + [(5, 5), (None, 3)] + [(2000, 2000 + n) for n in range(1, 400)] * 2
    rng.shuffle(links)
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(parts)).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = groups({x for p in real for x in p}, real)
    assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    from wakelag.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op6_jaccard_join(spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()['op6_jaccard_join']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_copies_of_a_large_table_are_never_sent_whole(spark, monkeypatch):
    monkeypatch.setattr(J, "LOOKUP", 100, raising=False)
    rows = spark.range(3000).selectExpr("id", "id AS host", "100L + id % 3 AS n")
    for side in J.grid(rows, rows, "host", 80, F.lit(1), 64):
        assert "BroadcastHashJoin" not in side._jdf.queryExecution().executedPlan().toString()
        assert side.select("id").distinct().count() == 3000


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    import time

    from wakelag.llm.common import kept

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    blocks = lambda: {b for b in disk.getAllBlocks().mkString("\n").split("\n") if b.startswith("shuffle_")}
    before, name = blocks(), "spark.sql.autoBroadcastJoinThreshold"
    limit = spark.conf.get(name)
    got = kept(spark.range(5000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), str(tmp_path / "t"))
    for _ in range(50):  # files go in the background
        if not blocks() - before:
            break
        time.sleep(0.1)
    assert not blocks() - before and spark.conf.get(name) == limit
    assert sorted(r["k"] for r in got.collect()) == list(range(7))


def test_brute_force_where_lookups_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(J, "LOOKUP", 0, raising=False)
    test_brute_force_on_edited_copies(spark, monkeypatch, 3, 90, 1, 4_000_000)


def test_ids_that_repeat_without_end(spark):
    """Two near copies of 10,000 rows each: pairs are made of ids, not of rows."""
    one, two = " ".join(f"w{n}" for n in range(60)), " ".join(f"w{n}" for n in range(61))
    d = spark.range(20_000).selectExpr("id % 2 AS doc_id", f"CASE WHEN id % 2 = 0 THEN '{one}' ELSE '{two}' END AS text").repartition(6)
    got = J.join(d).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 10_000), (1, 0, 10_000)]
