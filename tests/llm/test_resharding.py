import itertools
import zlib

import numpy as np
import pytest

from wakelag.llm import resharding as R


@pytest.mark.parametrize("seed", range(8))
def test_flow_is_of_least_cost(seed):
    rng = np.random.default_rng(seed)
    supply, cost = rng.integers(0, 4, 2).tolist(), rng.integers(0, 5, (2, 3)).tolist()
    capacity = [int(x) for x in rng.integers(1, 4, 3)]
    if sum(capacity) < sum(supply):
        capacity[0] += sum(supply)
    flow = R.min_cost_flow(supply, capacity, cost)
    assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= capacity[j] for j in range(3))
    paid = sum(flow[i][j] * cost[i][j] for i in range(2) for j in range(3))
    splits = lambda n: [x for x in itertools.product(range(n + 1), repeat=3) if sum(x) == n]
    best = min(sum(a[j] * cost[0][j] + b[j] * cost[1][j] for j in range(3)) for a in splits(supply[0]) for b in splits(supply[1]) if all(a[j] + b[j] <= capacity[j] for j in range(3)))
    assert paid == best


def test_too_little_room():
    with pytest.raises(ValueError):
        R.min_cost_flow([5], [4], [[0]])


def test_edges(docs, none):
    rows = R.reshard(docs).collect()  # docs has columns shard and block of its own
    assert len(rows) == docs.count()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    null = [r for r in rows if r["doc_id"] in (3, 4)]
    assert {(r["size"], r["text_crc32"]) for r in null} == {(1, 0)}
    assert R.reshard(none).count() == 0


def test_rows_alike_are_spread(spark):
    d = spark.range(0, 6000, 1, 8).selectExpr("7 AS doc_id", "'the same text' AS text")
    rows = R.reshard(d, piece_bytes=400).collect()
    held = np.bincount([r["shard"] for r in rows], minlength=16)
    assert held.sum() == 6000 and held.max() < 1.2 * held.min()
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(held[s]))


def test_even_and_least_moves(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = R.reshard(d).collect()
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    assert len(rows) == len(texts)
    sizes = np.zeros(16)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        sizes[r["shard"]] += r["size"]
    assert sizes.max() / sizes.min() < 1.02
    moved = sum(r["size"] for r in rows if r["old_shard"] != r["shard"])
    held = np.zeros(12)
    for r in rows:
        held[r["old_shard"]] += r["size"]
    least = np.maximum(held - sizes.sum() / 16, 0).sum()
    assert moved < 1.05 * least


def state(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("doc_id", "text", "shard", "block").collect()))


def test_rewrite_touches_only_moved_blocks(spark, tmp_path):
    d = spark.range(400).selectExpr("id AS doc_id", "repeat('x', cast(id AS int)) AS text")
    path = str(tmp_path / "t")
    R.write_layout(d, path, 2)
    before = state(spark, path)
    first = sorted({b for _, _, s, b in before if s == 0})
    moves = [(0, b, 2) for b in first[:3]] + [(0, first[-1], 0)]
    leaves = lambda: {str(p.parent.relative_to(path)): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    torn = {f"shard=0/piece={b // (R.BLOCKS // R.PIECES)}" for b in first[:3]}
    old = leaves()
    assert R.rewrite(spark, path, moves) == 3
    assert {p: t for p, t in leaves().items() if p in old} == {p: t for p, t in old.items() if p not in torn}
    want = sorted((i, t, 2 if b in first[:3] else s, b) for i, t, s, b in before)
    assert state(spark, path) == want  # by a plain reader
    assert R.rewrite(spark, path, []) == 0


@pytest.mark.parametrize("lost", [0, 1, 2])
def test_a_move_that_was_broken_off_is_finished(spark, tmp_path, monkeypatch, lost):
    """lost before the journal: nothing has changed; lost among the renames: the next reader finishes them."""
    d = spark.range(60).selectExpr("id AS doc_id", "repeat('y', cast(id AS int)) AS text")
    path = str(tmp_path / "t")
    R.write_layout(d, path, 2)
    before = state(spark, path)
    moves = [(s, b, 3) for s, b in sorted({(s, b) for _, _, s, b in before})[:6]]
    calls, whole = [], R.drop

    class Lost(Exception):
        pass

    def dies(spark_, *paths):
        calls.append(paths)
        if len(calls) > 1 and lost == 2:  # the first clears what an earlier run staged
            raise Lost
        whole(spark_, *paths)

    with monkeypatch.context() as m:
        m.setattr(R, "drop", dies)
        if lost == 0:
            m.setattr(R, "_write", lambda *_: (_ for _ in ()).throw(Lost()))
        if lost == 1:
            m.setattr(R, "finish", lambda *_: None)
        if lost == 1:
            R.rewrite(spark, path, moves)
        else:
            with pytest.raises(Lost):
                R.rewrite(spark, path, moves)
    got = sorted(map(tuple, R.read_layout(spark, path).select("doc_id", "text", "shard", "block").collect()))
    gone = {(s, b) for s, b, _ in moves}
    assert got == (before if lost == 0 else sorted((i, t, 3 if (s, b) in gone else s, b) for i, t, s, b in before))
    assert state(spark, path) == got


def test_query_reads_what_the_files_hold(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = str(tmp_path / "t")
    rows = {(r["doc_id"], r["shard"], r["block"]) for r in R.reshard(d, path=path).collect()}
    held = spark.read.parquet(path)
    assert set(d.columns) < set(held.columns) and rows == {(r["doc_id"], r["shard"], r["block"]) for r in held.collect()}
