import hashlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import ROWS
from wakelag.llm import fingerprints as P, queries

C = P.Chunker()


def slow_chunks(raw):
    """digest -> bytes, byte by byte: the gear hash of the last 16 bytes, a strict mask up to 64 bytes, a loose
    one beyond, chunks of 16 (exclusive) to 256 bytes."""
    gear = [xxhash.xxh32(bytes([b]), seed=10).intdigest() for b in range(256)]
    out, begin = {}, 0
    while begin < len(raw):
        end = len(raw)
        for at in range(begin + 16, min(begin + 256, len(raw)) + 1):  # at: bytes before the cut
            if at == begin + 256:
                end = at
                break
            h = sum(gear[raw[at - 1 - back]] << back for back in range(16) if at - 1 - back >= 0) % (1 << 32)
            if len(raw) - begin > 16 and h >> (32 - 7 if at - begin <= 64 else 32 - 4) == 0:
                end = at
                break
        out.setdefault(xxhash.xxh64_hexdigest(raw[begin:end])[:12], end - begin)
        begin = end
    return out


def brute(rows):
    spell = lambda c: ",".join(f"{d}:{n}" for d, n in c.items())
    share = lambda a, b: sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else float(not b)
    out = {}
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        own, new, then = (slow_chunks(x.encode()) for x in (t, e, after))
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), spell(own), spell(new), share(own, new), share(own, then))
    return out


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=1500), st.integers(0, 10**6).map(lambda n: np.random.default_rng(n).integers(97, 102, n % 3000, dtype=np.uint8).tobytes())))
def test_chunker_equals_the_byte_loop(raw):
    assert C.chunks(raw) == slow_chunks(raw)


def test_rows_of_one_key_are_several_ranges(spark):
    rows = [(None, f"text {n} " * 9) for n in range(300)] + [(4, f"more {n} " * 9) for n in range(300)] + [(n, f"own {n}") for n in range(100, 160)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    few, many = (sorted(map(str, P.compare_with_next(d, parts=n).collect())) for n in (1, 40))
    assert few == many and len(few) == len(rows)
    down, tie = np.zeros(900, dtype=np.int64), np.arange(900)
    at = P.range_of(down, tie, (np.zeros(8, dtype=np.int64), np.arange(100, 900, 100)))
    assert np.bincount(at).tolist() == [100] * 9


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_chunks_join_to_the_whole(raw):
    ends = C.ends(raw)
    assert (ends[-1] if ends else 0) == len(raw) and ends == sorted(set(ends))
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert all(n <= C.most for n in sizes) and all(n >= C.least for n in sizes[:-1])


def test_shift_resistance():
    import random

    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(800))
    own = C.chunks(text.encode())
    assert P.containment(own, C.chunks(("some words ahead " + text).encode())) > 0.97
    assert P.containment(own, C.chunks(text[::-1].encode())) < 0.05
    assert P.containment(own, own) == 1 and P.containment({}, {}) == 1 and P.containment({}, own) == 0


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_next_row_across_ranges(spark, parts):
    rows = [(n * 7 % 101, f"document {n} " * (n % 30)) for n in range(101)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in P.compare_with_next(d, parts=parts).collect()}
    assert got == brute(sorted(rows, reverse=True))


def test_edges(docs, none):
    rows = P.compare_with_next(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r[0]: r for r in rows}
    assert by[3]["n_chars"] == 0 and by[3]["fingerprint"] == ""
    assert by[1]["fingerprint"] == by[6]["fingerprint"]
    assert P.compare_with_next(none).count() == 0
    assert P.fingerprint(docs).count() == len(ROWS)
    one = P.compare_with_next(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(((r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    assert {r[0]: tuple(r)[1:] for r in queries.op10_fingerprints(spark, sf).collect()} == brute(rows)
