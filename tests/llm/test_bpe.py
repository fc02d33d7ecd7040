import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from wakelag.llm import bpe, tokencounts

CODEC = bpe.default_codec()


def plain():
    import base64

    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_digests_equal_the_library(docs, none):
    own = plain()
    got = bpe.digests(bpe.encode_decode(docs, CODEC)).collect()
    want = []
    for i, t, *_ in ROWS:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert bpe.digests(bpe.encode_decode(none, CODEC)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'st 1_\n\t é日.!"), max_size=80), st.integers(1, 9))
def test_cuts_change_nothing(text, piece):
    own = plain_cached()
    assert "".join(bpe.split_safely(text, piece)) == text
    assert CODEC.encode(text, piece).tolist() == own.encode_ordinary(text)


_own = []


def plain_cached():
    if not _own:
        _own.append(plain())
    return _own[0]


def test_encode_and_decode_columns(docs):
    d = bpe.decode(bpe.encode(docs.select("doc_id", "text", "ids"), CODEC), CODEC)
    assert d.columns == ["doc_id", "text", "ids", "decoded"]
    for r in d.collect():
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    one = docs.limit(1).select(F.array(F.lit(255)).cast("array<int>").alias("ids"))
    assert bytes(bpe.decode(one, CODEC).first()["decoded"]) == CODEC.decode(np.array([255]))  # bytes that are no text


def test_token_counts_equal_encoding(docs, none):
    got = tokencounts.token_counts(docs, CODEC).select("doc_id", "n_tokens").collect()
    own = plain_cached()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, len(own.encode_ordinary(t or "")))) for i, t, *_ in ROWS)
    assert tokencounts.token_counts(none, CODEC).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_scan_of_flat_files(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = []
    for f in range(3):
        ids = rng.choice([5, 6, tokencounts.EOD], 40 if f else 0).astype("<u2")
        ids.tofile(tmp_path / f"{f}.bin")
        at = [-1, *np.flatnonzero(ids == tokencounts.EOD)]
        want += [(f, n, int(b - a - 1), True) for n, (a, b) in enumerate(zip(at, at[1:]))]
        if len(ids) and at[-1] != len(ids) - 1:
            want.append((f, len(at) - 1, len(ids) - 1 - int(at[-1]), False))
    got = tokencounts.count(tokencounts.find_files(spark, str(tmp_path)), block=block).collect()
    assert sorted((int(r["path"][-5]), r["ordinal"], r["n_tokens"], r["ended"]) for r in got) == sorted(want)


def test_the_files_are_flat_and_the_query_reads_them(spark, docs, tmp_path):
    contents = tokencounts.write_files(docs, CODEC, str(tmp_path)).collect()
    own, texts = plain_cached(), {str(r[0]): r[1] for r in ROWS}
    for path in {r["path"] for r in contents}:
        want = [x for r in sorted((r for r in contents if r["path"] == path), key=lambda r: r["first"]) for k in r["keys"] for x in (*own.encode_ordinary(texts[str(k)] or ""), tokencounts.EOD)]
        assert np.fromfile(path, dtype="<u2").tolist() == want and contents[0]["length"] > 0
    got = tokencounts.count(tokencounts.find_files(spark, str(tmp_path)), block=1000)
    assert sum(r["n_tokens"] for r in got.collect()) == sum(len(own.encode_ordinary(t or "")) for _, t, *_ in ROWS)
    small = tokencounts.token_counts(docs, CODEC, block=64).select("doc_id", "n_tokens").collect()
    assert sorted(map(str, map(tuple, small))) == sorted(str((i, len(own.encode_ordinary(t or "")))) for i, t, *_ in ROWS)


def test_ids_that_do_not_fit_are_refused(spark, tmp_path):
    two = np.dtype("<u2")
    assert tokencounts.checked(np.array([0, 65535]), 50256, two).dtype == two
    for ids in ([65536], [50256], [-1]):
        with pytest.raises(ValueError):
            tokencounts.checked(np.array(ids), 50256, two)
    with pytest.raises(ValueError):
        tokencounts.write_files(spark.range(1).selectExpr("id AS doc_id", "'a' AS text"), CODEC, str(tmp_path), eod=70_000)
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number of ids"):
        tokencounts.count(tokencounts.find_files(spark, str(tmp_path))).collect()
