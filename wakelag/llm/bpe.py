"""Operator 1: byte-level BPE encoding and decoding with a local rank file.

Texts are cut at safe boundaries before they reach the tokenizer, so that no call sees more than a
bounded piece of a very long text; the ids of the pieces, put together, are those of the whole text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from wakelag.llm.common import arrow_map, plain, with_fields

#: Code points that one call of the tokenizer sees, if the text has a safe boundary there.
PIECE = 1 << 16
#: A letter or digit, then a blank or line feed: no match of the pre-splitting pattern holds both, since
#: white space only opens a match or fills it, and what ends before it does not look past it.
_SAFE = re.compile(r"(?<=[^\W_])(?=[ \n])")


def read_ranks(path: str) -> bytes:
    """The rank file as bytes (of fixed size, under a few MB); executors get them with the closure."""
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=4)
def _encoding(digest: str, pattern: str, ranks: _Ranks):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.raw.splitlines()) }
    return tiktoken.Encoding(digest, pat_str=pattern, mergeable_ranks=table, special_tokens={})


class _Ranks:
    """Bytes that hash by digest, so that a worker builds each tokenizer once."""

    def __init__(self, raw: bytes):
        self.raw, self.digest = raw, hashlib.sha256(raw).hexdigest()

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Ranks) and self.digest == other.digest


class Codec:
    """Encodes text to ids and ids to raw bytes; small enough to travel with a task."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks, self.pattern = _Ranks(ranks), pattern

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        return cls(read_ranks(path), pattern)

    @property
    def _own(self):
        return _encoding(self.ranks.digest, self.pattern, self.ranks)

    def encode(self, text: str | None, piece: int = PIECE) -> np.ndarray:
        own = self._own
        parts = [np.asarray(own.encode_ordinary(x), dtype=np.int32) for x in split_safely(text or "", piece)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self._own.decode_bytes(ids.tolist())


def split_safely(text: str, piece: int = PIECE) -> list[str]:
    """text in parts of about `piece` code points, cut only where the pattern's matches are unaffected.

    Where a stretch has no safe boundary the part is longer; nothing is ever cut elsewhere.
    """
    out, begin = [], 0
    while len(text) - begin > piece:
        found = _SAFE.search(text, begin + piece)
        if not found:
            break
        out.append(text[begin : found.start()])
        begin = found.start()
    out.append(text[begin:])
    return out


def list_column(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))


def encode_decode(df: DataFrame, codec: Codec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: `key`, `ids` (array of int) and `decoded` (the raw bytes of the ids).

    A null text counts as empty: no ids, no bytes. Repeated rows each give a row; an empty table gives
    none; other columns of df, whatever their names, are not read.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [codec.encode(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), list_column(ids), pa.array([codec.decode(x) for x in ids], type=pa.binary())], ["key", "ids", "decoded"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = arrow_map(rows, step, with_fields([rows.schema["key"]], ids=ArrayType(IntegerType()), decoded=BinaryType()), "text")
    return out.withColumnRenamed("key", key)


def encode(df: DataFrame, codec: Codec, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column `ids` (array of int); a null text gives an empty array. Row order and count stay."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = list_column([codec.encode(x) for x in batch.column(at).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "ids"])

    names = [x for x in df.columns if x != ids]
    at, rows = names.index(text), plain(df, names)
    return arrow_map(rows, step, with_fields(rows.schema.fields, ids=ArrayType(IntegerType())), f"c{at}").toDF(*names, ids)


def decode(df: DataFrame, codec: Codec, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a binary column `out`: the raw bytes of the ids, also where they are no valid UTF-8; null ids give null."""

    def step(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([None if y is None else codec.decode(np.asarray(y, dtype=np.int32)) for y in x.to_pylist()], type=pa.binary())

    step.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, F.arrow_udf(step, "binary")(F.col(ids)))


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of `encode_decode`'s result."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def default_codec(name: str = "byte_bpe_multi_50k.tiktoken", spark: SparkSession | None = None) -> Codec:
    """The codec of a rank file of the installed public tokenizers."""
    import public_tokenizers

    return Codec.from_file(public_tokenizers.path(name), public_tokenizers.PATTERN)
