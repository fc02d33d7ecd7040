"""Operator 10: document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes marks chunk boundaries (FastCDC's normalised form: a strict mask up to
the wanted length, a loose one beyond it), so an insertion moves only the chunks around it. A fingerprint
is the set of chunk digests with their bytes; the bytes of shared digests measure containment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from wakelag.llm.common import cut, text_slices


def _gear() -> np.ndarray:
    """256 pseudo-random 32-bit numbers from a rule: xxh32 of each byte."""
    return np.array([xxhash.xxh32(bytes([i]), seed=10).intdigest() for i in range(256)], dtype=np.uint32)


@dataclass(frozen=True)
class Chunker:
    """Chunks of `least` to `most` bytes, about `wanted` on average. least must reach the hash's window."""

    least: int = 16
    wanted: int = 64
    most: int = 256
    strict_bits: int = 7
    loose_bits: int = 4
    digest_chars: int = 12
    gear: np.ndarray = field(default_factory=_gear, compare=False, repr=False)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """At each byte the sum of gear[byte i back] << i over the window of 16, by doubling."""
        h = self.gear[data]
        for step in (1, 2, 4, 8):
            if len(h) > step:
                h = np.concatenate([h[:step], h[step:] + (h[:-step] << np.uint32(step))])
        return h

    def ends(self, raw: bytes) -> list[int]:
        """Where the chunks of raw end; the last is len(raw)."""
        n = len(raw)
        if n <= self.least:
            return [n] if n else []
        h = self.hashes(np.frombuffer(raw, dtype=np.uint8))
        loose = np.flatnonzero(h >> np.uint32(32 - self.loose_bits) == 0) + 1
        strict = (loose[h[loose - 1] >> np.uint32(32 - self.strict_bits) == 0]).tolist()
        loose = loose.tolist()
        out, at, i, j = [], 0, 0, 0
        strict.append(n + self.most)
        loose.append(n + self.most)
        while n - at > self.least:
            low, mid = at + self.least, at + self.wanted
            while strict[i] < low:
                i += 1
            if strict[i] > mid:
                while loose[j] <= mid:
                    j += 1
                at = min(loose[j], at + self.most, n)
            else:
                at = min(strict[i], n)
            out.append(at)
        if at < n:
            out.append(n)
        return out

    def chunks(self, raw: bytes) -> dict[str, int]:
        """digest -> bytes, in the order in which the digests first occur."""
        out: dict[str, int] = {}
        at = 0
        for end in self.ends(raw):
            out.setdefault(xxhash.xxh64_hexdigest(raw[at:end])[: self.digest_chars], end - at)
            at = end
        return out


def spell(chunks: dict[str, int]) -> str:
    return ",".join(f"{d}:{n}" for d, n in chunks.items())


def containment(own: dict[str, int], other: dict[str, int]) -> float:
    """The share of own's bytes whose chunks other holds; of an empty one 1 in an empty one, else 0."""
    total = sum(own.values())
    return sum(n for d, n in own.items() if d in other) / total if total else float(not other)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much of the next text, or all of that."""
    cut_off = len(text) // 3
    return text[: len(text) - cut_off] + following[:cut_off]


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", chunker: Chunker = Chunker()) -> DataFrame:  # noqa: B008
    """df's key and text (null: empty) with `chunks`, an array of (digest, bytes); rows stay one for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("digest", pa.string()), ("bytes", pa.int32())]))
        for batch in batches:
            for piece in text_slices(batch, "text"):
                made = [[{"digest": d, "bytes": n} for d, n in chunker.chunks((t or "").encode()).items()] for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(made, type=kind)], ["key", "text", "chunks"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, text string, chunks array<struct<digest:string,bytes:int>>")
    return out.withColumnsRenamed({"key": key, "text": text})


_OUT = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: Bytes of text of a range, about; rows of the sample that bounds come from, for each range.
RANGE_BYTES, RANGE_SAMPLE = 64 << 20, 64
_LAST = (1 << 63) - 1


def ranges(rows: DataFrame, parts: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (down, tie), in order, that cut the rows into `parts` ranges of about equally many, from a sample
    of RANGE_SAMPLE rows a range. They only say where ranges begin: any bounds give the same result."""
    if parts <= 1 or not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = rows.select("down", "tie").sample(min(1.0, parts * RANGE_SAMPLE / total), 10).toArrow()
    down, tie = (np.concatenate([np.zeros(0, np.int64), *[x.to_numpy() for x in got.column(i).chunks]]) for i in (0, 1))
    order = np.lexsort((tie, down))
    at = order[np.unique(np.arange(1, parts) * len(order) // parts)] if len(order) else order
    return down[at], tie[at]


def range_of(down: np.ndarray, tie: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each row how many bounds are not above it."""
    low, high = np.searchsorted(bounds[0], down, side="left"), np.searchsorted(bounds[0], down, side="right")
    for d in np.unique(down[high > low]):  # rows whose key is that of a bound go by their tie
        at = np.flatnonzero(down == d)
        a, b = low[at[0]], high[at[0]]
        low[at] = a + np.searchsorted(bounds[1][a:b], tie[at], side="right")
    return low


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text", chunker: Chunker = Chunker(), parts: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:  # noqa: B008
    """Each row's fingerprint against that of its edited text and of the next row by descending key.

    Rows are dealt by ranges of (key, hash of the text), so the next row is mostly in the same task, and rows
    of one key or without a key are many tasks' work; a range's last row meets the first of the next in a
    join of one row a range. Null texts are empty; null keys come last; rows with equal keys follow by the
    hash of their text, so identical rows are each other's next and stand in one task. The row after the last
    is the first; a single row follows itself; an empty table gives no rows. Other columns of df are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "down": F.coalesce(F.bitwise_not("key"), F.lit(_LAST))})
    if parts is None:
        total, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // range_bytes), 1)
    else:
        total = rows.count()
    bounds = ranges(rows, parts, total)

    def part_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for down, tie in batches:
            yield pa.array(range_of(down.to_numpy(), tie.to_numpy(), bounds), type=pa.int32())

    part_of.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    rows = rows.withColumn("part", F.arrow_udf(part_of, "int")(F.col("down"), F.col("tie")))
    order = ["down", "tie", F.col("key").isNull()]
    dealt = rows.repartitionById(len(bounds[0]) + 1, F.col("part")).sortWithinPartitions(*order).select("key", "text")

    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(keys: list, texts: list[str], nexts: list[str], own: list[dict], following: list[dict]) -> pa.RecordBatch:
        raw = [edited(a, b).encode() for a, b in zip(texts, nexts, strict=True)]
        new = [chunker.chunks(x) for x in raw]
        near = [pa.array([containment(a, b) for a, b in zip(own, x, strict=True)], pa.float64()) for x in (new, following)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), *[pa.array(x, pa.string()) for x in ([hashlib.sha256(x).hexdigest() for x in raw], list(map(spell, own)), list(map(spell, new)))], *near], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[list, list[str], list[dict]] = ([], [], [])
        for batch in batches:
            for piece in text_slices(batch, "text", 1 << 20):
                texts = piece.column(1).to_pylist()
                keys, texts, own = last[0] + piece.column(0).to_pylist(), last[1] + texts, last[2] + [chunker.chunks(x.encode()) for x in texts]
                last = keys[-1:], texts[-1:], own[-1:]
                if len(keys) > 1:
                    yield finish(keys[:-1], texts[:-1], texts[1:], own[:-1], own[1:])

    # the first and last row of each range: two rows a range, so their keys are broadcast to find the texts
    place = F.struct(F.col("down"), F.col("tie"), F.col("key").isNull().alias("none"))
    ends = cut(rows.select("part", place.alias("place")).groupBy("part").agg(F.min("place").alias("first"), F.max("place").alias("last")))
    ring = W.orderBy("part")
    ends = ends.withColumn("then", F.coalesce(F.lead("part").over(ring), F.min("part").over(W.partitionBy(F.lit(0)))))
    at = rows.withColumn("place", place)
    one = lambda end: at.join(F.broadcast(ends.select(F.col("part").alias("of"), F.col(end).alias("end"), "then")), (F.col("part") == F.col("of")) & (F.col("place") == F.col("end"))).dropDuplicates(["part"])
    lasts = one("last").select("key", F.col("text").alias("held"), "then")
    firsts = one("first").select(F.col("part").alias("then"), F.col("text").alias("after"))
    joined = lasts.join(firsts, "then").select("key", "held", "after")

    def run_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, nexts = (batch.column(i).to_pylist() for i in range(3))
            own, following = ([chunker.chunks(x.encode()) for x in y] for y in (texts, nexts))
            yield finish(keys, texts, nexts, own, following)

    return dealt.mapInArrow(run, _OUT).unionByName(joined.mapInArrow(run_ends, _OUT)).withColumnRenamed("key", key)
