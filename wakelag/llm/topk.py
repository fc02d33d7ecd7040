"""Operator 4: exact top-k inner-product search by distributed histogram selection.

Every candidate is scored against a block of queries. Global histograms of the scores locate, for each
query, the bucket that holds the k-th best one; that bucket is refined until the k-th value is known. A last
pass keeps the scores that reach it and breaks ties by the smaller id. What a task sends is bounded by k a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wakelag.llm.common import scratch

#: Bytes of a block of queries, as doubles: what is collected and sent to the tasks at a time.
QUERY_BYTES = 8 << 20
#: Bytes of a block's histograms: what a task holds of them.
HISTOGRAM_BYTES = 64 << 20
#: Buckets of a histogram.
BUCKETS = 1024
#: Scores are longs; whole doubles are exact below 2**53.
LONGEST, EXACT = (1 << 63) - 1, float(1 << 53)


def usable(vector: Column) -> Column:
    """No null and no component that is null or not finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _whole(x: Column, scale: float) -> Column:
    """floor(scale * x) as a double; from 2**53 on every double is whole, also beyond the range of a long."""
    y = x.cast("double") * scale
    return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)


class _Block:
    """A block of queries of one dimension and, for each, the score range still in question."""

    def __init__(self, keys: np.ndarray, matrix: np.ndarray, k: int, scale: float, bound: float):
        order = np.argsort(keys, kind="stable")
        self.keys, self.matrix, self.k, self.scale, self.bound = keys[order], matrix[order], k, scale, bound
        top = min(int(bound) + 1, LONGEST) if bound < 2.0**63 else LONGEST
        self.width = 1
        while self.width * BUCKETS < 2 * top:
            self.width *= 2
        self.span = BUCKETS  # buckets of the range in question; a refined one may have fewer
        self.low = np.full(len(keys), -top, dtype=np.int64)
        self.above = np.zeros(len(keys), dtype=np.int64)
        self.kept = np.full(len(keys), np.iinfo(np.int64).max)

    def scores(self, keys: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Integer scores (candidates x queries) and a mask of the pairs that count."""
        counts = np.ones((len(keys), len(self.keys)), dtype=bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        own = np.flatnonzero(self.keys[at] == keys)
        counts[own, at[own]] = False
        c = np.floor(self.scale * vectors.astype(np.float64))
        if self.bound < EXACT:  # every partial sum is exact
            return (c @ self.matrix.T).astype(np.int64), counts
        whole = np.array([[int(x) for x in r] for r in c], dtype=object).reshape(c.shape) @ np.array([[int(x) for x in r] for r in self.matrix], dtype=object).reshape(self.matrix.shape).T
        if any(abs(x) > LONGEST for x in whole[counts]):
            raise OverflowError("an inner product of the vectors is beyond the range of a long")
        whole[~counts] = 0
        return whole.astype(np.int64), counts

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        dim, step = self.matrix.shape[1], max(1, (2 << 20) // max(1, len(self.keys)))
        for batch in batches:
            vectors = batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((batch.num_rows, 0))
            keys = batch.column(0).to_numpy()
            for at in range(0, len(keys), step):
                yield keys[at : at + step], *self.scores(keys[at : at + step], flat[at : at + step])

    def histograms(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(self.keys)
        held = np.zeros(n * BUCKETS, dtype=np.int64)
        for _, s, counts in self.batches(batches):
            # differences of longs without a sign, so none passes the range
            off = (s.view(np.uint64) - self.low.view(np.uint64)) // np.uint64(self.width)
            counts &= (s >= self.low) & (off < self.span)
            off = np.minimum(off, BUCKETS).astype(np.int64)
            held += np.bincount((off + np.arange(n) * BUCKETS)[counts], minlength=n * BUCKETS)
        held = held.reshape(n, BUCKETS)[:, ::-1]
        # a bucket below this task's own k-th best can't hold the k-th best of all
        needed = (np.cumsum(held, axis=1) - held < self.k) & (held > 0)
        q, b = np.nonzero(needed)
        yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int32()), "bucket": pa.array(BUCKETS - 1 - b, pa.int32()), "n": pa.array(held[q, b], pa.int64())})

    def refine(self, found: list) -> None:
        """found: for each query in doubt (q, bucket, count in it, count above it)."""
        seen = np.zeros(len(self.keys), dtype=bool)
        for q, bucket, n, higher in found:
            self.low[q] += bucket * self.width
            self.kept[q] = self.above[q] + higher + n
            self.above[q] += higher
            seen[q] = True
        self.kept[~seen] = 0  # fewer candidates than k: all stay, the lower bound as it is
        # the lower bound is the k-th value, or splits the k best off from the rest
        self.done = self.width == 1 or bool((self.kept <= self.k).all())
        if not self.done:
            finer = max(1, self.width // BUCKETS)
            self.width, self.span = finer, self.width // finer

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """This task's rows that reach the bound of their query. Beyond the k best these are ties for the k-th
        value only; of them a task passes on the smallest ids, at most k rows a query."""
        held = [np.zeros(0, dtype=np.int64)] * 3
        for keys, s, counts in self.batches(batches):
            c, q = np.nonzero(counts & (s >= self.low))
            held = [np.concatenate(x) for x in zip(held, (q, keys[c], s[c, q]), strict=True)]
            order = np.lexsort((held[1], -held[2], held[0]))
            held = [x[order] for x in held]
            starts = np.searchsorted(held[0], held[0], side="left")
            held = [x[np.arange(len(starts)) - starts < self.k] for x in held]
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(self.keys[held[0]], pa.int64()), "vec_id": pa.array(held[1], pa.int64()), "score": pa.array(held[2], pa.int64())})


def top_k(df: DataFrame, asks: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, query_bytes: int = QUERY_BYTES, histogram_bytes: int = HISTOGRAM_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row of df that `asks` marks.

    Scores are inner products of floor(scale * component), exact; one beyond the range of a long raises
    OverflowError. Rows with a null id, and unusable vectors (see `usable`), take no part. A candidate is
    every row of another id and the query's dimension; repeated rows count one by one. Of query rows with
    one id the smallest vector asks. Queries are taken in blocks that are bounded in bytes and in
    histograms; a block's result is written to the shared folder. Candidates are never moved: a pass reads
    them once a block, and the block's products with them cost far more than that.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), asks.alias("asks"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + _whole(x, scale) * _whole(x, scale))
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count_if("asks").alias("n"), F.max(F.sqrt(square)).alias("norm")).where("n > 0").collect()
    ask = rows.where("asks").groupBy("key").agg(F.min("vector").alias("vector"))
    schema, folder, written = "query_id long, vec_id long, score long", scratch(spark, "top-k"), 0
    for dim, n, norm in sorted(sizes):
        most = max(1, min(query_bytes // (8 * max(1, dim)), histogram_bytes // (8 * BUCKETS)))
        blocks = -(-n // most)
        for b in range(blocks):
            mine = ask.where((F.size("vector") == dim) & (F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)).toArrow()
            if not mine.num_rows:
                continue
            flat = np.concatenate([np.zeros(0), *[x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for x in mine.column(1).chunks]])
            block = _Block(mine.column(0).to_numpy(), np.floor(scale * flat).reshape(mine.num_rows, dim), k, scale, norm * norm * (1 + 1e-9) + dim)
            there = rows.where(F.size("vector") == dim).select("key", "vector")
            while True:
                sums = there.mapInArrow(block.histograms, "q int, bucket int, n long").groupBy("q", "bucket").agg(F.sum("n").alias("n"))
                down = W.partitionBy("q").orderBy(F.col("bucket").desc())
                above = spark.createDataFrame([(i, int(x)) for i, x in enumerate(block.above)], "q int, above long")  # a row a query of the block
                sums = sums.withColumn("higher", F.sum("n").over(down) - F.col("n")).join(F.broadcast(above), "q")
                block.refine(sums.where((F.col("above") + F.col("higher") < k) & (F.col("above") + F.col("higher") + F.col("n") >= k)).select("q", "bucket", "n", "higher").collect())
                if block.done:
                    break
            there.mapInArrow(block.best, schema).write.parquet(f"{folder}/block={written}")
            written += 1
    out = spark.read.schema(schema).parquet(*[f"{folder}/block={n}" for n in range(written)]) if written else spark.createDataFrame([], schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
