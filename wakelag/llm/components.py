"""Connected components of links between integer ids, by local forests and alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wakelag.llm.common import drop, kept, scratch

#: Links that a task contracts at a time: what it holds in memory.
CHUNK = 2_000_000


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id reached) of the links (u, v), by hooking to smaller neighbours and halving paths."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(ids))
    while True:
        x, y = up[a], up[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return ids, ids[up]
        np.minimum.at(up, high, low)
        while True:
            further = up[up]
            if (further == up).all():
                break
            up = further


def forest(links: DataFrame) -> DataFrame:
    """links (u, v) contracted where they stand: of each chunk of a partition one row (u, v) for each id but
    the smallest of what its links join. Nothing is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def put() -> pa.RecordBatch:
            ids, low = _roots(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
            held.clear()
            child = ids != low
            return pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(low[child])], ["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x[0]) for x in held) >= CHUNK:
                yield put()
        if held:
            yield put()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) for the ids of links (a, b): the smallest id that links reach.

    Links are first contracted within their partitions. Then, until every tree is a star, each id's larger
    neighbours are sent to the smallest of its neighbourhood, its smaller ones to their smallest, and what
    comes out is contracted again. Ids without links have no row; nulls and links of an id with itself are
    left out. Each round is written to the shared folder, the one before it removed; the driver sees but
    whether anything is open.
    """
    spark = links.sparkSession
    root = scratch(spark, "components")
    edges = kept(forest(links.where("a is not null and b is not null and a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))), f"{root}/edges-0")
    for n in range(rounds):
        # a row an id: the smallest of it and its neighbours, and whether it has smaller ones, several of them,
        # and larger ones. Rows are summed up before the exchange, so an id with many neighbours is a row a task
        child = edges.select("u", "v", F.lit(True).alias("child"))
        sides = child.unionByName(edges.select(F.col("v").alias("u"), "v", F.lit(False).alias("child")))
        below = F.when(F.col("child"), F.col("v"))
        near = sides.groupBy("u").agg(F.min("v").alias("m"), F.bool_or("child").alias("child"), (F.min(below) != F.max(below)).alias("many"), (~F.every("child")).alias("up"))
        near = kept(near, f"{root}/near-{n}")
        if near.where("many OR (child AND up)").isEmpty():
            drop(spark, f"{root}/edges-{n}")
            return near.select(F.col("u").alias("id"), F.col("m").alias("label"))
        # roots keep their links as they are; the rest of `near` is what links are looked up in
        inner = near.where("up AND m < u").select(F.col("u").alias("v"), "m")
        large = edges.join(inner, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = kept(forest(small), f"{root}/edges-{n + 1}")
        drop(spark, f"{root}/edges-{n}", f"{root}/near-{n}")
    raise RuntimeError("components did not settle")
