"""Operator 7 (native): mixing sources to target weights by Sainte-Laguë apportionment.

Target sizes become whole numbers of equal-token blocks: first by source, then by shard of a source, each
time to the highest quotients weight / (2k - 1). Within a shard the documents stand in seeded order on a
ring of tokens; the quota is a run of consecutive blocks from a seeded block on, round the ring as often
as it takes. No source meets in one task: its shards do the work, and only sums per shard meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wakelag.llm.common import WORD, cut

#: Tokens of a block at most. A block has a FINENESS-th of the smallest target, so that a small source's quota is
#: as true to its target as a large one's.
BLOCK, FINENESS = 16, 64
#: Documents of a shard, about, and rows alike that stand together at most.
SHARD_ROWS = 1024
#: Sources up to which their table is sent to every task; more are joined in SALT places each.
FEW_SOURCES, SALT = 20_000, 64
SEED = 20240
CYCLE = (1, 2, 3)
REPEATS = 3


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def seeded(seed: int, *parts: Column) -> Column:
    """A hash in hexadecimal that any SQL engine can form; null parts count as the word null."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))


def number(hexed: Column) -> Column:
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")


def water_level(by_source: DataFrame, source: str, repeats: int = REPEATS, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """by_source (source, source_size) with weight and target: the whole by weight, none above `repeats`
    times its size, the excess reshared. The level is the largest that any number of full sources gives."""
    place = W.orderBy(F.col(source).asc_nulls_last())
    out = by_source.withColumn("place", F.row_number().over(place))
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), ((F.col("place") - 1) % len(cycle) + 1).cast("int")))
    out = out.withColumn("ceiling", F.col("source_size") * repeats)
    fill = W.orderBy(F.col("ceiling") / F.col("weight"), "place")
    everyone = W.partitionBy(F.lit(0))
    full = F.coalesce(F.sum("ceiling").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing))
    out = out.withColumn("total", F.sum("source_size").over(everyone)).withColumn("level", (F.col("total") - full).cast("double") / open_)
    out = out.withColumn("level", F.max("level").over(everyone))
    return out.withColumn("target", F.least(F.col("ceiling").cast("double"), F.col("weight") * F.col("level")))


def apportion(items: DataFrame, within: list[Column], order: list[Column], weight: str, seats: str, quota: str) -> DataFrame:
    """items with `quota`: the seats of each group by Sainte-Laguë. Items that surely win keep a base from a
    divisor that is too large by half a seat an item; only the last few quotients are compared."""
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    w, s = F.col(weight).cast("double"), F.col(seats)
    d = items.withColumn("__w", F.sum(w).over(group)).withColumn("__n", F.count(F.when(w > 0, 1)).over(group))
    share = lambda more: F.floor(w * (s + more) / F.col("__w") + 0.5)
    live = (w > 0) & (s > 0)
    d = d.withColumn("__base", F.when(live & (s > F.col("__n") / 2), F.greatest(share(-F.col("__n") / 2) - 1, F.lit(0))).otherwise(0))
    d = d.withColumn("__top", F.when(live, share(F.col("__n") / 2) + 1).otherwise(0))
    d = d.withColumn("__left", s - F.sum("__base").over(group))
    d = d.withColumn("__k", F.explode(F.when(F.col("__top") > F.col("__base"), F.sequence(F.col("__base") + 1, F.col("__top"))).otherwise(F.array(F.lit(0).cast("long")))))
    d = d.withColumn("__q", F.when(F.col("__k") > 0, w / (2 * F.col("__k") - 1)))
    rank = F.row_number().over(group.orderBy(F.col("__q").desc_nulls_last(), *order, "__k"))
    d = d.withColumn("__won", F.when(F.col("__q").isNotNull() & (rank <= F.col("__left")), 1).otherwise(0))
    return d.groupBy(*items.columns).agg((F.first("__base") + F.sum("__won")).alias(quota))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = SEED, repeats: int = REPEATS, cycle: tuple[int, ...] = CYCLE, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: key, size, source_size, target, taken, source, and the columns `more`.

    Null or wordless texts have size 0 and nothing is taken of them. A null source is a source of its own,
    last in order. Rows that repeat take part one by one, next to each other; ties in seeded order fall to the
    smaller key, size and `more`, so reruns agree. An empty table gives none; other columns of df are not
    read. A block has `block` words at most, fewer where a source's target is small.
    """
    docs = df.select(F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"), *more)
    # rows alike in all of this are one row with their number, cut up so that no many stand in one place
    docs = docs.groupBy("key", "source", "size", *more).agg(F.count("*").alias("n"))
    docs = docs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("n") - 1, F.lit(shard_rows)))))
    docs = cut(docs.withColumn("n", F.least(F.col("n") - F.col("piece") * shard_rows, F.lit(shard_rows))))
    by_source = water_level(docs.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows")), "source", repeats, cycle)
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(W.partitionBy(F.lit(0)))
    by_source = by_source.withColumn("block", F.greatest(F.least(F.lit(block), F.floor(F.coalesce(smallest, F.lit(0.0)) / FINENESS)), F.lit(1)).cast("long"))
    by_source = by_source.withColumn("seats", F.floor(F.col("total") / F.col("block"))).withColumn("shards", F.ceil(F.col("rows") / shard_rows))
    by_source = apportion(by_source, [], [F.col("place")], "target", "seats", "blocks").select(F.col("source").alias("of"), "source_size", "target", "block", "blocks", "shards")
    by_source = cut(by_source)

    order = seeded(seed, F.col("key"), F.col("size"), F.col("piece"))
    placed = with_source(docs, by_source).withColumn("order", order).withColumn("shard", F.pmod(number(F.col("order")), F.col("shards")))
    shards = placed.groupBy("of", "shard", "source_size", "target", "block", "blocks").agg(F.sum(F.col("size") * F.col("n")).alias("shard_size"))
    shards = apportion(shards, [F.col("of")], [F.col("shard")], "shard_size", "blocks", "quota")
    tokens = F.least(F.col("quota") * F.col("block"), F.col("shard_size") * repeats)
    full = F.when(F.col("shard_size") > 0, F.floor(tokens / F.col("shard_size"))).otherwise(0)
    shards = shards.select(
        F.col("of").alias("__of"), F.col("shard").alias("__shard"), "shard_size",
        full.alias("rounds"), (tokens - full * F.col("shard_size")).alias("run"),
        (F.when(F.col("shard_size") > 0, F.pmod(number(seeded(seed, F.col("of"), F.col("shard"))), F.ceil(F.col("shard_size") / F.col("block")))).otherwise(0) * F.col("block")).alias("first"),
    )
    ring = W.partitionBy("of", "shard").orderBy("order", "key", "size", "piece", *more).rowsBetween(W.unboundedPreceding, W.currentRow)
    docs = placed.withColumn("at", F.sum(F.col("size") * F.col("n")).over(ring) - F.col("size") * F.col("n"))
    docs = docs.join(shards, docs["of"].eqNullSafe(F.col("__of")) & (docs["shard"] == F.col("__shard")))
    docs = docs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    end, stop = F.col("at") + F.col("size"), F.col("first") + F.col("run")
    over = F.greatest(F.least(end, stop) - F.greatest(F.col("at"), F.col("first")), F.lit(0)) + F.greatest(F.least(end, stop - F.col("shard_size")) - F.col("at"), F.lit(0))
    taken = (F.col("rounds") * F.col("size") + over).cast("long")
    return docs.select(F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"), F.col("of").alias(source), *more)


def with_source(docs: DataFrame, by_source: DataFrame, few: int = FEW_SOURCES) -> DataFrame:
    """docs with the row of their source. The table of sources is sent to every task if it has `few` rows or
    fewer; else each source stands in SALT places, so that the rows of a hot one are as many tasks' work."""
    if by_source.limit(few + 1).count() <= few:
        return docs.join(F.broadcast(by_source), docs["source"].eqNullSafe(by_source["of"]))
    salted = by_source.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    docs = docs.withColumn("__d", F.pmod(F.xxhash64("key", "size", "piece"), F.lit(SALT)))
    return docs.join(salted, docs["source"].eqNullSafe(salted["of"]) & (docs["__d"] == salted["__s"])).drop("__s", "__d")


def oracle(block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = SEED, documents: str = "documents", tail: str | None = None) -> str:
    """The same mix in DuckDB SQL."""

    def seats(frm: str, part: str, order: str, w: str, s: str, keep: str, out: str) -> str:
        return f"""{out}_a AS (SELECT *, sum(CAST({w} AS DOUBLE)) OVER g AS w_, count(*) FILTER (WHERE {w} > 0) OVER g AS n_ FROM {frm} WINDOW g AS (PARTITION BY {part})),
{out}_b AS (SELECT *, CASE WHEN {w} > 0 AND {s} > 0 AND {s} > n_ / 2.0::DOUBLE THEN greatest(CAST(floor(CAST({w} AS DOUBLE) * ({s} - n_ / 2.0::DOUBLE) / w_ + 0.5::DOUBLE) AS BIGINT) - 1, 0) ELSE 0 END AS base_,
  CASE WHEN {w} > 0 AND {s} > 0 THEN CAST(floor(CAST({w} AS DOUBLE) * ({s} + n_ / 2.0::DOUBLE) / w_ + 0.5::DOUBLE) AS BIGINT) + 1 ELSE 0 END AS top_ FROM {out}_a),
{out}_c AS (SELECT *, {s} - sum(base_) OVER (PARTITION BY {part}) AS left_, unnest(CASE WHEN top_ > base_ THEN range(base_ + 1, top_ + 1) ELSE [0] END) AS k_ FROM {out}_b),
{out}_d AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY CASE WHEN k_ > 0 THEN CAST({w} AS DOUBLE) / (2 * k_ - 1) END DESC NULLS LAST, {order}, k_) AS r_ FROM {out}_c),
{out} AS (SELECT {keep}, CAST(any_value(base_) + count(*) FILTER (WHERE k_ > 0 AND r_ <= left_) AS BIGINT) AS quota FROM {out}_d GROUP BY {keep})"""

    hexed = lambda *x: f"md5(concat_ws(':', '{seed}', {', '.join(f'coalesce(CAST({y} AS VARCHAR), {chr(39)}null{chr(39)})' for y in x)}))"
    num = lambda x: f"CAST('0x' || substr({x}, 1, 8) AS BIGINT)"
    final = tail or "SELECT key AS doc_id, size, source_size, target, taken, source FROM mixed"
    return f"""WITH raw AS (SELECT doc_id AS key, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {documents}),
alike AS (SELECT key, source, size, count(*) AS n_all FROM raw GROUP BY ALL),
docs AS (SELECT *, least({shard_rows}, n_all - piece * {shard_rows}) AS n FROM (SELECT *, unnest(range(0, (n_all - 1) // {shard_rows} + 1)) AS piece FROM alike)),
s0 AS (SELECT source, CAST(sum(size * n) AS BIGINT) AS source_size, CAST(sum(n) AS BIGINT) AS n_rows FROM docs GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s0),
s2 AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS ceiling_, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s1),
s3 AS (SELECT *, CAST(total - coalesce(sum(ceiling_) OVER (ORDER BY ceiling_ / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / sum(weight) OVER (ORDER BY ceiling_ / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_ FROM s2),
s4 AS (SELECT *, least(CAST(ceiling_ AS DOUBLE), weight * max(level_) OVER ()) AS target, CAST(ceil(n_rows / {shard_rows}) AS BIGINT) AS shards FROM s3),
s5 AS (SELECT *, CAST(greatest(least({block}, floor(coalesce(min(CASE WHEN target > 0 THEN target END) OVER (), 0) / {FINENESS})), 1) AS BIGINT) AS block FROM s4),
s6 AS (SELECT *, CAST(floor(total / block) AS BIGINT) AS seats FROM s5),
{seats("s6", "1", "place", "target", "seats", "source, source_size, target, block, shards", "s7")},
placed AS (SELECT d.key, d.source, d.size, d.n, d.piece, source_size, target, block, quota AS blocks, {hexed("d.key", "d.size", "d.piece")} AS ord, {num(hexed("d.key", "d.size", "d.piece"))} % shards AS shard FROM docs d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source),
h0 AS (SELECT source, shard, block, blocks, CAST(sum(size * n) AS BIGINT) AS shard_size FROM placed GROUP BY ALL),
{seats("h0", "source", "shard", "shard_size", "blocks", "source, shard, block, shard_size", "h1")},
h2 AS (SELECT *, least(quota * block, shard_size * 3) AS tokens FROM h1),
h3 AS (SELECT *, CASE WHEN shard_size > 0 THEN tokens // shard_size ELSE 0 END AS rounds, CASE WHEN shard_size > 0 THEN tokens % shard_size ELSE 0 END AS run_,
  CASE WHEN shard_size > 0 THEN {num(hexed("source", "shard"))} % CAST(ceil(shard_size / block) AS BIGINT) ELSE 0 END * block AS first_ FROM h2),
rings AS (SELECT *, CAST(sum(size * n) OVER (PARTITION BY source, shard ORDER BY ord, key, size, piece ROWS UNBOUNDED PRECEDING) AS BIGINT) - size * n AS start_ FROM placed),
ring AS (SELECT * REPLACE (start_ + copy_ * size AS start_) FROM (SELECT *, unnest(range(0, n)) AS copy_ FROM rings)),
mixed AS (SELECT key, r.source, size, source_size, target, CAST(rounds * size + greatest(least(start_ + size, first_ + run_) - greatest(start_, first_), 0)
  + greatest(least(start_ + size, first_ + run_ - h.shard_size) - start_, 0) AS BIGINT) AS taken FROM ring r JOIN h3 h ON r.source IS NOT DISTINCT FROM h.source AND r.shard = h.shard)
{final}"""
