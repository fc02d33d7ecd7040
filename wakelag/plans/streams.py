"""Queries over stateful streams: several micro-batches, rows out of order and late, a restart. Importing it adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wakelag.functions import columns as c
from wakelag.operators import quality, quotes
from wakelag.plans import catalogue as k, view as v
from wakelag.plans.catalogue import query, r6
from wakelag.session import folder
from wakelag.sources import tables
from wakelag.streaming import stateful

BLOCKS = 6


def _dealt(d: DataFrame, block: Column, at: str, blocks: range) -> None:
    """One file a block, written one after another, so that a stream reads them in this order."""
    for n in blocks:
        d.where(block == n).coalesce(1).write.mode("append").parquet(at)


def _source(spark: SparkSession, d: DataFrame, at: str) -> DataFrame:
    """A stream that takes one file a batch."""
    return spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(at)


def _block() -> Column:
    """Blocks of five days."""
    return F.least(F.floor((F.dayofmonth("ts") - 1) / 5), F.lit(BLOCKS - 1))


def _unordered() -> Column:
    """The same, but every third row a block later, and some of the first week in the last one, long after the watermark."""
    late = (F.col("event_id") % 100 == 7) & (F.dayofmonth("ts") <= 8)
    return F.when(late, BLOCKS - 1).otherwise(F.least(_block() + (F.col("event_id") % 3 == 0).cast("int"), F.lit(BLOCKS - 1)))


@query(f"""WITH {v.Q}, m AS (SELECT max(ts) - INTERVAL 7 DAY AS mark FROM q WHERE NOT (event_id % 100 = 7 AND day(ts) <= 8))
 SELECT symbol, epoch_us(hour) * 1000 AS ts_ns, seq, round(bid_price, 6) AS bid_price FROM q, m WHERE hour < date_trunc('hour', mark) AND NOT (event_id % 100 = 7 AND day(ts) <= 8) QUALIFY row_number() OVER (PARTITION BY symbol, hour ORDER BY seq DESC) = 1""")
def stream_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an hour's rows of a symbol the last by sequence, over six batches with rows out of order; given out when
    the watermark has passed, rows later than that left out."""
    q = v.quotes(spark, sf_dir).select("symbol", F.col("ts").alias("at"), F.col("hour").alias("ts"), "seq", "bid_price", "ask_price", "bid_qty", "ask_qty", _unordered().alias("block"))
    at = folder(spark, "stream")
    _dealt(q, F.col("block"), at, range(BLOCKS))
    out = stateful.keep_last(_source(spark, q, at), v.KEYS, late="7 days", by="1 day")
    stateful.run_to_end(out, stateful.once_a_batch(f"{at}-out"), f"{at}-state")
    d = spark.read.schema(out.schema).parquet(f"{at}-out")
    mark = q.where(~((F.col("seq") % 100 == 7) & (F.dayofmonth("at") <= 8))).agg((F.max("at") - F.expr("INTERVAL 7 DAY")).alias("mark"))
    d = d.join(F.broadcast(mark), F.col("ts") < F.date_trunc("hour", "mark"))  # a table of one row
    return d.select("symbol", c.epoch_ns(F.col("ts")).alias("ts_ns"), "seq", r6("bid_price", "bid_price"))


def _gaps(d: DataFrame) -> DataFrame:
    d = stateful.gap_levels(d, v.KEYS).where("gap_max_ms IS NOT NULL OR zero_ret_count >= 0")
    return d.select("symbol", F.col("file").cast("string").alias("file"), *[r6(n, n) for n in (*quality.GAPS, "gap_max_ms")], "zero_ret_count", "ret_count")


@query(f"WITH {v.Q}, {k._SEG}, {v.enriched('e', 's')}, l AS (SELECT symbol, file, price, {k._LAGGED} FROM e WHERE is_clean WINDOW w AS (PARTITION BY symbol, segment ORDER BY ts)) {k._GAPS} FROM l GROUP BY symbol, file")
def stream_carried_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan carries from file to file, kept in state over six batches and cleared by excluded hours, which a join of
    the stream with a table brings in."""
    q, at = v.quotes(spark, sf_dir), folder(spark, "stream")
    rows = q.select("symbol", "file", "hour", "ts", "seq", "bid_price", "ask_price", "bid_qty", "ask_qty")
    _dealt(rows, _block(), at, range(BLOCKS))
    live = quality.segments(_source(spark, rows, at), v.KEYS, v.excluded(q))
    out = stateful.carried(quotes.enrich(live).where("is_clean").withColumn("place", F.unix_micros("ts")), v.KEYS, "place")
    stateful.run_to_end(out, stateful.once_a_batch(f"{at}-out"), f"{at}-state")
    return _gaps(spark.read.schema(out.schema).parquet(f"{at}-out"))


@query(f"WITH {v.Q}, {v.enriched()}, l AS (SELECT symbol, file, price, {k._LAGGED} FROM e WHERE is_clean WINDOW w AS (PARTITION BY symbol ORDER BY ts)) {k._GAPS} FROM l GROUP BY symbol, file")
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: a stream stops after three files, loses the record that its last batch was done, starts again from its checkpoint, repeats that
    batch and goes on to the end; the sink takes each batch once."""
    q, at = v.quotes(spark, sf_dir), folder(spark, "stream")
    rows = q.select("symbol", "file", "ts", "seq", "bid_price", "ask_price", "bid_qty", "ask_qty")
    _dealt(rows, _block(), at, range(3))
    clean = quotes.enrich(_source(spark, rows, at)).where("is_clean").withColumns({"segment": F.lit(0), "place": F.unix_micros("ts")})
    out, seen = stateful.carried(clean, v.KEYS, "place"), []
    sink = stateful.once_a_batch(f"{at}-out")

    def noted(df: DataFrame, batch: int) -> None:
        seen.append(batch)
        sink(df, batch)

    last = stateful.run_to_end(out, noted, f"{at}-state")
    tables.remove(spark, f"{at}-state/commits/{last}")
    _dealt(rows, _block(), at, range(3, BLOCKS))
    stateful.run_to_end(out, noted, f"{at}-state")
    if seen.count(last) != 2 or len(set(seen)) != BLOCKS:
        raise RuntimeError(f"batches ran as {seen}")
    return _gaps(spark.read.schema(out.schema).parquet(f"{at}-out"))
