"""Stateful stream operators by transformWithState: keep-last with event-time timers, carried values of a scan, and a
sink that repeats of a batch do not change.

State lies in RocksDB on the executors and in the query's checkpoint. A batch's rows of one key are sorted in memory; how many these
are the source's trigger options bound (maxFilesPerTrigger, maxBytesPerTrigger).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from wakelag.functions import columns as c
from wakelag.functions.clock import SEQUENCES, dedup_names

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_AT = StructType([StructField("at", LongType())])


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that transformWithState needs, for streams that are started meanwhile."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _rank(value: object) -> tuple:
    """Greatest first as Spark orders descending: no number above all numbers, null below."""
    if value is None:
        return (0,)
    return (2,) if isinstance(value, float) and math.isnan(value) else (1, value)


class KeepLast(StatefulProcessor):
    """Of the rows of one time the last by `order`, given out when the watermark has passed the time."""

    def __init__(self, schema: StructType, ts: str, order: list[str]):
        self.schema, self.ts, self.order = schema, ts, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getMapState("best", _AT, self.schema)

    def _key(self, row: Row) -> tuple:
        return tuple(_rank(row[n]) for n in self.order)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        found: dict[int, Row] = {}
        for row in rows:
            at = row["__at"]
            if at not in found or self._key(row) > self._key(found[at]):
                found[at] = row
        for at, row in found.items():
            new = True
            if self.best.exists() and self.best.containsKey((at,)):
                held = Row(*self.schema.names)(*self.best.getValue((at,)))
                new = self._key(row) > self._key(held)
            if new:
                self.best.updateValue((at,), tuple(row[n] for n in self.schema.names))
        for ms in {at // 1000 + 1 for at in found}:  # first whole millisecond behind a time
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        done = [k[0] for k in self.best.keys() if k[0] // 1000 + 1 == until]
        for at in done:
            yield Row(*self.schema.names)(*self.best.getValue((at,)))
            self.best.removeKey((at,))

    def close(self) -> None:
        pass


def keep_last(quotes: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes", by: str = "1 hour", event: str | None = None) -> DataFrame:
    """The last row of each (keys, ts) of a stream, by sequences, clocks and values as the batch form has it, given out
    once the watermark (`late` behind the latest time of `event`, or ts) has passed it; rows later than that are left out. State is dealt out by keys and slices `by`
    of time: a slice's rows are held until their time has passed."""
    order = dedup_names(quotes.columns)
    typed = quotes.where(F.col(ts).isNotNull()).withColumns({n: F.col(n).try_cast("bigint") for n in order if n in SEQUENCES})
    rows = typed.withWatermark(event or ts, late)
    rows = rows.withColumns({"__at": F.unix_micros(ts), "__slice": F.date_trunc("hour", ts) if by == "1 hour" else F.window(ts, by)["start"]})
    out = StructType([f for f in rows.schema.fields if f.name != "__slice"])
    found = rows.groupBy(*keys, "__slice").transformWithState(KeepLast(out, ts, [*order]), out, "Append", "EventTime")
    return found.drop("__at")


#: What a scan carries from row to row: the latest time of the files before, the file being read, its latest time and
#: the time read last in it, time and price of the last clean row, the segment.
CARRIED = StructType([StructField("before_ns", LongType()), StructField("file", StringType()), StructField("file_ns", LongType()), StructField("input_ns", LongType()), StructField("clean_ns", LongType()), StructField("clean_price", DoubleType()), StructField("segment", LongType())])


class Carried(StatefulProcessor):
    """Each row against what stood before it: whether its time repeats or runs back, and a clean row's gap and whether
    its price is the clean one before. An excluded hour in between (another segment) clears what is carried."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("previous", CARRIED)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        before = file = latest = last = clean = price = segment = None
        if self.held.exists():
            before, file, latest, last, clean, price, segment = self.held.get()
        shape = Row(*self.keys, "file", "repeats", "back", "gap_ms", "unchanged")
        for row in sorted(rows, key=lambda r: (r["segment"], r["file"], r["place"])):
            ns, gap, unchanged = row["ns"], None, None
            if segment != row["segment"]:
                before = file = latest = last = clean = price = None
                segment = row["segment"]
            if file != str(row["file"]):
                before = before if latest is None else latest if before is None else max(before, latest)
                file, latest, last = str(row["file"]), None, None
            seen = last if last is not None else before
            compared = seen is not None and ns is not None
            repeats, back, last = compared and ns == seen, compared and ns < seen, ns
            if ns is not None:
                latest = ns if latest is None else max(latest, ns)
            if row["is_clean"]:
                if clean is not None and ns > clean:
                    gap = (ns - clean) // 1000 / 1000.0
                    unchanged = row["price"] == price if price is not None and price > 0 else None
                clean, price = ns, row["price"]
            yield shape(*key, row["file"], repeats, back, gap, unchanged)
        self.held.update((before, file, latest, last, clean, price, segment))

    def close(self) -> None:
        pass


def carried(quotes: DataFrame, keys: list[str], place: str = "seq") -> DataFrame:
    """A row for each quote of a stream: keys, file, repeats, back, gap_ms, unchanged. quotes: keys, file, segment
    (`quality.segments`, a join of the stream with the table of excluded hours), ts, price, is_clean and `place`,
    the order of a file's rows. Batches must come in the order of segments and files, as a scan reads them."""
    kinds = {f.name: f for f in quotes.schema.fields}
    out = StructType([*[kinds[k] for k in keys], kinds["file"], *[StructField(n, t) for n, t in (("repeats", BooleanType()), ("back", BooleanType()), ("gap_ms", DoubleType()), ("unchanged", BooleanType()))]])
    rows = quotes.select(*keys, "file", F.col("segment").cast("long").alias("segment"), c.epoch_ns(F.col("ts")).alias("ns"), "price", "is_clean", F.col(place).alias("place"))
    return rows.groupBy(*keys).transformWithState(Carried(keys), out, "Append", "None")


def gap_levels(carried_rows: DataFrame, keys: list[str]) -> DataFrame:
    """What `quality.gap_stats` gives, of rows that a stream has written."""
    from wakelag.operators.quality import GAPS, levels

    gap = F.col("gap_ms")
    return carried_rows.groupBy(*keys, "file").agg(
        *levels(gap, gap > 0, GAPS, True), F.max(F.when(gap > 0, gap)).alias("gap_max_ms"), F.count_if("unchanged").alias("zero_ret_count"), F.count("unchanged").alias("ret_count"),
        F.count_if("repeats").alias("duplicate_ts"), F.count_if("back").alias("backward_ts"),
    )


def once_a_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch is written to a folder of its own name, in place of what an earlier try of it left; so a
    batch that is repeated after a failure counts once."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def run_to_end(out: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Runs a stream over all that is there, from where its checkpoint left off; the number of the last batch."""
    with rocksdb(out.sparkSession):
        q = out.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return q.lastProgress["batchId"] if q.lastProgress else -1
