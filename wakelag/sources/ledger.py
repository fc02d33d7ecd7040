"""A sink of chunks with a ledger, and the merge of a partial result with what is wanted.

A chunk's files lie in a folder named by its span. The ledger, written last, says how many rows a chunk has and a checksum of them; a chunk
counts only if its files agree with it. So a chunk that was torn by a failure, or written twice, is found and written again.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wakelag.functions.scalars import parse_span, span_name, to_ns
from wakelag.operators.validate import IntegrityError
from wakelag.sources.tables import _path


def _sums(rows: DataFrame, by: str) -> DataFrame:
    """Rows and a checksum that does not depend on their order; halves of hashes, so that sums stay below a long's range."""
    names = sorted(x for x in rows.columns if x != by)
    h = F.xxhash64(*[x for n in names for x in (F.col(n), F.col(n).isNull())])
    return rows.groupBy(by).agg(F.count("*").alias("rows"), F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))


def write_chunks(intervals: DataFrame, root: str, mode: str, spans: Sequence[tuple[datetime, datetime]], at: str = "end_ns") -> None:
    """Intervals whose `at` lies in one of the spans (nanoseconds in [start, end)), a folder a span in place of what it held, and then the
    ledger's rows of these, counted over the intervals, not over what was written. Spans are the driver's list; spans without rows are in the ledger, too."""
    spark = intervals.sparkSession
    table = spark.createDataFrame([(span_name(mode, a, b), to_ns(a), to_ns(b)) for a, b in spans], "chunk string, __from long, __to long")
    rows = intervals.join(F.broadcast(table), (F.col(at) >= F.col("__from")) & (F.col(at) < F.col("__to"))).drop("__from", "__to")
    drop_chunks(spark, root, [span_name(mode, a, b) for a, b in spans])
    rows.write.mode("append").option("compression", "zstd").partitionBy("chunk").parquet(f"{root}/chunks")
    noted = table.select("chunk").join(_sums(rows, "chunk"), "chunk", "left").fillna(0, ["rows", "high", "low"])
    noted.coalesce(1).withColumn("written", F.current_timestamp()).write.mode("append").parquet(f"{root}/ledger")


def chunk_rows(spark, root: str, like: DataFrame) -> DataFrame:
    """All rows of all chunk folders, with the columns that `like` has and each with its chunk's name, whether the ledger knows it or not."""
    schema = StructType([*[f for f in like.schema.fields if f.name != "chunk"], StructField("chunk", StringType())])
    fs, at = _path(spark, f"{root}/chunks")
    if not fs.exists(at) or not any("=" in str(x.getPath().getName()) for x in fs.listStatus(at)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/chunks").select(*schema.names)


def ledger(spark, root: str) -> DataFrame:
    """The latest word on each chunk."""
    fs, at = _path(spark, f"{root}/ledger")
    if not fs.exists(at):
        return spark.createDataFrame([], "chunk string, rows long, high long, low long")
    d = spark.read.parquet(f"{root}/ledger").groupBy("chunk").agg(F.max_by(F.struct("rows", "high", "low"), "written").alias("x"))
    return d.select("chunk", "x.rows", "x.high", "x.low")


def states(spark, root: str, like: DataFrame) -> DataFrame:
    """(chunk, state): sound; torn, where files and ledger differ; unknown, where the ledger does not have it; lost, where there are no files
    but rows in the ledger."""
    held = _sums(chunk_rows(spark, root, like), "chunk").withColumnsRenamed({"rows": "r", "high": "h", "low": "l"})
    said = ledger(spark, root)
    same = (F.col("r") == F.col("rows")) & (F.col("h") == F.col("high")) & (F.col("l") == F.col("low"))
    state = F.when(F.col("rows").isNull(), "unknown").when(F.col("r").isNull(), F.when(F.col("rows") == 0, "sound").otherwise("lost")).when(same, "sound").otherwise("torn")
    return said.join(held, "chunk", "full").select("chunk", state.alias("state"))


def sound_spans(spark, root: str, like: DataFrame) -> DataFrame:
    """(start_ns, end_ns) of the sound chunks: what `validate.coverage_gaps` and a resumed run go by."""
    parse = F.udf(lambda n: parse_span(n), "struct<start_ns: long, end_ns: long>")  # a row a chunk
    return states(spark, root, like).where("state = 'sound'").select(parse("chunk").alias("s")).where("s IS NOT NULL").select("s.start_ns", "s.end_ns")


def rest(spark, root: str, like: DataFrame, mode: str, spans: Sequence[tuple[datetime, datetime]]) -> list[tuple[datetime, datetime]]:
    """The spans, of the driver's list, that have no sound chunk."""
    done = {r["chunk"] for r in states(spark, root, like).where("state = 'sound'").select("chunk").collect()}
    return [(a, b) for a, b in spans if span_name(mode, a, b) not in done]


def drop_chunks(spark, root: str, names: Sequence[str]) -> None:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for n in names:
        fs, at = _path(spark, f"{root}/chunks/chunk={escape(n)}")
        fs.delete(at, True)


def sound_rows(spark, root: str, like: DataFrame) -> DataFrame:
    """The rows of the sound chunks."""
    return chunk_rows(spark, root, like).join(states(spark, root, like).where("state = 'sound'").select("chunk"), "chunk", "left_semi")


def reconcile(partial: DataFrame, catalog: DataFrame, keys: Sequence[str], columns: Sequence[tuple[str, str]], hours: DataFrame | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """A partial result and what is wanted, merged: `kept` (rows that still count, with all of `columns`, name and type; those an
    older result lacks are null), `rest` (rows of the catalog still to be done) and `dropped` (keys, reason, n).

    catalog: keys, instrument columns and `at`, the hour. hours: excluded since then (instrument columns, at). Rows that repeat whole count once
    (repeated); keys with different rows go (conflict) and are to be done again; so do rows of excluded hours (excluded) and of keys that the catalog does not have
    (unknown). strict: raises if anything is dropped.
    """
    keys = list(keys)
    wide = partial.select(*keys, *[(F.col(n) if n in partial.columns else F.lit(None)).cast(t).alias(n) for n, t in columns if n not in keys])
    names = [n for n, _ in columns if n not in keys]
    value = F.struct(*names)
    counted = wide.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(value).alias("__low"), F.max(value).alias("__high"))
    wanted = catalog
    if hours is not None:
        on = [c for c in hours.columns if c in catalog.columns]
        wanted = catalog.join(hours.select(*on).distinct().withColumn("__out", F.lit(True)), on, "left")
    else:
        wanted = catalog.withColumn("__out", F.lit(None).cast("boolean"))
    d = counted.join(wanted.select(*keys, "__out", F.lit(True).alias("__known")).distinct(), keys, "left")
    reason = F.when(F.col("__known").isNull(), "unknown").when(F.col("__out"), "excluded").when(~F.col("__low").eqNullSafe(F.col("__high")), "conflict")
    d = d.withColumn("reason", reason)
    kept = d.where("reason IS NULL").select(*keys, *[F.col("__low")[n].alias(n) for n in names])
    gone = d.select(*keys, F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("__n") > 1, "repeated").alias("reason"), F.when(F.col("reason").isNotNull(), F.col("__n")).otherwise(F.col("__n") - 1).alias("n")).where("reason IS NOT NULL")
    if strict and (bad := gone.limit(1).collect()):
        raise IntegrityError(f"the partial result does not fit: {bad[0].asDict()}")
    todo = wanted.where("__out IS NULL").drop("__out").join(kept.select(*keys), keys, "left_anti")
    return {"kept": kept, "rest": todo, "dropped": gone}
