"""Readers and writers of tables and manifests."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wakelag.functions.columns import finite
from wakelag.functions.scalars import bytes_hash, config_hash
from wakelag.operators.validate import IntegrityError, cache_problems

CACHE_PARTITIONS = ["exchange", "market_type", "symbol", "price_mode", "date"]
CACHE_VERSION = 4


class MissingCacheError(FileNotFoundError):
    """An instrument that is asked for has no intervals."""


def parquet(spark: SparkSession, paths: str | Sequence[str], physical_only: bool = False, provenance: str | None = None) -> DataFrame:
    """A path, glob or list of files, united by column name. physical_only leaves out partition columns;
    provenance names a column for each row's file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files to read")
    r = spark.read.option("mergeSchema", "true")
    df = (r.option("recursiveFileLookup", "true") if physical_only else r).parquet(*paths)
    return df.withColumn(provenance, F.col("_metadata.file_path")) if provenance else df


def in_file_order(df: DataFrame, file: str = "file_path", row: str = "row_index") -> DataFrame:
    """df, read from files, with each row's file and place in it: its physical order."""
    return df.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})


def describe(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def csv(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """A CSV file with a header and a declared schema; empty fields are null. Columns are taken by name,
    a byte order mark is no part of the first one."""
    raw = spark.read.option("header", "true").option("enforceSchema", "false").csv(path)
    names = {n.lstrip("﻿"): n for n in raw.columns}
    gone = sorted(set(required) - set(names))
    if gone:
        raise ValueError(f"columns are missing: {gone}")
    if most is not None and raw.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows in {path}")
    kinds = spark.createDataFrame([], schema).schema
    empty = lambda n: F.nullif(F.col(f"`{names[n]}`"), F.lit(""))
    return raw.select(*[(empty(f.name).cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds])


def csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; types are told from all rows."""
    return spark.read.option("header", "true").option("inferSchema", "true").option("samplingRatio", "1.0").csv(path)


def excluded_hours(spark: SparkSession, universe: str, path: str | None = None) -> DataFrame | None:
    """(exchange, market_type, symbol, hour) from a CSV of excluded hours: the one at `path`, which must be
    there, or excluded_hours.csv beside the universe; None where there is none. An hour that is not 0 to 23,
    or a date that is none, raises."""
    at = path or universe.rsplit("/", 1)[0] + "/excluded_hours.csv"
    fs, p = _path(spark, at)
    if not fs.exists(p):
        if path:
            raise FileNotFoundError(path)
        return None
    need = ("exchange", "market_type", "symbol", "date", "hour")
    d = csv(spark, at, ", ".join(f"{n} string" for n in need), required=need)
    n, day = F.col("hour").try_cast("int"), F.col("date").try_cast("date")
    bad = d.where(~F.coalesce(n.between(0, 23) & day.isNotNull(), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"invalid excluded hour: {bad[0].asDict()}")
    return d.select("exchange", "market_type", "symbol", (F.to_timestamp(day) + F.make_dt_interval(hours=n)).alias("hour")).distinct()


def components(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """Rows of the component files at a path or glob, each with the file's name; no file, or more than `most`, raises."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    n = found.select("path").limit(most + 1).count()
    if not n or n > most:
        raise IntegrityError(f"{n or 'no'} component files at {path}, {most} at most")
    return parquet(spark, path, physical_only=True, provenance="filename")


def hash_of_file(spark: SparkSession, path: str) -> str:
    """SHA-256 of a small control file's bytes."""
    fs, p = _path(spark, path)
    got = fs.open(p)
    try:
        return bytes_hash(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(got)))
    finally:
        got.close()


def footers(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, columns, rows) from the Parquet footer of each file, read where the task runs. For local and
    mounted file systems, or those that Arrow opens by address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            at = batch.column(0).to_pylist()
            names, rows = [], []
            for p in at:
                system, inner = fs.FileSystem.from_uri(p if "://" in p else "file://" + p.removeprefix("file:"))
                found = pq.read_metadata(inner, filesystem=system)
                names.append(found.schema.to_arrow_schema().names)
                rows.append(found.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.string()), pa.array(names, pa.list_(pa.string())), pa.array(rows, pa.int64())], ["path", "columns", "rows"])

    return paths.select(F.col(path).alias("path")).mapInArrow(run, "path string, columns array<string>, rows long")


def schema_problems(found: DataFrame, required: Sequence[str]) -> DataFrame:
    """Files without one of the required columns, and which."""
    gone = F.array_except(F.array(*map(F.lit, required)), F.col("columns"))
    return found.withColumn("missing", gone).where("size(missing) > 0")


def presence(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, n_files, in_all, in_any): whether all files and whether any file of `footers` has a column."""
    each = F.explode(F.array(*map(F.lit, names))).alias("name")
    d = found.select("columns", each)
    held = F.array_contains("columns", F.col("name"))
    return d.groupBy("name").agg(F.count("*").alias("n_files"), F.bool_and(held).alias("in_all"), F.bool_or(held).alias("in_any"))


def write_parquet(df: DataFrame, path: str, order: Sequence[str] = (), by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Compressed by zstd; sorted within files if an order is given. The commit protocol publishes whole."""
    w = (df.sortWithinPartitions(*order) if order else df).write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = True, mode: str = "overwrite") -> None:
    (df.coalesce(1) if one_file else df).write.mode(mode).option("header", "true").csv(path)


def write_both(df: DataFrame, path: str) -> None:
    """df as Parquet and as CSV, computed once."""
    kept = df.persist()
    try:
        write_parquet(kept, f"{path}.parquet")
        write_csv(kept, f"{path}.csv")
    finally:
        kept.unpersist()


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder and what is in it, if it is there."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def write_json(spark: SparkSession, data: object, path: str) -> None:
    """Through Hadoop's file system, to a side file that then takes the place of the old one in one step, so
    that there always is the old or the new text."""
    text = json.dumps(data, indent=2, sort_keys=True, default=str)
    jvm = spark._jvm
    fs, side = _path(spark, path + ".partial")
    out = fs.create(side, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, final = _path(spark, path)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    how = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fs.makeQualified(side), fs.makeQualified(final), how)


def read_json(spark: SparkSession, path: str) -> dict[str, object] | None:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    got = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(got)).decode())
    finally:
        got.close()


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, config: dict[str, object]) -> dict[str, object]:
    """Tables as Parquet and CSV under root, then the marker that says all are there. The marker of an
    earlier run goes first, so a broken run never looks whole."""
    fs, marker = _path(spark, f"{root}/SUCCESS.json")
    if fs.exists(marker):
        fs.delete(marker, False)
    rows = {}
    for name, df in tables.items():
        write_both(df, f"{root}/{name}")
        rows[name] = spark.read.parquet(f"{root}/{name}.parquet").count()
    done = {"status": "complete", "config": config, "config_hash": config_hash(config), "rows": rows, "written": datetime.now().isoformat()}
    write_json(spark, done, f"{root}/SUCCESS.json")
    return done


def write_cache(intervals: DataFrame, root: str, config: dict[str, object], rebuild: bool = False) -> None:
    """Intervals by instrument, price mode and date of their end. A cache with other settings, or one
    without a manifest, is refused unless it is rebuilt."""
    spark = intervals.sparkSession
    wanted = config | {"version": CACHE_VERSION}
    fs, at = _path(spark, root)
    held = read_json(spark, f"{root}/_cache.json")
    if not rebuild and held is None and fs.exists(at) and fs.listStatus(at):
        raise IntegrityError(f"{root} is no managed cache")
    if not rebuild and held is not None and (bad := cache_problems(held, wanted)):
        raise IntegrityError(f"the cache differs in {bad}")
    if rebuild and fs.exists(at):
        fs.delete(at, True)
    part = F.expr("end_ns DIV 21600000000000")  # a busy instrument's day is four tasks and files
    w = intervals.repartition(*CACHE_PARTITIONS, part).sortWithinPartitions(*CACHE_PARTITIONS, "end_ns").write
    w.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*CACHE_PARTITIONS).parquet(f"{root}/intervals")
    write_json(spark, wanted | {"config_hash": config_hash(wanted)}, f"{root}/_cache.json")


def read_cache(spark: SparkSession, root: str, start_ns: int, end_ns: int, max_interval_ms: float, price_mode: str = "mid", instruments: DataFrame | None = None, missing: str = "error", most: int | None = None, dates: tuple[date, date] | None = None, max_end_ns: int | None = None) -> DataFrame:
    """Intervals that meet (start, end), end by max_end_ns and have a finite return. They lie under the date of their end, so dates run on by the
    longest interval; that prunes folders. missing: error, warn or empty for instruments without any."""
    import logging

    from wakelag.functions.scalars import from_ns

    first, last = dates or (from_ns(start_ns).date(), from_ns(end_ns + int(max_interval_ms * 1_000_000)).date())
    df = spark.read.parquet(f"{root}/intervals").where((F.col("date") >= F.lit(first)) & (F.col("date") <= F.lit(last)) & (F.col("price_mode") == price_mode))
    df = df.where((F.col("end_ns") > start_ns) & (F.col("start_ns") < end_ns) & (F.col("end_ns") > F.col("start_ns")) & finite(F.col("ret")))
    if max_end_ns is not None:
        df = df.where(F.col("end_ns") <= max_end_ns)
    if instruments is not None:
        keys = ["exchange", "market_type", "symbol"]
        df = df.join(instruments.select(*keys).distinct(), keys, "left_semi")
        if missing not in ("error", "warn", "empty"):
            raise ValueError(f"unknown policy: {missing}")
        if missing != "empty" and (gone := instruments.select(*keys).distinct().join(df.select(*keys).distinct(), keys, "left_anti").limit(5).collect()):
            if missing == "error":
                raise MissingCacheError(f"no intervals of {[tuple(r) for r in gone]}")
            logging.getLogger(__name__).warning("no intervals of %s", [tuple(r) for r in gone])
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} intervals")
    return df


def resume(wanted: DataFrame, done: DataFrame, keys: Sequence[str] = ("exchange", "market_type", "symbol", "file_path")) -> DataFrame:
    """What of a catalog is not done yet."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def check_resume(spark: SparkSession, manifest: str, config: dict[str, object]) -> None:
    """Raises if an earlier run's settings differ; the first run writes its own."""
    held = read_json(spark, manifest)
    if held is not None and held.get("config_hash") != config_hash(config):
        raise IntegrityError("an earlier run had other settings")
    if held is None:
        write_json(spark, config | {"config_hash": config_hash(config)}, manifest)
