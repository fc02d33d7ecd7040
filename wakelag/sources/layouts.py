"""Caches of intervals as they lie on disk: which layout an instrument has, which files a range needs, which are not there.

One listing says it all; instruments are rows, and rules are columns over what the listing holds of them.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wakelag.functions.scalars import from_ns
from wakelag.operators.validate import IntegrityError
from wakelag.sources import catalog
from wakelag.sources.tables import MissingCacheError, _path

INSTRUMENT = ["exchange", "market_type", "symbol"]
# The manifest's name, and what the layouts are called.
MANIFEST = "_cache_config.json"
BY_MODE, LEGACY = "partitioned_price_mode", "legacy"
_BASE = r"exchange=([^/]+)/market_type=([^/]+)/symbol=([^/]+)/(?:price_mode=([^/]+)/)?(?:date=([^/]+)/)?[^/]+$"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the manifests of caches below root. Their names begin with an underscore, which Spark's listing hides; the
    driver lists them, one name a cache, and tasks read them."""
    fs, at = _path(spark, f"{root}/exchange=*/market_type=*/symbol=*/{{{MANIFEST},price_mode=*/{MANIFEST}}}")
    found = [str(x.getPath().toString()) for x in (fs.globStatus(at) or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow

        for batch in batches:
            texts = []
            for p in batch.column(0).to_pylist():
                system, inner = arrow.FileSystem.from_uri(p if "://" in p else "file://" + p.removeprefix("file:"))
                with system.open_input_stream(inner) as f:
                    texts.append(f.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

    return spark.createDataFrame([(p,) for p in found], "path string").mapInArrow(run, "path string, text string")


def placed(paths: DataFrame) -> DataFrame:
    """The instrument, price mode and date of each path that lies in a cache (mode and date empty where the path has none)."""
    names = [*INSTRUMENT, "mode", "date"]
    return paths.withColumns({n: F.regexp_extract("path", _BASE, i + 1) for i, n in enumerate(names)}).where("symbol <> ''")


def resolve(listed: DataFrame, held: DataFrame, instruments: DataFrame, mode: str) -> DataFrame:
    """For each instrument: layout, dated (whether files lie by date), manifest (its path), shadowed (an older layout that is passed over),
    other_modes, and the problem: mixed_by_mode or mixed_legacy (dated and flat files in one place), or no_cache.

    listed, held: the paths of files and of manifests. A manifest alone shows that a layout is meant; an empty folder does not.
    """
    files, notes = placed(listed), placed(held)
    own, base = F.col("mode") == mode, F.col("mode") == ""
    dated = F.col("date") != ""
    has = lambda c, n: F.coalesce(F.bool_or(c), F.lit(False)).alias(n)
    seen = files.groupBy(*INSTRUMENT).agg(has(own & dated, "md"), has(own & ~dated, "mf"), has(base & dated, "ld"), has(base & ~dated, "lf"), F.array_sort(F.collect_set(F.when(~own & ~base, F.col("mode")))).alias("modes"))
    said = notes.groupBy(*INSTRUMENT).agg(F.max(F.when(own, F.col("path"))).alias("mode_manifest"), F.max(F.when(base, F.col("path"))).alias("legacy_manifest"))
    d = instruments.select(*INSTRUMENT).distinct().join(seen, INSTRUMENT, "left").join(said, INSTRUMENT, "left").fillna(False, ["md", "mf", "ld", "lf"])
    meant = F.col("mode_manifest").isNotNull() | F.col("md") | F.col("mf")
    older = F.col("ld") | F.col("lf")
    problem = F.when(F.col("md") & F.col("mf"), "mixed_by_mode").when(F.col("ld") & F.col("lf"), "mixed_legacy").when(~(meant | older | F.col("legacy_manifest").isNotNull()), "no_cache")
    fine = problem.isNull()
    return d.select(
        *INSTRUMENT, F.when(fine, F.when(meant, BY_MODE).otherwise(LEGACY)).alias("layout"), F.when(fine, F.when(meant, F.col("md")).otherwise(F.col("ld"))).alias("dated"),
        F.when(fine, F.when(meant, F.col("mode_manifest")).otherwise(F.col("legacy_manifest"))).alias("manifest"), (fine & meant & older).alias("shadowed"),
        F.when(problem == "no_cache", F.coalesce("modes", F.array().cast("array<string>"))).alias("other_modes"), problem.alias("problem"),
    )


def require_sound(layouts: DataFrame) -> None:
    """Raises if an instrument's layout can't be told."""
    bad = layouts.where("problem IS NOT NULL").limit(1).collect()
    if bad:
        raise IntegrityError(f"cache layout: {bad[0].asDict()}")


def dates_needed(start_ns: int, end_ns: int, cap_ns: int, max_end_ns: int | None = None) -> tuple[date, date] | None:
    """First and last date that can hold an interval which meets [start, end): files lie under the date of an interval's end, so up to the
    longest interval behind the end, but not beyond max_end."""
    if end_ns <= start_ns:
        return None
    last = end_ns + cap_ns if max_end_ns is None else min(end_ns + cap_ns, max_end_ns + 1)
    return (from_ns(start_ns).date(), from_ns(last - 1).date()) if last > start_ns else None


def needed(layouts: DataFrame, listed: DataFrame, mode: str, first: date, last: date) -> tuple[DataFrame, DataFrame]:
    """Files (instrument, date, path) of the resolved layout that the dates need, and the (instrument, date) without any. A layout
    without dates needs all its files, and has no date to miss unless it has no file at all (date null)."""
    files = placed(listed).join(layouts.where("problem IS NULL").select(*INSTRUMENT, "layout", "dated"), INSTRUMENT)
    right = F.when(F.col("layout") == BY_MODE, F.col("mode") == mode).otherwise(F.col("mode") == "") & (F.col("dated") == (F.col("date") != ""))
    day = F.col("date").try_cast("date")
    files = files.where(right & (~F.col("dated") | day.between(F.lit(first), F.lit(last)))).select(*INSTRUMENT, F.when(F.col("dated"), day).alias("date"), "path")
    days = F.when(F.col("dated"), F.sequence(F.lit(first), F.lit(last))).otherwise(F.array(F.lit(None).cast("date")))
    spine = layouts.where("problem IS NULL").select(*INSTRUMENT, F.explode(days).alias("date"))
    of = files.select(*[F.col(c).alias(f"__{c}") for c in (*INSTRUMENT, "date")]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*INSTRUMENT, "date")]
    return files, spine.join(of, same, "left_anti")


def guard_files(files: DataFrame, most: int) -> DataFrame:
    """files, unless an instrument has more than `most` of them."""
    bad = files.groupBy(*INSTRUMENT).count().where(F.col("count") > most).limit(1).collect()
    if bad:
        raise IntegrityError(f"more than {most} files: {bad[0].asDict()}")
    return files


def handle_missing(gone: DataFrame, policy: str) -> None:
    """What is to happen for each (instrument, date) without files: error raises, warn says how many and names some, empty says nothing."""
    if policy not in ("error", "warn", "empty"):
        raise ValueError(f"unknown policy: {policy}")
    if policy != "empty" and (some := gone.limit(5).collect()):
        names = [tuple(map(str, r)) for r in some]
        if policy == "error":
            raise MissingCacheError(f"no intervals of {names}")
        logging.getLogger(__name__).warning("no intervals of %s (%d in all)", names, gone.count())


def zones(files: DataFrame, columns: Sequence[str] = ("start_ns", "end_ns"), path: str = "path") -> DataFrame:
    """files with rows and, from their footers, the least and greatest value of the columns (null where a footer does not say): what a file holds,
    without a page of it read."""
    names = [f"{f}_{c}" for c in columns for f in ("low", "high")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs as arrow

        for batch in batches:
            out: list[list] = []
            for p in batch.column(0).to_pylist():
                system, inner = arrow.FileSystem.from_uri(p if "://" in p else "file://" + p.removeprefix("file:"))
                meta = pq.read_metadata(inner, filesystem=system)
                at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                row: list = [meta.num_rows]
                for c in columns:
                    stats = [meta.row_group(g).column(at[c]).statistics for g in range(meta.num_row_groups)] if c in at else []
                    whole = bool(stats) and all(s is not None and s.has_min_max for s in stats)
                    row += [min(s.min for s in stats), max(s.max for s in stats)] if whole else [None, None]
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in out], pa.int64()) for i in range(1 + len(names))]], ["__path", "rows", *names])

    schema = StructType([StructField("__path", StringType()), StructField("rows", LongType()), *[StructField(n, LongType()) for n in names]])
    return files.join(files.select(path).distinct().mapInArrow(run, schema), F.col(path) == F.col("__path")).drop("__path")


def meets(start_ns: int, end_ns: int) -> Column:
    """Whether a file's footer admits an interval that meets (start, end); a footer that does not say admits it."""
    return F.coalesce((F.col("high_end_ns") > start_ns) & (F.col("low_start_ns") < end_ns), F.lit(True)) & (F.col("rows") > 0)


def read_range(spark: SparkSession, root: str, instruments: DataFrame, mode: str, start_ns: int, end_ns: int, cap_ns: int, missing: str = "error", max_end_ns: int | None = None, most_files: int = 100_000) -> DataFrame | None:
    """Intervals of the instruments that meet (start, end), of whatever layout each has, from files whose footers admit some;
    None where there is no such file. The paths, a budget's worth, are the driver's."""
    listed = catalog.files(spark, root).select("path")
    layouts = resolve(listed, manifests(spark, root).select("path"), instruments, mode)
    require_sound(layouts)
    span = dates_needed(start_ns, end_ns, cap_ns, max_end_ns)
    if span is None:
        return None
    files, gone = needed(layouts, listed, mode, *span)
    handle_missing(gone, missing)
    paths = [r["path"] for r in zones(guard_files(files, most_files)).where(meets(start_ns, end_ns)).select("path").collect()]
    if not paths:
        return None
    d = spark.read.option("mergeSchema", "true").option("basePath", root).parquet(*paths)
    d = d.where((F.col("end_ns") > start_ns) & (F.col("start_ns") < end_ns))
    if "price_mode" in d.columns:
        d = d.where(F.col("price_mode").isNull() | (F.col("price_mode") == mode))
    return d if max_end_ns is None else d.where(F.col("end_ns") <= max_end_ns)
