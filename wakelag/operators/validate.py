"""Checks as queries: each returns the rows that break a rule, and an empty result passes."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from wakelag.functions import columns as c
from wakelag.functions.scalars import version
from wakelag.operators.lagged import floor_div
from wakelag.operators.summary import CACHE, GROUP

log = logging.getLogger(__name__)
ID = ["x_exchange", "x_market_type", "x_symbol", "y_exchange", "y_market_type", "y_symbol"]
KEY = [*ID, "price_mode", "window_start", "window_end", "lag_ms"]
#: The first producer version whose component files are trusted, and the accepted versions of caches.
LEAST_PRODUCER, CACHE_VERSIONS = (3, 2, 0), (2, 3, 4)


class IntegrityError(ValueError):
    """A check found rows."""


def enforce(bad: DataFrame, what: str, severity: str = "strict") -> bool:
    """Whether the check passed. strict raises, warn logs, off does not even look."""
    if severity == "off":
        return True
    if severity not in ("strict", "warn"):
        raise ValueError(f"unknown severity: {severity}")
    row = bad.limit(1).collect()
    if row and severity == "strict":
        raise IntegrityError(f"{what}: {row[0].asDict()}")
    if row:
        log.warning("%s: %s", what, row[0].asDict())
    return not row


def one_config(df: DataFrame, column: str = "scan_config_hash") -> DataFrame:
    """A row if the column has several values, or a null."""
    d = df.agg(F.count_distinct(column).alias("n_values"), F.count_if(F.col(column).isNull()).alias("n_null"))
    return d.where("n_values <> 1 OR n_null > 0")


def varying(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups in which one of the columns has several values or a null."""
    d = df.groupBy(*keys).agg(*[F.count_distinct(x).alias(f"n_{x}") for x in columns], *[F.count_if(F.col(x).isNull()).alias(f"null_{x}") for x in columns])
    return d.where(" OR ".join(f"n_{x} <> 1 OR null_{x} > 0" for x in columns))


def marker_mismatch(components: DataFrame, markers: DataFrame, file: str = "filename") -> DataFrame:
    """Files whose rows, run or configuration differ from their marker (file, rows, run_id, config_hash),
    and files or markers without the other."""
    d = components.groupBy(file).agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("runs"), F.min("run_id").alias("run"), F.count_distinct("config_hash").alias("configs"), F.min("config_hash").alias("config"))
    m = markers.select(F.col(file), F.col("rows"), F.col("run_id"), F.col("config_hash"))
    same = c.all_of(*[F.col(a).eqNullSafe(F.col(b)) for a, b in (("n", "rows"), ("run", "run_id"), ("config", "config_hash"))]) & (F.col("runs") == 1) & (F.col("configs") == 1)
    return d.join(m, file, "full").where(~F.coalesce(same, F.lit(False)))


def invalid_components(components: DataFrame) -> DataFrame:
    """Rows with missing keys, measures that are null, infinite or negative, empty windows, a wrong flag,
    or a correlation that its parts do not give."""
    nulls = [F.col(k).isNull() for k in [*KEY, "run_id", "config_hash"] if k in components.columns]
    measures = [~c.finite(F.col(m)) for m in ("cov", "var_x", "var_y")] + [F.col(m) < 0 for m in ("var_x", "var_y", "n_overlap", "n_x", "n_y")] + [F.col(m).isNull() for m in ("n_overlap", "n_x", "n_y")]
    if "corr" in components.columns:
        given = c.correlation(F.col("cov"), F.col("var_x"), F.col("var_y"))
        nulls.append(c.differs(F.col("corr").isNull(), given.isNull()) | (F.abs(F.col("corr") - given) > 1e-9 * F.greatest(F.abs(given), F.lit(1.0))))
    bad = [*nulls, *measures, F.col("window_end") <= F.col("window_start"), c.differs(F.col("corr_is_diagnostic"), F.lit(True))]
    any_ = F.lit(False)
    for b in bad:
        any_ = any_ | F.coalesce(b, F.lit(False))
    return components.where(any_)


def cross_assets(components: DataFrame) -> DataFrame:
    """Pairs of different or missing base assets."""
    x, y = (c.normal(F.col(f"{a}_base_asset")) for a in "xy")
    return components.where(x.isNull() | y.isNull() | (x == "") | (y == "") | (x != y))


def duplicate_keys(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def split_runs(components: DataFrame, file: str = "filename") -> DataFrame:
    """Runs that stand in several files."""
    return components.groupBy("run_id").agg(F.count_distinct(file).alias("n_files")).where("n_files > 1")


def inconsistent_caches(components: DataFrame) -> DataFrame:
    """Instruments whose cache is described in different ways, on either side of a pair."""
    names = [m.removeprefix("x_") for m in CACHE if m.startswith("x_")]
    side = lambda a: components.select(*[F.col(f"{a}_{k}").alias(k) for k in ("exchange", "market_type", "symbol", *names)], "price_mode")
    both = side("x").unionByName(side("y"))
    identity = F.count_distinct(F.to_json(F.struct(*names))).alias("n_identities")
    return both.groupBy("exchange", "market_type", "symbol", "price_mode").agg(identity).where("n_identities > 1")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """One row: how many different pairs a table of pairs names, its names trimmed and in upper or lower case alike."""
    norm = [F.lower(F.trim(F.col(n))).alias(n) for n in ID]
    return pairs.select(*norm).distinct().agg(F.count("*").alias("n_pairs"))


def pair_count(components: DataFrame) -> int:
    return components.select(*ID).distinct().count()


def incomplete_lags(components: DataFrame, expected: int, group: Sequence[str] = GROUP) -> DataFrame:
    """Groups without all lags, or without lag 0."""
    d = components.groupBy(*group).agg(F.count_distinct("lag_ms").alias("n_lags"), F.max((F.col("lag_ms") == 0).cast("int")).alias("has_zero"))
    return d.where((F.col("n_lags") != expected) | (F.col("has_zero") != 1))


def uneven_windows(components: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Groups whose lags cover different numbers of windows."""
    d = components.groupBy(*group, "lag_ms").agg(F.count("*").alias("n"))
    return d.groupBy(*group).agg(F.min("n").alias("min_windows"), F.max("n").alias("max_windows")).where("min_windows <> max_windows")


def _with_far(spans: DataFrame, keys: Sequence[str], slice_ns: int = 86_400 * 10**9) -> DataFrame:
    """spans with `far`: how far those before one (by start, then end) reach, null for the first. Windows hold a slice of time;
    what slices before reach comes from a window over one row a slice."""
    d = spans.withColumn("__slice", floor_div(F.col("start_ns"), slice_ns))
    before = F.max("end_ns").over(W.partitionBy(*keys, "__slice").orderBy("start_ns", "end_ns").rowsBetween(W.unboundedPreceding, -1))
    reach = d.groupBy(*keys, "__slice").agg(F.max("end_ns").alias("__reach"))
    carried = reach.select(*keys, "__slice", F.max("__reach").over(W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)).alias("__carried"))
    d = d.withColumn("far", before).join(carried, [*keys, "__slice"])
    return d.withColumn("far", F.greatest("far", "__carried")).drop("__slice", "__carried")


def coverage_gaps(spans: DataFrame, keys: Sequence[str], start_ns: int, end_ns: int, excluded: DataFrame | None = None) -> DataFrame:
    """Where the spans (keys, start_ns, end_ns) of a group leave [start, end) uncovered, overlap or repeat:
    keys, problem, from_ns, to_ns. A gap that excluded ranges (keys, from_ns, to_ns) fill is none."""
    edge = spans.select(*keys).distinct()
    ends = edge.select(*keys, F.lit(start_ns).alias("start_ns"), F.lit(start_ns).alias("end_ns")).unionByName(edge.select(*keys, F.lit(end_ns).alias("start_ns"), F.lit(end_ns).alias("end_ns")))
    real = spans.where((F.col("end_ns") > start_ns) & (F.col("start_ns") < end_ns)).select(*keys, "start_ns", "end_ns", F.lit(1).alias("real"))
    d = _with_far(real, keys).where(F.col("far") > F.col("start_ns"))
    overlap = d.select(*keys, F.lit("overlap").alias("problem"), F.col("start_ns").alias("from_ns"), F.least("far", "end_ns").alias("to_ns"))
    cover = real.unionByName(ends.withColumn("real", F.lit(0)))
    if excluded is not None:
        cover = cover.unionByName(excluded.select(*keys, F.col("from_ns").alias("start_ns"), F.col("to_ns").alias("end_ns"), F.lit(0).alias("real")))
    g = _with_far(cover, keys).where((F.col("far") < F.col("start_ns")) & (F.col("start_ns") <= end_ns) & (F.col("far") >= start_ns))
    return g.select(*keys, F.lit("gap").alias("problem"), F.col("far").alias("from_ns"), F.col("start_ns").alias("to_ns")).unionByName(overlap)


def mixed_modes(cache: DataFrame, mode: str) -> DataFrame:
    """A row if a cache without mode in its path holds another price mode, or none."""
    d = cache.agg(F.count_distinct("price_mode").alias("n_modes"), F.count_if(F.col("price_mode").isNull()).alias("n_null"), F.min("price_mode").alias("low"), F.max("price_mode").alias("high"))
    return d.where((F.col("n_modes") > 1) | (F.col("n_null") > 0) | (F.col("low") != mode))


def repeated_instruments(universe: DataFrame, keys: Sequence[str] = ("group", "exchange", "market_type", "symbol")) -> DataFrame:
    return duplicate_keys(universe, keys)


def quality_mismatch(quality: DataFrame, universe: DataFrame, request: dict[str, object], keys: Sequence[str] = ("exchange", "market_type", "symbol")) -> DataFrame:
    """Instruments of the universe without a quality row, or with one scanned from other files, by another
    clock, policy, unit or price mode than requested."""
    shared = [n for n in ("parquet_glob", "timestamp_basis", "timestamp_col") if n in quality.columns and n in universe.columns]
    d = universe.select(*keys, *[F.col(n).alias(f"u_{n}") for n in shared]).join(quality.withColumn("__found", F.lit(True)), list(keys), "left")
    wrong = F.col("__found").isNull()
    for n in shared:
        wrong = wrong | c.differs(F.col(n), F.col(f"u_{n}"))
    for n, v in request.items():
        wrong = wrong | c.differs(F.col(n), F.lit(v))
    return d.where(wrong).select(*keys)


def marker_problems(marker: dict[str, object], file: str) -> list[str]:
    """What is wrong with a component file's marker."""
    out = []
    if marker.get("status") != "complete":
        out.append("not complete")
    if version(marker.get("script_version", marker.get("producer_version"))) < LEAST_PRODUCER:
        out.append("from a producer that is too old")
    if str(marker.get("components", "")).rsplit("/", 1)[-1] != file.rsplit("/", 1)[-1]:
        out.append("of another file")
    if marker.get("pair_base_asset_match", "equal") != "equal":
        out.append("pairs of different base assets")
    return out


def shared_value(markers: Sequence[dict[str, object]], name: str) -> object:
    """The one value that all markers have."""
    found = {str(m.get(name)): m.get(name) for m in markers}
    if len(found) != 1:
        raise IntegrityError(f"{name} differs: {sorted(found)}")
    return next(iter(found.values()))


def cache_problems(manifest: dict[str, object], wanted: dict[str, object]) -> list[str]:
    """Names of settings in which a cache differs from what is wanted, or that it does not state."""
    out = [k for k, v in wanted.items() if manifest.get(k) != v]
    return out + (["version"] if manifest.get("version") not in CACHE_VERSIONS and "version" in manifest else [])
