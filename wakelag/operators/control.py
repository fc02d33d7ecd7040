"""Control files as tables: manifests of caches and completion markers of component files, their rules as one table of violations.

A violation is a row (path, rule, detail). Rules about one file are columns; rules about all of them are aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wakelag.functions import columns as c
from wakelag.operators.validate import CACHE_VERSIONS, LEAST_PRODUCER
from wakelag.session import written

# Fields of a manifest, the clocks and the policies it may name.
MANIFEST = "exchange string, market_type string, symbol string, price_mode string, cache_config_version long, max_interval_ms double, timestamp_basis string, timestamp_col string, duplicate_ts_policy string, dedup_order_by array<string>, start string, end string, chunk_minutes double, excluded_hours_utc array<string>, __bad string"
CLOCKS = ("receive", "event", "transaction", "custom")
POLICIES = ("error", "keep-last")
# Fields of a marker.
MARKER = "status string, script_version string, run_id string, config_hash string, component_rows long, components string, lag_count long, research_config struct<pair_base_asset_match: string>, __bad string"
SUFFIX = ".SUCCESS.json"
HOUR_NS = 3600 * 10**9


def manifests(texts: DataFrame) -> DataFrame:
    """(path, readable, the fields of MANIFEST) of texts (path, text): what is no such JSON is a row without fields."""
    d = texts.select("path", F.from_json("text", MANIFEST, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}).alias("m"))
    return d.select("path", (F.col("m").isNotNull() & F.col("m.__bad").isNull()).alias("readable"), "m.*").drop("__bad")


def markers(spark: SparkSession, root: str) -> DataFrame:
    """(path, readable, the fields of MARKER) of the markers below root, a scan of JSON files of several lines each."""
    d = spark.read.schema(MARKER).option("multiLine", "true").option("columnNameOfCorruptRecord", "__bad").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{SUFFIX}").json(root)
    # written first: Spark does not prune a scan down to the column of what can't be parsed
    d = written(d.select(F.col("_metadata.file_path").alias("path"), *d.columns), "markers")
    return d.withColumn("readable", F.col("__bad").isNull()).drop("__bad")


def _violations(rows: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """rules: name to (what breaks it, detail). A rule whose condition is null is broken."""
    each = [F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(n).alias("rule"), detail.cast("string").alias("detail"))) for n, (bad, detail) in rules.items()]
    return rows.select("path", F.explode(F.array_compact(F.array(*each))).alias("v")).select("path", "v.rule", "v.detail")


def version_key(text: Column) -> Column:
    """A version as an array of three numbers, which compare in order; what is no number counts as 0."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\.")
    return F.array(*[F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(3)])


def excluded_ranges(found: DataFrame) -> DataFrame:
    """(path, said, from_ns, to_ns) of the hours that manifests leave out; null where a text is no time on a whole UTC hour."""
    at = F.expr("try_to_timestamp(said)")
    d = found.select("path", F.explode("excluded_hours_utc").alias("said")).distinct()
    start = F.when(F.unix_micros(at) % 3_600_000_000 == 0, F.unix_micros(at) * 1000)
    return d.select("path", "said", start.alias("from_ns"), (start + F.lit(HOUR_NS)).alias("to_ns"))


def manifest_violations(found: DataFrame, wanted: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """What is wrong with manifests. wanted: the path that each instrument's manifest should lie at, with exchange, market_type,
    symbol, price_mode and dated (whether its files lie by date)."""
    names = ("exchange", "market_type", "symbol", "price_mode")
    d = wanted.select("path", "dated", *[F.col(n).alias(f"w_{n}") for n in names]).join(found, "path", "left")
    there = F.col("readable")
    ns = lambda n: F.unix_micros(F.expr(f"try_to_timestamp({n})")) * 1000
    read = d.where(F.coalesce(there, F.lit(False))).withColumns({"start_ns": ns("start"), "end_ns": ns("`end`")})
    number = lambda n: ~(c.finite(F.col(n)) & (F.col(n) > 0))
    latest = F.col("cache_config_version") == max(CACHE_VERSIONS)
    strict = lambda bad: F.coalesce(latest, F.lit(False)) & F.coalesce(bad, F.lit(True))
    rules = {
        "max_interval_ms": (number("max_interval_ms"), F.col("max_interval_ms")),
        "version": (~F.col("cache_config_version").isin(*CACHE_VERSIONS), F.col("cache_config_version")),
        "timestamp_basis": (strict(~F.col("timestamp_basis").isin(*CLOCKS)), F.col("timestamp_basis")),
        "duplicate_ts_policy": (strict(~F.col("duplicate_ts_policy").isin(*POLICIES)), F.col("duplicate_ts_policy")),
        "timestamp_col": (strict(F.col("timestamp_col") == ""), F.col("timestamp_col")),
        "dedup_order_by": (strict((F.col("duplicate_ts_policy") == "keep-last") & (F.coalesce(F.size("dedup_order_by"), F.lit(0)) <= 0)), F.lit(None)),
        "identity": (~c.all_of(*[F.col(n).eqNullSafe(F.col(f"w_{n}")) for n in names]), F.concat_ws("/", *names)),
        "range": (~((F.col("start_ns") <= start_ns) & (F.col("end_ns") >= end_ns)), F.concat_ws(" to ", "start", "end")),
        "chunk_minutes": (number("chunk_minutes"), F.col("chunk_minutes")),
    }
    hours = excluded_ranges(found).where("from_ns IS NULL").select("path", F.lit("excluded_hour").alias("rule"), F.col("said").alias("detail"))
    gone = d.where(~F.coalesce(there, F.lit(False))).select("path", F.when(there.isNull(), "missing").otherwise("unreadable").alias("rule"), F.lit(None).cast("string").alias("detail"))
    flat = d.where(~F.col("dated")).select("path", F.lit("not_dated").alias("rule"), F.lit(None).cast("string").alias("detail"))
    out = _violations(read, rules)
    for more in (hours.join(wanted.select("path"), "path", "left_semi"), gone, flat, one_value(read, "timestamp_basis", "one_clock")):
        out = out.unionByName(more)
    return out


def one_value(found: DataFrame, name: str, rule: str) -> DataFrame:
    """A row without a path if the files do not all have one and the same value."""
    d = found.agg(F.array_sort(F.collect_set(F.col(name).cast("string"))).alias("values"), F.count_if(F.col(name).isNull()).alias("none"), F.count("*").alias("n"))
    return d.where("n > 0 AND (size(values) <> 1 OR none > 0)").select(F.lit(None).cast("string").alias("path"), F.lit(rule).alias("rule"), F.array_join("values", ",").alias("detail"))


def marker_violations(found: DataFrame, files: DataFrame, expected_hash: str | None = None) -> DataFrame:
    """What is wrong with the markers of component files (path): one stands beside each file, under its name and SUFFIX."""
    d = files.select((F.concat("path", F.lit(SUFFIX))).alias("path"), F.element_at(F.split("path", "/"), -1).alias("file")).join(found, "path", "left")
    there = F.col("readable")
    read = d.where(F.coalesce(there, F.lit(False)))
    empty = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) == ""
    rules = {
        "status": (F.col("status") != "complete", F.col("status")),
        "producer": (version_key(F.col("script_version")) < F.array(*map(F.lit, LEAST_PRODUCER)), F.col("script_version")),
        **{n: (empty(n), F.lit(None)) for n in ("run_id", "config_hash", "component_rows")},
        "file": (F.element_at(F.split("components", "/"), -1) != F.col("file"), F.col("components")),
        "base_asset_match": (F.col("research_config.pair_base_asset_match") != "equal", F.col("research_config.pair_base_asset_match")),
        "lag_count": (F.col("lag_count") <= 0, F.col("lag_count")),
    }
    if expected_hash is not None:
        rules["expected_hash"] = (F.col("config_hash") != expected_hash, F.col("config_hash"))
    gone = d.where(~F.coalesce(there, F.lit(False))).select("path", F.when(there.isNull(), "missing").otherwise("unreadable").alias("rule"), F.lit(None).cast("string").alias("detail"))
    out = _violations(read, rules).unionByName(gone)
    return out.unionByName(one_value(read, "config_hash", "one_config")).unionByName(one_value(read, "lag_count", "one_lag_count"))
