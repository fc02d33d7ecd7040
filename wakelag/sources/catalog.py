"""Instruments and pairs from a tree of hourly Parquet files.

{root}/{exchange}/{market_type}/{feed}/symbol=S/date=D/hour=H/*.parquet
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wakelag.functions import columns as c
from wakelag.functions.clock import CLOCKS
from wakelag.sources import tables
from wakelag.sources.tables import footers

_PATH = r"([^/]+)/([^/]+)/([^/]+)/symbol=([^/]+)/date=([^/]+)/hour=([^/]+)/[^/]+\.parquet$"
KEYS = ["exchange", "market_type", "feed", "symbol"]

# Instruments of the production inventory, by exchange and market type, with base assets.
INVENTORY = {
    ("binance", "spot"): {
        "XRPUSDT": "XRP", "DOGEUSDT": "DOGE", "ETHUSDT": "ETH", "SOLUSDT": "SOL", "PEPEUSDT": "1000PEPE",
        "XRPUSDC": "XRP", "DOGEUSDC": "DOGE", "ETHUSDC": "ETH", "SOLUSDC": "SOL", "PEPEUSDC": "1000PEPE", "USDCUSDT": "USDC",
    },
    ("binance", "perp"): {
        "XRPUSDT": "XRP", "DOGEUSDT": "DOGE", "FARTCOINUSDT": "FARTCOIN", "ETHUSDT": "ETH", "SOLUSDT": "SOL", "1000PEPEUSDT": "1000PEPE",
        "XRPUSDC": "XRP", "DOGEUSDC": "DOGE", "ETHUSDC": "ETH", "SOLUSDC": "SOL", "1000PEPEUSDC": "1000PEPE", "USDCUSDT": "USDC",
    },
    ("bybit", "perp"): {
        "XRPUSDT": "XRP", "XRPPERP": "XRP", "DOGEUSDT": "DOGE", "DOGEPERP": "DOGE", "FARTCOINUSDT": "FARTCOIN", "ETHUSDT": "ETH", "ETHPERP": "ETH",
        "SOLUSDT": "SOL", "SOLPERP": "SOL", "1000PEPEUSDT": "1000PEPE", "1000PEPEPERP": "1000PEPE", "USDCUSDT": "USDC",
    },
}


def whitelist(spark: SparkSession, inventory: Mapping[tuple[str, str], Mapping[str, str]] = INVENTORY) -> DataFrame:
    rows = [(e, m, s, b) for (e, m), x in inventory.items() for s, b in x.items()]
    return spark.createDataFrame(rows, "exchange string, market_type string, symbol string, base_asset string")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every Parquet file under root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path", "length")


def parse(paths: DataFrame, path: str = "path") -> DataFrame:
    """Columns exchange, market_type, feed, symbol, date, hour from the path, and `at`, the hour as a
    time; rows whose path has another shape go. at is null where date or hour is no such thing."""
    names = ["exchange", "market_type", "feed", "symbol", "date", "hour"]
    d = paths.withColumns({n: F.regexp_extract(path, _PATH, i + 1) for i, n in enumerate(names)}).where("symbol <> ''")
    d = d.withColumns({"exchange": F.lower("exchange"), "market_type": F.lower("market_type"), "symbol": F.upper("symbol")})
    n = F.col("hour").try_cast("int")
    day = F.to_timestamp(F.expr("try_cast(date AS DATE)"))
    return d.withColumn("at", F.when(n.between(0, 23), day + F.make_dt_interval(hours=n)))


def select(catalog: DataFrame, feed: str | None = "bbo", exchanges: Sequence[str] = (), market_types: Sequence[str] = (), symbols: Sequence[str] = (), dates: Sequence[str] = ()) -> DataFrame:
    """Rows that match all of the given values; an empty sequence admits everything."""
    for name, values in (("exchange", [x.lower() for x in exchanges]), ("market_type", [x.lower() for x in market_types]), ("symbol", [x.upper() for x in symbols]), ("date", list(dates)), ("feed", [feed] if feed else [])):
        if values:
            catalog = catalog.where(F.col(name).isin(values))
    return catalog


def in_range(catalog: DataFrame, start: datetime | None, end: datetime | None, keep_unknown: bool = True) -> DataFrame:
    """Files whose hour meets [start, end); those whose hour can't be told stay if keep_unknown."""
    ok = F.lit(True)
    if start is not None:
        ok &= F.col("at") + F.expr("INTERVAL 1 HOUR") > F.lit(start)
    if end is not None:
        ok &= F.col("at") < F.lit(end)
    return catalog.where(F.coalesce(ok, F.lit(keep_unknown)))


def date_bounds(catalog: DataFrame) -> DataFrame:
    """One row: the first date and the day after the last one."""
    d = F.col("date").try_cast("date")
    return catalog.agg(F.min(d).alias("start_date"), F.date_add(F.max(d), 1).alias("end_date"))


def first_files(catalog: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The smallest path of each group: what a schema is read from."""
    return catalog.groupBy(*keys).agg(F.min("path").alias("path"))


def hour_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(*KEYS, "date", "hour").agg(F.count("*").alias("file_count"))


def abnormal_hours(counts: DataFrame) -> DataFrame:
    """Hours with several files: left out, with the reason."""
    return counts.where("file_count <> 1").withColumn("reason", F.lit("multiple_parquet_files_in_hour"))


def normal_hours(counts: DataFrame) -> DataFrame:
    """First and last hour and number of hours with one file; instruments without any have no row."""
    at = F.concat_ws(" ", "date", F.lpad("hour", 2, "0"))
    return counts.where("file_count = 1").groupBy(*KEYS).agg(F.min(at).alias("first_hour"), F.max(at).alias("last_hour"), F.count("*").alias("n_hours"))


def clock_of(columns: Column, basis: str) -> Column:
    """The column of a clock among an array of names, by priority; null if there is none."""
    if basis not in CLOCKS:
        raise ValueError(f"unknown clock: {basis}")
    return F.coalesce(*[F.when(F.array_contains(columns, n), n) for n in CLOCKS[basis]])


def hours_of_range(spark: SparkSession, start: datetime, end: datetime, excluded: Sequence[datetime] = ()) -> DataFrame:
    """(at): the hours that [start, end) touches, less the excluded ones; an end on the hour touches none more."""
    last = F.date_trunc("hour", F.lit(end) - F.expr("INTERVAL 1 MICROSECOND"))
    d = spark.range(1 if end > start else 0).select(F.explode(F.sequence(F.date_trunc("hour", F.lit(start)), last, F.expr("INTERVAL 1 HOUR"))).alias("at"))
    return d.where(~F.col("at").isin(list(excluded))) if excluded else d


def files_of_range(catalog: DataFrame, start: datetime, end: datetime, excluded: Sequence[datetime] = ()) -> DataFrame:
    """Files of the hours of a range."""
    return catalog.join(F.broadcast(hours_of_range(catalog.sparkSession, start, end, excluded)), "at", "left_semi")


def bounds(catalog: DataFrame, rows: DataFrame, ts: str = "ts") -> DataFrame:
    """date_bounds from paths; where no path has a date, from the rows' least and greatest time."""
    named = date_bounds(catalog)
    seen = rows.agg(F.to_date(F.min(ts)).alias("a"), F.date_add(F.to_date(F.max(ts)), 1).alias("b"))
    return named.crossJoin(seen).select(F.coalesce("start_date", "a").alias("start_date"), F.coalesce("end_date", "b").alias("end_date"))  # two tables of one row


def task_config(root: str, out: str, basis: str = "receive", feed: str = "bbo") -> dict[str, object]:
    """The summary that is written beside the tables of a universe."""
    return {
        "raw_root": root, "feed": feed, "timestamp_basis": basis, "tables": {n: f"{out}/{n}.csv" for n in ("universe", "excluded_hours", "ignored_instruments", "pairs")},
        "group_a": {"exchange": "binance", "market_type": "perp"}, "group_b": {"rule": "all instruments except Binance perp"},
        "instrument_filter": {"target_count": sum(map(len, INVENTORY.values()))}, "pairing": {"pair_key": "base_asset"},
    }


def write_universe(made: dict[str, DataFrame], root: str, out: str, basis: str = "receive", feed: str = "bbo") -> dict[str, object]:
    """The tables of `universe` as CSV below out and, last, task_config.json with what they were made of and their rows."""
    spark = made["universe"].sparkSession
    rows = {}
    for name, d in made.items():
        tables.write_csv(d, f"{out}/{name}.csv")
        rows[name] = spark.read.option("header", "true").csv(f"{out}/{name}.csv").count()
    told = task_config(root, out, basis, feed) | {"rows": rows}
    tables.write_json(spark, told, f"{out}/task_config.json")
    return told


def universe(spark: SparkSession, root: str, basis: str = "receive", feed: str = "bbo", targets: DataFrame | None = None, **chosen: Sequence[str]) -> dict[str, DataFrame]:
    """Tables universe, excluded_hours, ignored_instruments and pairs of a tree.

    targets: exchange, market_type, symbol, base_asset. An instrument outside it, or without a column of
    the clock `basis` in its first file, is ignored with a reason. One footer an instrument is read.
    """
    targets = whitelist(spark) if targets is None else targets
    listed = select(parse(files(spark, root)), feed, **chosen)
    counts = hour_counts(listed)
    known = first_files(listed).join(F.broadcast(targets), ["exchange", "market_type", "symbol"], "left")
    # footers are read by tasks, one file an instrument
    names = footers(known.where("base_asset IS NOT NULL").select("path"))
    known = known.join(names.select("path", clock_of(F.col("columns"), basis).alias("timestamp_col")), "path", "left")
    reason = F.when(F.col("base_asset").isNull(), "not_in_target_instruments").when(F.col("timestamp_col").isNull(), f"missing_{basis}_timestamp")
    ignored = known.withColumn("reason", reason).where("reason IS NOT NULL").select("exchange", "market_type", "symbol", "reason")
    kept = known.where("base_asset IS NOT NULL AND timestamp_col IS NOT NULL")
    glob = F.concat(F.regexp_replace("path", r"/date=.*$", ""), F.lit("/date=*/hour=*/*.parquet"))
    uni = kept.join(normal_hours(counts), KEYS).select(
        c.instrument_id(*[F.col(k) for k in KEYS]).alias("instrument_id"), *KEYS, "base_asset", c.group_label(F.col("exchange"), F.col("market_type")).alias("group"),
        glob.alias("parquet_glob"), F.lit(basis).alias("timestamp_basis"), "timestamp_col", "first_hour", "last_hour", "n_hours",
    )
    excluded = abnormal_hours(counts).join(kept.select(*KEYS), KEYS, "left_semi")
    return {"universe": uni, "excluded_hours": excluded, "ignored_instruments": ignored, "pairs": pairs(uni)}


def pairs(uni: DataFrame) -> DataFrame:
    """Group A against group B of the same base asset."""
    side = lambda g, a: uni.where(F.col("group") == g).select("base_asset", *[F.col(n).alias(f"{a}_{n}") for n in ("instrument_id", "exchange", "market_type", "symbol")])
    return side("A", "x").join(side("B", "y"), "base_asset")
