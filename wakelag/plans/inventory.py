"""Queries over sources, universes, checks and streams, each with its SQL. Importing it adds them to the catalogue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from wakelag.functions import columns as c
from wakelag.operators import intervals as iv, latency, leadlag, quotes, validate
from wakelag.plans import catalogue as k, view as v
from wakelag.plans.catalogue import long, query, r6, r9
from wakelag.session import folder, written
from wakelag.sources import catalog, tables
from wakelag.streaming import carried

_NAMES = ("XRPUSDT", "DOGEUSDT", "ETHUSDT")


# ---- a tree of files


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """Two files a day and instrument; spot has no event clock; some hours of bybit's ETHUSDT have a second
    file; an instrument NOPE that nobody asks for."""
    at, q = folder(spark, "tree"), v.quotes(spark, sf_dir)
    name = F.when(F.col("event_id") % 50 == 0, "NOPE").otherwise(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 3 + 1).cast("int")))
    q = q.withColumns({"symbol": name, "recv_time_us": F.col("ts"), "event_time": F.col("ts"), "date": F.to_date("ts"), "hour": F.when(F.hour("ts") < 12, "00").otherwise("12")})
    for e, m in (("binance", "perp"), ("bybit", "perp"), ("binance", "spot")):
        part = q.where((F.col("exchange") == e) & (F.col("market_type") == m)).select("symbol", "date", "hour", "recv_time_us", *(["event_time"] if m == "perp" else []), "bid_price", "ask_price", "bid_qty", "ask_qty")
        write = lambda d, mode: d.repartition("symbol", "date", "hour").write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("symbol", "date", "hour").parquet(f"{at}/{e}/{m}/bbo")  # noqa: B023, E731
        write(part, "overwrite")
        if e == "bybit":
            write(part.where("symbol = 'ETHUSDT' AND day(date) % 7 = 3"), "append")
    return at


_TREE = f"""{v.Q}, f AS (SELECT exchange, market_type, CASE WHEN event_id % 50 = 0 THEN 'NOPE' ELSE (['XRPUSDT', 'DOGEUSDT', 'ETHUSDT'])[event_id % 3 + 1] END AS symbol, CAST(file AS VARCHAR) AS date, CASE WHEN hour(ts) < 12 THEN '00' ELSE '12' END AS hour FROM q),
 h AS (SELECT exchange, market_type, 'bbo' AS feed, symbol, date, hour, CASE WHEN exchange = 'bybit' AND symbol = 'ETHUSDT' AND day(CAST(date AS DATE)) % 7 = 3 THEN 2 ELSE 1 END AS file_count FROM f GROUP BY ALL)"""
_UNI = f"""{_TREE}, u AS (SELECT concat_ws('__', exchange, market_type, feed, symbol) AS instrument_id, exchange, market_type, feed, symbol, replace(symbol, 'USDT', '') AS base_asset, CASE WHEN exchange = 'binance' AND market_type = 'perp' THEN 'A' ELSE 'B' END AS "group",
 'receive' AS timestamp_basis, 'recv_time_us' AS timestamp_col, min(date || ' ' || hour) AS first_hour, max(date || ' ' || hour) AS last_hour, count(*) AS n_hours FROM h WHERE symbol <> 'NOPE' AND file_count = 1 GROUP BY ALL)"""


@query(f'WITH {_UNI} SELECT * EXCLUDE ("group"), "group" AS pair_group FROM u')
def catalog_from_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe that is found in a tree."""
    return catalog.universe(spark, _tree(spark, sf_dir))["universe"].drop("parquet_glob").withColumnRenamed("group", "pair_group")


@query(f"WITH {_UNI} SELECT base_asset, x.instrument_id AS x_instrument_id, y.instrument_id AS y_instrument_id, y.symbol AS y_symbol FROM (SELECT * FROM u WHERE \"group\" = 'A') x JOIN (SELECT * FROM u WHERE \"group\" = 'B') y USING (base_asset)")
def catalog_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group A against group B of one base asset."""
    return catalog.universe(spark, _tree(spark, sf_dir))["pairs"].select("base_asset", "x_instrument_id", "y_instrument_id", "y_symbol")


@query(f"WITH {_TREE} SELECT DISTINCT exchange, market_type, symbol, CASE WHEN symbol = 'NOPE' THEN 'not_in_target_instruments' ELSE 'missing_event_timestamp' END AS reason FROM h WHERE symbol = 'NOPE' OR market_type = 'spot'")
def ignored_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments nobody asks for, and those whose files lack the event clock."""
    return catalog.universe(spark, _tree(spark, sf_dir), "event")["ignored_instruments"]


@query(f"WITH {_TREE} SELECT exchange, market_type, feed, symbol, date, hour, CAST(file_count AS BIGINT) AS file_count, 'multiple_parquet_files_in_hour' AS reason FROM h WHERE file_count <> 1")
def excluded_hours_of_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded hours, written as CSV beside the universe and loaded again by the catalog."""
    return catalog.universe(spark, _tree(spark, sf_dir))["excluded_hours"]


@query(f"WITH {_TREE} SELECT exchange, market_type, symbol, epoch_us(CAST(date AS TIMESTAMP) + CAST(hour AS INTEGER) * INTERVAL 1 HOUR) * 1000 AS hour_ns FROM h WHERE file_count <> 1")
def excluded_hours_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the CSV that stands beside the universe."""
    root = folder(spark, "universe")
    tables.write_csv(catalog.universe(spark, _tree(spark, sf_dir))["excluded_hours"], f"{root}/excluded_hours.csv")
    d = tables.excluded_hours(spark, f"{root}/universe.csv")
    return d.select("exchange", "market_type", "symbol", c.epoch_ns(F.col("hour")).alias("hour_ns"))


_FROM, _TO = datetime(2024, 1, 5, 6), datetime(2024, 1, 9)


@query(f"""WITH {_TREE}, a AS (SELECT *, CAST(date AS TIMESTAMP) + CAST(hour AS INTEGER) * INTERVAL 1 HOUR AS hour_at FROM h), r AS (SELECT exchange, market_type, symbol, file_count FROM a WHERE hour_at + INTERVAL 1 HOUR > TIMESTAMP '{_FROM}' AND hour_at < TIMESTAMP '{_TO}' AND market_type = 'perp' AND symbol IN ('ETHUSDT', 'XRPUSDT'))
 SELECT exchange, market_type, symbol, CAST(sum(file_count) AS BIGINT) AS n_files FROM r GROUP BY ALL""")
def files_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by path keys and by the hours of a time range."""
    d = catalog.select(catalog.parse(catalog.files(spark, _tree(spark, sf_dir))), market_types=["PERP"], symbols=["ethusdt", "XRPUSDT"])
    return catalog.in_range(d, _FROM, _TO).groupBy("exchange", "market_type", "symbol").agg(F.count("*").alias("n_files"))


@query(f"""WITH {_TREE}, a AS (SELECT *, CAST(date AS TIMESTAMP) + CAST(hour AS INTEGER) * INTERVAL 1 HOUR AS hour_at FROM h)
 SELECT exchange, market_type, symbol, CAST(sum(file_count) AS BIGINT) AS n_files FROM a WHERE hour_at >= TIMESTAMP '{_FROM}' AND hour_at < TIMESTAMP '{_TO}' AND hour_at <> TIMESTAMP '2024-01-06 12:00:00' GROUP BY ALL""")
def files_of_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the hours that a range touches, but for an excluded hour."""
    d = catalog.files_of_range(catalog.parse(catalog.files(spark, _tree(spark, sf_dir))), _FROM, _TO, [datetime(2024, 1, 6, 12)])
    return d.groupBy("exchange", "market_type", "symbol").agg(F.count("*").alias("n_files"))


@query(f"WITH {_TREE} SELECT 'paths' AS source, min(date) AS start_date, CAST(CAST(max(date) AS DATE) + 1 AS VARCHAR) AS end_date FROM h UNION ALL SELECT 'rows', CAST(min(file) AS VARCHAR), CAST(max(file) + 1 AS VARCHAR) FROM q")
def date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range from paths; where paths name no date, from the rows."""
    found, q = catalog.parse(catalog.files(spark, _tree(spark, sf_dir))), v.quotes(spark, sf_dir)
    both = {"paths": catalog.bounds(found, q), "rows": catalog.bounds(found.limit(0), q)}
    one = [d.select(F.lit(n).alias("source"), F.col("start_date").cast("string"), F.col("end_date").cast("string")) for n, d in both.items()]
    return one[0].unionByName(one[1])


# ---- scans


def _halves(spark: SparkSession, sf_dir: str) -> str:
    """Two folders of files; one has a column that the other lacks."""
    at, q = folder(spark, "halves"), v.quotes(spark, sf_dir)
    q.where("event_id % 2 = 0").select("event_id", "symbol", "bid_price", F.lit("p").alias("part")).write.partitionBy("part").parquet(f"{at}/a")
    q.where("event_id % 2 = 1").select("event_id", "symbol", "k", F.lit("p").alias("part")).write.partitionBy("part").parquet(f"{at}/b")
    return at


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS half, count(*) AS n, count(CASE WHEN event_id % 2 = 0 THEN value END) AS n_bid, count(CASE WHEN event_id % 2 = 1 THEN 1 END) AS n_k, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL")
def scan_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of folders, physical columns only, united by name, each row with its file."""
    at = _halves(spark, sf_dir)
    d = tables.parquet(spark, [f"{at}/a", f"{at}/b"], physical_only=True, provenance="file")
    if "part" in d.columns:
        raise ValueError("a partition column among the physical ones")
    half = F.regexp_extract("file", "/([ab])/part=", 1).alias("half")
    return d.groupBy(half).agg(F.count("*").alias("n"), F.count("bid_price").alias("n_bid"), F.count("k").alias("n_k"), F.sum("event_id").alias("ids"))


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS half, CASE WHEN event_id % 2 = 0 THEN 'k' ELSE 'bid_price' END AS missing, count(*) AS n_rows FROM events GROUP BY ALL")
def footer_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column that the files of each folder lack and the rows they hold, from their footers."""
    at = _halves(spark, sf_dir)
    found = tables.footers(catalog.files(spark, at))
    bad = tables.schema_problems(found, ["event_id", "bid_price", "k"]).withColumn("missing", F.explode("missing"))
    return bad.groupBy(F.regexp_extract("path", "/([ab])/part=", 1).alias("half"), "missing").agg(F.sum("rows").alias("n_rows"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(CAST(o_totalprice AS DOUBLE), 2) AS o_totalprice FROM orders")
def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file whose types are told from its rows."""
    at = folder(spark, "inferred")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice"))
    tables.write_csv(o, at, one_file=False)
    return tables.csv_inferred(spark, at).select(long("o_orderkey", "o_orderkey"), long("o_custkey", "o_custkey"), "o_orderstatus", "o_totalprice")


# ---- expressions and filters


@query("SELECT event_id, epoch_us(ts) AS from_ns, epoch_us(ts) AS from_us, epoch_us(ts) // 1000 * 1000 AS from_ms, epoch_us(ts) AS from_ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(ts) END AS from_text FROM events")
def timestamp_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs in ns (with a rest below a microsecond), us and ms, a timestamp, and text that may be none."""
    q = v.quotes(spark, sf_dir)
    us = F.unix_micros("ts")
    d = q.select("event_id", (us * 1000 + 999).alias("ns"), us.alias("us"), F.unix_millis("ts").alias("ms"), F.col("ts").alias("t"), F.when(F.col("event_id") % 3 == 0, "no time").otherwise(us.cast("string")).alias("text"))
    made = {"from_ns": c.timestamp(F.col("ns"), "ns"), "from_us": c.timestamp(F.col("us"), "us"), "from_ms": c.timestamp(F.col("ms"), "ms"), "from_ts": c.timestamp(F.col("t"), "timestamp"), "from_text": c.timestamp(F.col("text"), "us", strict=False)}
    return d.select("event_id", *[c.micros(x).alias(n) for n, x in made.items()])


@query(f"""WITH {v.Q}, {v.sql_intervals("iv", "q", f"ts >= TIMESTAMP '{_FROM}' - INTERVAL 6 HOUR AND ts < TIMESTAMP '{_TO}'")} SELECT symbol, start_ns, end_ns, round(ret, 6) AS ret FROM iv WHERE ts >= TIMESTAMP '{_FROM}'""")
def intervals_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that end in [start, end), quotes read from the longest interval before."""
    d = v.intervals(v.quotes(spark, sf_dir), start=_FROM, end=_TO, look_back_ms=float(v.CAP_MS))
    return d.select("symbol", "start_ns", "end_ns", r6("ret", "ret"))


@query(f"""WITH {v.Q}, e AS (SELECT *, (bid_price * ask_qty + ask_price * bid_qty) / (bid_qty + ask_qty) AS price FROM q WHERE bid_price > 0 AND ask_price > bid_price AND bid_qty > 0 AND ask_qty > 0),
 l AS (SELECT symbol, ts, price, lag(ts) OVER w AS pt, lag(price) OVER w AS pp FROM e WHERE 10000.0::DOUBLE * (ask_price - bid_price) / ((bid_price + ask_price) / 2.0::DOUBLE) BETWEEN 0 AND 100 WINDOW w AS (PARTITION BY symbol ORDER BY ts))
 SELECT symbol, epoch_us(pt) * 1000 AS start_ns, epoch_us(ts) * 1000 AS end_ns, round(ln(price) - ln(pp), 6) AS ret FROM l WHERE epoch_us(ts) - epoch_us(pt) BETWEEN 1 AND CAST({v.CAP_MS} AS BIGINT) * 1000 AND abs(ln(price) - ln(pp)) > 1e-14""")
def microprice_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the microprice."""
    return v.intervals(v.quotes(spark, sf_dir), price_mode="microprice").select("symbol", "start_ns", "end_ns", r6("ret", "ret"))


@query(f"""WITH {v.Q}, n AS (SELECT *, CASE WHEN event_id % 31 <> 0 THEN ts END AS r FROM q) SELECT symbol, count(*) AS total_rows, count(*) FILTER (WHERE r IS NULL) AS recv_null_or_invalid_rows, count(*) FILTER (WHERE r IS NOT NULL AND event_ts IS NOT NULL) AS valid_latency_rows
 FROM n WHERE r IS NULL OR (r >= TIMESTAMP '{_FROM}' AND r < TIMESTAMP '{_TO}') GROUP BY symbol""")
def latency_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows without a receive time stay and count as bad; others need one in the range."""
    q = v.quotes(spark, sf_dir).withColumn("ts", F.when(F.col("event_id") % 31 != 0, F.col("ts")))
    d = latency.hourly(q, ["symbol"], "ts", "event_ts", _FROM, _TO)
    return d.select("symbol", "total_rows", "recv_null_or_invalid_rows", "valid_latency_rows")


@query(f"WITH {v.Q} SELECT exchange, market_type, count(*) AS n FROM q WHERE (exchange, market_type) IN (('binance', 'spot'), ('bybit', 'perp')) GROUP BY ALL")
def venue_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quotes of the venues that a text names."""
    from wakelag.functions.scalars import parse_venues

    d = latency.select_venues(v.quotes(spark, sf_dir), parse_venues("Bybit/perp, binance/SPOT"))
    return d.groupBy("exchange", "market_type").agg(F.count("*").alias("n"))


@query(f"WITH {v.Q} SELECT DISTINCT symbol, CASE WHEN exchange = 'binance' AND market_type = 'perp' THEN 'A' ELSE 'B' END AS label FROM q")
def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19, in any case of the names."""
    return v.quotes(spark, sf_dir).select("symbol", c.group_label(F.upper("exchange"), F.initcap("market_type")).alias("label")).distinct()


@query(f"""WITH {v.Q}, u AS (SELECT DISTINCT exchange, market_type, symbol, base_asset, "group" FROM q), b AS (SELECT * FROM u WHERE market_type = 'perp') SELECT x.symbol AS x_symbol, y.symbol AS y_symbol FROM (SELECT * FROM u WHERE "group" = 'A') x JOIN b y USING (base_asset) WHERE x.symbol <> y.symbol""")
def pairs_by_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y of one market type, a pair of an instrument with itself left out."""
    u = written(v.universe(v.quotes(spark, sf_dir)), "universe")
    every = u.withColumn("group", F.lit("B")).unionByName(u.where("group = 'A'")).distinct()
    return leadlag.make_pairs(every, skip_self=True, b_market="PERP").select("x_symbol", "y_symbol")


@query(f"WITH {v.Q} SELECT symbol, count(*) AS n FROM q GROUP BY symbol HAVING n > 1")
def guarded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count that is bounded beforehand, and a check that looks for one row."""
    q = v.quotes(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"))
    if not validate.enforce(leadlag.guard(q, 1000, "symbols").where("n < 1"), "groups without rows"):
        raise ValueError("groups without rows")
    return q.where("n > 1")


# ---- checks


def _line(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")


@query(f"""WITH {v.Q}, f AS (SELECT symbol, 'f' || (event_id % 4) AS filename, CASE WHEN event_id % 4 = 2 AND event_id % 8 = 2 THEN 'rX' ELSE 'r' || (event_id % 4) END AS run, CASE WHEN event_id % 1000 = 3 THEN 'h2' ELSE 'h' END AS config FROM q),
 m AS (SELECT * FROM (VALUES ('f0', 'r0', 0), ('f1', 'r1', 1), ('f2', 'r2', 0), ('f3', 'r3', 0), ('f9', 'r9', 0)) t(filename, run, more)),
 d AS (SELECT filename, count(*) AS n, min(run) AS run, count(DISTINCT run) AS runs, min(config) AS config, count(DISTINCT config) AS configs FROM f GROUP BY filename), cnt AS (SELECT filename, count(*) AS n FROM f GROUP BY filename),
 mm AS (SELECT m.filename, m.run, coalesce(cnt.n, 0) + more AS n FROM m LEFT JOIN cnt USING (filename))
 SELECT 'marker_mismatch' AS problem, count(*) AS n FROM d FULL JOIN mm USING (filename) WHERE NOT coalesce(d.n = mm.n AND d.run = mm.run AND d.config = 'h' AND runs = 1 AND configs = 1, false)
 UNION ALL SELECT 'one_config', CAST(count(DISTINCT config) <> 1 AS INTEGER) FROM f
 UNION ALL SELECT 'mixed_modes', CAST(count(DISTINCT symbol LIKE '%click') > 1 AS INTEGER) FROM q
 UNION ALL SELECT 'repeated_instruments', count(*) FROM (SELECT symbol FROM (SELECT DISTINCT symbol, event_id % 2 AS twice FROM q WHERE symbol LIKE 'U1%' OR event_id % 2 = 0) GROUP BY symbol HAVING count(*) > 1)
 UNION ALL SELECT 'quality_mismatch', count(DISTINCT symbol) FROM q WHERE symbol LIKE 'U2%' OR symbol LIKE '%view' OR symbol LIKE '%error'
 UNION ALL SELECT 'pairs_named', count(DISTINCT symbol) FROM q""")
def consistency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each rule, on data in which each is broken."""
    q = v.quotes(spark, sf_dir)
    rest = F.col("event_id") % 4
    name = lambda p: F.concat(F.lit(p), rest.cast("string"))
    f = q.select("symbol", name("f").alias("filename"), F.when(F.col("event_id") % 8 == 2, "rX").otherwise(name("r")).alias("run_id"), F.when(F.col("event_id") % 1000 == 3, "h2").otherwise("h").alias("config_hash"))
    counts = f.groupBy("filename").agg(F.count("*").alias("n"))
    m = spark.createDataFrame([("f0", "r0", 0), ("f1", "r1", 1), ("f2", "r2", 0), ("f3", "r3", 0), ("f9", "r9", 0)], "filename string, run_id string, more int").join(counts, "filename", "left")
    m = m.select("filename", (F.coalesce("n", F.lit(0)) + F.col("more")).alias("rows"), "run_id", F.lit("h").alias("config_hash"))
    u = written(v.universe(q), "universe").withColumns({"parquet_glob": F.col("symbol"), "timestamp_basis": F.lit("receive"), "timestamp_col": F.lit("ts")})
    scanned = u.where("symbol NOT LIKE 'U2%'").withColumns({"scan_price_mode": F.when(F.col("symbol").endswith("view"), "microprice").otherwise("mid"), "parquet_glob": F.when(F.col("symbol").endswith("error"), "other").otherwise(F.col("parquet_glob"))})
    scanned = scanned.select("exchange", "market_type", "symbol", "parquet_glob", "timestamp_basis", "timestamp_col", "scan_price_mode")
    twice = q.where("symbol LIKE 'U1%' OR event_id % 2 = 0").select("group", "exchange", "market_type", "symbol", (F.col("event_id") % 2).alias("twice")).distinct()
    pairs = q.select(*[F.concat(F.lit(" "), F.upper(F.col(n)) if n == "symbol" else F.col(n)).alias(f"{a}_{n}") for a in "xy" for n in ("exchange", "market_type", "symbol")])
    found = {
        "marker_mismatch": validate.marker_mismatch(f, m), "one_config": validate.one_config(f, "config_hash"),
        "mixed_modes": validate.mixed_modes(q.select(F.when(F.col("symbol").endswith("click"), "mid").otherwise("microprice").alias("price_mode")), "mid"),
        "repeated_instruments": validate.repeated_instruments(twice), "quality_mismatch": validate.quality_mismatch(scanned, u, {"scan_price_mode": "mid"}),
    }
    out = validate.distinct_pairs(pairs).select(F.lit("pairs_named").alias("problem"), F.col("n_pairs").alias("n"))
    for name_, bad in found.items():
        out = out.unionByName(_line(name_, bad))
    return out


@query(f"""WITH {v.Q}, {v.sql_intervals()}, w AS (SELECT symbol, start_ns - CASE WHEN (end_ns // 1000) % 11 = 0 THEN 1 ELSE 0 END * 3600000000000 AS start_ns, end_ns FROM iv),
 l AS (SELECT *, lag(end_ns) OVER (PARTITION BY symbol ORDER BY end_ns, start_ns) AS before FROM w) SELECT symbol, count(*) AS n FROM l WHERE before > start_ns GROUP BY symbol""")
def interval_disorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: intervals, some begun an hour too early, that begin before the one before them ends."""
    d = v.intervals(v.quotes(spark, sf_dir))
    early = F.when(F.expr("(end_ns DIV 1000) % 11 = 0"), F.lit(3600 * 10**9)).otherwise(F.lit(0))
    return iv.disorder(d.withColumn("start_ns", F.col("start_ns") - early), v.KEYS).groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"""{k._COMP} SELECT x_symbol, y_symbol, 'f' || (win % 2) AS file, count(*) AS n, CAST({v.CAP_MS} AS DOUBLE) AS x_max_interval_ms, CAST(4 AS BIGINT) AS y_cache_config_version, 'price_mode' AS x_cache_layout FROM comp GROUP BY ALL""")
def component_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S21, S4, K2, U-b: component files found at a path, each row with its file and what its cache was made by."""
    at = folder(spark, "components")
    d = written(leadlag.with_cache_identity(k._runs(spark, sf_dir), {"max_interval_ms": v.CAP_MS, "version": 4, "drop_zero_returns": True, "config_hash": "c"}), "runs")  # one computation for both files
    for f in ("f0", "f1"):
        tables.write_parquet(d.where(F.col("filename") == f).drop("filename"), f"{at}/{f}")
    found = tables.components(spark, f"{at}/*")
    return found.groupBy("x_symbol", "y_symbol", F.regexp_extract("filename", "/(f[01])/", 1).alias("file"), "x_max_interval_ms", "y_cache_config_version", "x_cache_layout").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 3 <> 0")
def resume_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5, U-f, J8: what is not done yet, by keys; an earlier run of other settings is refused."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    at = folder(spark, "run") + ".json"
    tables.check_resume(spark, at, {"a": 1})
    tables.check_resume(spark, at, {"a": 1})
    return tables.resume(o, o.where("o_custkey % 3 = 0"), ["o_orderkey"])


# ---- streams


def _run(out: DataFrame, spark: SparkSession, what: str) -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote."""
    at = folder(spark, what)
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def _stream(d: DataFrame, spark: SparkSession) -> DataFrame:
    at = folder(spark, "stream")
    d.write.parquet(at)
    return spark.readStream.schema(d.schema).parquet(at)


@query(f"WITH {v.Q}, {v.enriched()}, l AS (SELECT symbol, ts, lag(ts) OVER w AS pt, ln(price) - ln(lag(price) OVER w) AS ret FROM e WHERE is_clean WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, epoch_us(pt) * 1000 AS start_ns, epoch_us(ts) * 1000 AS end_ns, round(ret, 9) AS ret FROM l WHERE pt IS NOT NULL")
def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and returns by state that is kept between micro-batches; quotes of one time by their sequence."""
    clean = quotes.enrich(v.quotes(spark, sf_dir)).where("is_clean").select("symbol", "ts", "price", "seq")
    d = _run(carried.gaps(_stream(clean, spark), ["symbol"], ["seq"]), spark, "gaps")
    return d.select("symbol", "start_ns", "end_ns", r9(F.col("ret"), "ret"))


@query(f"""WITH {v.Q}, {v.enriched()}, m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM e) SELECT symbol, epoch_us(hour) * 1000 AS hour_ns, count(*) AS total_rows, count(*) FILTER (WHERE is_clean) AS clean_rows, count(*) FILTER (WHERE bid_price > ask_price) AS crossed_rows
 FROM e, m WHERE hour + INTERVAL 1 HOUR <= mark GROUP BY ALL""")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour in a stream with a watermark; an hour is given out once the watermark has passed it."""
    d = quotes.enrich(v.quotes(spark, sf_dir)).select("symbol", "ts", "is_clean", "is_crossed")
    out = _run(carried.counts(_stream(d, spark), ["symbol"]), spark, "counts")
    return out.select("symbol", c.epoch_ns(F.col("window.start")).alias("hour_ns"), "total_rows", "clean_rows", "crossed_rows")
