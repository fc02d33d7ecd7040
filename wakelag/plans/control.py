"""Queries over caches on disk, control files, chunks with a ledger and resumed results, each with every rule broken once. Importing it
adds them to the catalogue."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wakelag.functions.scalars import chunks, to_ns
from wakelag.operators import control
from wakelag.plans import view as v
from wakelag.plans.catalogue import query
from wakelag.session import folder, written
from wakelag.sources import catalog, layouts, ledger, tables

_INSTRUMENT = ("exchange", "market_type", "symbol")
_TYPES = ("click", "error", "purchase", "signup", "view")
#: The number of an instrument, 0 to 14, by which it gets its layout and its fault.
_I = f"CAST(symbol[2:2] AS INTEGER) * 5 + list_position({list(_TYPES)}, symbol[4:]) - 1"


def _number() -> Column:
    kind = F.array_position(F.array(*map(F.lit, _TYPES)), F.substring("symbol", 4, 99))
    return (F.substring("symbol", 2, 1).cast("int") * 5 + kind - 1).cast("int")


def _in(*n: int) -> str:
    return f"i IN ({', '.join(map(str, n))})"


#: Which instruments have files by mode and date, by mode alone, by date alone, flat, by another mode; and manifests.
_MD, _MF, _LD, _LF, _OTHER, _MODE_NOTE, _BASE_NOTE = (0, 4, 6, 13, 14), (1, 4, 11, 14), (2, 5, 9, 12, 14), (3, 5, 6, 14), (7, 13), (9, 11), (10, 12)


def _base(symbol: str) -> str:
    return f"exchange=x/market_type=perp/symbol={symbol}"


@query(f"""WITH {v.Q}, s AS (SELECT DISTINCT symbol, {_I} AS i FROM q), f AS (SELECT *, {_in(*_MD)} AS md, {_in(*_MF)} AS mf, {_in(*_LD)} AS ld, {_in(*_LF)} AS lf, {_in(*_OTHER)} AS other, {_in(*_MODE_NOTE)} AS mn, {_in(*_BASE_NOTE)} AS bn FROM s),
 g AS (SELECT *, CASE WHEN md AND mf THEN 'mixed_by_mode' WHEN ld AND lf THEN 'mixed_legacy' WHEN NOT (md OR mf OR ld OR lf OR mn OR bn) THEN 'no_cache' END AS problem, md OR mf OR mn AS meant FROM f)
 SELECT symbol, CASE WHEN problem IS NULL THEN CASE WHEN meant THEN '{layouts.BY_MODE}' ELSE '{layouts.LEGACY}' END END AS layout, CASE WHEN problem IS NULL THEN CASE WHEN meant THEN md ELSE ld END END AS dated,
 CASE WHEN problem IS NULL THEN CASE WHEN meant THEN mn ELSE bn END END AS has_manifest, problem IS NULL AND meant AND (ld OR lf) AS shadowed, CASE WHEN problem = 'no_cache' THEN CASE WHEN other THEN 'microprice' ELSE '' END END AS other_modes, problem FROM g""")
def cache_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout of each instrument's cache, or why it can't be told."""
    root, q = folder(spark, "layouts"), v.quotes(spark, sf_dir)
    rows = written(q.groupBy("symbol", F.col("file").cast("string").alias("date")).agg(F.count("*").alias("n")).withColumns({"exchange": F.lit("x"), "market_type": F.lit("perp"), "price_mode": F.lit("mid"), "i": _number()}), "rows")
    for held, mode, by in ((_MD, "mid", ("price_mode", "date")), (_MF, "mid", ("price_mode",)), (_LD, "mid", ("date",)), (_LF, "mid", ()), (_OTHER, "microprice", ("price_mode", "date"))):
        part = rows.where(F.col("i").isin(*held)).withColumn("price_mode", F.lit(mode)).drop("i", *({"price_mode", "date"} - {*by}))
        part.repartition(*_INSTRUMENT, *by).write.mode("append").partitionBy(*_INSTRUMENT, *by).parquet(root)
    names = {r["i"]: r["symbol"] for r in rows.select("i", "symbol").distinct().collect()}
    for n in (*_MODE_NOTE, *_BASE_NOTE):
        if n in names:
            tables.write_json(spark, {"max_interval_ms": 1}, f"{root}/{_base(names[n])}/{'price_mode=mid/' if n in _MODE_NOTE else ''}{layouts.MANIFEST}")
    d = layouts.resolve(catalog.files(spark, root).select("path"), layouts.manifests(spark, root).select("path"), rows.select(*_INSTRUMENT), "mid")
    return d.select("symbol", "layout", "dated", F.when(F.col("problem").isNull(), F.col("manifest").isNotNull()).alias("has_manifest"), "shadowed", F.array_join("other_modes", ",").alias("other_modes"), "problem")


_FROM, _TO = datetime(2024, 1, 5, 6), datetime(2024, 1, 9)
_MAX_END = to_ns(_TO + timedelta(hours=3))
_HOLE = "day(date) % 7 = length(symbol) % 7"


@query(f"""WITH {v.Q}, {v.sql_intervals()}, f AS (SELECT symbol, CAST(ts AS DATE) AS date, max(end_ns) AS high, min(start_ns) AS low, count(*) FILTER (WHERE end_ns > {to_ns(_FROM)} AND start_ns < {to_ns(_TO)} AND end_ns <= {_MAX_END}) AS n FROM iv GROUP BY ALL),
 g AS (SELECT * FROM f WHERE NOT ({_HOLE})), d AS (SELECT symbol, CAST(x AS DATE) AS date FROM (SELECT DISTINCT symbol FROM g), (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-09', INTERVAL 1 DAY)) AS x))
 SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN high IS NULL THEN 'missing' WHEN high > {to_ns(_FROM)} AND low < {to_ns(_TO)} THEN 'opened' ELSE 'pruned' END AS state, coalesce(n, 0) AS n FROM d LEFT JOIN g USING (symbol, date)""")
def required_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each instrument and date that a range needs whether there is no file, or one that its footer keeps shut, or one that is
    read, and how many intervals the range has of it."""
    root = folder(spark, "cache")
    d = v.intervals(v.quotes(spark, sf_dir)).where(f"NOT ({_HOLE})").withColumns({"exchange": F.lit("x"), "market_type": F.lit("perp")})
    d.repartition("symbol", "date").write.partitionBy(*_INSTRUMENT, "price_mode", "date").parquet(root)
    listed = catalog.files(spark, root).select("path")
    instruments = layouts.placed(listed).select(*_INSTRUMENT).distinct()
    found = layouts.resolve(listed, layouts.manifests(spark, root).select("path"), instruments, "mid")
    cap = v.CAP_MS * 1_000_000
    files, gone = layouts.needed(found, listed, "mid", *layouts.dates_needed(to_ns(_FROM), to_ns(_TO), cap, _MAX_END))
    state = F.when(layouts.meets(to_ns(_FROM), to_ns(_TO)), "opened").otherwise("pruned")
    out = layouts.zones(layouts.guard_files(files, 1000)).select("symbol", "date", state.alias("state")).unionByName(gone.select("symbol", "date", F.lit("missing").alias("state")))
    read = layouts.read_range(spark, root, instruments, "mid", to_ns(_FROM), to_ns(_TO), cap, "empty", _MAX_END)
    n = (read if read is not None else d.limit(0)).groupBy("symbol", F.to_date("date").alias("date")).agg(F.count("*").alias("n"))
    return out.join(n, ["symbol", "date"], "left").select("symbol", F.col("date").cast("string").alias("date"), "state", F.coalesce("n", F.lit(0)).alias("n"))


# What is done to the manifest and to the marker of each instrument, and the rule that it breaks.
_NOTES: tuple[tuple[dict[str, object] | None, str], ...] = (
    ({}, ""), (None, "missing"), ({"broken": True}, "unreadable"), ({"max_interval_ms": None}, "max_interval_ms"), ({"cache_config_version": 9}, "version"), ({"timestamp_basis": "wall"}, "timestamp_basis"),
    ({"duplicate_ts_policy": "first"}, "duplicate_ts_policy"), ({"timestamp_col": ""}, "timestamp_col"), ({"dedup_order_by": []}, "dedup_order_by"), ({"symbol": "other"}, "identity"), ({"start": "2024-01-03T00:00:00+00:00"}, "range"),
    ({"chunk_minutes": 0}, "chunk_minutes"), ({"excluded_hours_utc": ["2024-01-02T03:00:00Z", "2024-01-02T04:30:00Z"]}, "excluded_hour"), ({"flat": True}, "not_dated"), ({"timestamp_basis": "event"}, ""),
)
_MARKS: tuple[tuple[dict[str, object] | None, str], ...] = (
    ({}, ""), (None, "missing"), ({"broken": True}, "unreadable"), ({"status": "running"}, "status"), ({"script_version": "3.1.9"}, "producer"), ({"run_id": ""}, "run_id"), ({"config_hash": None}, "config_hash"), ({"component_rows": None}, "component_rows"),
    ({"components": "out/other.parquet"}, "file"), ({"research_config": {"pair_base_asset_match": "any"}}, "base_asset_match"), ({"lag_count": 0}, "lag_count"), ({"config_hash": "h2"}, ""), ({"lag_count": 7}, ""), ({}, ""), ({}, ""),
)


def _rules(kind: str, of: tuple) -> str:
    return f"SELECT '{kind}' AS kind, symbol, r AS rule FROM (SELECT symbol, ({[x[1] for x in of]})[i + 1] AS r FROM s) WHERE r <> ''"


@query(f"""WITH {v.Q}, s AS (SELECT DISTINCT symbol, {_I} AS i FROM q), n AS (SELECT max(i) AS i FROM s) {_rules('manifest', _NOTES)} UNION ALL {_rules('marker', _MARKS)}
 UNION ALL SELECT 'manifest', NULL, 'one_clock' FROM n UNION ALL SELECT 'marker', NULL, unnest(['one_config', 'one_lag_count']) FROM n""")
def control_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V13, V16, V20, V21, U-e: manifests and markers found on disk, each with one fault, as a table of the rules they break."""
    root, symbols = folder(spark, "control"), v.quotes(spark, sf_dir).select("symbol", _number().alias("i")).distinct().collect()  # fifteen
    wanted, files = [], []
    for r in symbols:
        at, component = f"{root}/{_base(r['symbol'])}/price_mode=mid/{layouts.MANIFEST}", f"{root}/out/{r['symbol']}.parquet"
        fault = _NOTES[r["i"]][0]
        wanted.append((at, "x", "perp", r["symbol"], "mid", not (fault or {}).get("flat", False)))
        files.append((component,))
        note = {"exchange": "x", "market_type": "perp", "symbol": r["symbol"], "price_mode": "mid", "cache_config_version": 4, "max_interval_ms": 2000, "timestamp_basis": "receive", "timestamp_col": "ts", "duplicate_ts_policy": "keep-last", "dedup_order_by": ["seq"], "start": "2024-01-02T00:00:00+00:00", "end": "2024-01-29T00:00:00+00:00", "chunk_minutes": 60, "excluded_hours_utc": []}
        if fault is not None:
            tables.write_json(spark, "broken" if fault.get("broken") else {k: x for k, x in (note | fault).items() if k != "flat"}, at)
        mark, fault = {"status": "complete", "script_version": "3.2.0", "run_id": "r", "config_hash": "h", "component_rows": 5, "components": f"out/{r['symbol']}.parquet", "lag_count": 13, "research_config": {"pair_base_asset_match": "equal"}}, _MARKS[r["i"]][0]
        if fault is not None:
            tables.write_json(spark, "broken" if fault.get("broken") else mark | fault, f"{component}{control.SUFFIX}")
    bare = lambda d: d.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    want = bare(spark.createDataFrame(wanted, "path string, exchange string, market_type string, symbol string, price_mode string, dated boolean"))
    notes = control.manifest_violations(bare(control.manifests(layouts.manifests(spark, root))), want, v.START_NS, v.END_NS)
    marks = control.marker_violations(bare(control.markers(spark, f"{root}/out")), bare(spark.createDataFrame(files, "path string")))
    symbol = F.coalesce(F.nullif(F.regexp_extract("path", "symbol=([^/]+)/", 1), F.lit("")), F.regexp_extract("path", r"/([^/]+)\.parquet\.SUCCESS", 1))
    one = lambda kind, d: d.select(F.lit(kind).alias("kind"), symbol.alias("symbol"), "rule")
    return one("manifest", notes).unionByName(one("marker", marks))


_SPANS = chunks(datetime(2024, 1, 3), datetime(2024, 1, 8), 720)
_TORN, _TWICE, _LOST, _NEVER = 2, 5, 7, 9


@query(f"""WITH {v.Q}, {v.sql_intervals()}, c AS (SELECT unnest(range(0, {len(_SPANS)})) AS i), n AS (SELECT (end_ns - {to_ns(_SPANS[0][0])}) // 43200000000000 AS i, count(*) AS n FROM iv WHERE end_ns >= {to_ns(_SPANS[0][0])} AND end_ns < {to_ns(_SPANS[-1][1])} GROUP BY ALL)
 SELECT {to_ns(_SPANS[0][0])} + i * 43200000000000 AS chunk_start_ns, CASE i WHEN {_TORN} THEN 'torn' WHEN {_TWICE} THEN 'torn' WHEN {_LOST} THEN 'lost' WHEN {_NEVER} THEN 'unknown' ELSE 'sound' END AS state_before, 'sound' AS state_after, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (i)""")
def chunk_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink of chunks in which one is torn, one written twice, one lost and one unknown to the ledger; what is not sound is written
    again, and only then all rows are there."""
    root = folder(spark, "chunks")
    d = v.intervals(v.quotes(spark, sf_dir)).select("symbol", "start_ns", "end_ns", "ret")
    d = written(d.where((F.col("end_ns") >= to_ns(_SPANS[0][0])) & (F.col("end_ns") < to_ns(_SPANS[-1][1]))), "intervals")
    name = lambda n: ledger.span_name("mid", *_SPANS[n])
    inside = lambda n: d.where((F.col("end_ns") >= to_ns(_SPANS[n][0])) & (F.col("end_ns") < to_ns(_SPANS[n][1]))).withColumn("chunk", F.lit(name(n)))
    ledger.write_chunks(d, root, "mid", [s for n, s in enumerate(_SPANS) if n != _NEVER])
    by_hand = lambda rows: rows.write.mode("append").partitionBy("chunk").parquet(f"{root}/chunks")
    ledger.drop_chunks(spark, root, [name(_TORN), name(_LOST)])
    first = inside(_TORN).agg(F.min("end_ns")).first()[0]
    by_hand(inside(_TORN).where(F.col("end_ns") > (first or 0)))
    by_hand(inside(_TWICE))
    by_hand(inside(_NEVER))
    before = written(ledger.states(spark, root, d), "states").withColumnRenamed("state", "state_before")
    ledger.write_chunks(d, root, "mid", ledger.rest(spark, root, d, "mid", _SPANS))
    after = ledger.states(spark, root, d).withColumnRenamed("state", "state_after")
    rows = ledger.sound_rows(spark, root, d).groupBy("chunk").agg(F.count("*").alias("n"))
    table = spark.createDataFrame([(name(n), to_ns(a)) for n, (a, _) in enumerate(_SPANS)], "chunk string, chunk_start_ns long")
    return table.join(before, "chunk", "left").join(after, "chunk", "left").join(rows, "chunk", "left").select("chunk_start_ns", "state_before", "state_after", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {v.Q}, f AS (SELECT symbol, CAST(file AS VARCHAR) AS file, day(file) AS d, count(*) AS n FROM q GROUP BY ALL), x AS (SELECT *, d <= 20 AS done, d = 7 AND symbol LIKE '%view' AS out, d = 3 AS conflict FROM f)
 SELECT 'kept' AS what, symbol, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n FROM x WHERE done AND NOT out AND NOT conflict GROUP BY symbol UNION ALL SELECT 'rest', symbol, count(*), CAST(count(*) AS BIGINT) FROM x WHERE NOT out AND (NOT done OR conflict) GROUP BY symbol
 UNION ALL SELECT 'repeated', symbol, count(*), count(*) FROM x WHERE done AND NOT out AND NOT conflict AND d % 5 = 0 GROUP BY symbol UNION ALL SELECT 'conflict', symbol, count(*), CAST(2 * count(*) AS BIGINT) FROM x WHERE conflict AND NOT out GROUP BY symbol
 UNION ALL SELECT 'excluded', symbol, count(*), count(*) FROM x WHERE out GROUP BY symbol UNION ALL SELECT 'unknown', 'gone', count(*), count(*) FROM x WHERE symbol = 'U0_click' AND d <= 20""")
def resume_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial result of an older schema, with rows that repeat, that differ under one key, that an hour excluded since then
    takes away and that nobody asks for, merged with its catalog."""
    day = F.dayofmonth(F.to_date("file"))
    found = written(v.quotes(spark, sf_dir).groupBy("symbol", F.col("file").cast("string").alias("file")).agg(F.count("*").alias("n")), "files")
    done = found.where(day <= 20)
    partial = done.unionByName(done.where(day % 5 == 0)).unionByName(done.where(day == 3).withColumn("n", F.col("n") + 1)).unionByName(done.where("symbol = 'U0_click'").withColumn("symbol", F.lit("gone")))
    hours = found.where((day == 7) & F.col("symbol").endswith("view")).select("symbol", "file")
    got = ledger.reconcile(partial, found.select("symbol", "file"), ["symbol", "file"], [("n", "long"), ("added_since", "double")], hours)
    if got["kept"].where("added_since IS NOT NULL").limit(1).count():
        raise ValueError("a column that the older result lacks has values")
    kept = got["kept"].groupBy("symbol").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n")).select(F.lit("kept").alias("what"), "symbol", "n_keys", "n")
    rest = got["rest"].groupBy("symbol").agg(F.count("*").alias("n_keys")).select(F.lit("rest").alias("what"), "symbol", "n_keys", F.col("n_keys").alias("n"))
    gone = got["dropped"].groupBy(F.col("reason").alias("what"), "symbol").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n"))
    return kept.unionByName(rest).unionByName(gone)
