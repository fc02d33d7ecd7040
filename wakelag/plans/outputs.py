"""Queries over what is handed on: final orders, identities of pairs, written universes, columns of files. Importing it adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wakelag.operators import leadlag, quality, ranked, summary
from wakelag.plans import catalogue as k, inventory, view as v
from wakelag.plans.catalogue import query
from wakelag.session import folder
from wakelag.sources import catalog, tables


@query(f"WITH {v.Q} SELECT symbol, row_number() OVER (ORDER BY symbol) AS place FROM (SELECT DISTINCT symbol FROM q)")
def quality_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: the place of each instrument in the quality table's final order."""
    files = k._files(spark, sf_dir).withColumn("backward_ts", F.lit(0))
    return ranked.numbered(quality.instrument_quality(files, v.KEYS), v.KEYS).select("symbol", "place")


@query(f"""{k._LS}, ok AS (SELECT *, row_number() OVER (PARTITION BY x_symbol, y_symbol ORDER BY abs(agg_corr) DESC NULLS LAST, total_overlap DESC, abs(lag_ms), lag_ms) AS rn FROM (SELECT * REPLACE (round(agg_corr, 9) AS agg_corr) FROM ls) WHERE total_overlap >= 100 AND n_window_rows >= 1 AND agg_corr IS NOT NULL)
 SELECT x_symbol, y_symbol, lag_ms AS best_lag_ms, row_number() OVER (ORDER BY abs(agg_corr) DESC, total_overlap DESC, x_symbol, y_symbol) AS place FROM ok WHERE rn = 1""")
def best_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the place of each pair in the summary's final order, by the largest absolute correlation, then overlap."""
    d = summary.best_abs(k._lags(spark, sf_dir), k._GROUP).withColumn("strength", F.round(F.abs("best_agg_corr"), 9))
    return ranked.numbered(d, [F.col("strength").desc(), F.col("total_overlap").desc(), *map(F.col, k._GROUP)]).select(*k._GROUP, "best_lag_ms", "place")


@query(f"""WITH {v.Q}, {v.PAIRS}, c AS (SELECT symbol, min(seq) % 5 * 100 + CAST(500 AS DOUBLE) AS cap, min(seq) % 2 = 0 AS zero FROM q WHERE symbol NOT LIKE '%view' GROUP BY symbol)
 SELECT xs AS x_symbol, ys AS y_symbol, 'r1' AS run_id, x.cap AS x_max_interval_ms, y.cap AS y_max_interval_ms, x.zero AS x_drop_zero_returns, y.zero AS y_drop_zero_returns, CASE WHEN y.symbol IS NOT NULL THEN 'bbo' END AS y_feed, CASE WHEN y.symbol IS NOT NULL THEN 'c-' || ys END AS y_cache_config_hash
 FROM p LEFT JOIN c x ON x.symbol = xs LEFT JOIN c y ON y.symbol = ys""")
def pair_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-c: what both sides' caches say of themselves beside each pair; instruments whose cache says nothing have nulls."""
    q = v.quotes(spark, sf_dir).where("symbol NOT LIKE '%view'")
    said = q.groupBy(F.col("symbol").alias("instrument_id")).agg(F.min("seq").alias("n")).select(
        "instrument_id", F.lit("bbo").alias("feed"), F.lit("partitioned_price_mode").alias("cache_layout"), (F.col("n") % 5 * 100 + 500).cast("double").alias("max_interval_ms"),
        F.lit(4).cast("long").alias("cache_config_version"), (F.col("n") % 2 == 0).alias("drop_zero_returns"), F.concat(F.lit("c-"), "instrument_id").alias("cache_config_hash"),
    )
    d = leadlag.with_pair_identity(k._pairs(spark, sf_dir), said, "r1", "h")
    return d.select("x_symbol", "y_symbol", "run_id", "x_max_interval_ms", "y_max_interval_ms", "x_drop_zero_returns", "y_drop_zero_returns", "y_feed", "y_cache_config_hash")


@query(f"""WITH {inventory._UNI} SELECT 'universe' AS name, count(*) AS n_rows FROM u UNION ALL SELECT 'excluded_hours', count(*) FROM h WHERE file_count <> 1 AND symbol <> 'NOPE' UNION ALL SELECT 'ignored_instruments', count(*) FROM (SELECT DISTINCT exchange, market_type FROM h WHERE symbol = 'NOPE')
 UNION ALL SELECT 'pairs', count(*) FROM (SELECT * FROM u WHERE "group" = 'A') x JOIN (SELECT * FROM u WHERE "group" = 'B') y USING (base_asset)""")
def universe_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9, K5: the tables of a universe written as CSV with their summary, by the rows that the summary and the files tell of."""
    root, out = inventory._tree(spark, sf_dir), folder(spark, "universe")
    catalog.write_universe(catalog.universe(spark, root), root, out)
    told = tables.read_json(spark, f"{out}/task_config.json")["rows"]
    d = spark.createDataFrame(list(told.items()), "name string, n_rows long")
    held = None
    for name in told:
        one = tables.csv_inferred(spark, f"{out}/{name}.csv").agg(F.count("*").alias("held")).withColumn("name", F.lit(name))
        held = one if held is None else held.unionByName(one)
    return d.join(held.where("held >= 0"), "name").where("held = n_rows").select("name", "n_rows")


@query("""WITH h AS (SELECT count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 2 = 1) AS b FROM events)
 SELECT name, CASE name WHEN 'bid_price' THEN b = 0 WHEN 'k' THEN a = 0 WHEN 'none' THEN false ELSE true END AS in_all, CASE name WHEN 'bid_price' THEN a > 0 WHEN 'k' THEN b > 0 WHEN 'none' THEN false ELSE true END AS in_any FROM h, (SELECT unnest(['event_id', 'bid_price', 'k', 'none']) AS name)""")
def column_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all files of a tree, and whether any, have a column: from their footers."""
    found = tables.footers(catalog.files(spark, inventory._halves(spark, sf_dir)))
    return tables.presence(found, ["event_id", "bid_price", "k", "none"]).select("name", "in_all", "in_any")
