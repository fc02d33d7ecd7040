"""Queries over stored quantile sketches. Importing it adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wakelag.functions import columns as c
from wakelag.operators import latency, quality, quotes, sketches
from wakelag.plans import catalogue as k, view as v
from wakelag.plans.catalogue import query
from wakelag.session import written

_KEYS = ("exchange", "market_type", "symbol", "base_asset", "date")


def _levels(per: str) -> str:
    one = lambda name, keys: f"SELECT '{name}' AS level, {', '.join(x if x in keys else f'NULL AS {x}' for x in _KEYS)}, count(ms) AS n FROM l GROUP BY {', '.join(keys)} HAVING count(ms) > 0"
    return f"WITH {k._HOURLY}, g AS ({' UNION ALL '.join(one(n, x) for n, x in latency.LEVELS.items())}) {per}"


@query(_levels(f"SELECT g.*, p AS quantile, true AS within FROM g, (SELECT unnest({list(latency.QUANTILES)}) AS p)"))
def merged_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency quantiles of all five levels from sketches stored by instrument and date; for each whether its rank is within
    RANK_ERROR, by counting rows."""
    q = v.quotes(spark, sf_dir).withColumns({"date": F.col("file").cast("string"), "ms": c.latency_ms(F.col("ts"), F.col("event_ts"))})
    held, out = written(sketches.sketched(q, _KEYS, F.col("ms")), "sketches"), None
    for name, keys in latency.LEVELS.items():
        found = sketches.quantiles(sketches.merged(held, keys), latency.QUANTILES)
        off = sketches.rank_errors(q, keys, F.col("ms"), found, latency.QUANTILES)
        pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("quantile"), (F.col(p) <= sketches.RANK_ERROR).alias("within")) for p in latency.QUANTILES])).alias("q")
        d = off.select(F.lit(name).alias("level"), *[F.col(x) if x in keys else F.lit(None).cast("string").alias(x) for x in _KEYS], "n", pairs).select("level", *_KEYS, "n", "q.quantile", "q.within")
        out = d if out is None else out.unionByName(d)
    return out


@query(f"WITH {v.Q}, {v.enriched()} SELECT symbol, count(*) AS n, true AS within, count(DISTINCT file) AS n_files FROM e WHERE is_clean GROUP BY symbol")
def merged_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread quantiles of instruments from sketches of their files, all within RANK_ERROR."""
    clean = quotes.enrich(v.quotes(spark, sf_dir)).where("is_clean").select("symbol", "file", "spread_bps")
    held = written(sketches.sketched(clean, ["symbol", "file"], F.col("spread_bps")), "sketches")
    found = sketches.quantiles(sketches.merged(held, ["symbol"]), quality.SPREADS)
    off = sketches.rank_errors(clean, ["symbol"], F.col("spread_bps"), found, quality.SPREADS)
    files = held.groupBy("symbol").agg(F.count("*").alias("n_files"))
    return off.join(files, "symbol").select("symbol", "n", (F.greatest(*quality.SPREADS) <= sketches.RANK_ERROR).alias("within"), "n_files")
