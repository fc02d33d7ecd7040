"""Mergeable quantiles: a KLL sketch for each file or hour, stored as a column, merged up any levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Size of a sketch; with it the rank of a quantile is off by less than RANK_ERROR of the rows (the published
#: bound at 99 percent is about 0.5 percent for one side).
SIZE, RANK_ERROR = 800, 0.01


def sketched(rows: DataFrame, keys: Sequence[str], value: Column, size: int = SIZE) -> DataFrame:
    """keys, n and the sketch of the values that are numbers: a bounded number of bytes a group, however many rows it has. A group
    without a value has no sketch."""
    v = F.when(~F.isnan(value), value)
    d = rows.select(*keys, v.alias("value")).groupBy(*keys).agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))
    return d.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of groups as those of coarser ones."""
    return sketches.where("sketch IS NOT NULL").groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, named: dict[str, float]) -> DataFrame:
    """A column for each quantile, in place of the sketch."""
    got = F.kll_sketch_get_quantile_double(F.col("sketch"), F.array(*[F.lit(float(x)) for x in named.values()]))
    d = sketches.withColumn("__q", got)
    return d.select(*[c for c in sketches.columns if c != "sketch"], *[F.col("__q")[n].alias(k) for n, k in enumerate(named)])


def rank_errors(rows: DataFrame, keys: Sequence[str], value: Column, found: DataFrame, named: dict[str, float]) -> DataFrame:
    """keys, n and for each quantile how far it lies from its share of the rows, by counting rows below it and up to it: 0 where
    the share is between the two."""
    d = rows.select(*keys, F.when(~F.isnan(value), value).alias("__value")).where("__value IS NOT NULL")
    of = found.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[F.col(q).alias(f"__{q}") for q in named])
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    counts = [x for q in named for x in (F.count_if(F.col("__value") < F.col(f"__{q}")).alias(f"__below_{q}"), F.count_if(F.col("__value") <= F.col(f"__{q}")).alias(f"__upto_{q}"))]
    d = d.join(of, same).groupBy(*keys).agg(F.count("*").alias("n"), *counts)
    off = lambda q, p: F.greatest(F.col(f"__below_{q}") / F.col("n") - p, F.lit(p) - F.col(f"__upto_{q}") / F.col("n"), F.lit(0.0))
    return d.select(*keys, "n", *[off(q, p).alias(q) for q, p in named.items()])
