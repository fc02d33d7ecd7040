"""Overlap joins of two sets of intervals, each without overlaps inside an instrument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

OUT = ("x_start", "x_end", "x_ret", "y_start", "y_end", "y_ret")


def _slice(at: Column, width: int) -> Column:
    """floor(at / width), also below zero."""
    return F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width))


def sweep(x: DataFrame, y: DataFrame, keys: list[str], slice_ns: int) -> DataFrame:
    """keys and OUT for every pair with max(starts) < min(ends). x, y: keys, start_ns, end_ns, ret.

    One sorted pass finds each pair where its later interval starts: there at most one interval of the
    other side is open. Time is cut into slices, so a busy key is many tasks; an interval also stands in
    later slices that it reaches, but only finds partners where it starts.
    """
    first, last = _slice(F.col("start_ns"), slice_ns), _slice(F.col("end_ns") - 1, slice_ns)

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.where("end_ns > start_ns").select(*keys, "start_ns", "end_ns", "ret", first.alias("home"), F.explode(F.sequence(first, last)).alias("slice"), F.lit(n).alias("side"))

    both = side(y, 0).unionByName(side(x, 1))  # y first: of equal starts only x finds y
    w = W.partitionBy(*keys, "slice").orderBy("start_ns", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    one = lambda n: F.last(F.when(F.col("side") == n, F.struct("start_ns", "end_ns", "ret")), ignorenulls=True).over(w)
    both = both.withColumn("o", F.when(F.col("side") == 1, one(0)).otherwise(one(1))).where((F.col("home") == F.col("slice")) & (F.col("o.end_ns") > F.col("start_ns")))
    pick = lambda a, f: F.when(F.col("side") == (1 if a == "x" else 0), F.col(f)).otherwise(F.col(f"o.{f}"))
    return both.select(*keys, *[pick(a, f).alias(f"{a}_{g}") for a in "xy" for f, g in (("start_ns", "start"), ("end_ns", "end"), ("ret", "ret"))])


def bucketed(x: DataFrame, y: DataFrame, keys: list[str], width_ns: int) -> DataFrame:
    """The same by an equality join on buckets of time; a pair counts in the bucket where its overlap starts."""

    def side(df: DataFrame, a: str) -> DataFrame:
        spread = F.explode(F.sequence(_slice(F.col("start_ns"), width_ns), _slice(F.col("end_ns") - 1, width_ns)))
        return df.where("end_ns > start_ns").select(*keys, F.col("start_ns").alias(f"{a}_start"), F.col("end_ns").alias(f"{a}_end"), F.col("ret").alias(f"{a}_ret"), spread.alias("bucket"))

    both = side(x, "x").join(side(y, "y"), [*keys, "bucket"])
    start = F.greatest("x_start", "y_start")
    return both.where((start < F.least("x_end", "y_end")) & (_slice(start, width_ns) == F.col("bucket"))).select(*keys, *OUT)
