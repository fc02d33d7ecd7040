"""Places in a total order, without one task that has all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wakelag.session import written


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "place", offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows offset + 1 to offset + limit of df in `order`, with their place, a long from 1. The rows are dealt out by
    ranges of that order and written; a place is the row's own in its range and the sizes of the ranges before, of which there is
    one row a range. Ranges outside the asked part are not read."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the row's place below
    d = written(ranged.withColumns({"__part": F.shiftright(at, 33), "__place": at.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = {r["__part"]: r["n"] for r in d.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    last, before, seen = None if limit is None else offset + limit, {}, 0
    for part in sorted(sizes):
        if seen + sizes[part] > offset and (last is None or seen < last):
            before[part] = seen
        seen += sizes[part]
    ahead = df.sparkSession.createDataFrame(list(before.items()), "__part long, __before long")  # a row a range
    out = d.join(F.broadcast(ahead), "__part").withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before")
    out = out.where(F.col(name) > offset)
    return out if last is None else out.where(F.col(name) <= last)
