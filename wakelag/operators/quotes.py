"""Quotes: prices, flags, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from wakelag.functions import columns as c
from wakelag.functions.clock import dedup_order

INSTRUMENT = ["exchange", "market_type", "symbol"]
HOUR = "__hour"


def enrich(quotes: DataFrame, price_mode: str = "mid", max_spread_bps: float = 100.0) -> DataFrame:
    """quotes with spread_bps, price and flags. Prices and quantities that are no numbers become null.

    is_clean: a time, four positive finite numbers, ask above bid, a spread of 0 to max_spread_bps and a
    positive finite price.
    """
    names = ("bid_price", "ask_price", "bid_qty", "ask_qty")
    q = quotes.withColumns({n: c.number(F.col(n)) for n in names})
    bid, ask, bid_qty, ask_qty = (F.col(n) for n in names)
    q = q.withColumn("spread_bps", c.spread_bps(bid, ask)).withColumn("price", c.price(price_mode, bid, ask, bid_qty, ask_qty))
    clean = c.all_of(
        F.col("ts").isNotNull(), *[c.finite(F.col(n)) & (F.col(n) > 0) for n in names], ask > bid,
        F.col("spread_bps").between(0.0, max_spread_bps), c.finite(F.col("price")) & (F.col("price") > 0),
    )
    return q.withColumns(
        {
            "is_clean": F.coalesce(clean, F.lit(False)),
            "is_crossed": F.coalesce(bid > ask, F.lit(False)),
            "is_locked": F.coalesce((bid == ask) & (bid > 0), F.lit(False)),
            **{f"non_positive_{n.removesuffix('_price')}": F.coalesce(F.col(n) <= 0, F.lit(False)) for n in names},
        }
    )


def flag_counts(enriched: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, rows with a time and rows by flag, for each group."""
    flags = ("is_crossed", "is_locked", "non_positive_bid", "non_positive_ask", "non_positive_bid_qty", "non_positive_ask_qty", "is_clean")
    rename = {"is_crossed": "crossed_rows", "is_locked": "locked_rows", "is_clean": "clean_rows"}
    return enriched.groupBy(*keys).agg(F.count("*").alias("total_rows"), F.count("ts").alias("valid_timestamp_rows"), *[F.count_if(f).alias(rename.get(f, f)) for f in flags])


def keep_last(quotes: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The last row of each (keys, ts), by sequences, clocks and values; rows without a time go. Rows that
    `by_hour` dealt out stay where they are."""
    order = dedup_order(quotes.columns, ts)
    w = W.partitionBy(*keys, *([HOUR] if HOUR in quotes.columns else []), ts).orderBy(*order)
    return quotes.where(F.col(ts).isNotNull()).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def physical_order(quotes: DataFrame, keys: list[str], file: str, row: str, ts: str = "ts") -> DataFrame:
    """Duplicate and backward times in the order the rows stand in, for each (keys, file).

    A row without a predecessor in its file, or after a row without a time, is compared with the largest
    time of the files before it. The frame is one file, so no task sees more than that.
    """
    per_file = quotes.groupBy(*keys, file).agg(F.max(ts).alias("file_max"))
    carried = per_file.withColumn("carried", F.max("file_max").over(W.partitionBy(*keys).orderBy(file).rowsBetween(W.unboundedPreceding, -1))).drop("file_max")
    before = F.lag(ts).over(W.partitionBy(*keys, file).orderBy(row))
    q = quotes.select(*keys, file, row, ts).withColumn("before", before).join(carried, [*keys, file])
    prev = F.coalesce("before", "carried")
    return q.groupBy(*keys, file).agg(F.count_if(F.col(ts) == prev).alias("duplicate_ts"), F.count_if(F.col(ts) < prev).alias("backward_ts"))


def by_hour(quotes: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """quotes dealt out by keys and hour, with the hour in HOUR: a busy instrument is a task an hour, and the
    windows that name HOUR among their keys need no other exchange."""
    return quotes.withColumn(HOUR, F.date_trunc("hour", ts)).repartition(*keys, HOUR)


def with_previous(rows: DataFrame, keys: list[str], columns: dict[str, str], ts: str = "ts") -> DataFrame:
    """rows (keys, HOUR, ts) with columns of the row before by ts, under new names, null for the first.

    Within an hour the row before is the window's; an hour's first row takes what the last hour before it
    left, which a window over one row an hour carries on. So no window holds an instrument's history. Both sides of
    the join name the hour as not null, as the join does for one of them: so their plans are alike down to `by_hour`, which is read and shuffled once.
    """
    take = F.struct(*[F.col(a).alias(b) for a, b in columns.items()])
    lasts = rows.where(F.col(HOUR).isNotNull()).groupBy(*keys, HOUR).agg(F.struct(*[F.max_by(F.col(a), F.col(ts)).alias(b) for a, b in columns.items()]).alias("__last"))  # of a struct, rows would be sorted again
    carried = lasts.select(*keys, HOUR, F.lag("__last").over(W.partitionBy(*keys).orderBy(HOUR)).alias("__carried"))
    before = F.lag(take).over(W.partitionBy(*keys, HOUR).orderBy(ts))
    out = rows.withColumn("__before", before).join(carried, [*keys, HOUR])
    return out.withColumn("__before", F.coalesce("__before", "__carried")).select(*rows.columns, *[F.col(f"__before.{b}").alias(b) for b in columns.values()])
