"""Column expressions over quotes, intervals and components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

NS_PER_MS = 1_000_000


def finite(c: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def number(c: Column) -> Column:
    """As a double; what is no number becomes null."""
    return c.try_cast("double")


def timestamp(c: Column, unit: str, strict: bool = True) -> Column:
    """A point in time from a column of `unit`: timestamp, or an epoch in ns, us or ms (floored to µs)."""
    n = c if strict else c.try_cast("bigint")
    if unit == "timestamp":
        return c.cast("timestamp") if strict else c.try_cast("timestamp")
    if unit == "ns":
        return F.timestamp_micros(F.call_function("div", n.cast("bigint") - F.pmod(n.cast("bigint"), F.lit(1000)), F.lit(1000)))
    if unit == "us":
        return F.timestamp_micros(n.cast("bigint"))
    if unit == "ms":
        return F.timestamp_millis(n.cast("bigint"))
    raise ValueError(f"unknown unit: {unit}")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_ns(ts: Column) -> Column:
    return micros(ts) * F.lit(1000).cast("bigint")


def elapsed_ms(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1000.0)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / F.lit(2.0)


def microprice(bid: Column, ask: Column, bid_qty: Column, ask_qty: Column) -> Column:
    """Prices weighted by the other side's quantity; null unless both quantities are positive."""
    return F.when((bid_qty > 0) & (ask_qty > 0), (bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty))


def spread_bps(bid: Column, ask: Column) -> Column:
    ok = finite(bid) & finite(ask) & (bid > 0) & (ask > 0)
    return F.when(ok, F.lit(10000.0) * (ask - bid) / ((bid + ask) / F.lit(2.0)))


def price(mode: str, bid: Column, ask: Column, bid_qty: Column, ask_qty: Column) -> Column:
    if mode == "mid":
        return mid(bid, ask)
    if mode == "microprice":
        return microprice(bid, ask, bid_qty, ask_qty)
    raise ValueError(f"unknown price mode: {mode}")


def log_return(now: Column, before: Column) -> Column:
    return F.when((now > 0) & (before > 0), F.ln(now) - F.ln(before))


def latency_ms(receive: Column, event: Column) -> Column:
    return F.when(receive.isNotNull() & event.isNotNull(), elapsed_ms(event, receive))


def correlation(cov: Column, var_x: Column, var_y: Column) -> Column:
    """cov over the product of the roots, not clipped; null unless all are finite and both variances positive."""
    ok = finite(cov) & finite(var_x) & finite(var_y) & (var_x > 0) & (var_y > 0)
    return F.when(ok, cov / (F.sqrt(var_x) * F.sqrt(var_y)))


def outside_unit(corr: Column) -> Column:
    return F.abs(corr) > 1.0


def interval_cap(p90: Column, p99: Column, least: float = 50.0, most: float = 2000.0) -> Column:
    full = F.lit(float(most))
    return F.greatest(F.lit(float(least)), F.least(full, F.lit(3.0) * F.coalesce(p90, full), F.coalesce(p99, full)))


def spread_cap(p99: Column, least: float = 10.0, most: float = 100.0) -> Column:
    low = F.lit(float(least))
    return F.least(F.lit(float(most)), F.greatest(low, F.lit(3.0) * F.coalesce(p99, low)))


def action(clean: Column, backward: Column, p90: Column, p99: Column, zero_ratio: Column) -> Column:
    """What an instrument's statistics suggest; the first rule that holds."""
    return (
        F.when(clean < 100, "too_few_clean_rows")
        .when(backward > 0, "input_order_problem")
        .when(p90 >= 500, "slow_update: stale filtering important")
        .when(p99 > 5.0 * F.nullif(p90, F.lit(0.0)), "bursty_or_stale: cap important")
        .when(zero_ratio >= 0.9, "many_zero_returns: check symbol/liquidity")
        .otherwise("normal")
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def group_label(exchange: Column, market_type: Column) -> Column:
    return F.when((F.lower(exchange) == "binance") & (F.lower(market_type) == "perp"), "A").otherwise("B")


def normal(c: Column) -> Column:
    return F.upper(F.trim(c))


def instrument_id(exchange: Column, market_type: Column, feed: Column, symbol: Column) -> Column:
    return F.concat_ws("__", exchange, market_type, feed, symbol)


def differs(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~a.eqNullSafe(b)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
