"""Market operators: bands, trends, sums of sensitivities, value at risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GREEKS = ("delta", "gamma", "theta", "vega")
# One-sided z scores by least confidence; below the last, 1.
Z_SCORES = ((0.99, 2.326), (0.975, 1.96), (0.95, 1.645), (0.90, 1.282))


def bollinger(df: DataFrame, keys: list[str], order: list[str], value: str, period: int = 20, width: float = 2.0) -> DataFrame:
    """``middle``, ``upper`` and ``lower`` bands by the population deviation of the last ``period`` rows; null before there are so many."""
    by = Window.partitionBy(*keys).orderBy(*order)
    w = by.rowsBetween(1 - period, 0)
    full = F.count(F.lit(1)).over(w) == period
    middle, spread = F.avg(value).over(w), F.stddev_pop(value).over(w)
    return df.withColumns({"middle": F.when(full, middle), "upper": F.when(full, middle + width * spread), "lower": F.when(full, middle - width * spread)})


def trend(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """A row per group: ``volatile`` where more than half of its rows step by more than 5 % of the first value (0.01 at least), else ``up``, ``down`` or ``flat`` by last minus first.

    Groups of one row are flat. Sums combine before the second shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limit = F.greatest(F.abs(F.first(value).over(whole)) * 0.05, F.lit(0.01))
    steps = df.select(*keys, *[c for c in order if c not in keys], F.col(value).alias("_v"), limit.alias("_limit"), F.lag(value).over(w).alias("_before"))
    at = F.struct(*order)
    out = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.sum((F.abs(F.col("_v") - F.col("_before")) > F.col("_limit")).cast("long")).alias("jumps"),
        (F.max_by("_v", at) - F.min_by("_v", at)).alias("change"),
        F.max("_limit").alias("_limit"),
    )
    kind = F.when(F.col("points") < 2, "flat").when(F.col("jumps") > F.col("points") * 0.5, "volatile").when(F.col("change") > F.col("_limit"), "up").when(F.col("change") < -F.col("_limit"), "down")
    return out.select(*keys, "points", F.coalesce(kind, F.lit("flat")).alias("trend"))


def sensitivities(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the Greeks and number of positions by symbol, expiry or both."""
    return positions.groupBy(*keys).agg(F.count(F.lit(1)).alias("positions"), *[F.sum(g).alias(g) for g in GREEKS])


def value_at_risk(delta: Column, notional: Column, confidence: float, days: int, daily_volatility: float = 0.02) -> Column:
    """Delta-normal value at risk: exposure times volatility over the holding period times the z score."""
    z = next((z for least, z in Z_SCORES if confidence >= least), 1.0)
    return F.abs(delta) * notional * (daily_volatility * days**0.5) * z


def margin(delta: Column, gamma: Column, vega: Column, notional: Column, daily_volatility: float = 0.02) -> Column:
    """Value at risk of a day at 95 % and additions for gamma (1 % of notional) and vega."""
    return value_at_risk(delta, notional, 0.95, 1, daily_volatility) + F.abs(gamma) * notional * 0.01 + F.abs(vega) * daily_volatility * notional


def profit_and_loss(trades: DataFrame, keys: list[str]) -> DataFrame:
    """``realised`` (sum over closed trades of size times exit minus entry) and ``unrealised`` (open ones, by ``mark``) per group."""
    gain = F.col("size") * (F.coalesce("exit", "mark") - F.col("entry"))
    return trades.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("exit").isNotNull(), gain)), F.lit(0.0)).alias("realised"),
        F.coalesce(F.sum(F.when(F.col("exit").isNull(), gain)), F.lit(0.0)).alias("unrealised"),
    )
