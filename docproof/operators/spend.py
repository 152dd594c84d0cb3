"""Prices of model calls, spend by day, kind and user, and the daily budget. Money is decimal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from docproof.session import broadcast_if_small

TOKENS = (("input_tokens", "p_in"), ("output_tokens", "p_out"), ("cache_read_tokens", "p_read"), ("cache_write_tokens", "p_write"))


def match_price(models: DataFrame, prices: DataFrame) -> DataFrame:
    """model, price_model: the price of exactly that name, else of the longest name it begins with, else null."""
    named = models.select("model").distinct()
    fits = named.join(broadcast_if_small(prices), F.startswith("model", "price_model"))
    best = fits.groupBy("model").agg(F.max_by("price_model", F.length("price_model")).alias("price_model"))
    return named.join(best, "model", "left")


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``calls`` with cost_usd decimal(10,6), rounded half-even; 0 where there is no price."""
    known = match_price(calls, prices).join(prices, "price_model", "left")
    total = sum((F.col(n).cast("decimal(18,0)") * F.coalesce(F.col(p), F.lit(0).cast("decimal(10,4)")) for n, p in TOKENS), F.lit(0).cast("decimal(20,4)"))
    cost = F.bround(total / F.lit(1_000_000).cast("decimal(10,0)"), 6).cast("decimal(10,6)")
    rows = calls.join(known, "model", "left").withColumn("cost_usd", cost)
    return rows.drop("price_model", *[p for _, p in TOKENS])


def unpriced_models(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Models without a price."""
    return match_price(calls, prices).filter("price_model is null").select("model")


def day(c: str = "created_at") -> Column:
    """The UTC day (sessions run in UTC)."""
    return F.to_date(F.col(c))


def spent_on_day(priced: DataFrame, date: str) -> DataFrame:
    """spent: 0 when nothing was."""
    return priced.filter(day() == F.lit(date).cast("date")).agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(12,6)").alias("spent"))


def budget_status(priced: DataFrame, budget: str) -> DataFrame:
    """day, spent, remaining (not below 0), exhausted (spent reaches the budget) of every day with calls."""
    limit = F.lit(budget).cast("decimal(10,2)")
    days = priced.groupBy(day().alias("day")).agg(F.sum("cost_usd").cast("decimal(12,6)").alias("spent"))
    return days.withColumn("remaining", F.greatest(F.lit(0).cast("decimal(12,6)"), (limit - F.col("spent")).cast("decimal(12,6)"))).withColumn("exhausted", F.col("spent") >= limit)


def budget_replay(priced: DataFrame, budget: str) -> DataFrame:
    """event_id, day, refused: a call is refused if the day's spend before it already reached the limit.

    Costs are not negative, so once it is reached it stays so, and the sum over all earlier calls
    decides as the sum over accepted ones would. A day is summed in two steps, by hour and within
    the hour, so a busy day is not one task's work."""
    limit = F.lit(budget).cast("decimal(10,2)")
    rows = priced.select("event_id", "created_at", "cost_usd", day().alias("day"), F.date_trunc("hour", "created_at").alias("hour"))
    hours = rows.groupBy("day", "hour").agg(F.sum("cost_usd").alias("h"))
    earlier = W.partitionBy("day").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    hours = hours.select("day", "hour", F.coalesce(F.sum("h").over(earlier), F.lit(0)).alias("earlier"))
    within = W.partitionBy("day", "hour").orderBy("created_at", "event_id").rowsBetween(W.unboundedPreceding, -1)
    spent = F.col("earlier") + F.coalesce(F.sum("cost_usd").over(within), F.lit(0))
    return rows.join(hours, ["day", "hour"]).withColumn("refused", spent >= limit).select("event_id", "day", "refused")


def spend_by_day(priced: DataFrame, last: str, days: int) -> DataFrame:
    """day, cost, calls of the ``days`` days up to ``last``, 0 where there were none."""
    end = F.lit(last).cast("date")
    all_ = priced.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    found = priced.groupBy(day().alias("day")).agg(F.sum("cost_usd").alias("cost"), F.count("*").alias("calls"))
    return all_.join(found, "day", "left").select("day", F.coalesce("cost", F.lit(0)).cast("decimal(12,6)").alias("cost"), F.coalesce("calls", F.lit(0)).alias("calls")).orderBy("day")


def spend_by_kind(priced: DataFrame) -> DataFrame:
    """kind, cost, calls; the most first."""
    return priced.groupBy("kind").agg(F.sum("cost_usd").cast("decimal(14,6)").alias("cost"), F.count("*").alias("calls")).orderBy(F.desc("cost"), "kind")


def spend_by_user(priced: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, full_name, cost, calls; calls without a user are kept, nameless ones last among equals."""
    sums = priced.groupBy("user_id").agg(F.sum("cost_usd").cast("decimal(14,6)").alias("cost"), F.count("*").alias("calls"))
    return sums.join(users.select("user_id", "full_name"), "user_id", "left").orderBy(F.desc("cost"), F.asc_nulls_last("full_name"))


def spend_share(spend: DataFrame) -> DataFrame:
    """``spend`` with share of the total; null when the total is 0. The total is one row."""
    total = spend.agg(F.sum("cost").alias("total"))
    return spend.crossJoin(F.broadcast(total)).withColumn("share", F.col("cost").cast("double") / F.nullif(F.col("total").cast("double"), F.lit(0.0))).drop("total")
