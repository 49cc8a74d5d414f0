"""Spend per day, latest run states, cached answers: logs reduced to their present state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.functions.names import unused

PRICE = 1.0 / 1_000_000  # dollars a token where no cost is reported


def priced(events: DataFrame) -> DataFrame:
    """Adds cost and estimated: a call without a reported cost is estimated by its tokens; without tokens it stays null."""
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    guess = F.when(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(), tokens * PRICE)
    return events.withColumns({"cost": F.coalesce("cost_usd", guess), "estimated": F.col("cost_usd").isNull() & guess.isNotNull()})


def daily_spend(events: DataFrame, ceiling: float) -> DataFrame:
    """(day, spent, calls, estimated, remaining, exhausted) by UTC day."""
    held = priced(events).filter("cost is not null").groupBy(F.to_date("ts").alias("day")).agg(
        F.round(F.sum("cost"), 6).alias("spent"), F.count(F.lit(1)).alias("calls"), F.count_if("estimated").alias("estimated")
    )
    return held.withColumns({"remaining": F.greatest(F.lit(0.0), F.round(F.lit(ceiling) - F.col("spent"), 6)), "exhausted": F.col("spent") >= ceiling})


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last written row of each key; the order must be total."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("s")).select(key, "s.*")


def request_key(parts: dict[str, Column]) -> Column:
    """SHA-256 of a flat request with its names in order."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)


def cached_answers(requests: DataFrame, records: DataFrame, version: int, now: float, ttl: float) -> DataFrame:
    """Requests (key) with the first valid record's body: same version, and within the TTL if it is over 0; hit tells whether there is one."""
    valid = F.lit(True) if ttl <= 0 else F.coalesce(F.lit(now) - F.col("stored_at") <= ttl, F.lit(False))
    first = records.filter(F.col("version") == version).filter(valid).groupBy("key").agg(F.min_by("body", "seq").alias("body"))
    return requests.join(first, "key", "left").withColumn("hit", F.col("body").isNotNull())


def running_budget(rows: DataFrame, key: str, order: list[str], size: Column, most: int, total: str = "held") -> DataFrame:
    """The leading rows of each key whose sizes add up to ``most`` at the most; ``total``, a name that rows lack, holds the sum so far."""
    if unused(total, rows) != total:
        raise ValueError(f"rows have a column {total} of their own")
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(total, F.sum(size).over(upto)).filter(F.col(total) <= most)
