"""Retrieval and answer metrics, model usage and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """hits (query_id, rank, id), gold (query_id, id): each query's recall at k, first hit and reciprocal rank. Queries
    without gold are left out, those without hits score 0."""
    gold = gold.select("query_id", "id").distinct()
    found = gold.join(hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank")), ["query_id", "id"], "left")
    at = [F.round(F.sum((F.col("rank") <= k).cast("int")) / F.count("*"), 6) for k in ks]
    out = found.groupBy("query_id").agg(*[F.coalesce(a, F.lit(0.0)).alias(f"recall_{k}") for a, k in zip(at, ks, strict=True)], F.min("rank").cast("long").alias("first_hit"))
    return out.withColumn("rr", F.coalesce(F.round(1 / F.col("first_hit"), 6), F.lit(0.0)))


def by_kind(scored: DataFrame, means: list[str], kind: str = "kind") -> DataFrame:
    """Means over all rows and by kind: the row over all has kind 'overall'."""
    out = scored.rollup(kind).agg(F.count("*").alias("n"), F.grouping(kind).alias("__g"), *[F.round(F.avg(c), 4).alias(c) for c in means], F.round(F.avg(F.col("first_hit").isNotNull().cast("double")), 4).alias("hit_rate"), F.round(F.avg("first_hit"), 2).alias("mean_first_hit"))
    return out.select(F.when(F.col("__g") == 1, "overall").otherwise(F.col(kind)).alias(kind), "n", *means, "hit_rate", "mean_first_hit")


def answers(scored: DataFrame) -> DataFrame:
    """Means of judged answers over all and by kind, and points hit out of points; null where there are none."""
    means = ["faithfulness", "citation", "completeness"]
    out = scored.rollup("kind").agg(F.count("*").alias("n"), F.grouping("kind").alias("__g"), *[F.round(F.avg(c), 4).alias(c) for c in means], F.round(F.try_divide(F.sum("hit"), F.sum("points")), 4).alias("point_rate"))
    return out.select(F.when(F.col("__g") == 1, "overall").otherwise(F.col("kind")).alias("kind"), "n", *means, "point_rate")


def usage(calls: DataFrame) -> DataFrame:
    """calls (model, kind, prompt, completion, cached, elapsed): by kind and model; calls without a count of prompt tokens
    are unmetered and add no tokens."""
    metered = F.col("prompt").isNotNull()
    tokens = [F.coalesce(F.sum(F.when(metered, F.coalesce(c, F.lit(0)))), F.lit(0)).cast("long").alias(c) for c in ("prompt", "completion", "cached")]
    return calls.groupBy("kind", "model").agg(F.count("*").alias("calls"), *tokens, F.round(F.sum("elapsed"), 6).alias("elapsed"), F.sum((~metered).cast("long")).alias("unmetered"))


def costs(used: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost at prices (model, price_in, price_out, price_cached) for a million tokens; null, never 0, for unknown models."""
    met = used.join(prices, "model", "left")
    cost = (F.greatest(F.col("prompt") - F.col("cached"), F.lit(0)) * F.col("price_in") + F.col("cached") * F.coalesce("price_cached", "price_in") + F.col("completion") * F.col("price_out")) / 1e6
    return met.select("kind", "model", "calls", F.round(cost, 6).alias("cost"))


def total_cost(costed: DataFrame) -> DataFrame:
    """Null if any part is unknown or there is none."""
    return costed.agg(F.when((F.count("*") == F.count("cost")) & (F.count("*") > 0), F.round(F.sum("cost"), 6)).alias("total"))
