"""Scores against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval, clipped to [0, 1]; null without trials."""
    p = F.try_divide(successes.cast("double"), n.cast("double"))
    d = 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    clip = lambda v: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    n_safe = n > 0
    return F.when(n_safe, clip(middle - half)), F.when(n_safe, clip(middle + half))


def detection_scores(pairs: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row: the confusion of null-ness and its rates; a rate without cases is null."""
    g, p = F.col(gold).isNotNull(), F.col(predicted).isNotNull()
    counts = pairs.agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(~g & ~p).alias("tn"), F.count_if(g & ~p).alias("fn"),
        F.count_if(g & p & (F.col(gold) == F.col(predicted))).alias("exact"),
    )
    rate = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "specificity": rate(tn, tn + fp), "accuracy": rate(tp + tn, tp + fp + tn + fn), "value_accuracy": rate(F.col("exact"), tp)})
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def exact_match_rate(pairs: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """Share of rows whose two values agree; two nulls agree."""
    return pairs.groupBy(group).agg(F.avg(F.col(left).eqNullSafe(F.col(right)).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts, at most 1; 1 without any.

    The binomial terms run from C(n, 0) to C(n, min); the logarithm of each, over 2 ^ n,
    comes from the one before, so that counts of any size neither overflow nor vanish.
    """
    n, least = b + c, F.least(b, c)
    start = F.struct((-F.log(F.lit(2.0)) * n).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda a, k: F.struct((a["log"] + F.log((n - k) / (k + 1))).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), least.cast("long")), start, step, lambda a: a["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def title_words(title: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9 ]", " "), " +"), lambda w: w != ""))


def title_similarity(left: Column, right: Column) -> Column:
    """Jaccard of lower-case words; two empty titles are alike, an empty and another are not."""
    a, b = title_words(left), title_words(right)
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)
