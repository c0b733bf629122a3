"""Seeded orders, samples, budget splits and resumable work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: Column, seed: int = 0) -> Column:
    """An order that looks random and is the same on every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    return df.withColumn("_o", seeded(F.col(key), seed)).orderBy("_o", key).limit(k).drop("_o")


def running_before(df: DataFrame, order: str, value: str, out: str, tie: str) -> DataFrame:
    """Adds the sum of `value` over all rows before, by a hex `order` column: sums of 4,096 buckets of the order's first three digits,
    then a running sum within each bucket, so no task sorts all rows."""
    bucket = F.substring(order, 1, 3)
    rows = df.withColumn("_b", bucket)
    sums = rows.groupBy("_b").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_b").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    # at most 4,096 rows
    return rows.join(F.broadcast(sums), "_b").withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("_b", "_before")


def budget_split(df: DataFrame, key: str, size: str, held: int, train: int, seed: int = 0) -> DataFrame:
    """Adds split: in seeded order `held` until its bytes reach the budget, then `train` until its own do, then `dropped`; the document that goes over stays."""
    rows = running_before(df.withColumn("_o", seeded(F.col(key), seed)), "_o", size, "before", key)
    end = rows.filter(F.col("before") < held).agg(F.coalesce(F.max(F.col("before") + F.col(size)), F.lit(0)).alias("_held"))
    end = end.first()["_held"]  # one number
    split = F.when(F.col("before") < held, "held").when(F.col("before") - F.lit(end) < train, "train").otherwise("dropped")
    return rows.withColumn("split", split).drop("_o")


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work not done yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def with_default(df: DataFrame, labels: DataFrame, key: str, label: str, order: str, default) -> DataFrame:
    """Left join by key with a default; of repeated labels the last by `order` counts."""
    last = labels.groupBy(key).agg(F.max_by(label, order).alias(label))
    return df.join(last, key, "left").withColumn(label, F.coalesce(label, F.lit(default)))


def batches(df: DataFrame, key: str, size: int, out: str = "batch", seed: int = 0) -> DataFrame:
    """Numbers rows in batches of `size` within 256 groups of the seeded order; no global order."""
    group = F.substring(seeded(F.col(key), seed), 1, 2)
    n = F.row_number().over(Window.partitionBy(group).orderBy(seeded(F.col(key), seed), key)) - 1
    return df.withColumn(out, F.concat_ws("-", group, F.floor(n / size).cast("string")))
