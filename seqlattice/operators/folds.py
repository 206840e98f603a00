"""Group folds and the guards against leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_folds(objects: DataFrame, k: int = 5, seed: int = 42, key: str = "base") -> DataFrame:
    """``base, fold``: distinct objects in the order of a seeded hash, dealt round; folds differ by one object at most.

    Objects are numbered in two steps: within each of 4096 ranges of the hash, and from the number of objects in the ranges in
    front of it.  A given table of folds takes the deal's place where parity matters.
    """
    placed = objects.select(key).distinct().withColumn("hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("range", F.substring("hash", 1, 3))
    sizes = placed.groupBy("range").agg(F.count("*").alias("size"))
    in_front = F.sum("size").over(Window.orderBy("range")) - F.col("size")
    numbered = placed.withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy("hash", key)) - 1)
    return numbered.join(sizes.select("range", in_front.alias("in_front")), "range").select(key, ((F.col("n") + F.col("in_front")) % k).cast("bigint").alias("fold"))


def keep_folds(df: DataFrame, folds: DataFrame, ids: list[int], exclude: bool = False, key: str = "base") -> DataFrame:
    """Rows whose object is in one of the folds, or in none of them."""
    return df.join(folds.where(F.col("fold").isin(ids)).select(key), key, "left_anti" if exclude else "left_semi")


def manifest_check(folds: DataFrame, k: int) -> DataFrame:
    """One row ``n_folds, n_missing, n_foreign``."""
    have = folds.agg(F.collect_set("fold").alias("have"))
    want = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i.cast("bigint"))
    return have.select(F.size("have").cast("bigint").alias("n_folds"), F.size(F.array_except(want, "have")).cast("bigint").alias("n_missing"), F.size(F.array_except("have", want)).cast("bigint").alias("n_foreign"))


def leaks(df: DataFrame, key: str = "base") -> DataFrame:
    """Objects that lie in more than one split or fold: ``base, n_splits, n_folds``."""
    return df.groupBy(key).agg(F.count_distinct("split").alias("n_splits"), F.count_distinct("fold").alias("n_folds")).where("n_splits > 1 OR n_folds > 1")


def attach_split(objects: DataFrame, lists: DataFrame, key: str = "base") -> DataFrame:
    """``objects`` with ``split`` from ``lists(base, split)``: of several, test before val before train; null if unlisted."""
    rank = F.when(F.col("split") == "test", 3).when(F.col("split") == "val", 2).when(F.col("split") == "train", 1).otherwise(0)
    best = lists.groupBy(key).agg(F.max_by("split", rank).alias("split"))
    return objects.join(best, key, "left")


def unassigned(objects: DataFrame, lists: DataFrame, key: str = "base") -> DataFrame:
    """Objects that no list names; a complete table has none."""
    return objects.join(lists, key, "left_anti")
