"""Tables that explain a choice: an example row, its best characters and candidates, and where its readings differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def find_example(reads: DataFrame, order: list[str]) -> DataFrame:
    """One of the rows ``visual, chosen, truth``: the first whose choice differs from the visual reading and is right, else the
    first that differs, else the first."""
    differs = F.col("chosen") != F.col("visual")
    right = differs & (F.col("truth") != "") & (F.col("chosen") == F.col("truth"))
    rank = F.when(right, 0).when(differs, 1).otherwise(2)
    return reads.withColumn("rank", rank.cast("bigint")).orderBy("rank", *order).limit(1)


def best_characters(lattice: DataFrame, keys: list[str], k: int = 4) -> DataFrame:
    """``keys, pos, rank, ch, lp``: the ``k`` best characters of each position."""
    order = Window.partitionBy(*keys, "pos").orderBy(F.desc("lp"), "ch_id")
    return lattice.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).select(*keys, "pos", "rank", "ch", "lp")


def best_candidates(candidates: DataFrame, keys: list[str], weight: float, k: int = 6) -> DataFrame:
    """``keys, candidate_index, visual_rank, score_rank``: the candidates among the ``k`` best by the visual sum or by the score."""
    w = Window.partitionBy(*keys)
    score = F.col("visual_sum") + weight * F.col("ppm_sum")
    ranked = candidates.withColumn("visual_rank", F.row_number().over(w.orderBy(F.desc("visual_sum"), "candidate_index")).cast("bigint")).withColumn("score_rank", F.row_number().over(w.orderBy(score.desc(), "candidate_index")).cast("bigint"))
    return ranked.where((F.col("visual_rank") <= k) | (F.col("score_rank") <= k)).select(*keys, "candidate_index", "visual_rank", "score_rank")


def disagreement_window(reads: DataFrame, keys: list[str], context: int = 2, least: int = 6) -> DataFrame:
    """``keys, lo, hi``: positions from ``context`` before the first to ``context`` behind the last difference of the choice from the
    visual reading or the truth, grown to ``least`` positions, to the left first; the whole row if nothing differs or the row
    has no more positions than that."""
    n = F.length("visual")

    def differences(a: str, b: str):  # noqa: ANN202
        return F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d.isNotNull())

    at = F.concat(
        F.filter(F.transform(differences("visual", "chosen"), lambda d, i: F.when(d, i)), lambda i: i.isNotNull()),
        F.when(F.length("truth") > 0, F.filter(F.transform(differences("truth", "chosen"), lambda d, i: F.when(d, i)), lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>")),
    )
    spot = reads.withColumn("at", F.filter(at, lambda i: i < n)).withColumn("n", n)
    first, last = F.greatest(F.array_min("at") - context, F.lit(0)), F.least(F.array_max("at") + context, F.col("n") - 1)
    placed = spot.withColumn("first", first).withColumn("last", last)
    short = F.greatest(F.least(F.lit(least), F.col("n")) - (F.col("last") - F.col("first") + 1), F.lit(0))
    lo = F.greatest(F.col("first") - short, F.lit(0))
    hi = F.col("last") + short - (F.col("first") - lo)
    whole = F.col("at").isNull() | (F.size("at") == 0) | (F.col("n") <= least)
    return placed.select(*keys, F.when(whole, 0).otherwise(lo).cast("bigint").alias("lo"), F.when(whole, F.col("n") - 1).otherwise(hi).cast("bigint").alias("hi"))
