"""Dense numbers over the sorted rows of a whole table, and shards of them, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved


def numbered(rows: DataFrame, order: list[str], number: str = "number") -> DataFrame:
    """``rows`` with ``number``: the place of a row in the order of the columns ``order``, from 1, nulls first.

    Rows are dealt to ranges of the order, and a range's numbers go on behind the rows of the ranges before it; only one count a
    range meets the driver.  Rows of equal keys stand in the order of a hash of all their columns, so that a key with
    many rows spreads over ranges too.
    """
    tie = F.xxhash64(*[F.to_json(F.struct("*"))]).alias("__tie")
    keys = [*order, "__tie"]
    ranged = rows.select("*", tie).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    # the low 33 bits of this id are the row's place in its partition
    placed = saved(ranged.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")))
    counts = sorted((r["__range"], r["n"]) for r in placed.groupBy("__range").agg((F.max("__place") + 1).alias("n")).collect())
    before, offsets = 0, []
    for part, n in counts:
        offsets += [F.lit(part), F.lit(before)]
        before += n
    start = F.create_map(*offsets)[F.col("__range")] if offsets else F.lit(0)
    return placed.withColumn(number, (start + F.col("__place") + 1).cast("bigint")).drop("__range", "__place")


def row_shard(rows: DataFrame, order: list[str], shard: int, shards: int, limit: int = 0) -> DataFrame:
    """``rows`` with ``number`` whose number over the sorted table, less one, is ``shard`` modulo ``shards``; of these the first ``limit`` (0: all)."""
    if shards < 1 or not 0 <= shard < shards:
        raise ValueError(f"shard {shard} of {shards}")
    place = F.col("number") - 1
    own = numbered(rows, order).where(place % shards == shard)
    return own.where(F.floor(place / shards) < limit) if limit > 0 else own
