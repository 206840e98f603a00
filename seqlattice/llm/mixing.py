"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Every source's target is cut into blocks of equally many words.  Blocks are the seats and targets the votes: the
quotients target / (2 k + 1) are given out from the highest on.  A source's seats are apportioned in the same way to its
256 parts, by their sizes, and a part's to its 256 shards, so no window holds more rows than that.  Parts and shards are named
by the first digits of a seeded hash, in tables of every size alike.  A shard is an order of its documents by that hash; its
quota takes the words of that order from the start, as often as needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the hash that name a part of a source, and a shard of it.
PART, SHARD = 2, 4


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_passes: int = 3) -> DataFrame:
    """``source, source_size, target``: one row for each source of ``sizes(source, size)``.

    Sources in code-point order, null last, get the weights in turn and share the sum of all sizes.  A target stops at
    ``most_passes`` times its source's size and the excess goes to the others by weight.  That ends where
    target = min(most_passes * size, level * weight), so the level is found directly: sources by rising cap per weight, the
    level of a prefix of stopped sources is what they leave over the weights behind them, and the highest level that the next
    source's cap allows is the one.
    The windows here run over one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    ranked = by_source.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most_passes).cast("double"))
    rising = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    behind = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    levels = (
        ranked.withColumn("level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(behind))
        .withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(all_rows))
    )
    return levels.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def apportion(votes: DataFrame, *, seats: Column, vote: str, within: list[str], tie: list[str]) -> DataFrame:
    """``votes`` with ``seats``: Sainte-Lague seats for each row, ``seats`` in all for each group of ``within``.

    With the divisor all / seats each row's share is rounded; what that misses or exceeds is at most half a seat a row, and
    goes to the highest, or from the lowest, quotients at those edges.  Ties: smaller ``tie`` first.
    """
    group = Window.partitionBy(*within)
    share = F.when(F.col("__all") > 0, F.col(vote) / F.col("__all") * F.col("__seats")).otherwise(F.lit(0.0))
    base = votes.withColumn("__all", F.sum(vote).over(group).cast("double")).withColumn("__seats", seats.cast("bigint")).withColumn("__base", F.floor(share + 0.5)).withColumn("__left", F.when(F.col("__all") > 0, F.col("__seats") - F.sum("__base").over(group)).otherwise(F.lit(0))).withColumn("__t", F.row_number().over(group.orderBy(*[F.col(t).asc_nulls_last() for t in tie])))
    # the quotients that may still change hands: as many a row as there are seats left
    step = F.sequence(F.lit(0), F.greatest(F.abs("__left") - 1, F.lit(0))).cast("array<bigint>")
    next_up = F.when(F.col("__left") > 0, F.transform(step, lambda j: F.col("__base") + j))
    last_down = F.when(F.col("__left") < 0, F.filter(F.transform(step, lambda j: F.col("__base") - 1 - j), lambda k: k >= 0))
    edge = base.select(*within, *tie, vote, "__left", "__t", F.explode(F.coalesce(next_up, last_down)).alias("__k")).withColumn("__q", F.col(vote) / (2 * F.col("__k") + 1))
    up = F.when(F.col("__left") > 0, 1).otherwise(-1)
    by_quotient = Window.partitionBy(*within).orderBy(-up * F.col("__q"), up * F.col("__t"), up * F.col("__k"))
    moved = edge.withColumn("__r", F.row_number().over(by_quotient)).where(F.col("__r") <= F.abs("__left")).groupBy(*within, *tie).agg(F.sum(F.signum("__left")).cast("bigint").alias("__moved"))
    names = [*within, *[t for t in tie if t not in within]]
    moved = moved.select(*[F.col(n).alias(f"__{n}") for n in names], "__moved")
    on = None
    for n in names:
        same = F.col(n).eqNullSafe(F.col(f"__{n}"))
        on = same if on is None else on & same
    return base.join(moved, on, "left").withColumn("seats", F.col("__base") + F.coalesce("__moved", F.lit(0))).select(*votes.columns, "seats")


def _key(source: Column) -> Column:
    """A source's name that is never null, so that rows are dealt out by it once for a window and for a join."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def mix_rows(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most_passes: int = 3, block_words: int = 4, seed: int = 42
) -> DataFrame:
    """``row, doc_id, size, source_size, target, taken``: as :func:`mix_sources`, with each input row as a struct.

    The rows travel through one shuffle, by shard, so each has its own ``taken`` however often its id or text occurs.  Runs
    jobs when called, which sum the sizes and deal the seats out to sources and parts.
    """
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    sizes = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), own)).alias("hash"),
        F.xxhash64(text_col).alias("mark"),
    )
    fine = saved(sizes.groupBy("source", F.substring("hash", 1, SHARD).alias("shard")).agg(F.sum("size").alias("shard_size")))
    goals = targets(fine.select("source", F.col("shard_size").alias("size")), weights, most_passes).withColumn("one", F.lit(1))
    total = F.sum("source_size").over(Window.partitionBy("one"))
    sources = apportion(goals, seats=F.round(total / block_words), vote="target", within=["one"], tie=["source"]).select(_key(F.col("source")).alias("key"), "source_size", "target", F.col("seats").alias("source_seats"))
    # an apportionment reads its votes twice, so plans of one upon another would double with each
    sources = saved(sources)
    shards = fine.select(_key(F.col("source")).alias("key"), F.substring("shard", 1, PART).alias("part"), "shard", "shard_size")
    parts = shards.groupBy("key", "part").agg(F.sum("shard_size").alias("part_size")).join(sources, "key")
    parts = apportion(parts, seats=F.col("source_seats"), vote="part_size", within=["key"], tie=["part"]).select("key", "part", "source_size", "target", F.col("seats").alias("part_seats"))
    parts = saved(parts)
    quotas = apportion(shards.join(parts, ["key", "part"]), seats=F.col("part_seats"), vote="shard_size", within=["key", "part"], tie=["shard"])
    # a source that stops at its cap gives all that it has
    most = F.col("shard_size") * most_passes
    quota = F.when(F.col("target") >= F.col("source_size") * most_passes, most).otherwise(F.least(F.col("seats") * block_words, most))
    quotas = quotas.select("key", "shard", "shard_size", "source_size", "target", quota.alias("quota"))
    before = Window.partitionBy("key", "shard").orderBy("hash", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    dealt = sizes.withColumns({"key": _key(F.col("source")), "shard": F.substring("hash", 1, SHARD)}).drop("source")
    placed = dealt.withColumn("from", F.coalesce(F.sum("size").over(before), F.lit(0)))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(F.lit(0))
    rest = F.col("quota") - passes * F.col("shard_size") - F.col("from")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.join(quotas, ["key", "shard"]).select("row", "doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mix_sources(docs: DataFrame, **options: object) -> DataFrame:
    """What the mix takes of each document: ``doc_id, size, source_size, target, taken``, one row for each row of ``docs``.

    Options: ``id_col``, ``text_col``, ``source_col``, ``weights``, ``most_passes``, ``block_words``, ``seed``.  ``size`` counts
    words (null text: 0).  For ``target`` see :func:`targets`; the words taken of a source differ from it by a few blocks of
    ``block_words`` at most.  ``taken`` counts repeats and never exceeds ``most_passes`` times the size.  Shards are the first
    digits of md5(seed:id), and their order is that hash, so reruns agree; rows that share an id follow each other in the order of their sizes, and each takes its own words.

    Rows with a null id are hashed by their text; null sources form a source of their own, the last; a source without words,
    or an empty table, takes nothing.  Other columns may have any name.
    """
    return mix_rows(docs, **options).drop("row")
