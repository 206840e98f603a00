"""Context counts of high order by sorting, and a packed model of them for scoring and beams.

**Counting.**  A letter with the ``order - 1`` letters before it is one key, whatever the order: keys sorted by the letters before, the
nearest first, put all letters that share a context of any length side by side, so the counts of every order are read off
sorted runs in one pass.  One row for each distinct key of a portion of texts is shuffled, by its nearest ``ROUTE`` letters, instead of
one for each letter and order.

**Scoring.**  A context is a number of five bits a letter, the nearest letter on top, so dropping the farthest letter is a shift.
A :class:`Packed` model is a handful of flat arrays over sorted numbers with suffix links; a task scores whole texts or
advances whole beams against it.  It is broadcast only if the counted n-grams stay within ``MOST_NGRAMS``.  Larger counts of
:func:`suffix_counts` lie in buckets by the nearest letters of their contexts (see ``routed``); other large tables are joined
(see ``ngram`` and ``lattice``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import ALPHABET
from ..session import kept

#: n-grams that a broadcast model may have: 12 bytes each, and 21 for each context.
MOST_NGRAMS = 16_000_000
#: Letters of the longest context, and groups (folds) of one model: 55 bits and 7.
MOST_LETTERS, MOST_GROUPS = 11, 128
BITS, GROUP_SHIFT = 5, 55
#: Nearest letters that decide where a context is counted; shorter contexts are few (27 ** ROUTE n-grams a group at most).
ROUTE = 4
#: Letters whose keys are made distinct before they are shuffled.
PORTION = 2_000_000
#: Number of a letter outside of the alphabet, which no context and no count has.
OTHER = 31
CLASSES, FLOOR = len(ALPHABET), 1e-12
_NUMBER = np.full(256, OTHER, np.int64)
_NUMBER[0] = 0
_NUMBER[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, CLASSES + 1)
_LETTER = {c: i for i, c in enumerate(ALPHABET, 1)}


def context_code(ctx: Column) -> Column:
    """The number of a context, its last letter on top."""
    number = F.aggregate(F.split(F.reverse(ctx), ""), F.lit(0).cast("bigint"), lambda a, c: a * (1 << BITS) + F.instr(F.lit(ALPHABET), c))
    return F.when(F.length(ctx) > 0, number).otherwise(F.lit(0).cast("bigint"))


def context_text(code: Column, m: Column) -> Column:
    """The context of ``m - 1`` letters with that number."""

    def letter(i: Column) -> Column:
        shifted = F.call_function("shiftright", code, (BITS * i).cast("int"))
        return F.substring(F.lit(ALPHABET), shifted.bitwiseAND(F.lit(OTHER).cast("bigint")).cast("int"), F.lit(1))

    return F.when(m > 1, F.array_join(F.transform(F.sequence(F.lit(0), m - 2), letter), "")).otherwise(F.lit(""))


def spelled(ngrams: DataFrame) -> DataFrame:
    """Counts with ``ctx, ch`` in place of ``code, ch_id``; other tables stay."""
    if "code" not in ngrams.columns:
        return ngrams
    ch = F.substring(F.lit(ALPHABET), F.col("ch_id"), F.lit(1))
    rest = [c for c in ngrams.columns if c not in ("code", "ch_id", "tot", "dis")]
    return ngrams.select(*rest, context_text(F.col("code"), F.col("m")).alias("ctx"), ch.alias("ch"))


def full_contexts(ch: np.ndarray, offset: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the ``width`` letters before each letter, as many as its text has; ``offset`` is a letter's place in its text."""
    full = np.zeros(len(ch), np.int64)
    for j in range(1, width + 1):
        full[j:] |= np.where(offset[j:] >= j, ch[:-j], 0) << (BITS * (width - j))
    return full


def keyed_letters(texts: DataFrame, order: int, text: str, by: list[str]) -> DataFrame:
    """``by, key, ch_id, n``: each letter behind the ``order - 1`` letters before it, counted within portions of texts; sorted keys of a
    group lie in as many partitions as their nearest letters tell."""
    fields = [*(texts.schema[b] for b in by), T.StructField("key", T.LongType()), T.StructField("ch_id", T.IntegerType()), T.StructField("n", T.LongType())]
    out = T.StructType(fields)
    n_by, names, width = len(by), [f.name for f in fields], order - 1

    def counted(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        ch, counts = _letters(table.column(n_by).to_pylist())
        if (ch == OTHER).any():
            raise ValueError("a letter outside of the alphabet")
        offset = np.arange(len(ch)) - np.repeat(np.cumsum(counts) - counts, counts)
        gram = (full_contexts(ch, offset, width) << BITS) | ch
        number: dict[tuple, int] = {}
        own = [number.setdefault(g, len(number)) for g in zip(*(table.column(i).to_pylist() for i in range(n_by)), strict=True)] if n_by else [0] * len(counts)
        group = np.repeat(np.array(own, np.int64), counts)
        kinds = [np.unique(gram[group == g] if len(number) > 1 else gram, return_counts=True) for g in range(max(len(number), 1))] if len(number) <= MOST_GROUPS else None
        if kinds is None:
            pairs, n = np.unique(np.stack([group, gram]), axis=1, return_counts=True)
            group, gram = pairs
        else:
            group, gram, n = np.repeat(np.arange(len(kinds)), [len(k) for k, _ in kinds]), np.concatenate([k for k, _ in kinds]), np.concatenate([c for _, c in kinds])
        first = {g: row for row, g in reversed(list(enumerate(own)))}
        at = pa.array(np.array([first[g] for g in range(len(first))], np.int64)[group])
        return pa.RecordBatch.from_arrays([*(table.column(i).combine_chunks().take(at) for i in range(n_by)), pa.array(gram >> BITS), pa.array((gram & OTHER).astype(np.int32)), pa.array(n.astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in portions(batch, "text"):
                held.append(part)
                size += part.column("text").nbytes
                if size >= PORTION:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    rows = texts.where(F.length(text) > 0).select(*by, F.col(text).alias("text")).mapInArrow(run, out)
    route = F.call_function("shiftright", F.col("key"), F.lit(BITS * max(width - ROUTE, 0)))
    return rows.repartition(*by, route).sortWithinPartitions(*by, "key")


class _Grams(NamedTuple):
    """The n-grams of order ``m`` of a batch: ``context`` of each and its sums, and by context whether it may go on elsewhere."""

    m: int
    groups: list[tuple]
    code: np.ndarray
    ch: np.ndarray
    n: np.ndarray
    tot: np.ndarray
    dis: np.ndarray
    part: np.ndarray


def _sorted_grams(order: int, n_by: int, batches: Iterator[pa.RecordBatch]) -> Iterator[_Grams]:
    """n-grams of all orders from batches sorted by group and key, one group at a time; a context that touches the ends of its group's rows
    in a batch is marked as ``part``, and so is a short one, which other partitions have too."""
    width = order - 1
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = list(zip(*(batch.column(i).to_pylist() for i in range(n_by)), strict=True)) if n_by else [()] * batch.num_rows
        cuts = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)] if n_by else [0, batch.num_rows]
        keys, letters, counts = (batch.column(c).to_numpy() for c in ("key", "ch_id", "n"))
        for start, end in zip(cuts, cuts[1:], strict=False):
            key, ch, n = keys[start:end], letters[start:end].astype(np.int64), counts[start:end]
            for m in range(1, order + 1):
                code = key >> (BITS * (width - m + 1))
                own = np.flatnonzero(((code & OTHER) > 0) | (m == 1))
                if not len(own):
                    break
                changed = np.diff(code[own]) != 0
                ctx = np.cumsum(np.r_[0, changed])
                gram, at = np.unique((ctx << BITS) | ch[own], return_inverse=True)
                owner = gram >> BITS
                first = own[np.flatnonzero(np.r_[True, changed])]
                part = np.full(len(first), m <= ROUTE)
                part[0] |= own[0] == 0
                part[-1] |= own[-1] == len(key) - 1
                tot = np.bincount(ctx, n[own]).astype(np.int64)
                yield _Grams(m, [groups[start]], code[first][owner], gram & OTHER, np.bincount(at, n[own]).astype(np.int64), tot[owner], np.bincount(owner)[owner], part[owner])


def _repeated(values: tuple, size: int, schema: pa.Schema, names: list[str]) -> list[pa.Array]:
    return [pa.repeat(pa.scalar(v, schema.field(c).type), size) for v, c in zip(values, names, strict=True)]


def _check_order(order: int) -> None:
    if not 1 <= order <= MOST_LETTERS + 1:
        raise ValueError(f"order {order} is not in 1..{MOST_LETTERS + 1}")


def suffix_counts(texts: DataFrame, order: int, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """``by, m, code, ch_id, n, tot, dis``: occurrences of letter ``ch_id`` (from 1) behind the context ``code`` of ``m - 1`` letters, and of
    the context, and its distinct followers, for every order ``m`` up to ``order`` (12 at most) and every group of ``by``.

    Texts hold letters of the alphabet only; others fail the query.  Null and empty texts count nothing.  Short contexts, and those that
    cross the ends of sorted batches, a few dozen a batch, are added up in a second, small step.  The counts are kept in the shared folder.
    """
    by = by or []
    _check_order(order)
    out = T.StructType([*(texts.schema[b] for b in by), *(T.StructField(c, t) for c, t in (("m", T.IntegerType()), ("code", T.LongType()), ("ch_id", T.IntegerType()), ("n", T.LongType()), ("tot", T.LongType()), ("dis", T.LongType()), ("part", T.BooleanType())))])
    n_by, schema = len(by), to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _sorted_grams(order, n_by, batches):
            size = len(g.code)
            arrays = [np.full(size, g.m, np.int32), g.code, g.ch.astype(np.int32), g.n, g.tot, g.dis, g.part]
            yield pa.RecordBatch.from_arrays([*_repeated(g.groups[0], size, schema, by), *map(pa.array, arrays)], schema=schema)

    counted = kept(keyed_letters(texts, order, text, by).mapInArrow(run, out), "counts")
    keys = [*by, "m", "code"]
    parts = counted.where("part").groupBy(*keys, "ch_id").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys)
    joined = parts.select(*keys, "ch_id", "n", F.sum("n").over(whole).alias("tot"), F.count("*").over(whole).alias("dis"))
    return counted.where("NOT part").drop("part").unionByName(joined)


def suffix_sums(texts: DataFrame, order: int, nearest: int = 2, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """``by, m, near, ch_id, contexts, n, tot, dis, most``: the counts of :func:`suffix_counts` summed over the contexts with the same
    ``nearest`` letters (two at most; ``near`` is their number), without a row for each of them: a task adds up its own."""
    by = by or []
    _check_order(order)
    sums = ["contexts", "n", "tot", "dis", "most"]
    out = T.StructType([*(texts.schema[b] for b in by), T.StructField("m", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("ch_id", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in sums), T.StructField("part", T.BooleanType())])
    n_by, schema = len(by), to_arrow_schema(out)

    def near(code, m: int):
        return code >> (BITS * max(m - 1 - nearest, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for g in _sorted_grams(order, n_by, batches):
            part, whole = np.flatnonzero(g.part), ~g.part
            if len(part):
                arrays = [np.full(len(part), g.m, np.int32), g.code[part], g.ch[part].astype(np.int32), np.ones(len(part), np.int64), *(x[part] for x in (g.n, g.tot, g.dis, g.n)), np.ones(len(part), bool)]
                yield pa.RecordBatch.from_arrays([*_repeated(g.groups[0], len(part), schema, by), *map(pa.array, arrays)], schema=schema)
            if whole.any():
                size = 1 << (BITS * (nearest + 1))
                own = held.setdefault((g.groups[0], g.m), np.zeros((5, size), np.int64))
                at, back = np.unique((near(g.code[whole], g.m) << BITS) | g.ch[whole], return_inverse=True)
                own[0, at] += np.bincount(back)
                for i, x in enumerate((g.n, g.tot, g.dis), 1):
                    own[i, at] += np.bincount(back, x[whole]).astype(np.int64)
                most = np.zeros(len(at), np.int64)
                np.maximum.at(most, back, g.n[whole])
                own[4, at] = np.maximum(own[4, at], most)
        for (group, m), own in held.items():
            at = np.flatnonzero(own[0])
            arrays = [np.full(len(at), m, np.int32), at >> BITS, (at & OTHER).astype(np.int32), *own[:, at], np.zeros(len(at), bool)]
            yield pa.RecordBatch.from_arrays([*_repeated(group, len(at), schema, by), *map(pa.array, arrays)], schema=schema)

    counted = kept(keyed_letters(texts, order, text, by).mapInArrow(run, out), "sums")
    keys = [*by, "m", "code"]
    parts = counted.where("part").groupBy(*keys, "ch_id").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys)
    joined = parts.select(*keys, "ch_id", F.lit(1).cast("bigint").alias("contexts"), "n", F.sum("n").over(whole).alias("tot"), F.count("*").over(whole).alias("dis"), F.col("n").alias("most"))
    cut = F.call_function("shiftright", F.col("code"), (BITS * F.greatest(F.col("m") - 1 - nearest, F.lit(0))).cast("int"))
    every = counted.where("NOT part").drop("part").unionByName(joined.withColumn("code", cut))
    return every.groupBy(*by, "m", F.col("code").alias("near"), "ch_id").agg(*[F.sum(c).alias(c) for c in sums[:-1]], F.max("most").alias("most"))


class Packed(NamedTuple):
    """``ctx``: sorted numbers of all contexts, the group on top; ``link``: place of the context without its farthest letter, -1 for the
    empty one; ``edge``: sorted ``place * 32 + letter`` with its count ``n``."""

    order: int
    groups: list[str]
    ctx: np.ndarray
    tot: np.ndarray
    dis: np.ndarray
    link: np.ndarray
    edge: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(order: int, groups: list[str], group: np.ndarray, code: np.ndarray, ch: np.ndarray, n: np.ndarray) -> Packed | None:
        """None if a context's shorter one is missing, which the search for the longest context relies on."""
        ctx, at = np.unique((group.astype(np.int64) << GROUP_SHIFT) | code, return_inverse=True)
        own = ctx & ((1 << GROUP_SHIFT) - 1)
        parent = (ctx - own) | (own >> BITS)
        link = np.searchsorted(ctx, parent)
        if (ctx[np.minimum(link, len(ctx) - 1)] != parent).any():
            return None
        edge = (at << BITS) | ch
        by_edge = np.argsort(edge)
        return Packed(order, groups, ctx, np.bincount(at, n).astype(np.int64), np.bincount(at).astype(np.int16), np.where(own == 0, -1, link).astype(np.int32), edge[by_edge], n[by_edge].astype(np.int32 if n.max(initial=0) < 1 << 31 else np.int64))

    def find(self, group: int | np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of a context in a group, and whether it is there."""
        key = (np.asarray(group, np.int64) << GROUP_SHIFT) | code
        at = np.minimum(np.searchsorted(self.ctx, key), len(self.ctx) - 1)
        return at, self.ctx[at] == key

    def totals(self, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences and distinct followers of counted contexts."""
        return self.tot[place], self.dis[place].astype(np.int64)

    def count(self, group: np.ndarray, place: np.ndarray, ch: np.ndarray) -> np.ndarray:
        key = (place.astype(np.int64) << BITS) | ch
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.n[at], 0)

    def longest(self, group: int | np.ndarray, full: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and letters of the longest counted context; ``full`` has ``order - 1`` letters, the nearest on top, ``length`` of
        them given.  Place -1 if not even the empty one is counted."""
        width = self.order - 1
        low, high = np.full(len(full), -1), np.minimum(length, width)
        place = np.full(len(full), -1)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            at, seen = self.find(group, full >> (BITS * (width - middle)))
            seen &= open_
            place, low = np.where(seen, at, place), np.where(seen, middle, low)
            high = np.where(seen | ~open_, high, middle - 1)
        return place, low

    def ppm(self, group: np.ndarray, place: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """Log probability of each letter behind its context, escaping from the longest one down."""
        p, at, hit = np.ones(len(ch)), place.copy(), np.zeros(len(ch), bool)
        due = np.flatnonzero(at >= 0)
        while len(due):
            own = at[due]
            n, (tot, dis) = self.count(group[due], own, ch[due]), self.totals(group[due], own)
            p[due] = p[due] * np.where(n > 0, n, dis) / (tot + dis)
            hit[due] = n > 0
            at[due] = self.link[own]
            due = due[(n == 0) & (at[due] >= 0)]
        return np.log(np.maximum(np.where(hit, p, p / CLASSES), FLOOR))

    def interpolated(self, group: np.ndarray, place: np.ndarray, depth: np.ndarray, ch: np.ndarray, share: float) -> np.ndarray:
        """Log probability after each order, by letter and order; what was not counted adds nothing."""
        ratio = np.zeros((self.order, len(ch)))
        at, deep = place.copy(), depth.copy()
        due = np.flatnonzero(at >= 0)
        while len(due):
            own = at[due]
            ratio[deep[due], due] = self.count(group[due], own, ch[due]) / self.totals(group[due], own)[0]
            at[due], deep[due] = self.link[own], deep[due] - 1
            due = due[at[due] >= 0]
        p, out = np.full(len(ch), 1 / CLASSES), []
        for m in range(self.order):
            p = share * ratio[m] + (1 - share) * p
            out.append(np.log(np.maximum(p, FLOOR)))
        return np.array(out)

    def extended(self, full: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """Contexts with one more letter in front of the next."""
        width = self.order - 1
        return (full >> BITS) | (ch << (BITS * (width - 1))) if width else full


class Without(Packed):
    """All counts less those of the own group, which the model of the groups ``own`` holds."""

    own: Packed
    gone: np.ndarray

    @staticmethod
    def of_both(every: Packed, own: Packed) -> Without:
        out = Without(*every._replace(groups=own.groups))
        out.own = own
        # followers of a context that no other group has
        place, ch = own.edge >> BITS, own.edge & OTHER
        code = own.ctx[place] & ((1 << GROUP_SHIFT) - 1)
        alone = Packed.count(every, place, Packed.find(every, 0, code)[0], ch) == own.n
        out.gone = np.bincount(place[alone], minlength=len(own.ctx)).astype(np.int16)
        return out

    def __reduce__(self):
        return Without.of_both, (Packed(*self), self.own)

    def _own(self, group: int | np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.own.find(group, self.ctx[place])

    def find(self, group: int | np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, seen = Packed.find(self, 0, code)
        at, held = self._own(group, place)
        return place, seen & (self.tot[place] > np.where(held, self.own.tot[at], 0))

    def totals(self, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, held = self._own(group, place)
        return self.tot[place] - np.where(held, self.own.tot[at], 0), self.dis[place].astype(np.int64) - np.where(held, self.gone[at], 0)

    def count(self, group: np.ndarray, place: np.ndarray, ch: np.ndarray) -> np.ndarray:
        at, held = self._own(group, place)
        return Packed.count(self, group, place, ch) - np.where(held, self.own.count(group, at, ch), 0)


def without(own: Packed) -> Without:
    """For each group of ``own`` the counts of all its other groups."""
    place, ch = own.edge >> BITS, own.edge & OTHER
    code = own.ctx[place] & ((1 << GROUP_SHIFT) - 1)
    gram, at = np.unique((code << BITS) | ch, return_inverse=True)
    every = Packed.of(own.order, [""], np.zeros(len(gram), np.int64), gram >> BITS, gram & OTHER, np.bincount(at, own.n).astype(np.int64))
    return Without.of_both(every, own)


def by_bucket(ngrams: DataFrame, order: int) -> bool:
    """Whether counts that no packed model holds can be looked up in buckets: those of :func:`suffix_counts`."""
    return "code" in ngrams.columns and 1 <= order <= MOST_LETTERS + 1


def _group(by: list[str]) -> Column:
    return F.to_json(F.struct(*by)) if by else F.lit("")


def pack(ngrams: DataFrame, order: int, by: list[str] | None = None) -> Packed | None:
    """A packed model of counts ``by, m, ctx, ch, n`` (as of ``ngram.counts``) or ``by, m, code, ch_id, n`` (as of :func:`suffix_counts`).

    None where the counts are too many, too deep or in too many groups, or hold other letters than the alphabet's: they are
    counted before any of them comes to the driver.
    """
    by = by or []
    if not 1 <= order <= MOST_LETTERS + 1:
        return None
    coded = "code" in ngrams.columns
    code, ch = (F.col("code"), F.col("ch_id")) if coded else (context_code(F.col("ctx")), F.instr(F.lit(ALPHABET), F.col("ch")))
    strange = F.lit(False) if coded else (ch == 0) | (F.length(F.translate("ctx", ALPHABET, "")) > 0)
    rows = ngrams.where(F.col("m") <= order).select(_group(by).alias("g"), code.alias("code"), ch.alias("ch"), "n", strange.alias("strange"))
    size = rows.agg(F.count("*").alias("n"), F.max("strange").alias("strange")).first()
    if not 0 < size.n <= MOST_NGRAMS or size.strange:
        return None
    groups = sorted(r.g for r in rows.select("g").distinct().limit(MOST_GROUPS + 1).collect())
    if len(groups) > MOST_GROUPS:
        return None
    number = F.array_position(F.array(*map(F.lit, groups)), F.col("g")) - 1
    got = rows.select(number.cast("int").alias("g"), "code", F.col("ch").cast("int").alias("ch"), "n").toArrow()
    return Packed.of(order, groups, *(got.column(c).to_numpy() for c in ("g", "code", "ch", "n")))


def shared(ngrams: DataFrame, order: int, by: list[str] | None = None) -> Broadcast | None:
    """:func:`pack` as a broadcast."""
    model = pack(ngrams, order, by)
    return None if model is None else ngrams.sparkSession.sparkContext.broadcast(model)


def shared_without(by_group: DataFrame, order: int, by: list[str]) -> Broadcast | None:
    """For each group of ``by`` the counts of all other groups (as ``ngram.excluded`` gives them), from counts by group."""
    own = pack(by_group, order, by)
    if own is None:
        return None
    return by_group.sparkSession.sparkContext.broadcast(without(own))


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all letters, one text after the other, and the texts' lengths."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    return np.where(points < 256, _NUMBER[np.minimum(points, 255)], OTHER), np.array([len(t) for t in texts], np.int64)


def text_steps(texts: DataFrame, model: Broadcast, keys: list[str], *, share: float = 0.8, text: str = "text", by: list[str] | None = None, profile: bool = False) -> DataFrame:
    """``keys, text, ppm array<double>, interpolated array<double>`` (or ``profile array<array<double>>``): scores of each letter of each text.

    Texts are scored in portions, all letters of a portion at once; nothing is shuffled.  Null and empty texts give no row.
    """
    by = by or []
    extra = T.StructField("profile", T.ArrayType(T.ArrayType(T.DoubleType()))) if profile else T.StructField("interpolated", T.ArrayType(T.DoubleType()))
    all_keys = [*dict.fromkeys([*by, *keys])]
    out = T.StructType([*(texts.schema[k] for k in all_keys), T.StructField("text", T.StringType()), T.StructField("ppm", T.ArrayType(T.DoubleType())), extra])
    n_keys = len(all_keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: Packed = model.value
        width = packed.order - 1
        number = {g: i for i, g in enumerate(packed.groups)}
        for batch in batches:
            for part in portions(batch, "text"):
                own = part.column("text").to_pylist()
                ch, counts = _letters(own)
                offset = np.arange(len(ch)) - np.repeat(np.cumsum(counts) - counts, counts)
                full = full_contexts(ch, offset, width)
                # a text of a group without counts meets no context
                group = np.repeat(np.array([number.get(g, -1) for g in part.column("__g").to_pylist()], np.int64), counts)
                place, depth = packed.longest(group, full, offset)
                ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
                ppm = pa.ListArray.from_arrays(pa.array(ends), pa.array(packed.ppm(group, place, ch)))
                inter = packed.interpolated(group, place, depth, ch, share)
                if profile:
                    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, inter.size + 1, packed.order, dtype=np.int32)), pa.array(inter.T.ravel()))
                    more = pa.ListArray.from_arrays(pa.array(ends), inner)
                else:
                    more = pa.ListArray.from_arrays(pa.array(ends), pa.array(inter[-1]))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n_keys)), part.column("text"), ppm, more], names=out.names)

    rows = texts.where(F.length(text) > 0).select(*all_keys, F.col(text).alias("text"), _group(by).alias("__g"))
    return rows.mapInArrow(run, out)


def text_summaries(texts: DataFrame, model: Broadcast, keys: list[str], fields: list[T.StructField], summary: Callable[..., list[pa.Array]], *, share: float = 0.8, text: str = "text", together: bool = False) -> DataFrame:
    """``keys`` and ``fields`` for each text: what ``summary`` makes of its letters in the task that scores them, so no letter is a row.

    ``summary(starts, offset, ppm, profile)`` is given where each text starts, each letter's place in it, and functions for its scores
    (those cut off at every order: a row for each order).  With ``together`` texts of equal keys are one, letters of one place side by
    side; texts are shuffled for that.  Null and empty texts give no row.
    """
    out = T.StructType([*(texts.schema[k] for k in keys), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: Packed = model.value
        for batch in batches:
            for part in portions(batch, "text"):
                ch, counts = _letters(part.column("text").to_pylist())
                sizes = part.column("sizes").flatten().to_numpy().astype(np.int64)
                offset = np.arange(len(ch)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                full, group = full_contexts(ch, offset, packed.order - 1), np.zeros(len(ch), np.int64)
                place, depth = packed.longest(group, full, offset)
                order = np.lexsort((offset, np.repeat(np.arange(len(counts)), counts))) if len(sizes) > len(counts) else slice(None)
                found = summary(np.cumsum(counts) - counts, offset[order], lambda: packed.ppm(group, place, ch)[order], lambda: packed.interpolated(group, place, depth, ch, share)[:, order])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *found], names=out.names)

    rows = texts.where(F.length(text) > 0).select(*keys, F.col(text).alias("text"))
    own = rows.groupBy(*keys).agg(F.collect_list("text").alias("own")) if together else rows.withColumn("own", F.array("text"))
    return own.select(*keys, F.array_join("own", "").alias("text"), F.transform("own", F.length).alias("sizes")).mapInArrow(run, out)


def portions(batch: pa.RecordBatch, column: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of a string column."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def beam_texts(packed: Packed, group: int, lattice: list[list[tuple[float, int, str]]], weight: float, beam: int) -> tuple[list[str], np.ndarray]:
    """The best ``beam`` texts of one lattice and their scores, best first; each position has ``(log probability, letter, text)``."""
    score, full, back = np.zeros(1), np.zeros(1, np.int64), []
    for k, cell in enumerate(lattice):
        lp, ch = np.array([c[0] for c in cell]), np.array([c[1] for c in cell], np.int64)
        place, _ = packed.longest(group, full, np.full(len(full), k))
        lm = packed.ppm(np.full(len(full) * len(cell), group), np.repeat(place, len(cell)), np.tile(ch, len(full))).reshape(len(full), len(cell))
        grown = ((score[:, None] + lp) + weight * lm).ravel()
        best = np.argsort(-grown, kind="stable")[:beam]
        parent, pick = np.divmod(best, len(cell))
        score, full = grown[best], packed.extended(full[parent], ch[pick])
        back.append((parent, pick))
    texts = [""] * len(score)
    at = np.arange(len(score))
    for cell, (parent, pick) in zip(lattice[::-1], back[::-1], strict=True):
        texts = [cell[c][2] + t for c, t in zip(pick[at].tolist(), texts, strict=True)]
        at = parent[at]
    return texts, score


def lattice_cells(cells: list[list[dict]]) -> list[list[tuple[float, int, str]]]:
    """A lattice as :func:`beam_texts` takes it."""
    return [[(-c["neg"], _LETTER.get(c["ch"], OTHER), c["ch"]) for c in cell] for cell in cells]


def packed_beam(rows: DataFrame, model: Broadcast, weight: float, beam: int, keys: list[str], by: list[str]) -> DataFrame:
    """``keys, rank, text, score`` of rows ``keys, lat``: arrays over positions of ``neg, ch_id, ch`` over characters, best first.

    A row's beam stays in one task's memory from its first position to its last.
    """
    out = T.StructType([*(rows.schema[k] for k in keys), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: Packed = model.value
        number = {g: i for i, g in enumerate(packed.groups)}
        for batch in batches:
            texts, scores = [], []
            for cells, g in zip(batch.column("lat").to_pylist(), batch.column("__g").to_pylist(), strict=True):
                own, score = beam_texts(packed, number.get(g, -1), lattice_cells(cells), weight, beam)
                texts.append(own)
                scores.append(score.tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_keys)), pa.array(texts, pa.list_(pa.string())), pa.array(scores, pa.list_(pa.float64()))], names=out.names)

    return ranked_texts(rows.select(*keys, "lat", _group(by).alias("__g")).mapInArrow(run, out), keys)


def ranked_texts(found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rank, text, score`` of arrays ``texts, scores``, best first."""
    ranked = found.select(*keys, F.posexplode(F.arrays_zip("texts", "scores")).alias("rank", "b"))
    return ranked.select(*keys, F.col("rank").cast("bigint").alias("rank"), F.col("b.texts").alias("text"), F.col("b.scores").alias("score"))
