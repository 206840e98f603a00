"""Exact top-k inner products: ball-tree branch and bound in shards.

Vectors are dealt to cells of space: each to the nearest of a few centres, which are fitted on a bounded sample.  A cell is a
ball around its centre, so it bounds the inner products of a query (q . centre + |q| radius).  A query first meets the cell of the
highest bound; the k-th score found there is a floor that it takes to those other cells only whose bound reaches it.  Large
cells are cut into shards of a bounded number of rows.  Queries whose best cell is one cell, or neighbours in number, form a
block, so a block asks for few shards; a shard is copied to the blocks that ask for it, and each such pair is a group.
In a shard the nodes of a ball tree are visited in the order of their bounds until no bound reaches the current k-th
score.  What comes back is at most k rows for each query and shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import saved

#: Rows that the centres are fitted on, rows of a centre at least, and centres at most.
SAMPLE, ROWS_A_CENTRE, MOST_CENTRES = 4096, 200, 256
#: Rows of a shard and queries of a block, about.
SHARD_ROWS, BLOCK_QUERIES = 20_000, 20_000
_LONG = (1 << 63) - 1
_FOUND = "q bigint, query_id bigint, vec_id bigint, score bigint"


def integers(vectors: list, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length: 64-bit integers, or Python's if products of those could overflow."""
    x = np.stack(vectors).astype(np.float64)
    if float(np.abs(x).max(initial=0)) * scale < 2.0**31 / max(1, x.shape[1]) ** 0.5:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[int(c) * scale if abs(c) >= 2.0**52 else int(np.floor(c * scale)) for c in row] for row in x], object).reshape(x.shape)


class BallTree:
    """Balls over the rows of an integer matrix, split at the median of the widest coordinate; leaves hold ``leaf`` rows or fewer.

    A matrix of Python's integers is one leaf, as floating bounds say nothing there.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = 64):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.plain = rows.dtype != object
        self.children: list[list[int] | None] = []
        self.members: list[np.ndarray] = []
        self.visited = 0  # leaves
        centres, radii = [], []
        todo = [(np.arange(len(rows)), -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            node = len(self.members)
            if parent >= 0:
                self.children[parent][side] = node
            self.children.append(None)
            self.members.append(np.sort(own))
            if not self.plain:
                break
            points = self.rows[own].astype(np.float64)
            centre = points.mean(axis=0)
            centres.append(centre)
            radii.append(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))
            spread = points.max(axis=0) - points.min(axis=0)
            if len(own) > leaf and spread.any():
                at = np.argsort(points[:, spread.argmax()], kind="stable")
                self.children[node] = [-1, -1]
                half = len(own) // 2
                todo += [(own[at[:half]], node, 0), (own[at[half:]], node, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        # sums of products stay exact in doubles below 2^53
        self.exact = self.plain and float(np.abs(self.rows).max(initial=0)) ** 2 * self.rows.shape[1] < 2**52
        self.floats = self.rows.astype(np.float64) if self.exact else None

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds for queries by nodes, with room for rounding."""
        if not self.plain or queries.dtype == object:
            return np.full((len(queries), len(self.members)), np.inf)
        return upper_bounds(queries.astype(np.float64), self.centres, self.radii)

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: float, home: bool = True) -> list[tuple[int, int]]:
        """The k best (score, -id) at or above ``floor``; at home one row with the query's id and vector is itself and left out."""
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        exact = self.exact and query.dtype != object and float(np.abs(query).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) * len(query) < 2**52
        vector = query.astype(np.float64) if exact else query.astype(object)
        own_rows = np.flatnonzero(self.ids == query_id) if home else []
        itself = next((int(i) for i in own_rows if (self.rows[i] == query).all()), -1)
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            self.visited += 1
            own = self.members[node]
            scores = (self.floats[own] @ vector).astype(np.int64) if exact else self.rows[own].astype(object) @ vector
            near = np.flatnonzero(scores >= floor)
            if len(near) > k + 1:  # members are in the order of their ids, so of equal scores the smaller ids stay
                near = near[np.argsort(-scores[near], kind="stable")[: k + 1]]
            for i in near:
                if own[i] == itself:
                    continue
                entry = (int(scores[i]), -int(self.ids[own[i]]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Bounds on the inner products of queries with the points of balls, with room for rounding."""
    length = np.sqrt((queries * queries).sum(axis=1))[:, None]
    with np.errstate(all="ignore"):
        room = 1e-9 * length * (np.sqrt((centres**2).sum(axis=1)) + radii)[None, :] + 1e-6
        found = queries @ centres.T + length * radii[None, :] + room
    return np.where(np.isfinite(found), found, np.inf)


def fit_centres(sample: list, n: int, rounds: int = 5) -> np.ndarray:
    """``n`` centres of a sample by a few rounds of means, seeded by its first rows."""
    x = np.array(sample, np.float64)
    centres = np.unique(x, axis=0)[:: max(1, len(x) // n)][:n] if len(x) else np.zeros((0, 0))
    for _ in range(rounds):
        own = _nearest(x, centres)
        centres = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        d = (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.nan_to_num(d, nan=0.0).argmin(axis=1)


def _by_length(vectors: list) -> dict[int, np.ndarray]:
    """Row numbers for each length."""
    long = np.array([len(v) for v in vectors], np.int64)
    return {int(n): np.flatnonzero(long == n) for n in np.unique(long)}


def _deal(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows with ``dim``, ``cell`` and their distance from its centre; lengths without centres have one in the origin."""
    for batch in batches:
        vectors = batch.column("v").to_pylist()
        cell, far = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        for dim, at in _by_length(vectors).items():
            x, own = np.array([vectors[i] for i in at], np.float64).reshape(len(at), dim), centres.get(dim, np.zeros((1, dim)))
            cell[at] = _nearest(x, own)
            with np.errstate(all="ignore"):
                far[at] = np.sqrt(((x - own[cell[at]]) ** 2).sum(axis=1))
        far = np.where(np.isfinite(far), far, np.inf)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(map(len, vectors), pa.int32()), pa.array(cell), pa.array(far)], names=["id", "v", "dim", "cell", "far"])


def _route(batches: Iterator[pa.RecordBatch], balls: dict[int, tuple], scale: int, first: bool) -> Iterator[pa.RecordBatch]:
    """Queries with each cell that they visit: the one of the highest bound, or all others whose bound reaches the floor."""
    for batch in batches:
        vectors, floors = batch.column("v").to_pylist(), None if first else batch.column("floor").to_pylist()
        took, cells = [], []
        for dim, at in _by_length(vectors).items():
            if dim not in balls:
                continue
            numbers, centres, radii = balls[dim]
            x = np.array([vectors[i] for i in at], np.float64).reshape(len(at), dim)
            # the integers lie within one of scale * x in every component, of queries as of points
            size = np.sqrt((x * x).sum(axis=1))
            with np.errstate(all="ignore"):
                bound = scale * scale * upper_bounds(x, centres, radii) + scale * np.sqrt(dim) * (size[:, None] + (np.sqrt((centres**2).sum(axis=1)) + radii)[None, :]) + dim
            bound = np.where(np.isfinite(bound), bound, np.inf)
            best = bound.argmax(axis=1)
            for row, i in enumerate(at):
                goes = [best[row]] if first else [c for c in np.flatnonzero(bound[row] >= (-np.inf if floors[i] is None else floors[i])) if c != best[row]]
                took += [int(i)] * len(goes)
                cells += [int(numbers[c]) for c in goes]
        names = ["q", *([] if first else ["block", "floor"])]
        out = pa.RecordBatch.from_arrays([batch.column(c) for c in names], names=names).take(pa.array(took, pa.int64()))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells, pa.int32())], names=[*out.schema.names, "cell"])


def query_blocks(counts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """For each (cell, queries) the number of its first block and how many it has: small cells share one, large ones have several."""
    out: list[tuple[int, int, int]] = []
    block = filled = 0
    for cell, n in counts:
        if filled and filled + n > BLOCK_QUERIES:
            block, filled = block + 1, 0
        own = max(1, -(-n // BLOCK_QUERIES))
        out.append((cell, block, own))
        block, filled = (block, filled + n) if own == 1 else (block + own, 0)
    return out


def _search(vectors: pd.DataFrame, queries: pd.DataFrame, k: int, scale: int) -> pd.DataFrame:
    found: list[tuple[int, int, int, int]] = []
    if len(vectors) and len(queries):
        tree = BallTree(vectors["id"].to_numpy(np.int64), integers(list(vectors["v"]), scale))
        own = int(vectors["shard"].iloc[0])
        for start in range(0, len(queries), 256):
            block = queries.iloc[start : start + 256]
            q = integers(list(block["v"]), scale)
            bounds = tree.bounds(q)
            floors = block["floor"].to_numpy(np.float64) if "floor" in block else np.full(len(block), -np.inf)
            floors = np.where(np.isnan(floors), -np.inf, floors)
            for i, (number, query_id, home) in enumerate(zip(block["q"].tolist(), block["id"].tolist(), block["home"].tolist(), strict=True)):
                found += [(number, query_id, -n, max(-_LONG, min(_LONG, s))) for s, n in tree.search(query_id, q[i], bounds[i], k, floors[i], home == own)]
    return pd.DataFrame(found, columns=["q", "query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v array<double>``; rows with a null id, a null vector, or null or non-finite components are left out."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), x.alias("v"))


def exact_top_k(vectors: DataFrame, *, every: int = 50, k: int = 5, centres: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` the k rows of highest inner product of
    floor(scale * x).

    Queries are rows of the table too; a row never answers itself, ties go to the smaller id, and a query with fewer than k
    other rows gets them all.  Rows that :func:`usable` leaves out take no part.  Rows that share an id are rows of their own,
    as queries too; vectors of different lengths have no product and never answer each other, empty ones have the product 0; a score beyond the range of a
    long is ordered by its true value within a shard and shown as the nearest long.

    Centres (one for ROWS_A_CENTRE rows, MOST_CENTRES at most, unless given) are fitted on the SAMPLE rows of smallest hash; every
    row is dealt to one.  They only decide on where the work is done.  Runs jobs when called.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col=id_col, vector_col=vector_col)
    drawn: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        drawn.setdefault(len(r.v), []).append(r.v)
    count = rows.count()
    n = centres or int(np.clip(count // ROWS_A_CENTRE, 1, MOST_CENTRES))
    fitted = {dim: fit_centres(own, min(n, max(1, len(own) // 4))) for dim, own in drawn.items() if dim}
    dealt = saved(rows.mapInArrow(lambda it: _deal(it, fitted), "id bigint, v array<double>, dim int, cell int, far double"))
    # one row for each length and cell, and lengths outside of the sample have one cell
    cells = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("dim", "cell").collect()
    balls: dict[int, tuple[list, list, list]] = {}
    for number, c in enumerate(cells):
        own = fitted.get(c["dim"], np.zeros((1, c["dim"])))
        for part, x in zip(balls.setdefault(c["dim"], ([], [], [])), (number, own[c["cell"]], c["radius"]), strict=True):
            part.append(x)
    balls = {dim: tuple(map(np.array, x)) for dim, x in balls.items()}
    numbered = spark.createDataFrame([(c["dim"], c["cell"], i, max(1, -(-c["n"] // SHARD_ROWS))) for i, c in enumerate(cells)], "dim int, cell int, number int, parts int")

    def shard(number: Column, part: Column) -> Column:
        return number.cast("bigint") * (1 << 32) + part

    placed = dealt.join(numbered, ["dim", "cell"]).select("id", "v", shard(F.col("number"), F.pmod(F.xxhash64("id", "v"), "parts")).alias("shard"))
    queries = saved(placed.where(F.col("id") % every == 0).select(F.monotonically_increasing_id().alias("q"), "id", "v", F.col("shard").alias("home")))
    parts = numbered.select(F.col("number").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def visit(sent: DataFrame) -> DataFrame:
        meets = sent.join(parts, "cell").withColumn("shard", shard(F.col("cell"), F.col("part"))).drop("cell", "part")
        asked = placed.join(meets.select("shard", "block").distinct(), "shard").select(*[F.col(c).alias(c) for c in ("id", "v", "shard", "block")])
        return asked.groupBy("shard", "block").cogroup(meets.join(queries, "q").groupBy("shard", "block")).applyInPandas(lambda v, q: _search(v, q, k, scale), _FOUND)

    # what is saved of a visit holds numbers only; vectors join them on their way to the groups
    start = saved(queries.mapInArrow(lambda it: _route(it, balls, scale, True), "q bigint, cell int"))
    spans = spark.createDataFrame(query_blocks([(r["cell"], r["count"]) for r in start.groupBy("cell").count().orderBy("cell").collect()]), "cell int, first int, own int")
    blocked = start.join(spans, "cell").select("q", "cell", (F.col("first") + F.pmod(F.xxhash64("q"), F.col("own"))).cast("int").alias("block"))
    first = saved(visit(blocked))
    floors = _best(first, k).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("q", F.when(F.col("n") == k, F.col("least")).cast("double").alias("floor"))
    others = queries.join(blocked.drop("cell"), "q").join(floors, "q", "left").mapInArrow(lambda it: _route(it, balls, scale, False), "q bigint, block int, floor double, cell int")
    away = visit(saved(others))
    return _best(first.unionByName(away), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
