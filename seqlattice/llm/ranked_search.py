"""Ranked lexical search for many queries at once, sharing their common parts.

Scores are sums over terms, so queries with terms in common have partial sums in common.  The queries are planned together:
terms that stand in the same queries are one shared set; then the two parts that stand together in most queries become one part,
again and again, while two queries share any.  What comes out is a graph of sums in which each query is a node and a part
that several queries share is summed once.  Every task walks its documents in blocks: it fills in the accumulators of
the terms, adds up the parts along the graph, each once for a block of documents, and keeps the best documents of every query.

Documents are read twice, once for their counts and once for the scores, and never shuffled; tasks hand on sums for each
term, and then ``k`` documents for each query.  Queries are a stated set; they are taken in blocks of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .license_scan import folded_words
from .session import saved
from .words import pieces

#: Distinct terms of all queries of a block, which the driver plans and the tasks hold.
MOST_TERMS = 50_000
#: Accumulators of a block of documents.
MOST_CELLS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Graph(NamedTuple):
    """Nodes below ``n_terms`` are terms; ``sums[j]`` are the parts of node ``n_terms + j``, all of smaller number."""

    n_terms: int
    sums: list[tuple[int, ...]]
    roots: list[int]

    def additions(self) -> int:
        return sum(len(parts) - 1 for parts in self.sums)

    def terms_of(self, node: int) -> list[int]:
        return [node] if node < self.n_terms else [t for part in self.sums[node - self.n_terms] for t in self.terms_of(part)]


def sharing_graph(queries: list[Iterable[int]], n_terms: int) -> Graph:
    """The graph of sums for queries, each of one term or more."""
    sums: list[tuple[int, ...]] = []

    def new(parts: Iterable[int]) -> int:
        sums.append(tuple(parts))
        return n_terms + len(sums) - 1

    holders_of: dict[int, list[int]] = defaultdict(list)
    for q, terms in enumerate(queries):
        for t in sorted(set(terms)):
            holders_of[t].append(q)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for t, own in holders_of.items():
        alike[tuple(own)].append(t)
    holders = {new(terms) if len(terms) > 1 else terms[0]: set(own) for own, terms in alike.items()}
    parts: list[set[int]] = [set() for _ in queries]
    for node, own in holders.items():
        for q in own:
            parts[q].add(node)
    shared = Counter(pair for own in parts for pair in combinations(sorted(x for x in own if len(holders[x]) > 1), 2))
    heap = [(-n, a, b) for (a, b), n in shared.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, a, b = heapq.heappop(heap)
        both = holders[a] & holders[b]
        if len(both) != -n:
            if len(both) > 1:
                heapq.heappush(heap, (-len(both), a, b))
            continue
        node = new((a, b))
        holders[a] -= both
        holders[b] -= both
        holders[node] = both
        beside: Counter[int] = Counter()
        for q in both:
            parts[q] -= {a, b}
            beside.update(parts[q])
            parts[q].add(node)
        for other, m in beside.items():
            if m > 1:
                heapq.heappush(heap, (-m, other, node))
    roots: dict[tuple[int, ...], int] = {}
    out = []
    for own in parts:
        key = tuple(sorted(own))
        if key not in roots:
            roots[key] = key[0] if len(key) == 1 else new(key)
        out.append(roots[key])
    return Graph(n_terms, sums, out)


def term_sets(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, terms``: the distinct terms of each query; rows of one id are one query, those without terms go."""
    terms = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), terms.alias("terms"))
    return rows.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where(F.size("terms") > 0)


def _counter(number: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents by term, and at -1 and -2 the documents with a term and all terms; a row for each number and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, n_docs, n_words = np.zeros(len(number), np.int64), 0, 0
        for rows in pieces(batches):
            for text in rows["text"]:
                words = folded_words(text)
                n_docs += bool(words)
                n_words += len(words)
                for w in number.keys() & set(words):
                    holding[number[w]] += 1
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2], pa.int64()), pa.array(np.r_[holding[at], n_docs, n_words], pa.int64())], names=["term", "n"])

    return count


class Best:
    """The ``k`` best documents of each query: greatest score first, equal scores by id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.least = np.ones(n, np.int64)  # a score of 0 is no hit
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in range(n)]

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """``scores`` by query and document."""
        reached = scores >= self.least[:, None]
        for q in np.flatnonzero(reached.any(axis=1)).tolist():
            at = np.flatnonzero(reached[q])
            if len(at) > self.k:  # of these, only scores from the k-th on count
                own = scores[q, at]
                at = at[own >= np.partition(own, len(own) - self.k)[len(own) - self.k]]
            new = [(-int(scores[q, d]), ids[d] is None, ids[d] or 0) for d in at.tolist()]
            self.rows[q] = heapq.nsmallest(self.k, self.rows[q] + new)
            if len(self.rows[q]) == self.k:
                self.least[q] = -self.rows[q][-1][0]


def accumulate(graph: Graph, cells: np.ndarray) -> np.ndarray:
    """Scores by query and document, from the accumulators of the terms."""
    out = np.zeros((graph.n_terms + len(graph.sums), cells.shape[1]), np.int64)
    out[: graph.n_terms] = cells
    for node, parts in enumerate(graph.sums, graph.n_terms):
        np.add(out[parts[0]], out[parts[1]], out=out[node])
        for part in parts[2:]:
            out[node] += out[part]
    return out[graph.roots]


def _searcher(number: dict[bytes, int], graph: Graph, weights: np.ndarray, n_docs: int, n_words: int, item_ids: list[int | None], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``item_id, doc_id, score``: the best documents of a task for each query."""
    block = max(1, MOST_CELLS // (graph.n_terms + len(graph.sums)))

    def score(ids: list[int | None], lengths: list[int], terms: list[int], owners: list[int], best: Best) -> None:
        at, tf = np.unique(np.array(terms, np.int64) * len(ids) + np.array(owners, np.int64), return_counts=True)
        term, doc = np.divmod(at, len(ids))
        m = 100 - 90 + (90 * np.array(lengths, np.int64) * n_docs) // n_words
        cells = np.zeros((graph.n_terms, len(ids)), np.int64)
        cells[term, doc] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        best.add(accumulate(graph, cells), ids)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, get = Best(len(item_ids), k), number.get
        ids: list[int | None] = []
        lengths: list[int] = []
        terms: list[int] = []
        owners: list[int] = []
        for rows in pieces(batches):
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                words = folded_words(text)
                found = [t for t in map(get, words) if t is not None]
                if not found:
                    continue
                terms += found
                owners += [len(ids)] * len(found)
                ids.append(doc_id)
                lengths.append(len(words))
                if len(ids) == block or len(terms) > MOST_CELLS:
                    score(ids, lengths, terms, owners, best)
                    ids, lengths, terms, owners = [], [], [], []
        if ids:
            score(ids, lengths, terms, owners, best)
        out = [(item, None if null else d, -s) for item, own in zip(item_ids, best.rows, strict=True) for s, null, d in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["item_id", "doc_id", "score"])

    return search


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each query of all documents, rank 1 first.

    A term is a maximal run of ASCII letters, digits and characters beyond ASCII, A-Z in lower case.  With N documents that have a term,
    L terms in all, n terms in the document, and df documents that hold the term, a term that occurs tf times adds
    ``w * (10**9 * tf div (1000 * tf + 8 * m))``, where ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and
    ``m = 10 + 90 * n * N div L``.  Scores of 0 are left out; equal scores rank by id, null ids last.  Rows of one item id
    are one query; every row of ``docs`` is a document, so rows that share an id are ranked each.  Null and empty texts
    match nothing.  The distinct terms of one query must fit the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    queries = saved(term_sets(items, id_col=item_col, text_col=item_text_col))
    n_blocks = math.ceil((queries.agg(F.sum(F.size("terms"))).first()[0] or 0) / MOST_TERMS)
    found = []
    for block in range(n_blocks):
        own = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).orderBy("item_id").collect()
        number = {t.encode(): i for i, t in enumerate(sorted({t for r in own for t in r.terms}))}
        counts = {r.term: r.n for r in rows.select("text").mapInArrow(_counter(number), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n_docs, n_words = counts.get(-1, 0), counts.get(-2, 0)
        if not own or not n_words:
            continue
        graph = sharing_graph([[number[t.encode()] for t in r.terms] for r in own], len(number))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(number))], np.int64)
        found.append(rows.mapInArrow(_searcher(number, graph, weights, n_docs, n_words, [r.item_id for r in own], k), "item_id bigint, doc_id bigint, score bigint"))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
