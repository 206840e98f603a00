"""Periodic runs of words, found online on sparse diagonals.

A word matches an earlier occurrence of itself at some lag; words that match at one lag one after the other are a diagonal,
and a diagonal of ``m`` words at lag ``q`` is a stretch of ``m + q`` words with period ``q``.  A word that ends a diagonal
worth to follow repeats together with the words before it, so only occurrences with a context are looked up: at lags up
to 5 with five words, up to 15 with fifteen, and so on by threes.  A context is at least as long as its lags and no longer than
the shortest diagonal that counts at them.  Hence the nearest occurrence at each context is the only one that can go on
at the smallest period of a run, and each word has one occurrence for each context at most, however often it occurs.

The walk goes over the words once: occurrences lengthen the diagonals at their lags, and a diagonal that the next word
doesn't lengthen ends there and is a run if it is long enough.  Documents are independent, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mix, pieces, rolling, words_of

#: Words of the shortest context: a run of period 1 has as many matches at least.
CONTEXT = 5
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("text", pa.string())])
WORD = r"[^\x20\x09-\x0D]+"


def least_length(period: int) -> int:
    """Words of the shortest run."""
    return max(6, 4 * period)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each distinct pair of numbers."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _repeated(ranks: np.ndarray) -> np.ndarray:
    """Whether another entry is equal."""
    return np.bincount(ranks)[ranks] > 1 if len(ranks) else np.zeros(0, bool)


def occurrences(ids: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """``(word, lag, width)`` in order: the word and the ``width - 1`` before it are those ``lag`` words earlier.

    ``ids`` numbers the words of texts one after the other, ``counts`` has the words of each text.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    # equal hashes only choose whom to look at; from there on, words are compared
    hashed = rolling(mix(ids.astype(np.uint64) + np.uint64(1)), CONTEXT)
    at = np.flatnonzero(offset >= CONTEXT - 1)
    own = mix(hashed[at - CONTEXT + 1] ^ mix(owner[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own)
    alike, shared = np.diff(own[order]) == 0, np.zeros(len(at), bool)
    shared[1:] |= alike
    shared[:-1] |= alike
    at = np.sort(at[order[shared]])
    ranks = owner[at]
    for back in range(CONTEXT):
        ranks = _paired(ranks, ids[at - back])
    out, low, width, longest = [], 1, CONTEXT, int(counts.max(initial=0))
    while len(at) and least_length(low) <= longest:
        keep = _repeated(ranks)
        at, ranks = at[keep], ranks[keep]
        order = np.lexsort((at, ranks))
        lag = np.diff(at[order])
        near = (np.diff(ranks[order]) == 0) & (lag >= low) & (lag <= width)
        out.append(np.stack([at[order][1:][near], lag[near], np.full(near.sum(), width)]))
        rank_at = np.full(len(ids), -1)
        rank_at[at] = ranks
        at = at[offset[at] >= 3 * width - 1]
        at = at[(rank_at[at - width] >= 0) & (rank_at[at - 2 * width] >= 0)]
        ranks = _paired(_paired(rank_at[at], rank_at[at - width]), rank_at[at - 2 * width])
        low, width = width + 1, 3 * width
    found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return [tuple(x) for x in found[:, np.argsort(found[0], kind="stable")].T.tolist()]


def diagonals(found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """``(start, length, period)`` of each run, as soon as its diagonal ends."""
    active: dict[int, int] = {}  # matched words by lag
    last, k = -1, 0
    while active or k < len(found):
        grown: dict[int, int] = {}
        at = last + 1 if active else found[k][0]
        while k < len(found) and found[k][0] == at:
            _, lag, width = found[k]
            grown[lag] = active.pop(lag, width - 1) + 1
            k += 1
        for lag, matched in active.items():
            if matched + lag >= least_length(lag):
                yield last + 1 - matched - lag, matched + lag, lag
        active, last = grown, at


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in pieces(batches, 2_000_000):
        split = [words_of(t) for t in rows["text"]]
        counts = np.array([len(w) for w in split], np.int64)
        flat = np.empty(int(counts.sum()), dtype=object)
        flat[:] = [w for own in split for w in own]
        first = np.cumsum(counts) - counts
        runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
        for start, length, period in diagonals(occurrences(pd.factorize(flat)[0], counts)):
            k = int(np.searchsorted(first, start, "right")) - 1  # empty texts start where the next one does
            runs[k].append((start - int(first[k]), length, period))
        texts = []
        for words, own in zip(split, runs, strict=True):
            own.sort(key=lambda r: (r[0], r[2]))
            gone = np.zeros(len(words), bool)
            for start, length, period in own:
                gone[start + period : start + length] = True
            texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if own else words).decode())
        spans = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(counts), pa.array(spans, SCHEMA.field("runs").type), pa.array(texts, pa.string())], schema=SCHEMA)


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs array<struct<start, length, period>>, text``, one row for each row.

    A word is a maximal run of characters other than ASCII white space.  A run is a stretch of words with smallest period
    ``q``, at least ``max(6, 4 * q)`` words long, that no neighbouring word extends; runs stand by start, then period.
    ``text`` has the words but for those behind the first period of a run, joined by a space.  Null and empty texts have
    no words and no runs; null ids, repeated rows and further columns are of no effect.  One text must fit a worker.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_runs, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string")


def with_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of the rows, with a repeated part in the texts of a tenth of the ids, by the checksum of the id; null ids keep theirs.

    Of ``n`` words, those from ``a`` on become repeats of the first ``p`` of them, with ``h`` the CRC-32 of the decimal id,
    ``g = h / 10``, ``a = g % n`` and ``p = 1 + (n - a) / (3 + g % 8)``.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, chosen = F.floor(h / 10), F.coalesce(h % 10 == 0, F.lit(False))
    cut = rows.withColumn("words", F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    cut = cut.withColumn("n", F.coalesce(F.size("words"), F.lit(0)))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return cut.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Number and checksums of the runs and of the collapsed text, and the run with the greatest exponent (the first of several)."""

    def greater(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", F.reduce("runs", none, greater))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
