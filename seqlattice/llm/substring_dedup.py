"""Substring dedup by relative Lempel-Ziv parsing.

Every document is parsed against the text of all documents with a smaller id.  That reference is cut into blocks: a
window of ``width`` consecutive words belongs to the block that its smallest three-word hash names, so equal windows
always meet in one block, and runs of neighbouring windows stay together.  A block is indexed: its windows, sorted, each with
its first holder.  A cursor then walks each document's words through the block.  It looks its window up; if a smaller
document holds that, a factor begins there and goes on word by word as long as the source goes on alike; behind the factor's
end the next window is looked up anew.  What no cursor finds stays.  Factors of one document from different stretches and
blocks are checked at their boundaries: where one goes on along the source of the one before, they are one factor.  No window
is missed, and every factor has ``width`` words or more, so it is a duplicate span.

A seed that a third of all documents hold would make one huge block.  Seeds that are frequent in a sample of the documents
name blocks together with the whole window, so their windows spread over all blocks, and equal ones still meet; the number of
blocks grows with the words.  The sample decides on where the work is done alone.

One shuffle carries the windows: per batch of documents and block one row of arrays.  Before it, each batch is parsed in
the same way against itself, its factors compared word by word, and what lies in none is sent on; so a passage that a third of
all documents share costs one entry a batch.  Spans come back by document and meet the texts in one join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, pieces, rolling, word_hashes, words_of

#: Words of the hash that names a window's block.
SEED_WORDS = 3
#: One in so many documents shows which seeds are frequent; seeds that are spread, at most (8 bytes each in a task).
SAMPLE, MOST_SPREAD = 64, 100_000
#: Words of a block on average, in tables that are large enough.
BLOCK_WORDS = 4_000_000
#: Windows that one cursor walks; longer runs have several, whose factors are joined at their boundaries.
STRETCH = 64

_BLOCK_ROW = "block int, settled boolean, ids array<bigint>, marks array<bigint>, doc array<int>, start array<int>, n array<int>, seed array<bigint>, prints array<int>"
_FACTOR = "doc_id bigint, mark bigint, start int, n_words int, ref_doc bigint, ref_start int"


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive entries, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _windows(counts: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows over ``n`` words that lie in one text: index of the first word, text, and word within the text."""
    text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    at = np.arange(n, dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.flatnonzero(at + width <= counts[text]) if n else np.zeros(0, np.int64)
    return first, text[first], at[first].astype(np.int32)


def _runs(*same: np.ndarray) -> np.ndarray:
    """Where a run starts: an entry differs from the one before it in any of the arrays."""
    new = np.ones(len(same[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in same])
    return np.flatnonzero(new)


def _seeds(hashes: np.ndarray, width: int) -> np.ndarray:
    return _smallest(rolling(hashes, SEED_WORDS), width - SEED_WORDS + 1)


def _count_seeds(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for rows in pieces(batches):
        hashes, counts = word_hashes(rows["text"])
        first, _, _ = _windows(counts, len(hashes), width)
        if len(first):
            seed, n = np.unique(_seeds(hashes, width)[first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n, pa.int64())], names=["seed", "n"])


def _sample(rows: DataFrame) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")


def sampled_words(rows: DataFrame) -> int:
    """Words of the sample of ``rows(doc_id, text)``."""
    return _sample(rows).agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")))).first()[0] or 0


def frequent_seeds(rows: DataFrame, width: int, n_blocks: int, words: int) -> np.ndarray:
    """Seeds with at least an eighth of a block's even share of the windows, in a sample of ``rows(doc_id, text)`` with ``words``
    words; at most MOST_SPREAD of them, sorted."""
    counts = _sample(rows).mapInArrow(lambda it: _count_seeds(it, width), "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).where("n >= 100")
    top = counts.orderBy(F.col("n").desc(), "seed").limit(MOST_SPREAD).collect()
    return np.sort(np.array([r.seed for r in top if r.n * 8 * n_blocks >= words], np.int64).view(np.uint64))


def _index(batches: Iterator[pa.RecordBatch], width: int, n_blocks: int, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of windows by block; and, marked as settled, spans that repeat a smaller document of the same portion."""
    for rows in pieces(batches):
        order = np.argsort(np.array(rows["doc_id"], np.int64), kind="stable")
        ids = np.array(rows["doc_id"], np.int64)[order]
        marks = np.array(rows["mark"], np.int64)[order]
        hashes, counts = word_hashes([rows["text"][i] for i in order])
        first, doc, start = _windows(counts, len(hashes), width)
        if not len(first):
            continue
        prints = rolling(hashes, width)[first]
        seeds = _seeds(hashes, width)[first]
        named = seeds
        if len(spread):
            named = np.where(spread[np.minimum(np.searchsorted(spread, seeds), len(spread) - 1)] == seeds, mix(seeds ^ prints), seeds)
        own_id, word = ids[doc], np.arange(width)
        begin, source, long = parse(prints, own_id, doc, lambda i, j: (hashes[first[i][:, None] + word] == hashes[first[j][:, None] + word]).all(axis=1))
        covered = np.zeros(len(prints) + 1, np.int64)
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + long, -1)
        own = np.cumsum(covered[:-1]) == 0
        out: dict[str, list] = {k: [] for k in ("block", "settled", "ids", "marks", "doc", "start", "n", "seed", "prints")}

        def put(block: int, settled: bool, docs: np.ndarray, starts: np.ndarray, n: np.ndarray, seed: np.ndarray, fine: np.ndarray) -> None:
            used, local = np.unique(docs, return_inverse=True)
            for k, v in (("block", block), ("settled", settled), ("ids", ids[used]), ("marks", marks[used]), ("doc", local.astype(np.int32)), ("start", starts), ("n", n.astype(np.int32)), ("seed", seed), ("prints", fine)):
                out[k].append(v)

        if len(begin):
            # seed and prints hold the source of a settled span
            put(int(named[begin[0]] % np.uint64(n_blocks)), True, doc[begin], start[begin], long, own_id[source], start[source])
        at = np.flatnonzero(own)
        r = _runs(doc[at], start[at] - np.arange(len(at)), named[at])
        n = np.diff(np.append(r, len(at)))
        block = (named[at[r]] % np.uint64(n_blocks)).astype(np.int64)
        fine = (prints[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        by_block = np.argsort(block, kind="stable")
        edges = _runs(block[by_block])
        for runs in np.split(by_block, edges[1:]):
            inside = np.repeat(r[runs] - (np.cumsum(n[runs]) - n[runs]), n[runs]) + np.arange(n[runs].sum())
            put(int(block[runs[0]]), False, doc[at][r][runs], start[at][r][runs], n[runs], seeds[at[r]][runs].view(np.int64), fine[inside])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["block"], pa.int32()), pa.array(out["settled"], pa.bool_())]
            + [pa.array(out[k], pa.list_(t)) for k, t in (("ids", pa.int64()), ("marks", pa.int64()), ("doc", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("seed", pa.int64()), ("prints", pa.int32()))],
            names=list(out),
        )


def parse(key: np.ndarray, doc: np.ndarray, run: np.ndarray, alike: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, source and number of windows of each factor of the documents of a block against the smaller ones in it.

    Windows are in the order of their documents, neighbours of one ``run`` side by side; ``alike`` compares windows whose keys
    are equal.  The index is the sorted keys with their first holders.  A cursor for each stretch of a run looks its window
    up, walks along the source while that goes on alike, and looks up anew behind the factor's end; all cursors go a window a step.
    """
    index, holder = np.unique(key, return_index=True)
    first = _runs(run)
    within = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    at = np.flatnonzero(within % STRETCH == 0)
    stop = np.append(at[1:], len(key))
    begin, source = np.full(len(at), -1), np.full(len(at), -1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(at):
        inside = at < stop
        on = (begin >= 0) & inside
        i = np.flatnonzero(on)
        ahead = np.minimum(source[i] + at[i] - begin[i], len(key) - 1)
        same = (run[ahead] == run[source[i]]) & (key[ahead] == key[at[i]])
        same[same] = alike(ahead[same], at[i[same]])
        on[i] = same
        ends = (begin >= 0) & ~on
        found.append((begin[ends], source[ends], (at - begin)[ends]))
        begin[ends] = -1
        i = np.flatnonzero(inside & ~on)
        holds = holder[np.searchsorted(index, key[at[i]])]
        held = doc[holds] < doc[at[i]]
        held[held] = alike(holds[held], at[i[held]])
        begin[i[held]], source[i[held]] = at[i[held]], holds[held]
        at, stop, begin, source = at[inside] + 1, stop[inside], begin[inside], source[inside]
    return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(3))


def _parse_block(rows: pd.DataFrame, width: int) -> pd.DataFrame:
    """Greedy factors of the documents of one block against the smaller documents in it."""
    found = []
    settled = rows["settled"].to_numpy(bool)
    for r in rows[settled].itertuples():
        found.append((r.ids[r.doc], r.marks[r.doc], r.start, r.n, r.seed, r.prints))
    rows = rows[~settled]
    if len(rows):
        ids = np.concatenate([i[d] for i, d in zip(rows["ids"], rows["doc"], strict=True)])
        marks = np.concatenate([i[d] for i, d in zip(rows["marks"], rows["doc"], strict=True)])
        starts, n = np.concatenate(list(rows["start"])), np.concatenate(list(rows["n"])).astype(np.int64)
        _, seed = np.unique(np.concatenate(list(rows["seed"])), return_inverse=True)
        by_doc = np.lexsort((starts, ids))
        offset = (np.cumsum(n) - n)[by_doc]
        ids, marks, starts, n, seed = ids[by_doc], marks[by_doc], starts[by_doc], n[by_doc], seed[by_doc]
        run, within = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        fine = np.concatenate(list(rows["prints"]))[offset[run] + within].astype(np.int32, copy=False).view(np.uint32)
        key = (seed.astype(np.uint64) << np.uint64(32))[run] | fine  # the whole seed, by its number, and the window's print
        begin, source, long = parse(key, ids[run], run, lambda i, j: np.ones(len(i), bool))
        if len(begin):
            at, of = run[begin], run[source]
            found.append((ids[at], marks[at], starts[at] + within[begin], long, ids[of], starts[of] + within[source]))
    columns = [np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(6)]
    columns[3] = columns[3] + (width - 1)
    return pd.DataFrame(dict(zip(("doc_id", "mark", "start", "n_words", "ref_doc", "ref_start"), columns, strict=True)))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows under fixed names; ``mark`` tells apart rows of one id with different texts."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))


def factors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13, blocks: int | None = None) -> DataFrame:
    """Factors of ``width`` words or more, by block: ``doc_id, mark, start, n_words, ref_doc, ref_start``.

    Words ``start`` to ``start + n_words`` of the document are those from ``ref_start`` of document ``ref_doc``, whose id is
    smaller.  ``mark`` is xxhash64 of the text.  ``blocks`` (unless given one for BLOCK_WORDS words, by the sample, and four for
    each shuffle partition at least) only spreads the work.  Every repeated window lies in a factor, but its source need not be the smallest document that holds it.  Windows
    are equal if 96 bits of hash are: among 1e13 windows fewer than one in a thousand runs meets a false one.  Runs jobs on the
    sample when called.

    Null ids take no part; null and empty texts, and texts of fewer than ``width`` words, have no factors.  Rows with one id
    aren't compared with each other.  Other columns may have any name.
    """
    rows = _marked(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    words = sampled_words(rows)
    n_blocks = blocks or max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), words * SAMPLE // BLOCK_WORDS)
    spread = frequent_seeds(rows, width, n_blocks, words)
    windows = rows.mapInArrow(lambda it: _index(it, width, n_blocks, spread), _BLOCK_ROW)
    return windows.groupBy("block").applyInPandas(lambda g: _parse_block(g, width), _FACTOR)


def chained(spans: list, width: int) -> list[list[int]]:
    """``start, n_words, ref_doc, ref_start`` of a document's factors in order, those joined that go on along one source.

    The window behind a factor's last one lies in another stretch or block; if that holds it, its factor begins there.
    """
    out: list[list[int]] = []
    for s in sorted(spans, key=lambda s: (s["start"], -s["n_words"])):
        last = out[-1] if out else None
        if last and s["ref_doc"] == last[2] and s["ref_start"] - s["start"] == last[3] - last[0] and s["start"] <= last[0] + last[1] - width + 1:
            last[1] = max(last[1], s["start"] + s["n_words"] - last[0])
        else:
            out.append([s["start"], s["n_words"], s["ref_doc"], s["ref_start"]])
    return out


def _keep(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for rows in pieces(batches):
        n_words, n_removed, n_factors, kept = [], [], [], []
        for text, spans in zip(rows["text"], rows["spans"], strict=True):
            words, parsed = words_of(text), chained(spans or [], width)
            stay, end, gone = [], 0, 0
            for start, n, *_ in parsed:
                if start + n > end:
                    stay += words[end:start]
                    gone += start + n - max(start, end)
                    end = start + n
            stay += words[end:]
            n_words.append(len(words))
            n_removed.append(gone)
            n_factors.append(len(parsed))
            kept.append(b" ".join(stay).decode())
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), *[pa.array(x, pa.int64()) for x in (n_words, n_removed, n_factors)], pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "n_factors", "kept"])


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13, blocks: int | None = None) -> DataFrame:
    """Texts without the words of repeated passages: ``doc_id, n_words, n_removed, n_factors, kept``, a row for each of ``docs``.

    A word goes if a window of ``width`` consecutive words covers it whose words also start somewhere in a document with a
    smaller id; windows are judged on the input.  ``kept`` joins the remaining words by one space.

    A null or empty text has no words; a row with a null id keeps all its words and is no reference; rows that share an id
    keep what only they repeat of each other; an empty table gives an empty result.
    """
    rows = _marked(docs, id_col, text_col)
    spans = factors(docs, id_col=id_col, text_col=text_col, width=width, blocks=blocks).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n_words", "ref_doc", "ref_start")).alias("spans"))
    return rows.join(spans, ["doc_id", "mark"], "left").select("doc_id", "text", "spans").mapInArrow(lambda it: _keep(it, width), "doc_id bigint, n_words bigint, n_removed bigint, n_factors bigint, kept string")
