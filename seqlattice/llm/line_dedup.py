"""Line dedup over overlapping windows of three lines, in DataFrame functions only.

Each document becomes an array of line-window hashes inside one projection; only (document, position, hash) rows are
shuffled.  Repeated windows are found by a partial aggregate of the first occurrence, joined back to the occurrences (a
join whose hot keys Spark may split), and the covered positions of a document return as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def window_hashes(text: Column, width: int) -> Column:
    """128 bits for each ``width`` consecutive lines, as an array of two-number structs in the order of positions.

    Every line is hashed once; a window hashes the numbers of its lines.  The array of lines is bound by a transform over
    one element, since an expression inside a lambda function is evaluated anew for every element.
    """
    hashed = F.transform(_lines(text), lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(width), line).alias("b")))

    def windows(lines: Column) -> Column:
        def at(i: Column) -> Column:
            return F.struct(*[F.xxhash64(*[F.get(lines, i + j)[x] for j in range(width)]).alias(x) for x in ("a", "b")])

        return F.when(F.size(lines) >= width, F.transform(F.sequence(F.lit(0), F.size(lines) - width), at))

    return F.element_at(F.transform(F.array(hashed), windows), 1)


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Line positions to remove: ``doc_id, mark, gone array<int>``, one row for each text that repeats a window.

    A window's first occurrence has the smallest (id, position); ``gone`` holds, sorted and once each, the positions that
    any later occurrence covers.  ``mark`` is xxhash64 of the text, so rows of one id with different texts stay apart.
    """
    windows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.posexplode(window_hashes(F.col(text_col), width)).alias("pos", "w")).where("doc_id IS NOT NULL").select("doc_id", "mark", "pos", "w.a", "w.b")
    first = windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "pos", "mark")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    later = windows.join(first, ["a", "b"]).where(F.struct("doc_id", "pos", "mark") > F.col("first"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("pos", F.col("pos") + (width - 1))))))
    return later.groupBy("doc_id", "mark").agg(covered.alias("gone"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """All columns of ``docs``, the text without its repeated lines, and ``n_lines, n_removed``.

    Lines are the parts between line feeds, compared unchanged.  Where ``width`` consecutive lines occur in several places,
    the place with the smallest (id, position) stays and the lines of all others go; overlapping windows of one run merge.

    A null text has no lines and stays null; texts of fewer than ``width`` lines, and rows with a null id, stay whole; of
    exactly repeated rows (same id and text) all are treated alike.  An existing column of a result's name is replaced.
    """
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, width=width).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    text = F.col("text")
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1

    def without(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    kept = F.element_at(F.transform(F.array(_lines(text)), without), 1)
    new = {
        text_col: F.when(F.col("gone").isNull(), text).otherwise(kept),
        "n_lines": F.coalesce(n_lines, F.lit(0)).cast("bigint"),
        "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("bigint"),
    }
    joined = rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left")
    old = [c for c in docs.columns if c not in ("n_lines", "n_removed") or c == text_col]
    return joined.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in old], *[new[c].alias(c) for c in ("n_lines", "n_removed")])
