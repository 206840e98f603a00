"""Character error rates: by row, by object, confident letters only, and masked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import convert, latin_swap, normalise
from .contexts import portions
from .distances import edit_distances, masked_many


#: Letters from which on a row is compared in bands.
LONG = 512


def edits(a: Column, b: Column) -> Column:
    """Unit-cost edit distance of rows: by Spark's own function, which is quadratic, or in bands where a row is long."""
    long = F.greatest(F.length(a), F.length(b)) > LONG
    return F.coalesce(edit_distances(F.when(long, a), F.when(long, b)), F.levenshtein(a, b))


def error_rate(errors: Column, chars: Column) -> Column:
    """Sum of errors over sum of reference lengths; 0 without references."""
    return F.when(F.sum(chars) > 0, F.sum(errors) / F.sum(chars)).otherwise(F.lit(0.0))


def row_cer(preds: DataFrame, by: list[str]) -> DataFrame:
    """``errors, chars, cer`` for each group of ``by``, both sides in upper case."""
    e, n = edits(F.upper("pred"), F.upper("truth")).cast("bigint"), F.length("truth").cast("bigint")
    return preds.withColumns({"__e": e, "__n": n}).groupBy(*by).agg(F.sum("__e").alias("errors"), F.sum("__n").alias("chars"), error_rate(F.col("__e"), F.col("__n")).alias("cer"))


def row_cer_rollup(preds: DataFrame, by: list[str]) -> DataFrame:
    """:func:`row_cer` with subtotals; null keys stand for all."""
    e, n = edits(F.upper("pred"), F.upper("truth")).cast("bigint"), F.length("truth").cast("bigint")
    return preds.withColumns({"__e": e, "__n": n}).rollup(*by).agg(F.sum("__e").alias("errors"), F.sum("__n").alias("chars"), error_rate(F.col("__e"), F.col("__n")).alias("cer"))


def joined_rows(rows: DataFrame, text: str, by: list[str], order: str = "row_idx", end: str = "") -> DataFrame:
    """``by, text``: the rows of each object in order, joined by line feeds, with ``end`` behind them."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return rows.groupBy(*by).agg(F.concat(F.array_join(parts, "\n"), F.lit(end)).alias("text"))


def with_prediction(files: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``files(name, base)`` with ``pred``: the transcript under the file's own name, else its object's, else empty."""
    own = transcripts.select(F.col("base").alias("name"), F.col("text").alias("__own"))
    obj = transcripts.select("base", F.col("text").alias("__obj"))
    return files.join(own, "name", "left").join(obj, "base", "left").withColumn("pred", F.coalesce("__own", "__obj", F.lit(""))).drop("__own", "__obj")


def all_letter_score(scored: DataFrame, use_old: bool = False) -> DataFrame:
    """``n_all_err, n_all_char`` of rows ``pred, truth``: all letters and the line breaks between rows."""
    pred = latin_swap(F.col("pred")) if use_old else F.col("pred")
    p, t = F.array_join(normalise(pred, use_old), "\n"), F.array_join(normalise(F.col("truth"), use_old), "\n")
    return scored.withColumns({"n_all_err": edit_distances(p, t), "n_all_char": F.length(t).cast("bigint")})


def first_version_score(scored: DataFrame) -> DataFrame:
    """The earlier scorer: the reference ends with a line feed, and the prediction is converted with the old map twice."""
    p = convert(convert(F.col("pred"), True), True)
    t = F.concat(convert(F.col("truth"), True), F.lit("\n"))
    return scored.withColumns({"errors": edit_distances(p, t), "chars": F.length(t).cast("bigint")})


def confident_rows(letters: DataFrame, by: list[str]) -> DataFrame:
    """``by, text, n_char``: confident letters only, rows left empty dropped, from ``row_idx, pos, ch, conf``."""
    kept = letters.where("conf").groupBy(*by, "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("row"))
    return joined_rows(kept, "row", by).withColumn("n_char", F.length("text").cast("bigint"))


def break_confidence(letters: DataFrame, by: list[str]) -> DataFrame:
    """``by, row_idx, conf`` for each break behind a row: up to and with the first row that has a confident letter, both this
    and the next row must have one; behind it, the next row."""
    has = letters.groupBy(*by, "row_idx").agg(F.bool_or("conf").alias("has"))
    order = Window.partitionBy(*by).orderBy("row_idx")
    seen = F.max(F.col("has")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return has.withColumns({"conf": seen, "__next": F.lead("has").over(order)}).where(F.col("__next").isNotNull()).select(*by, "row_idx", (F.col("conf") & F.col("__next")).alias("conf"))


def whole_rows(letters: DataFrame, by: list[str]) -> DataFrame:
    """``by, row_idx, text, flags``: each row's letters in order, and whether they are confident, from ``row_idx, pos, ch, conf``."""
    rows = letters.groupBy(*by, "row_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "ch", "conf"))).alias("l"))
    return rows.select(*by, "row_idx", F.array_join("l.ch", "").alias("text"), F.col("l.conf").alias("flags"))


def object_texts(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, truth, flags, text, n_char`` from ``by, row_idx, text, flags`` of :func:`whole_rows`: the rows of each object joined by line
    feeds, for each character of that text whether it is confident, and the confident text as in :func:`confident_rows`.

    The line feeds' flags are those of :func:`break_confidence`.  A row is shuffled once, as it is, and no letter on its own.  If ``rows``
    have readings ``pred``, these are joined likewise.
    """
    # the distances behind take long for the size of the texts, so tasks aren't put together by it
    met = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    preds = [F.array_sort(F.collect_list("pred")).alias("preds")] if "pred" in rows.columns else []
    own = met.groupBy(*by, "row_idx").agg(F.collect_list(F.struct("text", "flags")).alias("own"), *preds)
    # rows of one number are one row, letter by letter
    letters = F.transform("own", lambda x: F.transform(F.split(x["text"], ""), lambda ch, i: F.struct(i.alias("pos"), ch.alias("ch"), F.get(x["flags"], i).alias("conf"))))
    several = own.withColumn("l", F.when(F.size("own") > 1, F.array_sort(F.flatten(letters))))
    one = [F.when(F.col("l").isNull(), F.get("own", F.lit(0))[c]).otherwise(more).alias(c) for c, more in (("text", F.array_join("l.ch", "")), ("flags", F.col("l.conf")))]
    named = several.select(*by, "row_idx", *one, *["preds"][: len(preds)])
    order = F.array_sort(F.collect_list(F.struct("row_idx", F.struct("text", "flags", *["preds"][: len(preds)]).alias("x"))))
    whole = named.withColumn("has", F.coalesce(F.exists("flags", lambda f: f), F.lit(False))).groupBy(*by).agg(order.alias("o"), F.array_sort(F.collect_list(F.struct("row_idx", "has"))).alias("h"))
    whole = whole.select(*by, F.col("o.x").alias("r"), F.col("h.has").alias("h")).withColumn("first", F.array_position("h", True))
    breaks = lambda i: (F.col("first") > 0) & (i + 1 >= F.col("first")) & F.get("h", i + 1)
    flags = F.flatten(F.transform("r", lambda x, i: F.when(i + 1 < F.size("r"), F.concat(x["flags"], F.array(breaks(i)))).otherwise(x["flags"])))
    sure = F.filter(F.transform("r", lambda x: F.array_join(F.filter(F.split(x["text"], ""), lambda ch, i: F.get(x["flags"], i)), "")), lambda t: t != "")
    out = whole.select(*by, F.array_join(F.col("r.text"), "\n").alias("truth"), flags.alias("flags"), F.array_join(sure, "\n").alias("text"), *[F.array_join(F.flatten("r.preds"), "\n").alias("pred")][: len(preds)])
    return out.withColumn("n_char", F.length("text").cast("bigint"))


def _masked(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_opt_err, n_opt_char`` of rows ``keys, truth, flags, pred``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in portions(batch, "truth"):
                truths, preds = (b.column(c).to_pylist() for c in ("truth", "pred"))
                flags = [np.asarray(x.values.to_numpy(zero_copy_only=False), bool) for x in b.column("flags")]
                for i, (truth, own) in enumerate(zip(truths, flags, strict=True)):
                    if len(truth) != len(own):
                        raise ValueError(f"{b.column(0)[i]}: {len(own)} flags for {len(truth)} characters")
                found = masked_many([(truth, own, pred or "") for truth, own, pred in zip(truths, flags, preds, strict=True)])
                errors, chars = [cost for cost, _ in found], [int(own.sum()) + hits for own, (_, hits) in zip(flags, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(errors, pa.int64()), pa.array(chars, pa.int64())], names=out.names)

    out = T.StructType([*(scored.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in ("n_opt_err", "n_opt_char"))])
    return scored.select(*keys, "truth", "flags", "pred").mapInArrow(run, out)


def masked_score(scored: DataFrame) -> DataFrame:
    """``key, n_opt_err, n_opt_char`` of rows ``key, truth, flags, pred``; ``flags`` has one boolean for each character.

    Leaving out an unclear character is free; the characters that count are the clear ones and the matched unclear ones."""
    return _masked(scored.withColumn("key", F.col("key").cast("string")), ["key"])


def object_pairs(preds: DataFrame | None, letters: DataFrame, by: list[str], use_old: bool = False) -> DataFrame:
    """``by, key, pred, truth, flags, text, n_char``: each object's normalised prediction, and its texts and flags as in
    :func:`object_texts`.

    ``preds`` has one text ``pred`` for each object, missing ones are empty; ``letters`` are the normalised letters of the
    truth, ``row_idx, pos, ch, conf``.  Without ``preds`` they are whole rows, ``row_idx, text, flags, pred``.
    """
    truth = object_texts(letters if preds is None else whole_rows(letters, by), by)
    pairs = truth if preds is None else truth.join(preds.select(*by, "pred"), by, "left")
    given = F.coalesce("pred", F.lit(""))
    pred = F.array_join(normalise(latin_swap(given) if use_old else given, use_old), "\n")
    return pairs.withColumns({"pred": pred, "key": F.concat_ws(":", *by)})


def confident_score(pairs: DataFrame) -> DataFrame:
    """``n_err`` of rows ``pred, text``: the prediction against the confident letters."""
    return pairs.withColumn("n_err", edit_distances(F.col("pred"), F.col("text")))


def object_scores(preds: DataFrame | None, letters: DataFrame, by: list[str], use_old: bool = False) -> DataFrame:
    """``by`` and errors and characters of the three scores of each object of :func:`object_pairs`: ``n_err, n_char``
    (confident letters only), ``n_all_err, n_all_char`` (all letters) and ``n_opt_err, n_opt_char`` (masked), line breaks counted.

    ``use_old`` converts predictions with the old map; the letters must be converted likewise.  A pair is made once, and all three
    scores follow in one pass."""
    counted = all_letter_score(confident_score(object_pairs(preds, letters, by, use_old)))
    return _masked(counted, [*by, "n_err", "n_char", "n_all_err", "n_all_char"])


#: The three scores of :func:`object_scores`, for :func:`micro`.
SCORES = {"cer": ("n_err", "n_char"), "all_cer": ("n_all_err", "n_all_char"), "opt_cer": ("n_opt_err", "n_opt_char")}


def micro(scores: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row with the ratio of sums for each named pair of error and character columns."""
    return scores.agg(*[error_rate(F.col(e), F.col(n)).alias(name) for name, (e, n) in pairs.items()])


def score_card(*one_row_frames: DataFrame) -> DataFrame:
    """Frames of one row each, side by side."""
    out = one_row_frames[0]
    for other in one_row_frames[1:]:
        out = out.crossJoin(other.limit(1))
    return out
