"""A training corpus from ``documents``: five stages, each one operator of ``seqlattice.llm``.

Every function takes (spark, docs, sf_dir) and works on all rows that the stage before kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.llm import bpe, line_dedup, mixing, near_dedup, quality
from seqlattice.llm.queries import LEAST_TAIL, ratings, table
from seqlattice.llm.session import new_folder

#: SQL can express neither the fitted classifier nor the sampled signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for the highest grade; all of them if no model can be fitted.

    Rows are judged by their texts alone: null ids and repeated rows are of no effect, a null text is graded as an empty one.
    """
    model = quality.fit(docs, ratings(spark, sf_dir))
    return docs if model is None else docs.where(quality.tail_of(model)(F.col("text")) >= LEAST_TAIL)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document of which no line is left goes.

    Null texts and rows with a null id stay as they are; repeated rows are treated alike.
    """
    # other columns go along in a struct, so they may have any name
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    out = line_dedup.line_dedup(docs.select("doc_id", "text", rest.alias("rest")))
    kept = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class; rows with a null id stay.

    Rows without words are classes of their own; of rows that share the id of a class all stay.
    """
    classes = near_dedup.near_duplicates(docs)
    first = classes.where("doc_id = class_id").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi")
    return named.unionByName(docs.where(F.col("doc_id").isNull())).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; of a pass that ends inside a document, the words that it takes.

    Every row takes the words that the mix promises it, whatever its id or text shares with others; rows without words,
    and so null and empty texts, are never taken.
    """
    size, taken, text = F.col("size"), F.col("taken"), F.col("row.text")
    mixed = mixing.mix_rows(docs).where(taken > 0)
    passes = F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(taken / size))).alias("pass")
    rows = mixed.select("row", "size", "taken", passes)
    # a text is cut behind its last word taken; whole passes keep it unchanged
    words = F.least(size, taken - (F.col("pass") - 1) * size)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(mixing.WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), words.cast("int")), "")
    shown = rows.select("row", F.when(words < size, cut).otherwise(text).alias("shown"))
    new = {"text": F.col("shown"), "n_chars": F.length("shown").cast(docs.schema["n_chars"].dataType)}
    return shown.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: ``doc_id, ids``, one row for each row; none for null and empty texts."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("source mixing", mixing_stage),
    ("bpe encoding", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
