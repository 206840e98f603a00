"""Readers, writers and checks: letter files, image metadata, object indexes, score tables, shards and manifests."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ALPHABET, base_id, rotation, safe_base
from ..operators.evaluate import edits

#: Explicit schemas of the tables that are read.
METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("file_name", "image", "rotation", "squeeze_id", "base_id", "source_base_id", "annotation_file", "raw_annotation")])
EXAMPLES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("split", "base", "rot1_img", "rot2_img")]
    + [T.StructField(n, T.IntegerType()) for n in ("row_idx", "chunk_idx")]
    + [T.StructField("row_text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("chunk_aligned", T.BooleanType()), T.StructField("base_pos", T.IntegerType())]
)
SPLITS = ("train", "val", "test")


# --- letter files


def letter_lines(files: DataFrame) -> DataFrame:
    """``file, line_no, line, section`` of rows ``file, value`` (whole texts): each line that isn't blank, with the number of ``#`` lines up
    to it; heads themselves are left out."""
    lines = files.select("file", F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", "\r$", "")).where(F.translate("line", "* ", "") != "")
    order = Window.partitionBy("file").orderBy("line_no")
    head = F.col("line").startswith("#")
    return lines.withColumn("section", F.sum(head.cast("int")).over(order)).where(~head)


def read_letter_texts(spark: SparkSession, path: str) -> DataFrame:
    """``file, value`` of every file under ``path``, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), "value")


def _numbers(line: Column) -> Column:
    return F.transform(F.split(F.btrim(line, F.lit(" \t")), "[ \t]+"), lambda x: x.try_cast("double"))


def letter_tables(files: DataFrame) -> dict[str, DataFrame]:
    """Typed tables of letter files: ``files, boxes, transcript_lines, segments, confidence, parse_errors``.

    Sections by number: 1 angle, 2 boxes, 3 transcript, 4 segments, 5 confidence digits.  A box needs eight numbers and an area of 9 or
    more; a segment four, none NaN, and a length.  What doesn't fit is a row of ``parse_errors`` and the rest of the file is
    read on; so are lines before the first head, a second angle, and files with unequal numbers of boxes and digits.
    """
    lines = letter_lines(files)
    order = Window.partitionBy("file").orderBy("line_no")
    parsed = lines.withColumn("x", _numbers(F.col("line"))).withColumn("bad", F.exists("x", lambda v: v.isNull()))
    n = F.size("x")

    angles = parsed.where("section = 1").withColumn("k", F.row_number().over(order))
    named = files.select("file").distinct().withColumns({"base": base_id(F.regexp_replace("file", "_letters(?=\\.|$)", "")), "rotation": F.regexp_extract("file", "_Rotation([12])", 1).try_cast("int")})
    head = named.join(angles.where("k = 1").select("file", F.get("x", F.lit(0)).alias("angle")), "file", "left")

    def side(i: int, j: int) -> Column:
        return F.sqrt((F.get("x", F.lit(j)) - F.get("x", F.lit(i))) ** 2 + (F.get("x", F.lit(j + 1)) - F.get("x", F.lit(i + 1))) ** 2)

    box_lines = parsed.where("section = 2").withColumn("reason", F.when((n != 8) | F.col("bad"), "box without eight numbers").when(side(0, 6) * side(0, 2) < 9, "box with a very small area"))
    corners = ("xnw", "ynw", "xsw", "ysw", "xse", "yse", "xne", "yne")
    boxes = box_lines.where("reason IS NULL").select("file", (F.row_number().over(order) - 1).cast("bigint").alias("box_id"), *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(corners)])

    transcript = lines.where("section = 3").select("file", (F.row_number().over(order) - 1).cast("bigint").alias("line_no"), F.translate("line", "* \r", "").alias("text"))

    same = (F.get("x", F.lit(0)) == F.get("x", F.lit(2))) & (F.get("x", F.lit(1)) == F.get("x", F.lit(3)))
    nan = F.exists("x", lambda v: F.isnan(v))
    seg_lines = parsed.where("section = 4").withColumn("reason", F.when((n != 4) | F.col("bad"), "segment without four numbers").when(nan, "segment with NaN").when(same, "segment without length"))
    segments = seg_lines.where("reason IS NULL").select("file", (F.row_number().over(order) - 1).cast("bigint").alias("seg_id"), *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])

    digits = lines.where("section = 5").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: F.translate(r["line"], " \r", "")), "").alias("d"))
    flags = digits.select("file", F.posexplode(F.split("d", "")).alias("box_id", "c"))
    told = flags.select("file", F.col("box_id").cast("bigint").alias("box_id"), (F.col("c") == "1").alias("conf"))
    silent = boxes.join(digits, "file", "left_anti").select("file", "box_id", F.lit(True).alias("conf"))
    confidence = told.unionByName(silent)

    counts = boxes.groupBy("file").agg(F.count("*").alias("n")).join(digits.select("file", F.length("d").alias("k")), "file").where("n <> k").select("file", F.lit(None).cast("int").alias("line_no"), F.lit("as many digits as boxes are needed").alias("reason"))
    errors = (
        lines.where("section = 0").select("file", "line_no", F.lit("line before the first head").alias("reason"))
        .unionByName(angles.where("k > 1").select("file", "line_no", F.lit("more than one angle").alias("reason")))
        .unionByName(box_lines.where("reason IS NOT NULL").select("file", "line_no", "reason"))
        .unionByName(seg_lines.where("reason IS NOT NULL").select("file", "line_no", "reason"))
        .unionByName(counts)
    )
    return {"files": head, "boxes": boxes, "transcript_lines": transcript, "segments": segments, "confidence": confidence, "digits": digits.withColumnRenamed("d", "digits"), "parse_errors": errors}


def confident_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of :func:`letter_tables` as a letter file is read by default: without unclear boxes and letters.

    The digits of a file go through its boxes, and through the letters of its transcript lines one after the other; letters beyond the last
    digit go.  Boxes are numbered anew, lines stay even if empty.  A file without digits stays as it is; one with more
    or fewer digits than boxes has neither boxes nor lines (it is a row of ``parse_errors``).
    """
    unfit = tables["parse_errors"].where("line_no IS NULL").select("file").distinct()
    boxes = tables["boxes"].join(tables["confidence"].where("conf").select("file", "box_id"), ["file", "box_id"]).join(unfit, "file", "left_anti")
    order = Window.partitionBy("file").orderBy("box_id")
    again = boxes.withColumn("__k", (F.row_number().over(order) - 1).cast("bigint")).withColumn("box_id", F.col("__k")).drop("__k")
    before = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = tables["transcript_lines"].join(unfit, "file", "left_anti").withColumn("__at", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int"))
    told = lines.join(tables["digits"], "file", "left")
    letters = F.filter(F.split("text", ""), lambda c, i: F.substring(F.col("digits"), F.col("__at") + i + 1, F.lit(1)) == "1")
    kept = told.withColumn("text", F.when(F.col("digits").isNull() | (F.length("digits") == 0), F.col("text")).otherwise(F.array_join(letters, "")))
    return tables | {"boxes": again, "transcript_lines": kept.select(tables["transcript_lines"].columns)}


def letter_texts(boxes: DataFrame, letters: DataFrame, segments: DataFrame | None = None, angle: float = 0.0, view: int = 1) -> DataFrame:
    """``file, value``: letter files of one view written from ``file_id, box_id`` corners and ``file_id, row_idx, box_id, ch, conf``."""
    corner = F.concat_ws(" ", *[F.col(c) for c in ("xnw", "ynw", "xsw", "ysw", "xse", "yse", "xne", "yne")])
    sorted_join = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("v")))), lambda r: r["v"]), "\n")
    box_part = boxes.groupBy("file_id").agg(sorted_join("box_id", corner).alias("boxes"))
    rows = letters.groupBy("file_id", "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_id", "ch"))), lambda r: r["ch"]), "").alias("t"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_id", "conf"))), lambda r: r["conf"].cast("int").cast("string")), "").alias("c"))
    text_part = rows.groupBy("file_id").agg(sorted_join("row_idx", F.col("t")).alias("rows"), sorted_join("row_idx", F.col("c")).alias("confs"))
    whole = box_part.join(text_part, "file_id")
    if segments is not None:
        seg = segments.groupBy("file_id").agg(sorted_join("seg_id", F.concat_ws(" ", "x0", "y0", "x1", "y1")).alias("segs"))
        whole = whole.join(seg, "file_id", "left")
    else:
        whole = whole.withColumn("segs", F.lit(None).cast("string"))
    text = F.concat(F.lit(f"# Baseline angle\n{angle}\n# Boxes\n"), "boxes", F.lit("\n# Transcript\n"), "rows", F.lit("\n# Lines\n"), F.coalesce("segs", F.lit("")), F.lit("\n# Confidence\n"), "confs", F.lit("\n"))
    return whole.select(F.concat(F.lit("s"), F.col("file_id").cast("string"), F.lit(f"_Rotation{view}_300dpi_letters.txt")).alias("file"), text.alias("value"))


# --- image metadata


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under an explicit schema; other fields are ignored."""
    return spark.read.schema(METADATA).json(path)


def _given(text: Column) -> Column:
    """A text that isn't empty, else null."""
    return F.nullif(text, F.lit(""))


def resolve_metadata(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted ``base, rotation, file_name, annotation_file, raw_annotation`` and rejected records with their ``reason``.

    The image is ``file_name``, else ``image``.  The object is the first of squeeze_id, base_id, source_base_id and the name's own, without merge
    marks and safe in a path; the rotation comes from its column, else the name.  Empty texts count as missing.
    """
    named = records.withColumn("file_name", F.coalesce(_given(F.col("file_name")), _given(F.col("image"))))
    base = F.coalesce(*[_given(F.col(c)) for c in ("squeeze_id", "base_id", "source_base_id")], base_id(F.col("file_name")))
    full = named.withColumns({"base": safe_base(F.replace(base, F.lit("_Merged"), F.lit(""))), "rotation": F.coalesce(_given(F.col("rotation")), rotation(F.col("file_name")))})
    known = F.col("file_name").isNotNull() & F.coalesce(F.col("rotation").isin("Rotation1", "Rotation2"), F.lit(False))
    good = full.where(known).select("base", "rotation", "file_name", "annotation_file", "raw_annotation")
    reason = F.when(F.col("file_name").isNull(), "no file name").otherwise("unknown rotation")
    return good, full.where(~known).select("file_name", "rotation", reason.alias("reason"))


def resolve_images(records: DataFrame, listing: DataFrame, folder: str, root: str) -> tuple[DataFrame, DataFrame]:
    """``records`` with ``image_path``, and those whose image is missing with the ``tried`` paths.

    An image is looked for beside the metadata (``folder``), under ``root`` and under its ``data``, and the first place that
    ``listing(path)`` has counts.
    """
    places = F.array(*[F.concat(F.lit(p.rstrip("/") + "/"), F.col("file_name")) for p in (folder, root, f"{root.rstrip('/')}/data")])
    names = records.select("file_name").distinct().select("file_name", F.posexplode(places).alias("__rank", "__path"))
    there = listing.select(F.col("path").alias("__path")).distinct()
    found = names.join(there, "__path").groupBy("file_name").agg(F.min_by("__path", "__rank").alias("image_path"))
    joined = records.join(found, "file_name", "left").select(*records.columns, "image_path")
    return joined.where("image_path IS NOT NULL"), joined.where("image_path IS NULL").drop("image_path").withColumn("tried", places)


def resolve_annotations(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``base, rotation, file_name, annotation`` and the records without any.

    First the record's own text, then the file it names, then ``<image stem>_letters.txt``, of each only if it holds any (the own
    text more than white space); line ends become line feeds.
    """
    by_name = files.select(F.col("file").alias("__named"), _given(F.col("value")).alias("__v1"))
    by_stem = files.select(F.col("file").alias("__stem"), _given(F.col("value")).alias("__v2"))
    name = F.regexp_extract("annotation_file", "([^/]*)$", 1)
    stem = F.concat(F.regexp_replace(F.regexp_extract("file_name", "([^/]*)$", 1), "\\.[^.]*$", ""), F.lit("_letters.txt"))
    joined = records.withColumn("__n", name).withColumn("__s", stem).join(by_name, F.col("__n") == F.col("__named"), "left").join(by_stem, F.col("__s") == F.col("__stem"), "left")
    own = F.when(F.col("raw_annotation").rlike("\\S"), F.col("raw_annotation"))
    found = joined.withColumn("annotation", F.replace(F.coalesce(own, "__v1", "__v2"), F.lit("\r\n"), F.lit("\n")))
    columns = ["base", "rotation", "file_name"]
    return found.where("annotation IS NOT NULL").select(*columns, "annotation"), found.where("annotation IS NULL").select(*columns)


# --- objects and views


def object_index(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """``base, ann_path, rot1_img, rot2_img``: objects with a Rotation1 letter file and at least one image.

    ``annotations(base, rotation, path)`` and ``images(base, rotation, path)``; of several files for one place the first by path counts.
    """
    ann = annotations.where("rotation = 'Rotation1'").groupBy("base").agg(F.min("path").alias("ann_path"))
    both = images.groupBy("base").agg(*[F.min(F.when(F.col("rotation") == f"Rotation{i}", F.col("path"))).alias(f"rot{i}_img") for i in (1, 2)])
    return ann.join(both.where("rot1_img IS NOT NULL OR rot2_img IS NOT NULL"), "base")


def image_index(objects: DataFrame) -> DataFrame:
    """``base, rot, img_path``: the index by image, places without one dropped."""
    return objects.select("base", F.expr("stack(2, 1L, rot1_img, 2L, rot2_img) AS (rot, img_path)")).where("img_path IS NOT NULL")


def canonical_views(views: DataFrame) -> DataFrame:
    """``base, slot, file_name, rotation``: two views of each object, by file name.

    Slot 1 is the first Rotation1, else the first Rotation2; slot 2 the next Rotation2, else the next Rotation1; a single view fills both
    slots, and further ones are dropped.
    """
    order = Window.partitionBy("base", "rotation").orderBy("file_name")
    ranked = views.withColumn("r", F.row_number().over(order))

    def nth(rot: int, r: int) -> Column:
        return F.min(F.when((F.col("rotation") == f"Rotation{rot}") & (F.col("r") == r), F.struct("file_name", "rotation"))).alias(f"v{rot}{r}")

    picks = ranked.groupBy("base").agg(nth(1, 1), nth(1, 2), nth(2, 1), nth(2, 2))
    first = F.coalesce("v11", "v21")
    second = F.when(F.col("v11").isNotNull(), F.coalesce("v21", "v12")).otherwise(F.col("v22"))
    slots = picks.select("base", F.posexplode(F.array(first, F.coalesce(second, first))).alias("i", "v"))
    return slots.select("base", (F.col("i") + 1).cast("bigint").alias("slot"), "v.file_name", "v.rotation")


# --- examples and class scores


def sorted_examples(examples: DataFrame) -> DataFrame:
    """In the order of split, base_pos, row, chunk and base."""
    rank = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    return examples.orderBy(rank, "base_pos", "row_idx", "chunk_idx", "base")


def write_examples(examples: DataFrame, path: str) -> None:
    """Parquet by split."""
    examples.write.partitionBy("split").parquet(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples from JSON lines or a written table; rows with bad numbers are dropped, and an empty index fails the query."""
    raw = spark.read.parquet(path) if not path.endswith((".json", ".jsonl")) else spark.read.schema(EXAMPLES).json(path)
    good = raw.where("row_idx IS NOT NULL AND chunk_idx IS NOT NULL AND base IS NOT NULL")
    if good.isEmpty():
        raise ValueError(f"{path} holds no examples")
    return good


def filter_examples(examples: DataFrame, split: str, include: DataFrame | None = None, exclude: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Examples of a split whose label is one class, of objects in ``include`` and not in ``exclude``; with ``limit``, the first in order."""
    out = examples.where((F.col("split") == split) & (F.length("label") == 1) & F.lit(ALPHABET).contains(F.upper("label")))
    if include is not None:
        out = out.join(include.select("base"), "base", "left_semi")
    if exclude is not None:
        out = out.join(exclude.select("base"), "base", "left_anti")
    return sorted_examples(out).limit(limit) if limit else out


def write_logits(logits: DataFrame, path: str) -> None:
    """Parquet by tag and split; scores as float arrays."""
    logits.withColumn("logits", F.col("logits").cast("array<float>")).write.partitionBy("tag", "split").parquet(path)


def read_logits(spark: SparkSession, path: str, tag: str | None = None, split: str | None = None) -> DataFrame:
    """The table of :func:`write_logits`, scores as doubles; a tag or split reads only its own files."""
    rows = spark.read.parquet(path)
    for name, value in (("tag", tag), ("split", split)):
        rows = rows.where(F.col(name) == value) if value is not None else rows
    return rows.withColumn("logits", F.col("logits").cast("array<double>"))


def logits_checks(logits: DataFrame, width: int = len(ALPHABET)) -> DataFrame:
    """``check, n_bad`` in one pass: empty table, widths, labels, null keys."""
    null_key = F.lit(False)
    for c in ("base", "row_idx", "chunk_idx"):
        null_key = null_key | F.col(c).isNull()
    label_ok = F.col("label").between(0, width - 1)
    checks = {"rows": (F.count("*") == 0).cast("bigint"), "width": F.count_if(~F.coalesce(F.size("logits") == width, F.lit(False))), "label": F.count_if(~F.coalesce(label_ok, F.lit(False))), "keys": F.count_if(null_key)}
    one = logits.agg(*[c.alias(k) for k, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n_bad")) for k in checks])).alias("x")).select("x.*")


# --- shards, manifests, outputs


def shard_check(shards: DataFrame) -> DataFrame:
    """One row ``n_shards, n_missing, n_duplicate, n_counts, n_row_mismatch`` of ``shard_id, n_shards, n_rows, expected_rows``."""
    one = shards.agg(F.max("n_shards").alias("n"), F.collect_set("shard_id").alias("have"), (F.count("*") - F.count_distinct("shard_id")).alias("n_duplicate"), F.count_distinct("n_shards").alias("n_counts"), F.count_if(~F.col("n_rows").eqNullSafe(F.col("expected_rows"))).alias("n_row_mismatch"))
    want = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: i.cast("bigint"))
    return one.select(F.col("n").alias("n_shards"), F.size(F.array_except(want, "have")).cast("bigint").alias("n_missing"), "n_duplicate", "n_counts", "n_row_mismatch")


def merge_shards(parts: DataFrame, shards: DataFrame) -> DataFrame:
    """``parts`` if all shards are complete; otherwise the query fails."""
    ok = F.expr("n_missing = 0 AND n_duplicate = 0 AND n_counts = 1 AND n_row_mismatch = 0")
    flag = shard_check(shards).select(F.assert_true(ok, F.lit("shards are not complete")).alias("x")).scalar()
    return parts.where(flag.isNull())


def manifest_mismatches(manifest: DataFrame, expected: dict[str, object]) -> DataFrame:
    """``field, expected, found`` of every field that differs; none means that the table follows the recipe."""
    rows = [F.struct(F.lit(k).alias("field"), F.lit(str(v)).alias("expected"), (F.col(k).cast("string") if k in manifest.columns else F.lit(None).cast("string")).alias("found")) for k, v in expected.items()]
    return manifest.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("NOT (expected <=> found)")


def transcripts(rows: DataFrame, text: str = "pred") -> DataFrame:
    """``base, text``: rows joined by line feeds in order, white space at the end removed."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.col(text).alias("t")))), lambda x: x["t"]), "\n")
    return rows.groupBy("base").agg(F.regexp_replace(joined, "\\s+$", "").alias("text"))


def run_summary(predictions: DataFrame, run: str) -> DataFrame:
    """One row ``run, rows, objects, errors, chars, cer``."""
    e, n = edits(F.col("pred"), F.col("truth")).cast("bigint"), F.length("truth").cast("bigint")
    return predictions.agg(F.count("*").alias("rows"), F.count_distinct("base").alias("objects"), F.sum(e).alias("errors"), F.sum(n).alias("chars"), (F.sum(e) / F.sum(n)).alias("cer")).select(F.lit(run).alias("run"), "*")


def once_per_content(rows: DataFrame, payload: str, work) -> DataFrame:  # noqa: ANN001
    """``rows`` with ``result``: ``work`` maps a payload column to a column and runs once for each distinct payload."""
    key = F.sha2(payload, 256)
    done = rows.select(key.alias("content_key"), payload).dropDuplicates(["content_key"]).select("content_key", work(F.col(payload)).alias("result"))
    return rows.withColumn("content_key", key).join(done, "content_key", "left")


def once_across_runs(rows: DataFrame, payload: str, work, store: str, shards: int = 1) -> DataFrame:  # noqa: ANN001
    """``rows`` with ``content_key, result`` of :func:`once_per_content`, results being kept in the folder ``store`` for later runs.

    A run computes only payloads whose key the store lacks, in ``shards`` parts by key.  A part is written under a name of its own and
    counts from when the ledger names it, so a run that fails loses no more than the part that it was at, and what it
    left behind is never read.  Two runs at once may both compute a payload; readers take one result of each key.  Null
    payloads have null keys and results, and are not stored.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("content_key", F.sha2(payload, 256))
    asked = keyed.where(F.col("content_key").isNotNull()).select("content_key", F.col(payload).alias("__payload"))
    parts = finished_parts(spark, store)
    kept = spark.read.parquet(*parts) if parts else None
    fresh = asked if kept is None else asked.join(kept.select("content_key"), "content_key", "left_anti")
    run = uuid.uuid4().hex
    for shard in range(shards):
        own = fresh.where(F.pmod(F.xxhash64("content_key"), F.lit(shards)) == shard).dropDuplicates(["content_key"])
        name = f"{run}-{shard}"
        own.select("content_key", work(F.col("__payload")).alias("result")).write.parquet(f"{store}/parts/{name}")
        spark.createDataFrame([(name,)], "part string").coalesce(1).write.mode("append").parquet(f"{store}/ledger")
    done = spark.read.parquet(*finished_parts(spark, store)).groupBy("content_key").agg(F.first("result").alias("result"))
    return keyed.join(done, "content_key", "left")


def finished_parts(spark: SparkSession, store: str) -> list[str]:
    """Folders of the parts that the ledger of ``store`` names; none where there is no ledger yet."""
    try:
        names = spark.read.schema("part string").parquet(f"{store}/ledger").distinct().collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(f"{store}/parts/{r.part}" for r in names)
