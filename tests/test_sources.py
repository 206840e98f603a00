"""Numbering of sorted tables, the default reading of letter files, metadata look-ups and transcript files."""

import os

import pytest
from pyspark.sql import functions as F

from seqlattice.operators import numbering as nu
from seqlattice.sources import ingest
from seqlattice.sources import transcript_files as tf


def test_numbers_of_sorted_rows(spark):
    rows = [(k, None if k % 11 == 0 else k % 7, "x" * (k % 3)) for k in range(500)] + [(1, 1, "hot")] * 400
    df = spark.createDataFrame(rows, "k int, g int, t string").repartition(5)
    out = nu.numbered(df, ["g", "k"]).orderBy("number").collect()
    assert [r.number for r in out] == list(range(1, len(rows) + 1))
    keys = [(r.g is not None, r.g or 0, r.k) for r in out]
    assert keys == sorted(keys)
    assert sorted(map(repr, rows)) == sorted(repr((r.k, r.g, r.t)) for r in out)
    assert nu.numbered(df.limit(0), ["k"]).count() == 0


def test_row_shards(spark):
    df = spark.createDataFrame([(k,) for k in range(103)], "k int").repartition(4)
    shards = [sorted(r.k for r in nu.row_shard(df, ["k"], s, 4).collect()) for s in range(4)]
    assert shards == [list(range(s, 103, 4)) for s in range(4)]
    assert sorted(r.k for r in nu.row_shard(df, ["k"], 2, 4, limit=3).collect()) == [2, 6, 10]
    for shard, n in ((0, 0), (4, 4), (-1, 4)):
        with pytest.raises(ValueError):
            nu.row_shard(df, ["k"], shard, n)


BOX = "100 100 100 140 130 140 130 100"


def letter_file(n, rows, digits):
    boxes = "\n".join(BOX.replace("130", str(130 + i)) for i in range(n))
    return f"# a\n0.0\n# b\n{boxes}\n# t\n" + "\n".join(rows) + "\n# l\n# c\n" + digits + "\n"


def test_default_reading_leaves_out_what_is_unclear(spark):
    files = [
        ("s1_Rotation1_300dpi_letters.txt", letter_file(5, ["AB", "C", "DEFG"], "10 0\n11")),
        ("s2_Rotation1_300dpi_letters.txt", letter_file(3, ["AB", "C"], "")),
        ("s3_Rotation1_300dpi_letters.txt", letter_file(3, ["AB", "C"], "11")),
        ("s4_Rotation1_300dpi_letters.txt", letter_file(2, ["AB"], "00")),
    ]
    tables = ingest.confident_tables(ingest.letter_tables(spark.createDataFrame(files, "file string, value string")))
    boxes = {}
    for r in tables["boxes"].orderBy("file", "box_id").collect():
        boxes.setdefault(r.file[:2], []).append((r.box_id, r.xse))
    assert boxes == {"s1": [(0, 130.0), (1, 133.0), (2, 134.0)], "s2": [(0, 130.0), (1, 131.0), (2, 132.0)]}
    lines = {}
    for r in tables["transcript_lines"].orderBy("file", "line_no").collect():
        lines.setdefault(r.file[:2], []).append(r.text)
    assert lines == {"s1": ["A", "", "DE"], "s2": ["AB", "C"], "s4": [""]}


RECORD = "file_name string, image string, rotation string, squeeze_id string, base_id string, source_base_id string, annotation_file string, raw_annotation string"


def test_metadata_and_images(spark):
    rows = [
        ("", "p/a_Rotation1_300dpi.png", "", "", None, "o_Merged/1", None, None),
        ("b_Rotation2_300dpi.png", "ignored", None, None, None, None, None, None),
        (None, "", "Rotation1", "x", None, None, None, None),
        ("c.png", None, None, "x", None, None, None, None),
        ("d.png", None, "Rotation2", "y", None, None, None, None),
    ]
    good, bad = ingest.resolve_metadata(spark.createDataFrame(rows, RECORD))
    assert {(r.base, r.rotation, r.file_name) for r in good.collect()} == {("o_1", "Rotation1", "p/a_Rotation1_300dpi.png"), ("b", "Rotation2", "b_Rotation2_300dpi.png"), ("y", "Rotation2", "d.png")}
    assert {(r.file_name, r.reason) for r in bad.collect()} == {(None, "no file name"), ("c.png", "unknown rotation")}
    listing = spark.createDataFrame([(p,) for p in ("r/p/a_Rotation1_300dpi.png", "r/data/p/a_Rotation1_300dpi.png", "r/data/b_Rotation2_300dpi.png", "r/data/b_Rotation2_300dpi.png")], "path string")
    found, missing = ingest.resolve_images(good, listing, "r/meta/", "r")
    assert {(r.base, r.image_path) for r in found.collect()} == {("o_1", "r/p/a_Rotation1_300dpi.png"), ("b", "r/data/b_Rotation2_300dpi.png")}
    assert [(r.base, r.tried) for r in missing.collect()] == [("y", ["r/meta/d.png", "r/d.png", "r/data/d.png"])]


def test_blank_annotations_count_as_missing(spark):
    rows = [("a", "Rotation1", "a.png", "f/n.txt", " \r\n\t"), ("b", "Rotation1", "b.png", "f/empty.txt", None), ("c", "Rotation1", "c.png", None, "own\r\nline"), ("d", "Rotation1", "d.png", None, "")]
    records = spark.createDataFrame(rows, "base string, rotation string, file_name string, annotation_file string, raw_annotation string")
    files = spark.createDataFrame([("n.txt", "named"), ("empty.txt", ""), ("b_letters.txt", "stem"), ("d_letters.txt", "")], "file string, value string")
    found, missing = ingest.resolve_annotations(records, files)
    assert {(r.base, r.annotation) for r in found.collect()} == {("a", "named"), ("b", "stem"), ("c", "own\nline")}
    assert [r.base for r in missing.collect()] == ["d"]


def test_transcript_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [("o1", "AB\nC\n \n"), ("o/2+x", "É"), ("o3", None), ("o4", "")]
    df = spark.createDataFrame(rows, "base string, text string").repartition(3)
    for _ in range(2):  # a second run replaces the files of the first
        tf.write_transcripts(df, f"file://{folder}")
    assert {n: open(f"{folder}/{n}", encoding="utf-8", newline="").read() for n in os.listdir(folder)} == {"o1_transcript.txt": "AB\nC", "o_2+x_transcript.txt": "É", "o3_transcript.txt": "", "o4_transcript.txt": ""}
    back = {r.base: r.text for r in tf.read_transcripts(spark, folder).collect()}
    assert back["o1"] == "AB\nC" and back["o_2+x"] == "É"
    with pytest.raises(Exception, match="two objects are named"):
        tf.write_transcripts(spark.createDataFrame([("a/b", "x"), ("a_b", "y")], "base string, text string"), str(tmp_path / "twice"))
    assert not [n for n in os.listdir(tmp_path / "twice") if n.endswith(".txt")] if (tmp_path / "twice").exists() else True
    with pytest.raises(Exception, match="mounted"):
        tf.write_transcripts(df.withColumn("text", F.lit("x")), "s3://bucket/x")


def test_results_are_kept_over_runs(spark, tmp_path):
    store = str(tmp_path / "store")
    calls = spark.sparkContext.accumulator(0)

    def count(texts):
        calls.add(len(texts))
        return texts.str.len()

    length = F.pandas_udf(count, "long")
    first = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id int, text string")
    assert {r.id: r.result for r in ingest.once_across_runs(first, "text", length, store).collect()} == {1: 1, 2: 2, 3: 1, 4: None}
    assert calls.value == 2
    # a part that no ledger names is what a failed run leaves behind
    spark.createDataFrame([("x", 99)], "content_key string, result long").write.parquet(f"{store}/parts/left-0")
    later = first.union(spark.createDataFrame([(5, "ccc"), (6, "")], "id int, text string"))
    assert {r.id: r.result for r in ingest.once_across_runs(later, "text", length, store, shards=3).collect()} == {1: 1, 2: 2, 3: 1, 4: None, 5: 3, 6: 0}
    assert calls.value == 4
    assert {r.id: r.result for r in ingest.once_across_runs(later, "text", length, store).collect()}[5] == 3
    assert calls.value == 4 and len(ingest.finished_parts(spark, store)) == 5
