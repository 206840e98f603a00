"""Cases of the fourth round's findings."""

import random
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from seqlattice.llm import bpe
from seqlattice.operators import distances, evaluate, layout, ngram, scoring
from seqlattice.plans.queries import QUERIES


def test_two_empty_texts_have_a_band():
    nothing = np.zeros(0, bool)
    assert distances.masked_band("", "", 0) == 0
    assert distances.masked_many([("", nothing, ""), ("A", np.ones(1, bool), "A"), ("", nothing, "")]) == [(0, 0)] * 3


def test_a_band_of_one_diagonal_grows(monkeypatch):
    monkeypatch.setattr(distances, "FIRST_BAND", 1)
    assert distances.edit_distance("ABCD" * 10, "BCDA" * 10) == 2


def test_scores_of_whole_objects_shuffle_rows_not_letters(spark, small):
    for name in ("e6_masked_cer", "e8_micro_rates", "e8_micro_scores", "e4_confident_cer"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert len(re.findall(r"Generate posexplode", plan)) == 1, name


def test_rows_of_one_number_are_one_row(spark):
    letters = [(1, 0, i, ch, ch != "B") for i, ch in enumerate("ABC")] + [(1, 0, i, ch, False) for i, ch in enumerate("XY")] + [(1, 2, 0, "D", True), (1, 3, 0, "B", False)]
    df = spark.createDataFrame(letters, "base int, row_idx int, pos int, ch string, conf boolean")
    want = [("AXBYC\nD\nB", [True, False, False, False, True, True, True, False, False], "AC\nD", 4)]
    parts = spark.createDataFrame([(1, 0, "ABC", [True, False, True]), (1, 0, "XY", [False, False]), (1, 2, "D", [True]), (1, 3, "B", [False])], "base int, row_idx int, text string, flags array<boolean>")
    for rows in (evaluate.whole_rows(df, ["base"]), parts):
        assert [tuple(r) for r in evaluate.object_texts(rows, ["base"]).select("truth", "flags", "text", "n_char").collect()] == want


def test_pairs_of_tokens_at_hand_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_FITS", 50)
    vocab, rng = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randint(2, 9))) for _ in range(60)) for _ in range(20)]
    once = bpe.Encoder(vocab)
    for text in texts:
        assert bpe.decode(vocab, once([text])[0]) == text
        assert len(vocab._fits) <= 51
    monkeypatch.setattr(bpe, "MOST_FITS", 1 << 30)
    whole = bpe.Encoder(bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")))(texts)
    assert bpe.Encoder(vocab)(texts) == whole


def test_scores_by_row_make_no_row_of_a_letter(spark, small):
    for name in ("l4_order_profile", "b11_incremental_score"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "ppm#" not in plan and "Window" not in plan, name


def test_increments_and_profiles_of_texts(spark, monkeypatch):
    rng = random.Random(11)
    texts = [(i, "".join(rng.choices("ABCDE", k=rng.randint(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(texts, "id int, text string")
    model = ngram.counts(df, 3)
    letters = [(r.id, r.pos, r.ppm) for r in ngram.step_scores(df, model, 3, ["id"]).orderBy("id", "pos").collect()]
    bounds = {r.id: (r.total, r.least, r.most) for r in ngram.increment_bounds(df, model, 3, ["id"]).collect()}
    profiles = {(r.id, r.pos): r.profile for r in ngram.step_profiles(df, model, 3, ["id"], share=0.7).collect()}
    sums = {(r.id, r.k): (r.total, r.n) for r in ngram.profile_sums(df, model, 3, ["id"], share=0.7).collect()}
    for i, text in texts:
        own = [ppm for j, _, ppm in letters if j == i]
        assert (i in bounds) == bool(text)
        if text:
            assert np.allclose(bounds[i], (sum(own), min(own), max(own)), atol=1e-9)
            for k in (1, 2, 3):
                assert sums[i, k][1] == len(text) and np.isclose(sums[i, k][0], sum(profiles[i, p][k - 1] for p in range(len(text))), atol=1e-9)
    twice = {r.id: r.total for r in ngram.increment_bounds(df.unionByName(df), model, 3, ["id"]).collect()}
    # letters of one place follow each other, and the last total is the mean times the last place's number
    assert all(np.isclose(twice[i], np.mean([p for j, _, p in letters if j == i]) * len(t)) for i, t in texts if t)


def test_a_run_is_laid_out_once_for_each_repair(spark, small, monkeypatch):
    made, links = [], layout.neighbours
    monkeypatch.setattr(layout, "neighbours", lambda boxes, *more: made.append(1) or links(boxes, *more))
    monkeypatch.setattr(scoring.ly, "neighbours", layout.neighbours)
    QUERIES["e10_run_totals"](spark, small)
    assert len(made) == 3  # files without segments, and all files by either version of the repair


def test_nearest_segments_of_many_boxes(spark, monkeypatch):
    monkeypatch.setattr(layout, "CELLS", 7)
    monkeypatch.setattr(layout, "FILES", 2)
    rng = random.Random(5)
    boxes = [(f, i, rng.uniform(0, 50), rng.uniform(0, 50)) for f in range(5) for i in range(11)]
    segments = [(f, i, *[float(rng.randint(0, 50)) for _ in range(4)], i // 2) for f in range(4) for i in range(6)] + [(3, 6, 0.0, 0.0, 50.0, 50.0, 9), (3, 7, 0.0, 0.0, 50.0, 50.0, 8)]
    b = spark.createDataFrame(boxes, "file_id int, box_id int, cx double, cy double")
    s = spark.createDataFrame(segments, "file_id int, seg_id int, x0 double, y0 double, x1 double, y1 double, label int")
    pairs = b.join(s, "file_id").withColumn("d", layout.segment_distance(F.col("cx"), F.col("cy")))
    want = pairs.groupBy("file_id", "box_id").agg(F.min(F.struct("d", "seg_id", "label")).alias("m")).select("file_id", "box_id", "m.label", "m.d")
    got = layout.nearest_polyline(b, s)
    assert "transform(segments" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
