"""Cases of the third round's findings."""

import itertools
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.functions.text import ALPHABET
from seqlattice.llm import mixing, near_dedup
from seqlattice.operators import contexts, distances, lattice, layout, ngram, pairing, routed
from seqlattice.plans import views
from seqlattice.plans.queries import ORACLES, QUERIES
from seqlattice.sources import transcript_files


def test_run_scores_keep_the_break_before_an_empty_last_row(spark, tmp_path):
    # supplier 15 has one letter in its second row, a W, of which the reading has nothing
    lines = [(15, 1 + i, 7 + i % 3, 1, 1.0 * i) for i in range(21)]
    spark.createDataFrame(lines, "l_suppkey bigint, l_orderkey bigint, l_partkey bigint, l_linenumber bigint, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["e8_run_scores"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['e8_run_scores']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def _altered(text, share, rng):
    out = [c if rng.random() > share else rng.choice(["", "X", c + "Z"]) for c in text]
    return "".join(out)


def test_first_band_holds_most_long_texts(monkeypatch):
    rng, widths, band = random.Random(5), [], distances._in_band
    monkeypatch.setattr(distances, "_in_band", lambda a, b, places, below, above: widths.append(below + above) or band(a, b, places, below, above))
    text = "".join(rng.choice("ABCDEFGHIKLM") for _ in range(6000))
    other = _altered(text, 0.2, rng)
    found = distances.edit_distance(text, other)
    assert len(widths) == 1 and found <= widths[0] < 0.35 * len(text)
    longer, shorter = max(text, other, key=len), min(text, other, key=len)
    assert found == distances._whole(longer, shorter, {c: sum(1 << i for i, x in enumerate(longer) if x == c) for c in set(longer)})


def test_bands_of_uneven_texts_are_exact(monkeypatch):
    monkeypatch.setattr(distances, "BEGINNING", 16)
    monkeypatch.setattr(distances, "FIRST_BAND", 2)
    rng = random.Random(7)
    for _ in range(400):
        a = "".join(rng.choice("AB" if rng.random() < 0.3 else "ABCDEFGH") for _ in range(rng.randint(0, 90)))
        b = _altered(a, rng.random() / 2, rng)
        b = b[: rng.randint(0, len(b))] + b[rng.randint(0, len(b)) :]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert distances.edit_distance(a, b) == row[-1]


def test_links_at_the_threshold_are_kept(spark):
    # 4,000 pairs of texts, 50 of whose 62 shingles are common: similarity 0.806, and each pair's only link
    common = [[f"w{i}x{k}" for k in range(54)] for i in range(4000)]
    made = [(2 * i + j, " ".join([*words, *[f"w{i}y{j}{k}" for k in range(6)]])) for i, words in enumerate(common) for j in (0, 1)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string").repartition(8)
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert [i for i in range(4000) if classes[2 * i + 1] != 2 * i] == []


def _read_with_confusions(rng, n):
    """A text, flags, and a reading that takes some letters for others and drops the N of AN."""
    text = "".join(rng.choice("AEEINNORSTTLU") for _ in range(n))
    return text, np.array([rng.random() > 1 / 7 for _ in text]), text.replace("AN", "A").translate(str.maketrans("OSI", "QZL"))


def test_characters_without_an_equal_narrow_the_band(monkeypatch):
    # the letters that the texts lack tell all but the dropped ones, so the band need not be as wide as the distance
    widths, band = [], distances._in_band
    monkeypatch.setattr(distances, "_in_band", lambda a, b, places, below, above: widths.append(below + above) or band(a, b, places, below, above))
    text, _, reading = _read_with_confusions(random.Random(3), 3000)
    found = distances.edit_distance(text, reading)
    assert sum(widths) < 0.5 * found
    assert found == distances._whole(text, reading, {c: sum(1 << i for i, x in enumerate(text) if x == c) for c in set(text)})


def test_masked_bands_are_narrow_and_exact(monkeypatch):
    bands, table = [], distances.masked_in_bands
    monkeypatch.setattr(distances, "masked_in_bands", lambda pairs, k: bands.append(k) or table(pairs, k))
    rng = random.Random(4)
    pairs = [(text, flags, reading) for text, flags, reading in (_read_with_confusions(rng, n) for n in (1, 5, 40, 300, 700))]
    pairs += [(text, flags, _altered(text, 0.3, rng)) for text, flags, _ in (_read_with_confusions(rng, rng.randint(1, 60)) for _ in range(60))]
    found = distances.masked_many(pairs)
    assert found == [tuple(int(x[0]) for x in table([pair], len(pair[0]) + len(pair[2]))) for pair in pairs]
    bands.clear()
    text, flags, reading = _read_with_confusions(rng, 4000)
    distances.masked_many([(text, flags, reading)])
    assert bands[0] < 0.5 * distances.edit_distance(text, reading)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_is_sorted_for_a_pair_of_boxes(spark, small):
    boxes = views.boxes(spark, small)
    assert "SortAggregate" not in _plan(layout.neighbours(boxes))
    assert "SortAggregate" not in _plan(layout.nearest_polyline(boxes, layout.polylines(views.segments(spark, small))))


def test_views_of_chunks_are_made_once(spark):
    one = spark.createDataFrame([(1, 0, 0, "AB"), (1, 0, 1, "C"), (2, 0, 0, "D"), (2, 1, 0, None), (3, None, 0, "E")], "base int, row_idx int, chunk_idx int, t string")
    two = spark.createDataFrame([(1, 0, 0, "AB"), (1, 0, 1, "C"), (2, 0, 0, "X"), (3, None, 0, "E"), (4, 0, 0, "F")], "base int, row_idx int, chunk_idx int, t string")
    found = pairing.training_pairs(one, two)
    assert _plan(found).count("Scan") == 2
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(1, 0, 0, "AB", "pair"), (1, 0, 1, "C", "pair"), (2, 0, 0, "D", "rot1"), (2, 0, 0, "X", "rot2"), (3, None, 0, "E", "rot1"), (3, None, 0, "E", "rot2"), (4, 0, 0, "F", "rot2")]))


def test_sums_of_deep_counts_hold_no_row_for_a_context(spark, monkeypatch):
    # the n-grams of order 12 are a dozen for each letter, their sums some thousand rows whatever the text
    rng, most = random.Random(11), []
    made = [(i % 3, "".join(rng.choice("AABCDE") for _ in range(rng.randint(0, 90)))) for i in range(400)] + [(1, ""), (2, None)]
    texts = spark.createDataFrame(made, "fold int, text string").repartition(3)
    keep = contexts.kept
    monkeypatch.setattr(contexts, "kept", lambda df, name: most.append(keep(df, name)) or most[-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = {tuple(r) for r in contexts.suffix_sums(texts, 12, by=["fold"]).collect()}
        sums_rows = most[-1].where("NOT part").count()
        counts = contexts.suffix_counts(texts, 12, by=["fold"]).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = {}
    for fold, text in made:
        for i, ch in enumerate(text or ""):
            for m in range(1, min(12, i + 1) + 1):
                key = (fold, m, text[i - m + 1 : i], ch)
                plain[key] = plain.get(key, 0) + 1
    tot, want = {}, {}
    for (fold, m, ctx, _), n in plain.items():
        t = tot.setdefault((fold, m, ctx), [0, 0])
        t[0], t[1] = t[0] + n, t[1] + 1
    for (fold, m, ctx, ch), n in plain.items():
        near = 0
        for c in ctx[-2:][::-1]:
            near = near * 32 + ALPHABET.index(c) + 1
        row = want.setdefault((fold, m, near, ALPHABET.index(ch) + 1), [0, 0, 0, 0, 0])
        t = tot[fold, m, ctx]
        row[:] = row[0] + 1, row[1] + n, row[2] + t[0], row[3] + t[1], max(row[4], n)
    assert got == {(*k, *v) for k, v in want.items()}
    assert len(counts) == len(plain) and int(counts.n.sum()) == sum(plain.values())
    assert sums_rows < len(plain) / 3


def _deep_case(spark):
    rng = random.Random(9)
    made = [(i % 3, "".join(rng.choices("AABBCDE&", k=40))) for i in range(60)]
    texts = spark.createDataFrame(made, "fold bigint, text string")
    scores = [(b, 0, c, 0, [rng.gauss(0, 1) for _ in range(27)]) for b, n in enumerate([1, 4, 9, 13, 7, 12]) for c in range(n)]
    # letters of the texts are likely, so that long contexts are met
    logits = spark.createDataFrame([(*r[:4], [x + 3 * (i in (0, 1, 2, 3, 4, 24)) for i, x in enumerate(r[4])]) for r in scores], "base bigint, row_idx bigint, chunk_idx bigint, label bigint, logits array<double>")
    return texts, logits.withColumn("fold", F.col("base") % 4)


@pytest.mark.parametrize("others", [False, True])
def test_counts_beyond_a_packed_model_are_used_in_buckets(spark, monkeypatch, others):
    texts, logits = _deep_case(spark)
    keys = ["fold", "base", "row_idx"]
    counts = contexts.suffix_counts(texts, 12, by=["fold"])
    truth = logits.select(*keys).distinct().withColumn("truth", F.lit("ABC&"))

    def table():
        rows = lattice.candidate_table(logits, truth, counts, order=12, beam=16, top=6, include_truth=True, keys=keys, by=["fold"], others=others).collect()
        return {(r.base, r.text): (r.candidate_index, r.edit_distance, r.visual_sum, r.ppm_sum) for r in rows}

    want = table()
    monkeypatch.setattr(contexts, "MOST_NGRAMS", 0)
    monkeypatch.setattr(routed, "BUCKET", 300)
    monkeypatch.setattr(routed, "BLOCK", 2)
    monkeypatch.setattr(ngram, "histories", None)  # counts are not joined
    got = table()
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_letters_scored_in_buckets(spark, monkeypatch):
    texts, _ = _deep_case(spark)
    counts = contexts.suffix_counts(texts.where("fold < 2"), 12)
    asked = spark.createDataFrame([(0, "ABBAC&DEABAAQZ"), (1, "Z"), (2, ""), (3, None), (4, "ABjB")], "id int, text string").unionByName(texts.limit(5).select((F.col("fold") + 10 + F.length("text")).cast("int").alias("id"), "text").dropDuplicates(["id"]))

    def both():
        steps = {(r.id, r.pos, r.ch): (r.interpolated, r.ppm) for r in ngram.step_scores(asked, counts, 12, ["id"], share=0.7).collect()}
        return steps, {(r.id, r.pos, r.ch): r.profile for r in ngram.step_profiles(asked, counts, 12, ["id"], share=0.7).collect()}

    asked = asked.localCheckpoint()
    want = both()
    monkeypatch.setattr(contexts, "MOST_NGRAMS", 0)
    monkeypatch.setattr(routed, "BUCKET", 200)
    monkeypatch.setattr(ngram, "histories", None)
    got = both()
    for a, b in zip(got, want, strict=True):
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in b)


def test_plan_of_a_mix_does_not_double_with_each_level(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "'a b c' AS text", "concat('s', id % 3) AS source")
    assert _plan(mixing.mix_rows(docs)).count("Window") < 20


def test_few_links_are_settled_in_one_job(spark, monkeypatch):
    rng = random.Random(5)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    rounds, save = [], near_dedup.saved
    monkeypatch.setattr(near_dedup, "saved", lambda d: rounds.append(1) or save(d))
    few = sorted(map(tuple, near_dedup.components(df).collect()))
    assert len(rounds) <= 2
    monkeypatch.setattr(near_dedup, "LINKS_A_TASK", 100)
    assert sorted(map(tuple, near_dedup.components(df).collect())) == few and len(rounds) > 4


def test_texts_without_insertions_need_no_band(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(distances, "_in_band", None)
    monkeypatch.setattr(distances, "_whole", None)
    for n in (1, 30, 3000):
        text, _, reading = _read_with_confusions(rng, n)
        assert distances.edit_distance(reading, text) == sum(c in "OSI" for c in text) + text.count("AN")
    monkeypatch.undo()
    for _ in range(300):
        a = "".join(rng.choice("ABC") for _ in range(rng.randint(1, 12)))
        b = _altered(a, 0.4, rng)
        a, b = max(a, b, key=len), min(a, b, key=len)
        if b:
            most = max(sum(x == y for x, y in zip(kept, b, strict=True)) for kept in itertools.combinations(a, len(b)))
            assert distances._without_insertions(a, b) == len(a) - most


def test_union_of_views_by_rows_is_that_of_boxes(spark):
    rng = random.Random(8)
    made = [(b, f, r, [rng.choice([True, False, None]) for _ in range(rng.randint(1, 6))]) for b in range(12) for f in range(rng.randint(1, 3)) for r in range(3)]
    made += [(20, f, r, [f == 0] * n) for f, lengths in enumerate([(3, 2), (2, 1, 2)]) for r, n in enumerate(lengths)]
    files = spark.createDataFrame(made, "base bigint, file_id int, row_idx bigint, flags array<boolean>")
    boxes = files.select("base", "file_id", "row_idx", F.posexplode("flags").alias("pos", "conf")).withColumn("box_id", F.col("row_idx") * 100 + F.col("pos"))
    want = sorted(str((r.base, r.box_id, r.conf)) for r in layout.confidence_union(boxes).collect())
    got = [str((r.base, r.row_idx * 100 + i, f)) for r in layout.confidence_union_rows(files).collect() for i, f in enumerate(r.flags)]
    assert sorted(got) == want and len(want) > 5


def test_no_letter_is_a_row_of_the_union(spark, small):
    plan = _plan(QUERIES["g11_confidence_union"](spark, small))
    assert plan.count("hashpartitioning") == 1 and "pos#" not in plan.split("hashpartitioning")[0]


def test_transcript_files_are_read_by_their_names(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.range(3000).selectExpr("concat('o', id) AS base", "repeat('AB', cast(id % 7 AS int)) AS text").repartition(3)
    transcript_files.write_transcripts(df, folder)
    back = transcript_files.read_transcripts(spark, folder)
    assert "Scan binaryFile" not in _plan(back) and back.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert len(os.listdir(folder)) == 3000
