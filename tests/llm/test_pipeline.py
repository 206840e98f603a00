"""The pipeline's stages against what each promises on its own input."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from seqlattice.llm import mixing

from .test_operators import SCHEMA, WORD, documents, plain_classes, plain_lines


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """Input and output of each stage, as the pipeline hands them on."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, small).write.parquet(path)
        done = spark.read.parquet(path)
        out.append((docs, done))
        docs = done
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns
    assert stages[-1][1].columns == ["doc_id", "ids"]


def test_classifier_keeps_rows_whole(stages):
    before, after = (texts_of(x) for x in stages[0])
    assert after.items() <= before.items() and len(after) > 0.5 * len(before)


def test_lines(stages):
    before, after = (texts_of(x) for x in stages[1])
    want = {i: t for i, (n, gone, t) in plain_lines(before).items() if gone == 0 or gone < n}
    assert after == want


def test_one_of_each_class_stays(stages):
    before, after = (texts_of(x) for x in stages[2])
    classes = plain_classes(before)
    assert set(after) == {i for i, c in classes.items() if i == c}


def test_mix(stages):
    before, after = stages[3]
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(before).collect()}
    rows = defaultdict(list)
    for r in after.collect():
        rows[r.doc_id].append(r.text)
    whole = texts_of(before)
    for i, t in whole.items():
        words = WORD.findall(t or "")
        got = [WORD.findall(x) for x in rows.get(i, [])]
        assert sum(map(len, got)) == taken[i]
        assert all(g == words[: len(g)] for g in got)
        assert sum(g == words for g in got) == (taken[i] // len(words) if words else 0)


def test_mix_gives_every_row_its_words(spark, small):
    texts = ["a b c", "a b c", "d e f", None, "", "g h i j", "a b c", "x y", "k l m"]
    docs = documents(spark, texts, sources=["s", "t", None], ids=[1, 1, 1, 2, 2, None, None, None, 3])
    promised = sum(r.taken for r in mixing.mix_sources(docs).collect())
    given = sum(len(WORD.findall(r.text)) for r in corpus_pipeline.mixing_stage(spark, docs, small).collect())
    assert given == promised > 0


def test_encoding(stages):
    from tokenizers import Tokenizer

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = stages[4]
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in before.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in after.collect()) == want


def test_stages_take_odd_rows(spark, small):
    texts, ids = [None, "", "a\nb\nc", "a\nb\nc", "x y z"], [None, 1, 2, 2, 3]
    odd = documents(spark, texts, sources=[None, "s"], ids=ids)
    rows = Counter(zip(ids, texts, strict=True))
    of = lambda name: dict(corpus_pipeline.STAGES)[name](spark, odd, small)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), small).count() == 0, name
    got = lambda name: Counter((r.doc_id, r.text) for r in of(name).collect())
    # no rated id has a text of a grade among these, so nothing is rejected for another's sake, and rows stay whole
    assert got("quality classifier") <= rows
    # repeated rows are treated alike, so none is a later one
    assert got("line dedup") == rows
    # rows that share the id of a class all stay
    assert got("near dedup") == rows
    mixed = of("source mixing").collect()
    promised = sum(r.taken for r in mixing.mix_sources(odd).collect())
    assert sum(len(WORD.findall(r.text)) for r in mixed) == promised > 0
    assert all((r.doc_id, r.text) in rows or any(r.doc_id == i and (t or "").startswith(r.text) for i, t in rows) for r in mixed)
    encoded = of("bpe encoding").collect()
    assert len(encoded) == len(texts) and sorted(len(r.ids) for r in encoded)[:2] == [0, 0]


def test_stages_take_clashing_columns(spark, small):
    """Further columns with names that operators use come out as they went in, at all stages but the last."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    more = {"size": F.lit("s"), "taken": F.lit(7), "class_id": F.lit(-1), "row": F.lit("r"), "n_removed": F.lit(-2), "__id": F.lit(True), "mark": F.lit(1.5), "pass": F.lit("p")}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumns(more), small)
        assert out.columns == [*docs.columns, *more], name
        plain = Counter((r.doc_id, r.text) for r in stage(spark, docs, small).collect())
        rows = out.collect()
        assert Counter((r.doc_id, r.text) for r in rows) == plain, name
        assert all(tuple(r)[len(docs.columns) :] == ("s", 7, -1, "r", -2, True, 1.5, "p") for r in rows), name
