"""Class scores, lattices and beams.

A lattice is a long table ``keys, pos, ch_id, ch, lp``, ``keys`` naming the row.  Beams over it run inside one expression for each row:
the positions of a row are folded over the array of its best prefixes, so only the lattice is shuffled.
"""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ALPHABET
from ..session import saved
from . import contexts, ngram, routed

KEYS = ["base", "row_idx"]
MISSING = -1e9


def log_softmax(scores: Column) -> Column:
    """Log probabilities of an array of scores; the norm is bound first, so that it is computed once for an array."""
    top = F.array_max(scores)
    norm = F.element_at(F.transform(F.array(top), lambda t: t + F.log(F.aggregate(scores, F.lit(0.0), lambda acc, v: acc + F.exp(v - t)))), 1)
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(scores, lambda v: v - n)), 1)


def average_scores(scores: DataFrame, keys: list[str], column: str = "logits") -> DataFrame:
    """``keys, column``: elementwise means over all rows of a key."""
    items = scores.select(*keys, F.posexplode(column).alias("i", "v"))
    means = items.groupBy(*keys, "i").agg(F.avg("v").alias("v"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(column))


def average_aligned(a: DataFrame, b: DataFrame, keys: list[str], column: str = "logits") -> DataFrame:
    """Elementwise means of two score sets; a key that one of them lacks fails the query."""
    right = b.select(*keys, F.col(column).alias("__b"))
    both = a.select(*keys, column).join(right, keys, "full")
    mean = F.zip_with(column, "__b", lambda x, y: (x + y) / 2)
    return both.select(*keys, F.when(F.col(column).isNotNull() & F.col("__b").isNotNull(), mean).otherwise(F.raise_error(F.lit("score sets differ in their keys"))).alias(column))


def true_rank(label: Column, scores: Column) -> Column:
    """1 + the number of classes ahead of the true one; of equal scores the earlier class is ahead."""
    own = F.get(scores, label.cast("int"))
    ahead = F.filter(scores, lambda v, i: (v > own) | ((v == own) & (i < label)))
    return 1 + F.size(ahead)


def top_k_accuracy(logits: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row ``n, errors, top1, top3, top5``; accuracies are 0 for an empty table."""
    rank = true_rank(F.col("label"), F.col("logits"))
    hits = [F.coalesce(F.avg((F.col("__r") <= k).cast("double")), F.lit(0.0)).alias(f"top{k}") for k in ks]
    return logits.select(rank.alias("__r")).agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("__r") > 1).cast("bigint")), F.lit(0)).alias("errors"), *hits)


def class_weights(logits: DataFrame, power: float, n_classes: int = len(ALPHABET)) -> DataFrame:
    """``label, n, weight`` for every class: (n_rows / (classes * max(n, 1))) ** power, scaled to add to the number of classes.

    Power 0 weighs all alike, 1 balances, 0.5 is its root."""
    spark = logits.sparkSession
    counted = logits.groupBy("label").agg(F.count("*").alias("n"))
    full = spark.range(n_classes).withColumnRenamed("id", "label").join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    all_ = Window.partitionBy()
    raw = F.pow(F.sum("n").over(all_) / (n_classes * F.greatest("n", F.lit(1))), F.lit(power))
    return full.withColumn("raw", raw).withColumn("weight", F.col("raw") * n_classes / F.sum("raw").over(all_)).drop("raw")


def cross_entropy(logits: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row ``loss``: the (weighted) mean of minus the log probability of the true class, over the whole set."""
    lp = F.get(log_softmax(F.col("logits")), F.col("label").cast("int"))
    if weights is None:
        return logits.agg((-F.avg(lp)).alias("loss"))
    w = logits.join(weights.select("label", "weight"), "label")
    return w.agg((-F.sum(F.col("weight") * lp) / F.sum("weight")).alias("loss"))


def confusion(logits: DataFrame) -> DataFrame:
    """``actual, pred, n, share, log_share``: counts, their share of the true class, and log10(share + 1e-4)."""
    best = F.array_position(F.col("logits"), F.array_max("logits")) - 1
    n = logits.select(F.col("label").alias("actual"), best.cast("bigint").alias("pred")).groupBy("actual", "pred").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("actual"))
    return n.withColumn("share", share).withColumn("log_share", F.log10(F.col("share") + 1e-4))


def top_confusions(matrix: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` most frequent pairs of different classes, by count, then true and read class."""
    return matrix.where(F.col("actual") != F.col("pred")).orderBy(F.desc("n"), "actual", "pred").limit(k)


def positions(logits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """With ``pos``: the dense number of a position in its row, in the order of ``chunk_idx``."""
    return logits.withColumn("pos", (F.row_number().over(Window.partitionBy(*(keys or KEYS)).orderBy("chunk_idx")) - 1).cast("bigint"))


def lattice(logits: DataFrame, top: int = 0, keys: list[str] | None = None) -> DataFrame:
    """``keys, pos, ch_id, ch, lp``: log probabilities of the ``top`` characters of each position (0: all).

    The characters of a position are ranked inside its array: by probability, then in the order of the alphabet.
    """
    keys = keys or KEYS
    placed = positions(logits, keys)
    ranked = F.array_sort(F.transform(log_softmax(F.col("logits")), lambda lp, i: F.struct((-lp).alias("neg"), i.alias("ch_id"))))
    if top:
        ranked = F.slice(ranked, 1, top)
    rows = placed.select(*keys, "pos", F.explode(ranked).alias("x"))
    letters = F.array(*map(F.lit, ALPHABET))
    return rows.select(*keys, "pos", F.col("x.ch_id").cast("bigint").alias("ch_id"), F.get(letters, F.col("x.ch_id")).alias("ch"), (-F.col("x.neg")).alias("lp"))


def argmax_read(lat: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, text``: the best character of each position; the earlier class on ties."""
    keys = keys or KEYS
    best = lat.groupBy(*keys, "pos").agg(F.min_by("ch", F.struct(-F.col("lp"), "ch_id")).alias("ch"))
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("text"))


def _by_position(lat: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, lat``: an array over positions of arrays over characters, best first."""
    own = lat.groupBy(*keys, "pos").agg(F.array_sort(F.collect_list(F.struct((-F.col("lp")).alias("neg"), "ch_id", "ch"))).alias("cs"))
    return own.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cs"))), lambda x: x["cs"]).alias("lat"))


def visual_beam(lat: DataFrame, beam: int, keys: list[str] | None = None) -> DataFrame:
    """``keys, rank, text, score``: prefixes are extended by every character of the next position and the best ``beam`` stay.

    Ties keep the order of expansion: the parent's rank, then the character's.
    """
    keys = keys or KEYS
    start = F.array(F.struct(F.lit(0.0).alias("neg"), F.lit(0).alias("p"), F.lit(0).alias("c"), F.lit("").alias("text")))

    def extend(best: Column, cs: Column) -> Column:
        grown = F.flatten(F.transform(best, lambda b, p: F.transform(cs, lambda x, c: F.struct((b["neg"] + x["neg"]).alias("neg"), p.alias("p"), c.alias("c"), F.concat(b["text"], x["ch"]).alias("text")))))
        return F.slice(F.array_sort(grown), 1, beam)

    out = _by_position(lat, keys).select(*keys, F.posexplode(F.aggregate("lat", start, extend)).alias("rank", "b"))
    return out.select(*keys, F.col("rank").cast("bigint").alias("rank"), F.col("b.text").alias("text"), (-F.col("b.neg")).alias("score"))


def language_beam(lat: DataFrame, ngrams: DataFrame, order: int, weight: float, beam: int, keys: list[str] | None = None, *, by: list[str] | None = None, model: Broadcast | None = None, others: bool = False) -> DataFrame:
    """``keys, rank, text, score`` of a beam whose steps add ``weight`` times the PPM log probability of the character after its prefix.

    Counts that a packed model may hold (see ``contexts``; ``model`` if it is there already) are broadcast, and a row's beam runs from
    its first position to its last in one task.  Larger ones of ``contexts.suffix_counts`` are cut to what the lattices of a block of rows
    can spell, which then runs likewise (see ``routed``; with ``others`` by the counts of all other groups).  With other tables all rows advance a position at a time, a round for each position of the longest row; the contexts of a step meet the count
    tables in one join, and the state is saved after every step, as the next one names it twice.  Rows that have ended wait
    aside.  ``by`` names keys (such as the fold) that choose the counts.
    """
    keys, by = keys or KEYS, by or []
    if model is None and not others:
        ngrams = ngram._kept(ngrams)
        model = contexts.shared(ngrams, order, by)
    if model is not None:
        return contexts.packed_beam(_by_position(lat, keys), model, weight, beam, keys, by)
    if contexts.by_bucket(ngrams, order):
        return routed.language_beam(_by_position(lat, keys), ngrams, order, weight, beam, keys, by, others)
    lat = saved(lat.withColumn("rank_in", F.row_number().over(Window.partitionBy(*keys, "pos").orderBy(F.desc("lp"), "ch_id"))))
    lengths = lat.groupBy(*keys).agg((F.max("pos") + 1).alias("len"))
    longest = lengths.agg(F.max("len")).first()[0] or 0
    state = lengths.select(*keys, "len", F.lit(0).cast("bigint").alias("rank"), F.lit("").alias("text"), F.lit(0.0).alias("score"))
    done = None
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "rank", "rank_in")
    for pos in range(longest):
        tail = F.substring("text", -(order - 1), order - 1) if order > 1 else F.lit("")
        grown = state.join(lat.where(F.col("pos") == pos).drop("pos"), keys).withColumn("tail", tail)
        found = ngram.histories(grown.select(*by, "tail", "ch").distinct(), ngrams, order, by)
        step = found.select(*by, "tail", "ch", ngram.ppm(F.col("h")).alias("lm"))
        scored = grown.join(step, [*by, "tail", "ch"]).withColumn("score", F.col("score") + F.col("lp") + weight * F.col("lm"))
        state = saved(scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).select(*keys, "len", (F.col("r") - 1).cast("bigint").alias("rank"), F.concat("text", "ch").alias("text"), "score"))
        ended = state.where(F.col("len") == pos + 1)
        done = ended if done is None else done.unionByName(ended)
        state = state.where(F.col("len") > pos + 1)
    return (done if done is not None else state).select(*keys, "rank", "text", "score")


def candidate_pool(*beams: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, candidate_index, text``: the union of beams, each text once, numbered in text order."""
    keys = keys or KEYS
    all_ = beams[0].select(*keys, "text")
    for b in beams[1:]:
        all_ = all_.unionByName(b.select(*keys, "text"))
    order = Window.partitionBy(*keys).orderBy("text")
    return all_.distinct().withColumn("candidate_index", (F.row_number().over(order) - 1).cast("bigint"))


def visual_sums(texts: DataFrame, lat: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, text, visual_sum`` over the full lattice: -1e9 for a character that a position lacks, up to the shorter of both."""
    keys = keys or KEYS
    letters = texts.select(*keys, "text", F.posexplode(F.split("text", "")).alias("pos", "ch")).withColumn("pos", F.col("pos").cast("bigint"))
    lengths = lat.groupBy(*keys).agg((F.max("pos") + 1).alias("len"))
    hit = letters.join(lengths, keys).where("pos < len").join(lat.select(*keys, "pos", "ch", "lp"), [*keys, "pos", "ch"], "left")
    sums = hit.groupBy(*keys, "text").agg(F.sum(F.coalesce("lp", F.lit(MISSING))).alias("visual_sum"))
    return texts.select(*keys, "text").join(sums, [*keys, "text"], "left").withColumn("visual_sum", F.coalesce("visual_sum", F.lit(0.0)))


def candidate_table(logits: DataFrame, truth: DataFrame, ngrams: DataFrame, *, order: int, beam: int, top: int, weights: tuple[float, ...] = (1.0,), include_truth: bool = False, keys: list[str] | None = None, by: list[str] | None = None, others: bool = False) -> DataFrame:
    """``keys, candidate_index, text, truth, chars, edit_distance, visual_sum, ppm_sum``: the pool of a visual beam and one language
    beam for each weight, with features and distances; ``truth(keys, truth)`` may add the truth itself.

    ``by`` names those of ``keys`` that choose the counts, and all of them come out of one job; with ``others`` a row is scored by the
    counts of all groups but its own (``by`` is then the fold)."""
    keys, by = keys or KEYS, by or []
    full = saved(lattice(logits, 0, keys))
    proposal = lattice(logits, top, keys)
    ngrams = ngram._kept(ngrams)
    model = contexts.shared_without(ngrams, order, by) if others else contexts.shared(ngrams, order, by)
    inside = others and model is None and contexts.by_bucket(ngrams, order)
    if others and model is None and not inside:
        ngrams = ngram.excluded(ngrams, ngrams.select("fold").union(logits.select("fold")).distinct())
    beams = [visual_beam(proposal, beam, keys), *[language_beam(proposal, ngrams, order, w, beam, keys, by=by, model=model, others=inside) for w in weights]]
    if include_truth:
        beams.append(truth.select(*keys, F.col("truth").alias("text")))
    pool = saved(candidate_pool(*beams, keys=keys))
    seen = visual_sums(pool, full, keys)
    scored = ngram.step_scores(pool.withColumn("own", F.col("text")), ngrams, order, [*keys, "own"], by=by, model=model, others=inside).groupBy(*keys, "own").agg(F.avg("ppm").alias("p"))
    ppm = scored.select(*keys, F.col("own").alias("text"), (F.col("p") * F.length("own")).alias("ppm_sum"))
    out = pool.join(seen, [*keys, "text"]).join(ppm, [*keys, "text"], "left").join(truth.select(*keys, "truth"), keys, "left")
    return out.select(*keys, "candidate_index", "text", "truth", F.length("truth").cast("bigint").alias("chars"), F.levenshtein("text", "truth").cast("bigint").alias("edit_distance"), "visual_sum", F.coalesce("ppm_sum", F.lit(0.0)).alias("ppm_sum"))


def fold_rows(candidates: DataFrame, tag: str) -> DataFrame:
    """A candidate table by fold as the selector takes it: with ``tag`` and ``row_key``, the row's name among all folds."""
    key = F.concat(F.lit("f"), F.col("fold").cast("string"), F.lit(":"), F.col("base").cast("string"), F.lit(":"), F.col("row_idx").cast("string"))
    return candidates.select("fold", F.lit(tag).alias("tag"), "base", "row_idx", key.alias("row_key"), *[c for c in candidates.columns if c not in ("fold", "base", "row_idx")])


def decode(candidates: DataFrame, weight: float, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, pred, score, candidates``: the chosen text of every row of ``rows``; an empty pool gives an empty text."""
    keys = keys or KEYS
    score = F.col("visual_sum") + weight * F.col("ppm_sum")
    best = candidates.groupBy(*keys).agg(F.max_by(F.struct("text", score.alias("score")), F.struct(score, -F.col("candidate_index"))).alias("b"), F.count("*").alias("candidates"))
    return rows.select(*keys).join(best, keys, "left").select(*keys, F.coalesce("b.text", F.lit("")).alias("pred"), F.col("b.score").alias("score"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
