"""Secret scans: known forms and a battery of randomness tests, in DataFrame functions only.

Known forms are found by pattern.  Besides, every long run of encoding characters is tested, and so are the long segments of
it between slashes, and between slashes, underscores and hyphens: the encoding of each is inferred, and under that alphabet a chi-squared test of uniformity, a runs test and a serial-correlation test must all accept
randomness.  Whether it may be ordinary text is judged by its likelihood ratio against a reference for text; exp(-ratio)
bounds that probability, falls with length, and a step-up over all runs and segments of the table controls the false discoveries
among those that the battery accepts.  A long run is tested in pieces, whose scores are added up.

Both passes read the texts alone; only counts by ratio are shuffled, at most RATIO_BINS + 1 for each task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of the known forms. The shorter matches of ACCESS and HEX fail, so the bounds are part of them.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")



def _run(chars: str) -> str:
    """Runs of 20 of the characters at least, with the padding behind them; another ``=`` ends a name in front of a value."""
    return rf"(?<![{chars}])[{chars}]{{20,}}(?:=+(?![A-Za-z0-9+/_=-]))?"


#: Runs that the battery tests, and their segments.
RUN = _run("A-Za-z0-9+/_-")
SEGMENTS = (_run("A-Za-z0-9+_-"), _run("A-Za-z0-9+"))
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the narrowest on: pattern of all characters, alphabet in the order of values.
ENCODINGS = (
    (r"[0-9a-f]+", _DIGITS + _LOWER[:6]),
    (r"[0-9A-F]+", _DIGITS + _UPPER[:6]),
    (r"[A-Z2-7]+", _UPPER + _DIGITS[2:8]),
    (r"[0-9a-z]+", _DIGITS + _LOWER),
    (r"[0-9A-Z]+", _DIGITS + _UPPER),
    (r"[0-9A-Za-z]+", _DIGITS + _UPPER + _LOWER),
    (r"[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
    (r".+", _UPPER + _LOWER + _DIGITS + "+/"),
)
#: Encodings without a digit, likewise; each alphabet is one or two times a to z.
LETTERS = ((r"[a-z]+", _LOWER), (r"[A-Z]+", _UPPER), (r"[A-Za-z]+", _UPPER + _LOWER))
#: The reference for text of letters alone: percentages of a to z in either case, and the share of capitals if both occur.
LETTER_SHARES = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
CAPITALS = 0.06
#: The reference for other text: probability of each class of characters, spread evenly in the class.
TEXT_SHARES = {"lower": 0.90, "upper": 0.05, "digit": 0.03, "mark": 0.02}
RATIO_BINS = 400
#: Bounds of the three tests' normal scores at a joint level of one in a hundred.
MOST_CHI, MOST_RUNS, MOST_SERIAL = 2.71, 2.94, 2.94
#: Characters of a piece; the last one of a run has up to twice as many.
PIECE = 4096
#: Elements that are summed up one by one.
BLOCK = 128

_SPANS = "array<struct<start:int,kind:int,end:int>>"
_MATCHES = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body, or a lambda function in it, names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of ``start, end, value`` for the matches of a pattern, in code points: what lies between matches tells where they are."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))

    def located(x: Column) -> Column:
        steps = F.transform(x["m"], lambda m, i: F.length(m) + F.length(F.get(x["between"], i)))

        def match(before: Column, i: Column) -> Column:
            start = before + F.length(F.get(x["between"], i))
            return F.struct(start.alias("start"), (start + F.length(F.get(x["m"], i))).alias("end"), F.get(x["v"], i).alias("value"))

        return F.transform(_let(steps, lambda s: _before(s)), match)

    return F.when(text.rlike(pattern), _let(parts, located)).otherwise(F.array().cast(_MATCHES))


def _before(values: Column, levels: int = 2) -> Column:
    """Sum of the values in front of each; blocks are summed up first, then the blocks' sums likewise, so the work is linear."""

    def step(acc: Column, v: Column) -> Column:
        return F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    if not levels:
        return F.aggregate(values, first, step, lambda acc: acc["out"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), first, step))
    return _let(blocks, lambda k: F.flatten(F.zip_with(k, _let(F.transform(k, lambda x: x["at"]), lambda sums: _before(sums, levels - 1)), lambda x, start: F.transform(x["out"], lambda v: v + start))))


def _spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Spans of one kind; with ``least``, of the matches whose second group has as many characters."""
    found = _matches(text, pattern, 2 if least else 0)
    if least:
        found = F.filter(found, lambda x: F.length(x["value"]) >= least)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(_SPANS)


def base_spans(text: Column) -> Column:
    """Spans of the known forms, sorted by start and kind."""
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, LEAST_VALUE), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _count(t: Column, chars: str) -> Column:
    return F.length(t) - F.length(F.translate(t, chars, ""))


def _total(values: Column, of: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + of(v))


def _text_ratio(t: Column, n: Column, k: Column) -> Column:
    mark = n - _count(t, _LOWER) - _count(t, _UPPER) - _count(t, _DIGITS)
    shares = ((_count(t, _LOWER), "lower", 26), (_count(t, _UPPER), "upper", 26), (_count(t, _DIGITS), "digit", 10), (mark, "mark", 4))
    ratio = -n * F.log(k)
    for count, name, size in shares:
        ratio = ratio - count * math.log(TEXT_SHARES[name] / size)
    return ratio


def _letters_ratio(t: Column, values: Column, n: Column, k: Column) -> Column:
    """As :func:`_text_ratio` for letters alone, by how often text has each of them."""
    shares = F.array(*[F.lit(math.log(p / sum(LETTER_SHARES))) for p in LETTER_SHARES])
    cases = F.when(k > 26, _count(t, _UPPER) * math.log(CAPITALS) + _count(t, _LOWER) * math.log(1 - CAPITALS)).otherwise(F.lit(0.0))
    return -n * F.log(k) - _total(values, lambda v: F.get(shares, (v % 26).cast("int"))) - cases


def _chi_score(t: Column, alphabet: Column, n: Column, k: Column) -> Column:
    """Normal score of the chi-squared statistic of uniformity over the alphabet."""
    squares = _total(F.split(alphabet, ""), lambda a: F.pow(n - F.length(F.replace(t, a, F.lit(""))), F.lit(2.0)))
    df = k - 1
    return (F.pow(F.greatest(squares * k / n - n, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))


def _steps(values: Column, of: Callable[[Column, Column], Column]) -> Column:
    """Sum of a function of each two neighbours."""
    return _total(F.zip_with(F.slice(values, F.lit(2), F.size(values)), values, lambda a, b: F.coalesce(of(a, b), F.lit(0.0))))


def _run_score(values: Column, n: Column, k: Column) -> Column:
    """Normal score of the number of runs of values in the alphabet's upper and lower half."""
    runs = 1 + _steps(values, lambda a, b: ((a >= k / 2) != (b >= k / 2)).cast("double"))
    ones = _total(values, lambda v: (v >= k / 2).cast("double"))
    return _let(
        F.struct(runs.alias("runs"), (2 * ones * (n - ones) / n + 1).alias("mean")),
        lambda x: F.when(x["mean"] > 2, (x["runs"] - x["mean"]) / F.sqrt((x["mean"] - 1) * (x["mean"] - 2) / (n - 1))).otherwise(F.lit(1e9)),
    )


def _serial_score(values: Column, n: Column) -> Column:
    """Normal score of the correlation between neighbours."""

    def about(mean: Column) -> Column:
        return _let(_total(values, lambda v: (v - mean) * (v - mean)), lambda spread: F.when(spread > 0, (_steps(values, lambda a, b: (a - mean) * (b - mean)) / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(1e9)))

    return _let(_total(values) / n, about)


def _tested(t: Column) -> Column:
    """Struct ``ratio, random`` for a run: its log likelihood ratio of an even alphabet to text, and the battery's verdict.

    Runs without a letter are text.
    """
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(t.rlike(f"^{pattern}$"), F.lit(letters)).otherwise(alphabet)
    for pattern, letters in reversed(LETTERS):
        alphabet = F.when(t.rlike(f"^{pattern}$"), F.lit(letters)).otherwise(alphabet)

    def scores(x: Column, n: Column, k: Column) -> Column:
        values = x["values"]
        ratio = F.when(x["t"].rlike("^[A-Za-z]+$"), _letters_ratio(x["t"], values, n, k)).otherwise(_text_ratio(x["t"], n, k))
        return F.struct(_chi_score(x["t"], x["alphabet"], n, k).alias("chi"), _run_score(values, n, k).alias("runs"), _serial_score(values, n).alias("serial"), ratio.alias("ratio"))

    def measured(t: Column, alphabet: Column) -> Column:
        values = F.transform(F.split(t, ""), lambda c: (F.position(c, alphabet) - 1).cast("double"))
        parts = F.struct(t.alias("t"), alphabet.alias("alphabet"), F.length(t).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"), values.alias("values"))
        return _let(parts, lambda x: scores(x, x["n"], x["k"]))

    def battery(pieces: Column) -> Column:
        even = F.sqrt(F.size(pieces).cast("double"))  # the sum of m normal scores has m times their variance
        random = (_total(pieces, lambda p: p["chi"]) / even <= MOST_CHI) & (F.abs(_total(pieces, lambda p: p["runs"])) / even <= MOST_RUNS) & (F.abs(_total(pieces, lambda p: p["serial"])) / even <= MOST_SERIAL)
        return F.struct(_total(pieces, lambda p: p["ratio"]).alias("ratio"), random.alias("random"))

    def in_pieces(x: Column) -> Column:
        cut = F.when(F.length(x["t"]) < 2 * PIECE, F.array(x["t"])).otherwise(F.regexp_extract_all(x["t"], F.lit(f".{{{PIECE}}}(?=.{{{PIECE}}})|.+"), F.lit(0)))
        return _let(F.transform(cut, lambda p: measured(p, x["alphabet"])), battery)

    tested = _let(F.struct(t.alias("t"), alphabet.alias("alphabet")), in_pieces)
    return F.when(t.rlike("[A-Za-z]"), tested).otherwise(F.struct(F.lit(-1.0).alias("ratio"), F.lit(False).alias("random")))


def tested_runs(text: Column) -> Column:
    """Array of ``start, end, ratio, random`` for every run of encoding characters and its segments, each span once; trailing
    ``=`` are padding and not tested."""
    kind = "array<struct<start:int,end:int,t:struct<ratio:double,random:boolean>>>"
    spans = F.when(text.rlike(RUN), F.array_distinct(F.concat(*[_matches(text, pattern) for pattern in (RUN, *SEGMENTS)]))).otherwise(F.array().cast(_MATCHES))
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _tested(F.regexp_replace(x["value"], "(?<=.)=+$", "")).alias("t"))).cast(kind)


def least_ratio(docs: DataFrame, text_col: str = "text", false_discoveries: float = 0.01) -> DataFrame:
    """One row ``least``: the smallest ratio whose step-up bound holds; null if none does.

    Of all that is tested, the runs and segments that the battery accepts with this ratio or more are the discoveries.  They
    are counted in bins of one nat, so the counts that are gathered don't grow with the table.
    """
    ratios = docs.where(F.col(text_col).rlike(RUN)).select(F.explode(tested_runs(F.col(text_col))).alias("r")).select(F.least(F.greatest(F.floor("r.t.ratio"), F.lit(0)), F.lit(RATIO_BINS)).alias("bin"), F.col("r.t.random").cast("bigint").alias("random"))
    bins = ratios.groupBy("bin").agg(F.count("*").alias("n"), F.sum("random").alias("accepted"))
    above = F.sum("accepted").over(Window.orderBy(F.col("bin").desc()))
    return bins.select("bin", above.alias("above"), F.sum("n").over(Window.partitionBy()).alias("all")).where((F.col("bin") > 0) & (F.col("all") * F.exp(-F.col("bin")) <= false_discoveries * F.col("above"))).agg(F.min("bin").cast("double").alias("least"))


def _shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", false_discoveries: float = 0.01) -> DataFrame:
    """``doc_id, base, spans``: for each row the known forms and all spans, as sorted arrays of ``start, kind, end``.

    ``kind`` numbers KINDS; positions are code points, the end exclusive.  A run, or the segment
    of one that isn't taken itself, that the battery and the step-up take as random is added unless it overlaps a known form.  Null and empty texts have no spans; null ids, repeated rows and further
    columns are of no effect, but equal runs count each time in the step-up.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    least = least_ratio(docs, text_col, false_discoveries).scalar()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), base_spans(text).alias("base"), F.filter(tested_runs(text), lambda r: r["t"]["random"]).alias("runs"), F.coalesce(least, F.lit(float("inf"))).alias("least"))
    passed = F.filter("runs", lambda r: (r["t"]["ratio"] >= F.col("least")) & ~F.exists(F.col("base"), lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    inner = lambda r, s: (s["start"] <= r["start"]) & (r["end"] <= s["end"]) & (r["end"] - r["start"] < s["end"] - s["start"])
    added = _let(passed, lambda p: F.filter(p, lambda r: ~F.exists(p, lambda s: inner(r, s))))
    random = F.transform(added, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end"))).cast(_SPANS)
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def scan_secrets(docs: DataFrame, **options: object) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` from :func:`secret_spans`, whose options it takes."""
    found = secret_spans(docs, **options)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))
