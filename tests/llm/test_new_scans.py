"""Periodic runs, license scans and ranked search against plain restatements."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqlattice.llm import license_rules, license_scan, periodic_runs, ranked_search

from .test_operators import ODD, SCHEMA, WORD, documents


# --- periodic runs


def plain_runs(words):
    """Every lag of every word; runs whose stretch has a smaller period go."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.append((i - q, j - i + q, q))
            i = max(j, i + 1)
    kept = [r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found)]
    return sorted(kept, key=lambda r: (r[0], r[2]))


def fast_runs(texts):
    split = [t.encode().split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [w for own in split for w in own]
    first = (np.cumsum(counts) - counts).tolist()
    out = [[] for _ in texts]
    for start, length, period in periodic_runs.diagonals(periodic_runs.occurrences(pd.factorize(flat)[0], counts)):
        k = max(i for i, f in enumerate(first) if f <= start and counts[i])
        out[k].append((start - first[k], length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def test_runs_of_random_words():
    rng = random.Random(5)
    texts = ["", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "x " + "a b c " * 5 + "a b y"]
    for _ in range(400):
        block = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 30))]
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 12))] + block * rng.randint(1, 9) + block[: rng.randint(0, 5)]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "z"
        texts.append(" ".join(words * rng.choice([1, 1, 4, 5]) + [rng.choice("ab")]))
    got = fast_runs(texts)
    for t, runs in zip(texts, got, strict=True):
        assert runs == plain_runs(t.split()), t


def test_each_word_has_few_occurrences():
    # one word throughout, and blocks within blocks: no pairs of all positions
    for words in (["a"] * 20_000, (["a", "b"] * 40 + ["c"]) * 200):
        found = periodic_runs.occurrences(pd.factorize(np.array(words, dtype=object))[0], np.array([len(words)]))
        assert len(found) < 8 * len(words)
    assert fast_runs(["a " * 20_000]) == [[(0, 20_000, 1)]]


def test_runs_of_rows(spark):
    texts = ODD + ["lead " + "to be or not " * 9 + "tail", "w " * 70_000]
    docs = documents(spark, texts, ids=[None, 1, 1, *range(3, len(texts))]).withColumn("runs", F.lit(1))
    rows = periodic_runs.periodic_runs(docs).collect()
    assert len(rows) == len(texts)
    by_words = {}
    for r in rows:
        by_words.setdefault(r.n_words, []).append(r)
    for t in texts:
        words = WORD.findall(t or "")
        want = plain_runs(words) if len(words) < 5000 else [(0, len(words), 1)]
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert any([tuple(x) for x in r.runs] == want and r.text == kept for r in by_words[len(words)]), t
    assert periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_run_digest_takes_the_greatest_exponent(spark):
    schema = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string"
    runs = [(0, 9, 2), (12, 18, 4), (40, 18, 4), (70, 13, 3)]
    row = periodic_runs.digest(spark.createDataFrame([(1, 99, runs, "t"), (2, 0, [], "")], schema)).orderBy("doc_id").collect()
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    assert (row[0].start, row[0].length, row[0].period, row[0].exponent_milli) == (*best, 4500)
    assert row[1][1:6] == (0, None, None, None, None) and row[1].runs_sha256 == row[1].collapsed_sha256


# --- license scans

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LICENSES = [
    ("Released under the MIT License.", {"mit"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache-2"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3"}),
    ("under the GNU Lesser General Public License version 2.1", {"lgpl-2.1"}),
    ("the GNU Affero General Public License v3", {"agpl-3"}),
    ("SPDX-License-Identifier: GPL-2.0-or-later OR MIT", {"gpl-2", "mit"}),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/legalcode", {"cc-by-nc-sa"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", {"bsd"}),
    ("under the 3-clause BSD license", {"bsd-3-clause"}),
    ("Mozilla Public License 2.0 and Boost Software License 1.0", {"mpl-2", "bsl-1"}),
    ("Das ist mit und ohne Lizenz", set()),
    ("the mit (no licence here) was by a cc of nc", set()),
    ("Apache helicopters, version 2", set()),
]


def plain_scan(text):
    """All rules on the whole text, and each pair of detections compared."""
    words = TERM.findall((text or "").translate(LOWER))
    line = " " + " ".join(words) + " "

    def place(m):
        start, end = m.span(m.lastindex or 0)
        return line[:start].count(" ") - 1, line[:end].count(" ")

    rules, _ = license_rules.read_rules()
    hits = [(*place(m), r.priority, n) for n, r in enumerate(rules) for m in re.finditer(r.pattern.pattern.decode(), line)]

    def over(a, b):
        """Whether ``a`` removes ``b``."""
        if not (a[0] <= b[0] and a[1] >= b[1]) or a == b:
            return False
        more = (a[2], a[1] - a[0], -a[3]) > (b[2], b[1] - b[0], -b[3])
        return a[2] >= b[2] and more

    kept = sorted(h for h in set(hits) if not any(over(o, h) for o in hits))
    base = sorted((i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), base, [(rules[n].label, s, e) for s, e, _, n in kept]


def test_license_rules():
    rules, families = license_rules.read_rules()
    assert len(rules) >= 300 and all(f.rules and f.gates for f in families)
    assert len({(r.label, r.pattern.pattern) for r in rules}) == len(rules)


@pytest.mark.parametrize("text, labels", LICENSES)
def test_license_labels(text, labels):
    base, hits = license_scan.scan(license_scan.folded_words(text))
    rules, _ = license_rules.read_rules()
    assert {rules[h.rule].label for h in hits} | {b[0] for b in base} == labels


def test_license_gates_lose_nothing(spark, small):
    pool = [t for t, _ in LICENSES] + ["gnu gpl v2 or gpl3 license", "all rights reserved", "dedicated to the public domain", "dual licensed under mit or apache 2.0 license", "spdx license identifier bsd 2 clause cc0 1.0 universal"]
    rng = random.Random(3)
    texts = ODD + pool + [" ".join(rng.choices(pool + ["É", "plain words", "under the", "license"], k=rng.randint(2, 9))) for _ in range(60)]
    docs = documents(spark, texts).withColumn("base", F.lit(1))
    rows = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    for i, t in enumerate(texts):
        n, base, kept = plain_scan(t)
        assert rows[i].n_words == n
        assert [(b.start, b.label) for b in rows[i].base] == base
        assert sorted((d.start, d.end, d.label) for d in rows[i].detections) == sorted((s, e, label) for label, s, e in kept), t


def test_license_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in license_scan.summary(license_scan.license_scan(docs)).collect()}
    for d in docs.collect():
        n, base, kept = plain_scan(d.text)
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), *((base[0][0], base[-1][0]) if base else (None, None)))
        assert r.base_labels == ",".join(sorted({b[1] for b in base}))
        assert r.labels == ",".join(sorted({b[1] for b in base} | {k[0] for k in kept}))
        assert (r.score > 0) == bool(r.labels) and 0 <= r.score <= 1
        assert bool(r.labels) == bool(re.search(r"under the MIT|Apache License|CC BY|General Public License|All rights reserved", d.text or ""))


def test_license_empty_and_repeated(spark):
    assert license_scan.summary(license_scan.license_scan(spark.createDataFrame([], SCHEMA))).count() == 0
    twice = documents(spark, ["CC BY-NC-SA 4.0 " * 3000] * 2, ids=[None, None])
    rows = license_scan.summary(license_scan.license_scan(twice)).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    assert (rows[0].n_base, rows[0].last_word, rows[0].labels) == (3000, 6 * 2999, "cc-by-nc,cc-by-nc-sa")


# --- ranked search


def plain_search(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    found = [(i, Counter(term.findall((t or "").translate(LOWER)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_words = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    terms = {}
    for item, t in items:
        terms.setdefault(item, set()).update(term.findall((t or "").translate(LOWER)))
    out = {}
    for item, own in terms.items():
        scores = []
        for i, c in found:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out[item] = [(r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return {i: v for i, v in out.items() if v}


def searched(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.rank):
        out.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return out


@pytest.fixture(scope="module")
def search_case(spark):
    rng = random.Random(9)
    words = ["the", "The", "of", "x1", "ÉA", "éa", "rare", "b-c", "d_e", "[f]"] + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, weights=[30, 9, 20] + [1] * 47, k=rng.randint(1, 60))) for _ in range(300)]
    texts += [None, "", "...", *["same text of w1 w2"] * 40, "w3 " * 9000]
    ids = [*range(len(texts) - 3), None, None, 7]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(30)]
    items += [(3, "w1 w1 w2 extra"), (None, "of w2"), (50, None), (51, "?!"), (52, "absent"), (53, items[0][1]), (54, "same text of w1 w2")]
    return texts, ids, items


@pytest.mark.parametrize("most_terms", [50_000, 60])
def test_ranked_search(spark, search_case, monkeypatch, most_terms):
    texts, ids, items = search_case
    monkeypatch.setattr(ranked_search, "MOST_TERMS", most_terms)
    monkeypatch.setattr(ranked_search, "MOST_CELLS", 3000)
    docs = documents(spark, texts, ids=ids).withColumn("score", F.lit("x")).repartition(3)
    got = searched(ranked_search.ranked_search(docs, spark.createDataFrame(items, "item_id bigint, text string")))
    assert got == plain_search(list(zip(ids, texts, strict=True)), items)


def test_ranked_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert ranked_search.ranked_search(spark.createDataFrame([], SCHEMA), items).count() == 0
    assert ranked_search.ranked_search(documents(spark, ["a b", None]), items.where("item_id > 1")).count() == 0
    assert ranked_search.ranked_search(documents(spark, [None, ""]), items).count() == 0


def test_sharing_graph_sums_each_query_once():
    rng = random.Random(1)
    common = [rng.sample(range(200), 8) for _ in range(6)]
    queries = [sorted({*rng.choice(common), *rng.choice(common), *rng.sample(range(200), rng.randint(1, 9))}) for _ in range(80)]
    queries += [queries[0], [5], [5], list(range(200))]
    graph = ranked_search.sharing_graph(queries, 200)
    for q, root in zip(queries, graph.roots, strict=True):
        assert sorted(graph.terms_of(root)) == sorted(q)
    assert all(part < node for node, parts in enumerate(graph.sums, 200) for part in parts)
    assert graph.additions() < 0.7 * sum(len(q) - 1 for q in queries)
    cells = np.array([[rng.randrange(10**9) for _ in range(7)] for _ in range(200)])
    assert (ranked_search.accumulate(graph, cells) == np.array([cells[q].sum(axis=0) for q in queries])).all()
