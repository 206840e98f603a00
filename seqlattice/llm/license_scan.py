"""License scans: ordered signature rules, gated by keywords, with overlapping detections resolved.

Each text is read as its words in lower case.  The rules of ``license_rules`` stand in families; a family is tried on a text only
if the text holds a word of each of its groups of keywords, which leaves most texts without any pattern.  What the
patterns find is then resolved over the text: a detection goes if one of higher priority, or one of the same priority that is
longer or comes first, contains its interval.  The phrases that every scan looks for stay whatever contains them.

Rows are independent, so nothing is shuffled; the rules are the only thing sent to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import KINDS, Family, Rule, read_rules
from .words import pieces

#: Phrases that are always reported, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_BASE = [(label, re.compile(b"(?<= )" + phrase.encode() + b"(?= )")) for phrase, label in PHRASES]
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Upper to lower case, and every byte outside of words to a space.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))
HIT = pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(SPAN)), ("detections", pa.list_(HIT))])


def folded_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits and all other characters beyond ASCII; A-Z in lower case."""
    return text.encode().translate(_TO_WORDS).split() if text else []


class Hit(NamedTuple):
    start: int
    end: int
    priority: int
    rule: int


def resolve(hits: list[Hit]) -> list[Hit]:
    """The hits that no other one of more weight contains, by start.

    Containers come before what they contain in order of (start, -end); of equal intervals the one of more weight comes first.
    A hit goes if one of its priority or a higher one before it ends at its end or later.
    """
    reach: dict[int, int] = {}  # end of the last interval by priority
    kept = []
    for hit in sorted(set(hits), key=lambda h: (h.start, -h.end, -h.priority, h.rule)):
        if not any(priority >= hit.priority and end >= hit.end for priority, end in reach.items()):
            kept.append(hit)
        reach[hit.priority] = max(reach.get(hit.priority, 0), hit.end)
    return kept


@lru_cache(maxsize=1)
def _rules() -> tuple[list[Rule], list[Family], frozenset[bytes]]:
    rules, families = read_rules()
    # a family is worth a look only if its rarest group is there; all groups are asked, so any one of them serves as the first gate
    return rules, families, frozenset().union(*(min(f.gates, key=len) for f in families))


def scan(words: list[bytes]) -> tuple[list[tuple[str, int, int]], list[Hit]]:
    """Places of the phrases, and what the rules find, in words from 0 with exclusive ends."""
    rules, families, first = _rules()
    present = set(words)
    due = [n for f in families if all(not g.isdisjoint(present) for g in f.gates) for n in f.rules] if not first.isdisjoint(present) else []
    base_due = {b"mit", b"apache", b"cc"} & present
    if not due and not base_due:
        return [], []
    text = b" " + b" ".join(words) + b" "
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)

    def place(m: re.Match) -> tuple[int, int]:
        start, end = m.span(m.lastindex or 0)
        return int(np.searchsorted(spaces, start)) - 1, int(np.searchsorted(spaces, end))

    base = [(label, *place(m)) for label, pattern in _BASE for m in pattern.finditer(text)]
    hits = [Hit(*place(m), rules[n].priority, n) for n in due for m in rules[n].pattern.finditer(text)]
    return sorted(base, key=lambda b: b[1]), resolve(hits)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = _rules()[0]
    for rows in pieces(batches):
        counts, base, found = [], [], []
        for text in rows["text"]:
            words = folded_words(text)
            own, hits = scan(words)
            counts.append(len(words))
            base.append([{"label": label, "start": s, "end": e} for label, s, e in own])
            found.append([{"label": rules[h.rule].label, "kind": rules[h.rule].kind, "start": h.start, "end": h.end, "score": rules[h.rule].score} for h in hits])
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(counts, pa.int64()), pa.array(base, pa.list_(SPAN)), pa.array(found, pa.list_(HIT))], schema=SCHEMA)


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, base array<struct<label, start, end>>, detections array<struct<label, kind, start, end, score>>``.

    One row for each row; places are words from 0, ends are exclusive.  ``base`` has all places of the fixed phrases,
    ``detections`` what is left of the rules' finds once contained ones are gone.  Null and empty texts have no words; null
    ids, repeated rows and further columns are of no effect.  One text must fit a worker.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = "doc_id bigint, n_words bigint, base array<struct<label:string,start:bigint,end:bigint>>, detections array<struct<label:string,kind:string,start:bigint,end:bigint,score:double>>"
    return rows.mapInArrow(_scan, out)


def summary(found: DataFrame) -> DataFrame:
    """Number, first and last place of the phrases, their labels, all labels, and the score of the surest find (0 without any)."""
    base, all_labels = F.col("base.label"), F.concat(F.col("base.label"), F.col("detections.label"))
    shown = F.array_max(F.col("detections.score"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.col("base.start")).alias("first_word"),
        F.array_max(F.col("base.start")).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(all_labels)), ",").alias("labels"),
        F.greatest(F.coalesce(shown, F.lit(0.0)), F.when(F.size("base") > 0, F.lit(KINDS["title"][1])).otherwise(0.0)).alias("score"),
    )
