"""Word splitting and rolling hashes over Arrow batches, shared by the operators on word sequences.

A word is a maximal run of characters other than ASCII white space (``[^\\x20\\x09-\\x0D]+``); ``bytes.split``
cuts UTF-8 at exactly these six bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc

MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; a null has none."""
    return text.encode().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts``, one text after the other, and each text's number of words."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = words_of(text)
        counts[i] = len(own)
        words += own
    if not words:
        return np.zeros(0, np.uint64), counts
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False), counts


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive entries; the caller drops those that cross a text's end."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += hashes[j : j + n] * np.uint64(pow(MULTIPLIER, j, 1 << 64))
    return mix(out)


def pieces(batches: Iterator, most_bytes: int = 4_000_000) -> Iterator[dict[str, list]]:
    """Columns of whole rows in portions of about ``most_bytes`` UTF-8 bytes of the column ``text``.

    A portion ends after the row that reaches the bound, so a single longer text is a portion of its own.  Batches are cut
    before their rows become Python objects, so no more than a portion of them is held at once.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        filled = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = int(filled[start - 1]) if start else 0
            end = min(int(np.searchsorted(filled, before + most_bytes)) + 1, batch.num_rows)
            part = batch.slice(start, end - start)
            yield {name: part.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            start = end
