"""Edit distances of long texts, banded: only alignments near the diagonal are looked at, and the band grows until it holds the result.

A result that no alignment outside the band can be below is exact.
The plain distance goes a whole column of the band at a time in one integer, bit by bit in parallel; the masked one goes
over many pairs of similar length side by side, a row of all their bands at a time.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Diagonals of the first band at least.
FIRST_BAND = 32
#: Letters whose distance tells how wide the first band is, and what it is multiplied with; four times as many are not looked at so.
BEGINNING, MARGIN = 1024, 1.75
#: Columns for which the bits of the characters are cut out at once.
COLUMNS = 2048
#: Characters by which lengths may differ for a pair to be tried without insertions first.
STEPS = 4096
#: Classes of characters, and places, that bound the band of a masked pair.
KINDS, PLACES = 64, 2048
#: Cells of the bands of pairs that go side by side.
MOST_CELLS = 1 << 16
_FAR = np.int32(1 << 29)


def _whole(a: str, b: str, places: dict[str, int]) -> int:
    """Distance over all diagonals; ``places`` has a bit for each place of ``a`` by character."""
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0  # where the column rises and falls
    for ch in b:
        eq = places.get(ch, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(flat | up)), up & flat
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1) | 1, left << 1
        up, down = (left | ~(flat | right)) & full, right & flat & full
    return score


def _in_band(a: str, b: str, places: dict[str, int], below: int, above: int) -> int:
    """Least cost of the alignments that stay between ``above`` and ``below`` the main diagonal; ``a`` is the longer one, by ``below`` at
    most, and longer than ``below``."""
    width = below + above + 1
    full = (1 << width) - 1
    top, score, row = 1 << (width - 1), below, 1 << (width - 2)
    up, down = ((1 << (below + 1)) - 1) << above, 0
    rest = len(a) - below
    for first in range(0, len(b), COLUMNS):
        base, cut = first - above, (1 << (width + COLUMNS)) - 1
        near = {ch: ((bits >> base) if base >= 0 else (bits << -base)) & cut for ch, bits in places.items()}
        for j, ch in enumerate(b[first : first + COLUMNS], first):
            eq = (near.get(ch, 0) >> (j - first)) & full
            flat = (((eq & up) + up) ^ up) | eq | down
            right, left = down | (full & ~(flat | up)), flat & up
            if j < rest:  # along the lowest diagonal
                score += not flat & top
            else:  # along the last row
                score += bool(right & row) - bool(left & row)
                row >>= 1
            flat >>= 1
            up, down = left | (full & ~(flat | right)), flat & right
    return score


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _surplus(a: str, b: str) -> int:
    """Characters of ``a`` that have no equal in ``b``, by their counts."""
    return (Counter(a) - Counter(b)).total()


def _without_insertions(a: str, b: str) -> int:
    """Least cost of alignments that insert nothing into ``a``, the longer one, and leave its characters out rather evenly.

    They go from the main diagonal to the last one and never back, so all columns of a diagonal are done at once: the matches up to a
    column are those along the diagonal behind the best place to come from the one before.  Each diagonal is looked at some
    diagonals' share of columns around its own.
    """
    x, y = _points(a), _points(b)
    m, more = len(y), len(x) - len(y)
    share, aside = m / max(more, 1), int(2 * more**0.5) + 3
    best = np.full(m + 1, -m, np.int32)
    best[0] = 0
    for diagonal in range(more + 1):
        first, last = max(int((diagonal - aside) * share), 0), min(int((diagonal + aside) * share) + 1, m)
        along = np.cumsum(x[diagonal + first : diagonal + last] == y[first:last], dtype=np.int32)
        own = best[first + 1 : last + 1]
        own -= along
        np.maximum.accumulate(best[first : last + 1], out=best[first : last + 1])
        own += along
    return len(x) - int(best[m])


def edit_distance(a: str, b: str) -> int:
    """Unit-cost edit distance.

    An alignment that goes ``aside`` beyond the diagonals between both ends inserts as many characters at least, and leaves out as many
    more than the lengths differ by.  Besides its insertions it costs as many steps as ``a`` has characters that ``b`` lacks, so
    a result up to the larger of both bounds is exact.  Where no character need be inserted, that is known without a band
    (:func:`_without_insertions`).  The first band follows from the distance of the beginnings, and a
    result that is not exact tells how wide the next one must be.
    """
    if len(a) < len(b):
        a, b = b, a
    n = 0
    while n < len(b) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    n = 0
    while n < len(b) and a[len(a) - 1 - n] == b[len(b) - 1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not b:
        return len(a)
    more, least, aside = len(a) - len(b), _surplus(a, b), max(FIRST_BAND // 2, 1)
    if more < STEPS and _without_insertions(a, b) == least:
        return least
    points = _points(a)
    places = {chr(c): int.from_bytes(np.packbits(points == c, bitorder="little").tobytes(), "little") for c in np.unique(points).tolist()}
    if len(a) > 4 * BEGINNING:
        one, other = a[:BEGINNING], b[: max(BEGINNING * len(b) // len(a), 1)]
        seen = _whole(one, other, {ch: bits & ((1 << BEGINNING) - 1) for ch, bits in places.items()})
        share = MARGIN * len(a) / BEGINNING
        aside += min(int(share * (seen - _surplus(one, other))), max(int(share * seen) - more, 0) // 2)
    while 2 * aside + more < 0.7 * len(a):
        score = _in_band(a, b, places, more + aside, aside)
        if score <= max(least + aside, more + 2 * aside):
            return score
        enough = min(score - least, (score - more + 1) // 2)
        aside = enough if enough <= 4 * aside else 3 * aside
    return _whole(a, b, places)


@F.pandas_udf(LongType())
def edit_distances(a: pd.Series, b: pd.Series) -> pd.Series:
    """Column function: distances of whole texts; null where one is null."""
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def masked_in_bands(pairs: list[tuple[str, np.ndarray, str]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least costs of pairs ``reference, clear, hypothesis`` and the hits along the preferred alignments, exact where no alignment of
    least cost leaves the band, as of cost ``k`` or less.

    A cell of the table is reached along the diagonal, by leaving out a character of the reference (free where it is unclear) or by
    inserting; ties prefer them in that order, and the hits, the matched unclear characters, go the same way, as that choice
    does not depend on the way taken later.  A row of the table holds the cells from ``low`` diagonals below the main one to
    ``k`` above.
    """
    n, m = (np.array([len(p[i]) for p in pairs]) for i in (0, 2))
    low, rows = k + max(int((n - m).max()), 0), int(n.max())
    width = low + k + 1
    # a cell is one number: its cost on top, then the way it was reached, then its hits
    for_hits, for_way = (rows + 1).bit_length(), (width + 1).bit_length()
    top = for_hits + for_way
    if top + (2 * (rows + int(m.max()) + width)).bit_length() > 62:
        raise ValueError(f"a text of {rows} characters is too long")
    one, left_out, far = 1 << top, 1 << for_hits, (rows + int(m.max()) + width) << top
    reference = np.zeros((len(pairs), rows + 1), np.uint32)
    gain, drop = np.full((len(pairs), rows + 1), -one), np.full((len(pairs), rows + 1), left_out)
    other = np.full((len(pairs), rows + low + width + int(m.max()) + 1), 0xFFFFFFFF, np.uint32)
    for i, (ref, flags, hyp) in enumerate(pairs):
        reference[i, : len(ref)] = _points(ref)
        gain[i, : len(ref)] += ~flags
        drop[i, : len(ref)] -= one * ~flags
        other[i, low : low + len(hyp)] = _points(hyp)
    place = np.arange(width, dtype=np.int64)
    # inserting adds one a cell; an inserted character comes from the last cell before it that was not reached so
    before, behind = one - place * one + ((width - place) << for_hits), place * one
    state = np.broadcast_to(np.where(place >= low, (place - low) * one, far), (len(pairs), width)).copy()
    best, spare, same = np.zeros_like(state), np.zeros_like(state), np.zeros(state.shape, bool)
    costs, found = np.full(len(pairs), int(_FAR)), np.zeros(len(pairs), np.int64)
    last = m - n + low  # where the lower right cell of a pair stands in its last row
    ends = set(n.tolist())

    def end(row: int) -> None:
        done = np.flatnonzero((n == row) & (last >= 0) & (last < width))
        cells = state[done, last[done]]
        costs[done], found[done] = cells >> top, cells & ((1 << for_hits) - 1)

    end(0)
    for row in range(1, rows + 1):
        # costs are less by one up to the sum with ``before``
        np.equal(other[:, row - 1 : row - 1 + width], reference[:, row - 1 : row], out=same)
        np.multiply(same, gain[:, row - 1 : row], out=best)
        np.add(best, state, out=best)
        np.add(state[:, 1:], drop[:, row - 1 : row], out=spare[:, 1:])
        np.minimum(best[:, :-1], spare[:, 1:], out=best[:, :-1])
        np.bitwise_and(best, ~left_out, out=best)
        if row <= low:  # in front of the hypothesis; cells behind its end never lead back
            best[:, : low - row] = far
        np.add(best, before, out=best)
        np.minimum.accumulate(best, axis=1, out=best)
        np.bitwise_and(best, ~(one - left_out), out=best)
        np.add(best, behind, out=state)
        if row in ends:
            end(row)
    return costs, found


def masked_band(ref: str, hyp: str, bound: int) -> int:
    """A ``k`` for :func:`masked_in_bands` that holds all alignments of cost ``bound`` or less.

    Each character of the hypothesis that the reference lacks costs one, in front of a cell of the table as behind it, so no such
    alignment crosses a diagonal all of whose cells have more in sum.  Characters are counted by class, and cells are looked at
    in steps; a step changes either sum by one at most.
    """
    n, m = len(ref), len(hyp)
    if not n + m:
        return bound
    x, y = _points(ref) % KINDS, _points(hyp) % KINDS
    kinds = np.unique(np.r_[x, y])
    have, want = (np.array([np.r_[0, np.cumsum(z == c)] for c in kinds], np.int32) for z in (x, y))
    every = (want[:, -1] - have[:, -1])[:, None]
    step = 1 + max(n, m) // PLACES

    def closed(diagonal: int) -> bool:
        """Whether no alignment crosses the cells ``i, i + diagonal``."""
        i = np.arange(max(0, -diagonal), min(n, m - diagonal) + 1)[:: step]
        if not len(i):
            return True
        before = want[:, i + diagonal] - have[:, i]
        least = np.maximum(before, 0).sum(0) + np.maximum(every - before, 0).sum(0)
        return int(least.min()) - 2 * (step - 1) > bound

    open_, k = 0, bound
    while k - open_ > max(4, k // 8):
        middle = (open_ + k) // 2
        if closed(middle + 1) and closed(-middle - max(n - m, 0) - 1):
            k = middle
        else:
            open_ = middle
    return k


def masked_many(pairs: list[tuple[str, np.ndarray, str]]) -> list[tuple[int, int]]:
    """Cost and hits of all pairs, those of similar length side by side.

    Leaving characters out for free only lowers a cost, so the plain distance of a pair bounds it (see :func:`masked_band`).
    """
    bound = [masked_band(ref, hyp, edit_distance(hyp, ref)) for ref, _, hyp in pairs]
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), bound[i]))
    start = 0
    while start < len(order):
        band = wide = 0
        for end in range(start, len(order)):
            ref, _, hyp = pairs[order[end]]
            most = max(band, bound[order[end]], 1)
            over = max(wide, len(ref) - len(hyp), 0)
            if end > start and ((end + 1 - start) * (2 * most + over + 1) > MOST_CELLS or most > 2 * band or len(ref) > 1.5 * len(pairs[order[start]][0]) + 64):
                break
            band, wide = most, over
        else:
            end = len(order)
        own = order[start:end]
        costs, hits = masked_in_bands([pairs[i] for i in own], band)
        for i, cost, hit in zip(own, costs.tolist(), hits.tolist(), strict=True):
            out[i] = (cost, hit)
        start = end
    return out
