"""Alignments of pairs of sequences within a band of diagonals, many pairs at a time.

A match scores 1, a mismatch and each gap -1. Scores are packed with what is asked of the best alignment,
so one array holds all of it: of equal scores the one with more matches counts, and of these the one
that starts on the larger diagonal. A row of the tables is worked on for all pairs of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Diagonals to each side of the one that an alignment is sought along.
BAND = 16
#: Bits of the diagonal and of the matches below the score.
DIAGONAL_BITS, MATCH_BITS = 7, 26
ONE = 1 << (DIAGONAL_BITS + MATCH_BITS)
MATCH, MISS = ONE + (1 << DIAGONAL_BITS), -ONE
NEVER = -(1 << 61)
#: Bytes of sequences that are aligned at once; one longer pair is aligned alone.
BATCH_BYTES = 1_000_000
#: Bytes of pairs that are gathered from Arrow batches before they are aligned.
GATHERED = 16_000_000


def batches(lengths: Sequence[int], most: int = BATCH_BYTES) -> Iterator[np.ndarray]:
    """Places of pairs of about equal length, of ``most`` bytes when all are padded to the longest."""
    order, at = np.argsort(lengths, kind="stable"), 0
    for n in range(1, len(order) + 1):
        if n == len(order) or (n - at + 1) * int(lengths[order[n]]) > most:
            yield order[at:n]
            at = n


def _rows(seqs: Sequence[bytes], shift: np.ndarray, width: int, fill: int) -> np.ndarray:
    """Sequences as rows of bytes; byte t of a row is byte t + shift of its sequence."""
    out = np.full((len(seqs), width), fill, np.uint8)
    for row, s, d in zip(out, seqs, shift.tolist(), strict=True):
        data = np.frombuffer(s, np.uint8)[max(0, d) : max(0, d + width)]
        row[max(0, -d) : max(0, -d) + len(data)] = data
    return out


def may_agree(a: Sequence[bytes], b: Sequence[bytes], diagonal: Sequence[int], identity: float, coverage: float, band: int = BAND) -> np.ndarray:
    """False for pairs that have no alignment in the band with ``identity`` percent of equal columns and ``coverage`` percent of either.

    Such an alignment has at least as many columns as ``coverage`` asks of the longer sequence, and each column that differs
    spoils q of its runs of q equal ones at most. The runs that are left begin at different places of a, each on a diagonal of
    the band; a pair with fewer places than that is told apart without an alignment.
    """
    wrong = 1 - identity / 100
    q = min(12, max(1, int(0.75 / wrong))) if wrong > 0 else 12
    least = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)]) * (coverage / 100) * (1 - q * wrong) - q + 1
    out = np.ones(len(a), bool)
    if identity <= 0 or 1 - q * wrong <= 0:
        return out
    sizes = np.array([len(x) + 2 * band + q for x in a], np.int64)
    for at in batches(sizes):
        own = sizes[at]
        first = np.cumsum(own) - own
        left, right = np.zeros(own.sum(), np.uint8), np.ones(own.sum() + 2 * band, np.uint8)
        for i, begin, width in zip(at.tolist(), first.tolist(), own.tolist(), strict=True):
            left[begin : begin + len(a[i])] = np.frombuffer(a[i], np.uint8)
            right[begin : begin + width] = _rows([b[i]], np.array([diagonal[i] - band]), width, 1)[0]
        seen = np.zeros(len(left), bool)
        for begin in range(0, len(left), 1 << 16):
            x = left[begin : begin + (1 << 16) + q - 1]
            for k in range(2 * band + 1):
                run, n = x == right[begin + k : begin + k + len(x)], 1
                while n < q:
                    step = min(n, q - n)
                    run, n = run[: len(run) - step] & run[step:], n + step
                seen[begin : begin + len(run)] |= run
        out[at] = np.add.reduceat(seen, first, dtype=np.int64) >= least[at] - 1e-6
    return out


def overlaps(a: Sequence[bytes], b: Sequence[bytes], diagonal: Sequence[int], band: int = BAND) -> dict[str, np.ndarray]:
    """The best alignment of each pair in the band around a diagonal (place in b less place in a), ends free.

    It starts where either sequence starts and ends where either ends: ``columns`` with ``matches`` in them, and the
    bases ``span_a``, ``span_b`` that it takes of each. All are 0 where the band meets no pair of bases.
    """
    out = {k: np.zeros(len(a), np.int64) for k in ("columns", "matches", "span_a", "span_b")}
    sizes = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    for at in batches(sizes, GATHERED):
        for k, v in _overlaps([a[i] for i in at], [b[i] for i in at], np.asarray(diagonal, np.int64)[at], band).items():
            out[k][at] = v
    return out


def _overlaps(a: list[bytes], b: list[bytes], diagonal: np.ndarray, band: int) -> dict[str, np.ndarray]:
    order = np.argsort([len(x) for x in a], kind="stable")
    a, b, diagonal = [a[i] for i in order], [b[i] for i in order], diagonal[order]
    la, lb = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    k = np.arange(2 * band + 1)
    top = int(la[-1]) if len(la) else 0
    zero = np.zeros(len(a), np.int64)
    bases_a = _rows(a, zero, top + 1, 0)
    bases_b = _rows(b, diagonal - band - 1, top + len(k) + 1, 1)
    first = diagonal[:, None] + k - band  # j of row 0
    start = np.broadcast_to(k.astype(np.int64), first.shape)
    v = np.where((first >= 0) & (first <= lb[:, None]), start, NEVER)
    best = np.full((len(a), 3), NEVER, np.int64)  # value, i, k

    def ended(rows: slice, value: np.ndarray, i: int) -> None:
        at = value.argmax(1)
        top_value = value[np.arange(len(value)), at]
        better = top_value > best[rows, 0]
        best[rows] = np.where(better[:, None], np.stack([top_value, np.full_like(at, i), at], 1), best[rows])

    live = 0
    slope = -MISS * k
    for i in range(top + 1):
        rows = slice(live, None)
        j = first[rows] + i
        if i:
            same = bases_a[rows, i - 1 : i] == bases_b[rows, i : i + len(k)]
            t = v[rows] + np.where(same, MATCH, MISS)
            t[:, :-1] = np.maximum(t[:, :-1], v[rows, 1:] + MISS)
            t = np.where(j == 0, start[rows], np.where(j < 0, NEVER, t))
            t = np.maximum.accumulate(t + slope, axis=1) - slope
            v[rows] = np.where(j > lb[rows, None], NEVER, t)
        at_end = (j == lb[rows, None]).any(1)
        if at_end.any():
            ended(rows, np.where(j == lb[rows, None], v[rows], NEVER), i)
        done = int(np.searchsorted(la, i, side="right"))
        if done > live:
            ended(slice(live, done), v[live:done], i)
            live = done
    value = np.where(best[:, 0] > NEVER // 2, best[:, 0], band)
    score, low = np.divmod(value, ONE)
    matches, k0 = np.divmod(low, 1 << DIAGONAL_BITS)
    d0 = diagonal + k0 - band
    found = best[:, 0] > NEVER // 2
    end_i, end_j = best[:, 1], best[:, 1] + diagonal + best[:, 2] - band
    result = {"columns": 2 * matches - score, "matches": matches, "span_a": end_i - np.maximum(0, -d0), "span_b": end_j - np.maximum(0, d0)}
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return {n: np.where(found, x, 0)[back] for n, x in result.items()}


@dataclass
class Gapped:
    """Alignments from end to end: ``text`` has a character or ``-`` for each base of the centres, one after the other.

    What is inserted are runs: ``row`` and ``place`` (before that base of the centre), ``width``, and the ``bases`` of all.
    """

    text: bytes
    row: np.ndarray
    place: np.ndarray
    width: np.ndarray
    bases: bytes


def gapped(centre: Sequence[bytes], other: Sequence[bytes], band: int) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """Each ``other`` aligned to its ``centre`` from end to end: a character or ``-`` for each base of the centre, and what is inserted before its places."""
    out: list = [None] * len(centre)
    for at, found in gapped_batches(centre, other, band):
        ends = np.cumsum([0, *(len(centre[i]) for i in at.tolist())]).tolist()
        more: list[list[tuple[int, str]]] = [[] for _ in at]
        begin = 0
        for row, place, width in zip(found.row.tolist(), found.place.tolist(), found.width.tolist(), strict=True):
            more[row].append((place, found.bases[begin : begin + width].decode("latin-1")))
            begin += width
        for n, i in enumerate(at.tolist()):
            out[i] = (found.text[ends[n] : ends[n + 1]].decode("latin-1"), more[n])
    yield from out


def gapped_batches(centre: Sequence[bytes], other: Sequence[bytes], band: int) -> Iterator[tuple[np.ndarray, Gapped]]:
    """Places of pairs, and their alignments in a band around the diagonals between both ends, so lengths may differ by any number.

    Of equal alignments the one with pairs rather than gaps, seen from the end, counts.
    """
    sizes = np.array([(len(x) + 1) * (2 * band + abs(len(x) - len(y)) + 1) for x, y in zip(centre, other, strict=True)], np.int64)
    for at in batches(sizes, 8 * BATCH_BYTES):
        yield at, _gapped([centre[i] for i in at], [other[i] for i in at], band)


def _gapped(a: list[bytes], b: list[bytes], band: int) -> Gapped:
    la, lb = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    low = np.minimum(0, lb - la) - band
    widths = np.maximum(0, lb - la) + band - low + 1
    width, top, n = int(widths.max()), int(la.max()), len(a)
    kind = np.int16 if top + int(lb.max()) + 2 * width < 8000 else np.int32
    never = kind(-(1 << 14) if kind is np.int16 else -(1 << 29))
    bases_a = _rows(a, np.zeros(n, np.int64), top + 1, 0)
    bases_b = _rows(b, low - 1, top + width + 1, 1)
    k = np.arange(width)
    j = (low[:, None] + k).astype(np.int32)
    beyond = k >= widths[:, None]  # another pair's band is wider
    last = lb[:, None].astype(np.int32)
    # Scores are held with k added, so that going along a row costs nothing
    v = np.where((j >= 0) & (j <= last) & ~beyond, k - j, never).astype(kind)
    came = np.empty((top + 1, n, width), np.uint8)  # 0 pair, 1 centre alone, 2 other alone, 3 the start
    came[0] = 2
    came[0, np.arange(n), -low] = 3
    alone, moved = np.full_like(v, never), np.empty_like(v)
    for i in range(1, top + 1):
        j += 1
        pair = (bases_a[:, i - 1 : i] == bases_b[:, i : i + width]).astype(kind)
        pair += pair
        pair -= kind(1)
        pair += v
        np.subtract(v[:, 1:], kind(2), out=alone[:, :-1])
        outside = (j < 0) | (j > last) | beyond
        pair[j <= 0] = never
        t = np.maximum(pair, alone)
        t[outside] = never
        best, step = t.copy(), 1
        while step < width:
            moved[:, step:] = best[:, :-step]
            np.maximum(best[:, step:], moved[:, step:], out=best[:, step:])
            step *= 2
        best[outside] = never
        how = (t != pair).view(np.uint8)
        how[best > t] = 2
        came[i] = how
        v = best
    flat, at = came.reshape(-1), (la * n + np.arange(n)) * width + (lb - la - low)
    back = np.array([n * width, n * width - 1, 1, 0])
    steps = []
    while True:
        how = flat.take(at)
        if how.min() == 3:
            break
        steps.append(how)
        at -= back.take(how)
    taken = np.array(steps[::-1], np.uint8).reshape(len(steps), n).T
    held, inserted = taken <= 1, taken == 2
    of_b = (taken == 0) | inserted
    # Bases of the others in their order: each that is taken is the next one of its row
    text = np.full(taken.shape, ord("-"), np.uint8)
    text[of_b] = np.frombuffer(b"".join(b), np.uint8)
    row, column = np.nonzero(inserted)
    place = np.cumsum(held, axis=1)[row, column] if len(row) else row
    fresh = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])])[: len(row)])
    return Gapped(text[held].tobytes(), row[fresh], place[fresh], np.diff(np.append(fresh, len(row))), text[inserted].tobytes())
