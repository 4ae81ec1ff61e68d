"""K-mers of many sequences at a time: digests of canonical ones, and hashes of those as they are.

Sequences of a batch are joined to one array of bytes, and its places are worked on in blocks that fit
a processor's cache. A character other than A, C, G and T is odd: k-mers with one go by plain Python.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np

from spanwright.functions.expr import BASES, COMPLEMENTS

#: Places worked on at a time; bases of sequences that are joined, of which a longer one is cut.
BLOCK, JOINED = 1 << 14, 1 << 20
#: K-mers of so many bases fit a number; longer ones go by plain Python.
LONGEST = 31
ODD = 4
CODES = np.full(256, ODD, np.uint8)
CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)
LETTERS = np.frombuffer(b"ACGT", np.uint8)
TURNED = str.maketrans(BASES, COMPLEMENTS)
#: Up to four bases as the bytes of a number, by their codes; the first base is the lowest byte.
QUADS = [np.array([sum(int(LETTERS[(x >> 2 * (r - 1 - i)) & 3]) << 8 * i for i in range(r)) for x in range(4**r)], np.uint32) for r in range(5)]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def pieces(seqs: Sequence[str], k: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Texts of JOINED characters in all, the sequences that they are of, and where they begin there. Pieces of one sequence overlap by k - 1."""
    texts, rows, at, held = [], [], [], 0
    for row, s in enumerate(seqs):
        for i in range(0, max(1, len(s) - k + 1), JOINED):
            text = s[i : i + JOINED + k - 1]
            if texts and held + len(text) > JOINED:
                yield texts, np.array(rows), np.array(at)
                texts, rows, at, held = [], [], [], 0
            texts.append(text)
            rows.append(row)
            at.append(i)
            held += len(text)
    if texts:
        yield texts, np.array(rows), np.array(at)


def digest_starts(words: list[np.ndarray | int]) -> np.ndarray:
    """The first four bytes of MD5 digests, as numbers, of texts that fit one block: its sixteen words."""
    n = next(len(w) for w in words if not isinstance(w, int))
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps leave these bytes alone
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        w = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
        f += a
        if isinstance(w, int):
            f += np.uint32((SINES[i] + w) & 0xFFFFFFFF)
        else:
            f += np.uint32(SINES[i])
            f += w
        s = TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - s), out=t)
        f <<= np.uint32(s)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return b + np.uint32(START[0])


def _message(canonical: np.ndarray, k: int) -> list[np.ndarray | int]:
    """The block of MD5 for k-mers given as codes of two bits a base."""
    words: list[np.ndarray | int] = [0] * 16
    for j in range(k // 4 + 1):
        r = min(4, k - 4 * j)
        codes = (canonical >> canonical.dtype.type(2 * (k - 4 * j - r))) & canonical.dtype.type(4**r - 1)
        words[j] = QUADS[r].take(codes) | np.uint32(0x80 << 8 * r if r < 4 else 0)
    words[14] = 8 * k
    return words


def _plain(kmer: str) -> tuple[bool, str, bool]:
    """Whether the digest of the canonical form begins with 0, that form, and whether the k-mer has it."""
    least = min(kmer, kmer.translate(TURNED)[::-1])
    return hashlib.md5(least.encode()).hexdigest()[0] == "0", least, least == kmer


def sketched(seqs: Sequence[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """Sequences, places from 1, k-mers and directions of the canonical k-mers whose MD5 digest begins with 0."""
    kind = np.uint32 if k <= 16 else np.uint64
    for texts, rows, begins in pieces(seqs, k):
        sizes = np.array([len(t) + 1 for t in texts])
        first = np.cumsum(sizes) - sizes
        joined = "\n".join(texts) + "\n"
        codes = CODES[np.frombuffer(joined.encode("latin-1", "replace"), np.uint8)]
        found: list[tuple[np.ndarray, list[str], np.ndarray]] = []
        for at in range(0, max(0, len(codes) - k), BLOCK):
            own = codes[at : at + BLOCK + k - 1]
            odd = np.concatenate([[0], np.cumsum(own == ODD)])
            clean = odd[k:] == odd[:-k]
            if k <= LONGEST:
                n = len(own) - k + 1
                forward, back = np.zeros(n, kind), np.zeros(n, kind)
                for i in range(k):
                    base = own[i : i + n].astype(kind) & kind(3)
                    forward = (forward << kind(2)) | base
                    back |= (kind(3) - base) << kind(2 * i)
                least = np.minimum(forward, back)
                hit = np.flatnonzero(clean & (digest_starts(_message(least, k)) & np.uint32(0xF0) == 0))
                letters = LETTERS[(least[hit, None] >> (2 * np.arange(k - 1, -1, -1)).astype(kind)) & kind(3)]
                found.append((at + hit, letters.tobytes().decode() if len(hit) else "", (forward <= back)[hit]))
                found[-1] = (at + hit, [found[-1][1][i : i + k] for i in range(0, len(hit) * k, k)], found[-1][2])
                clean = ~clean
            else:
                clean[:] = True
            rest = []
            for p in (at + np.flatnonzero(clean)).tolist():
                kmer = joined[p : p + k]
                if "\n" not in kmer:
                    good, least_text, same = _plain(kmer)
                    if good:
                        rest.append((p, least_text, same))
            if rest:
                found.append((np.array([r[0] for r in rest]), [r[1] for r in rest], np.array([r[2] for r in rest])))
        if found:
            place = np.concatenate([x[0] for x in found])
            text = np.searchsorted(first, place, side="right") - 1
            yield rows[text], begins[text] + place - first[text] + 1, [m for x in found for m in x[1]], np.concatenate([x[2] for x in found])


def _rolled(data: np.ndarray, i: int, n: int, width: int) -> np.ndarray:
    """Numbers of ``width`` bytes from place i on."""
    out = data[i : i + n].astype(np.uint64)
    for b in range(1, width):
        out |= data[i + b : i + b + n].astype(np.uint64) << np.uint64(8 * b)
    return out


def hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Signed 64-bit hashes of the k bytes from each place on: XXH64 with the seed 42, without its lanes for long texts."""
    out = np.empty(max(0, len(data) - k + 1), np.int64)
    turned = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    for at in range(0, len(out), BLOCK):
        own = data[at : at + BLOCK + k - 1]
        n = len(own) - k + 1
        h, i = np.full(n, (42 + int(P5) + k) % 2**64, np.uint64), 0
        while k - i >= 8:
            h = turned(h ^ (turned(_rolled(own, i, n, 8) * P2, 31) * P1), 27) * P1 + P4
            i += 8
        if k - i >= 4:
            h = turned(h ^ (_rolled(own, i, n, 4) * P1), 23) * P2 + P3
            i += 4
        for j in range(i, k):
            h = turned(h ^ (own[j : j + n].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[at : at + n] = (h ^ (h >> np.uint64(32))).view(np.int64)
    return out


def least_hashes(seqs: Sequence[str], k: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The hashes of the ``most`` k-mers of each sequence whose hashes are least, each once, with their first places from 1.

    Characters beyond ASCII count by their last eight bits.
    """
    out = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in seqs]
    for texts, rows, begins in pieces(seqs, k):
        data = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint8)
        all_hashes, first = hashes(data, k), 0
        for text, row, begin in zip(texts, rows.tolist(), begins.tolist(), strict=True):
            n = len(text) - k + 1
            if n > 0:
                own = all_hashes[first : first + n]
                at = np.argpartition(own, most - 1)[:most] if n > most else np.arange(n)
                at = np.flatnonzero(own <= own[at].max())  # with all of equal hashes
                h, place = np.concatenate([out[row][0], own[at]]), np.concatenate([out[row][1], at + begin + 1])
                order = np.lexsort((place, h))[:most]
                out[row] = h[order], place[order]
            first += len(text)
    for row, (h, place) in enumerate(out):
        once = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        out[row] = h[once], place[once]
    return out
