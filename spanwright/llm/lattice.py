"""Lattices of all ways to segment texts into vocabulary pieces, in numpy.

Many units of text are worked on at once: their characters stand in one array, an edge leads from a
position over a piece to a later one, and the recursions step through positions, all units abreast.
"""

from __future__ import annotations

import re

import numpy as np

SPACE = "▁"
#: Factor of the rolling hash of pieces, and bits and factor of the table that holds them.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BITS = 18
SPREAD = np.uint64(0xD6E8FEB86659FD93)


class Lattice:
    """Edges and recursions for a vocabulary of pieces; pieces like <0x41> stand for bytes."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        self.bytes = np.full(256, -1, np.int64)
        ids: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if re.fullmatch("<0x[0-9A-F]{2}>", p):
                self.bytes[int(p[3:5], 16)] = i
            elif p not in ("<unk>", "<s>", "</s>"):
                ids.setdefault(p, i)
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece has white space after another character; words can't be kept apart")
        known: dict[int, int] = {}
        for p, i in ids.items():
            h = 0
            for k, c in enumerate(p):
                h = (h * int(FACTOR) + ord(c) + 1) % 2**64
                if k + 1 < len(p):
                    known.setdefault(h, -1)
            known[h] = i
        self.longest = max(map(len, ids))
        self.hashes = np.zeros(1 << BITS, np.uint64)  # no prefix has hash 0
        self.ids = np.full(1 << BITS, -2, np.int32)
        self.probes = 1
        for h, i in known.items():
            at, n = (h * int(SPREAD)) % 2**64 >> (64 - BITS), 1
            while self.hashes[at]:
                at, n = (at + 1) % (1 << BITS), n + 1
            self.hashes[at], self.ids[at] = h, i
            self.probes = max(self.probes, n)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """A piece's id, -1 for the beginning of one, -2 for neither."""
        at = ((h * SPREAD) >> np.uint64(64 - BITS)).astype(np.int64)
        out = np.where(self.hashes[at] == h, self.ids[at], -2)
        left = np.flatnonzero((out == -2) & (self.hashes[at] != 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) % (1 << BITS)
            hit = self.hashes[at[left]] == h[left]
            out[left[hit]] = self.ids[at[left[hit]]]
            left = left[~hit & (self.hashes[at[left]] != 0)]
        return out

    def edges(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Edges of all texts: start and end nodes, piece (or -1 - code point), order of starts."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        ends = np.cumsum(lengths)
        stop = np.repeat(ends, lengths)
        owner = np.repeat(np.arange(len(texts)), lengths)
        at = np.arange(len(codes))
        h = codes + np.uint64(1)
        parts = []
        for k in range(1, self.longest + 1):
            found = self.lookup(h)
            hit = found >= 0
            parts.append((at[hit], np.full(hit.sum(), k), found[hit]))
            if k == 1:
                parts.append((at[~hit], np.ones((~hit).sum(), np.int64), -1 - codes[at[~hit]].astype(np.int64)))
            more = (found >= -1) & (at + k < stop[at])
            at, h = at[more], h[more] * FACTOR + codes[at[more] + k] + np.uint64(1)
            if not len(at):
                break
        start, length, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        step = start - (ends - lengths)[owner[start]]
        order = np.argsort(step.astype(np.int16) if step.size and step.max() < 2**15 else step, kind="stable")  # small numbers are sorted by radix
        start, length, piece, step = start[order], length[order], piece[order], step[order]
        return {"from": start + owner[start], "to": start + length + owner[start], "piece": piece, "step": step, "length": length, "first": ends - lengths + np.arange(len(texts)), "last": ends + np.arange(len(texts))}

    def weights(self, piece: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log weights of edges; a character without piece is spelt in bytes."""
        out = logp[np.maximum(piece, 0)]
        if (odd := np.flatnonzero(piece < 0)).size:
            chars, which = np.unique(-1 - piece[odd], return_inverse=True)
            out[odd] = np.array([logp[self.bytes[list(chr(c).encode("utf-8", "replace"))]].sum() for c in chars])[which]
        return out

    @staticmethod
    def forward(e: dict[str, np.ndarray], w: np.ndarray) -> np.ndarray:
        """Log weight of all ways from a text's start to each node."""
        alpha = np.full(e["last"][-1] + 1, -np.inf)
        alpha[e["first"]] = 0
        cuts = np.flatnonzero(np.diff(e["step"], prepend=-1, append=e["step"][-1] + 1))
        a, b = e["from"], e["to"]
        for i, j in zip(cuts, cuts[1:], strict=False):  # edges from one place lead to different nodes
            alpha[b[i:j]] = np.logaddexp(alpha[b[i:j]], alpha[a[i:j]] + w[i:j])
        return alpha

    def likelihood(self, texts: list[str], logp: np.ndarray) -> np.ndarray:
        """Natural log of each text's probability, over all segmentations."""
        if not texts:
            return np.zeros(0)
        e = self.edges(texts)
        return self.forward(e, self.weights(e["piece"], logp))[e["last"]]

    def expected(self, texts: list[str], counts: np.ndarray, logp: np.ndarray, whole: bool = False) -> np.ndarray:
        """How often each piece is expected in the texts, each text counting as often as told.

        With ``whole`` each edge's share is rounded, so that the sum is exact in any order.
        """
        out = np.zeros(len(self.pieces))
        if not texts:
            return out
        e = self.edges(texts)
        w = self.weights(e["piece"], logp)
        alpha = self.forward(e, w)
        beta = np.full(len(alpha), -np.inf)
        beta[e["last"]] = 0
        to_step = e["step"] + e["length"]
        order = np.argsort((-to_step).astype(np.int16) if to_step.max() < 2**15 else -to_step, kind="stable")
        a, b, v = e["from"][order], e["to"][order], w[order]
        steps = to_step[order]
        cuts = np.flatnonzero(np.diff(steps, prepend=steps[0] + 1, append=steps[-1] - 1))
        for i, j in zip(cuts, cuts[1:], strict=False):  # edges to one place come from different nodes
            beta[a[i:j]] = np.logaddexp(beta[a[i:j]], v[i:j] + beta[b[i:j]])
        owner = np.searchsorted(e["last"], e["from"])
        share = np.exp(alpha[e["from"]] + w + beta[e["to"]] - alpha[e["last"]][owner]) * counts[owner]
        if whole:
            share = np.round(share)
        real = e["piece"] >= 0
        out += np.bincount(e["piece"][real], share[real], len(out))
        for c, n in zip(-1 - e["piece"][~real], share[~real], strict=True):
            for b_ in chr(c).encode("utf-8", "replace"):
                out[self.bytes[b_]] += n
        return out
