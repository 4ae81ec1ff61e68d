"""Every place of many short patterns in sequences, on both strands, by one bit-parallel automaton (Shift-And)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.alignment import batches

#: Ends of elements that the literature names, by gene type. Capitals but N must match; all else is any base.
END_PATTERNS = {
    "DDE_Tnp_IS1": ["GGnnnTG"],
    "DDE_Tnp_IS1595": ["GGCnnTG", "CGCTCTT", "GGGgctg", "CcTGATT", "nnnGcnTATC", "ggnnatTAT", "CGGnnTT"],
    "DDE_Tnp_IS66": ["GTAA"],
    "DDE_Tnp_ISL3": ["GG"],
    "DDE_Tnp_Tn3": ["GGGG"],
    "DDE_Tnp_ISAZ013": ["Gagg", "GaaG"],
}
#: So many patterns are held at most: they are read on the driver and sent to each task.
MOST = 10_000
OTHER = str.maketrans("ACGTN", "TGCAN")


def needed(pattern: str) -> str:
    """The characters that must match, and dots."""
    return "".join(c if c.isupper() and c != "N" else "." for c in pattern)


class Automaton:
    """A bit for each character of each pattern, in words of 64 bits; patterns of the other strand are turned round."""

    def __init__(self, patterns: list[tuple[str | None, str]]) -> None:
        self.ends: list[tuple[str | None, str, str, int, int]] = []  # type, pattern, strand, word, bit of the last character
        table, first, used = [np.zeros(256, np.uint64)], [0], 0
        for kind, pattern in patterns:
            for strand, text in (("+", needed(pattern)), ("-", needed(pattern).translate(OTHER)[::-1])):
                if not 0 < len(text) <= 64:
                    raise ValueError("a pattern has 1 to 64 characters")
                if used + len(text) > 64:
                    table.append(np.zeros(256, np.uint64))
                    first.append(0)
                    used = 0
                for i, c in enumerate(text):
                    codes = slice(None) if c == "." else ord(c)
                    table[-1][codes] |= np.uint64(1 << (used + i))
                first[-1] |= 1 << used
                used += len(text)
                self.ends.append((kind, pattern, strand, len(table) - 1, used - 1))
        table[0][0] = 0
        self.table, self.first = np.array(table), np.array(first, np.uint64)
        self.table[:, 0] = 0  # behind the end of a sequence

    def places(self, kinds: list[str | None], seqs: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """Sequence, pattern's number in ``ends`` and the place of its first character, from 0."""
        for at in batches([len(s) for s in seqs]):
            width = max(len(seqs[i]) for i in at)
            codes = np.zeros((len(at), width), np.uint8)
            for row, i in zip(codes, at, strict=True):
                row[: len(seqs[i])] = np.frombuffer(seqs[i], np.uint8)
            own = np.zeros((len(at), len(self.first)), np.uint64)
            for kind, _, _, word, bit in self.ends:
                own[[kinds[i] == kind for i in at], word] |= np.uint64(1 << bit)
            state = np.zeros_like(own)
            for j in range(width):
                state = ((state << np.uint64(1)) | self.first) & self.table[:, codes[:, j]].T
                if (hit := state & own).any():
                    for e, (kind, pattern, _, word, bit) in enumerate(self.ends):
                        for row in np.flatnonzero(hit[:, word] & np.uint64(1 << bit)):
                            if kinds[at[row]] == kind:
                                yield int(at[row]), e, j - len(pattern) + 1


def motif_places(seqs: DataFrame, patterns: DataFrame, id: str = "id", kind: str = "rec_type", seq: str = "seq") -> DataFrame:
    """``id, pattern, strand, start`` of every place where a pattern of the row's own type occurs; overlapping ones too.

    ``patterns`` has ``kind, pattern``, MOST rows at most. Places count from 0 along the sequence as it stands; ``-`` means that
    its reverse complement matches there. Null types and sequences have no place; case of sequences doesn't count.
    """
    listed = [tuple(r) for r in patterns.where(F.col(kind).isNotNull() & (F.length("pattern") > 0)).select(kind, "pattern").distinct().limit(MOST + 1).collect()]
    if len(listed) > MOST:
        raise ValueError(f"more than {MOST} patterns")
    rows = seqs.where(F.col(kind).isNotNull() & F.col(seq).isNotNull()).select(F.col(id).alias("id"), F.col(kind).cast("string").alias("kind"), F.upper(seq).alias("seq"))
    id_type = dict(rows.dtypes)["id"]
    listed.sort()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(listed) if listed else None
        for b in parts:
            texts = [s.encode("ascii", "replace") for s in b.column("seq").to_pylist()]
            found = list(automaton.places(b.column("kind").to_pylist(), texts)) if automaton else []
            at = pa.array([f[0] for f in found], pa.int64())
            ends = [automaton.ends[f[1]] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array([e[1] for e in ends], pa.string()), pa.array([e[2] for e in ends], pa.string()), pa.array([f[2] for f in found], pa.int64())], ["id", "pattern", "strand", "start"])

    return rows.mapInArrow(run, f"id {id_type}, pattern string, strand string, start bigint").withColumnRenamed("id", id)
