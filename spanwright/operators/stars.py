"""Star alignments of stacks: each sequence is aligned to the centre of its unit, and gap columns are merged by a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators import alignment
from spanwright.operators.skew import even_join
from spanwright.session import Tables, small_batches

#: So few units are broadcast with their centres; more are joined by their keys.
FEW = 1000
#: Bytes of aligned rows that a task makes at once.
MADE = 4_000_000
#: Bytes of sums that a task holds before it hands them on.
SUMS = 64_000_000


def _of_unit(rows: DataFrame, units: DataFrame, keys: list[str], n_units: int, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(units), keys, how) if n_units <= FEW else even_join(rows, units, keys, how)


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists, and the row of each."""
    lists = batch.column(name)
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _columns(gaps: str, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The columns of a centre's n bases, those where gaps before its places begin, and the number of columns."""
    widths = np.zeros(n + 1, np.int64)
    if gaps:
        at, width = np.array([x.split(":") for x in gaps.split(",")], np.int64).T
        widths[at] = width
    ends = np.arange(n + 1) + np.cumsum(widths)
    return ends[:n], ends - widths, int(n + widths.sum())


def star_pieces(stacks: DataFrame, keys: list[str], band: int) -> DataFrame:
    """``stacks`` with their alignments to the centres: ``_kept``, what is inserted (``_at``, ``_width``, ``_bases``), and the unit's ``_gaps``."""
    small_batches(stacks.sparkSession)
    kept = Tables(stacks.sparkSession)
    rows = kept.keep(stacks.withColumn("seq", F.coalesce("seq", F.lit(""))))
    first = F.struct(F.length("seq").alias("size"), (-F.col("ord")).alias("early"))
    centres = kept.keep(rows.groupBy(*keys).agg(F.max_by("seq", first).alias("_centre")))
    n_units = centres.count()
    names = rows.columns

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            a, b = ([s.encode() for s in whole.column(c).to_pylist()] for c in ("_centre", "seq"))
            for at, found in alignment.gapped_batches(a, b, band):
                batch = whole.take(pa.array(at))
                ends = np.cumsum([0, *(len(a[i]) for i in at.tolist())])
                runs = np.searchsorted(found.row, np.arange(len(at) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pa.array(x, pa.int32())) for x in (found.place, found.width)]
                bases = np.concatenate([[0], np.cumsum(found.width)])[runs]
                texts = [pa.array([t[i:j] for i, j in zip(e, e[1:])], pa.string()) for t, e in ((found.text.decode("latin-1"), ends.tolist()), (found.bases.decode("latin-1"), bases.tolist()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts[0], *lists, texts[1]], [*names, "_kept", "_at", "_width", "_bases"])

    joined = _of_unit(rows, centres, keys, n_units).select(*names, "_centre")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", _kept string, _at array<int>, _width array<int>, _bases string"
    pieces = kept.keep(joined.mapInArrow(aligned, schema))
    wide = pieces.select(*keys, F.explode(F.arrays_zip("_at", "_width")).alias("x")).groupBy(*keys, F.col("x._at").alias("at")).agg(F.max("x._width").alias("width"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("at", "width"))), lambda g: F.concat(g["at"].cast("string"), F.lit(":"), g["width"].cast("string")))
    wide = kept.keep(wide.groupBy(*keys).agg(F.array_join(pairs, ",").alias("_gaps")))
    return _of_unit(pieces, wide, keys, n_units, "left").withColumn("_gaps", F.coalesce("_gaps", F.lit("")))


def _laid_out(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch of pieces that are of one unit, and their characters by column, of MADE bytes at most."""
    kept = [s.encode("latin-1") for s in batch.column("_kept").to_pylist()]
    bases = np.frombuffer("".join(batch.column("_bases").to_pylist()).encode("latin-1"), np.uint8)
    (at, row), (width, _) = _flat(batch, "_at"), _flat(batch, "_width")
    begins = np.cumsum(width) - width
    units: dict[tuple[str, int], list[int]] = {}
    for i, (gaps, text) in enumerate(zip(batch.column("_gaps").to_pylist(), kept, strict=True)):
        units.setdefault((gaps, len(text)), []).append(i)
    for (gaps, n), members in units.items():
        own, starts, size = _columns(gaps, n)
        together = max(1, MADE // max(1, size))
        for i in range(0, len(members), together):
            rows = np.array(members[i : i + together])
            out = np.full((len(rows), size), ord("-"), np.uint8)
            out[:, own] = np.frombuffer(b"".join(kept[r] for r in rows.tolist()), np.uint8).reshape(len(rows), n)
            line = np.full(batch.num_rows, -1)
            line[rows] = np.arange(len(rows))
            runs = np.flatnonzero(line[row] >= 0)
            if len(runs):
                within = np.arange(width[runs].sum()) - np.repeat(np.cumsum(width[runs]) - width[runs], width[runs])
                out[np.repeat(line[row[runs]], width[runs]), np.repeat(starts[at[runs]], width[runs]) + within] = bases[np.repeat(begins[runs], width[runs]) + within]
            yield rows, out


def star_alignment(stacks: DataFrame, keys: list[str], band: int = alignment.BAND) -> DataFrame:
    """``stacks`` (``keys``, ``ord``, ``seq`` and more) with gaps in ``seq``, so that all of a unit have one width.

    A unit's centre is its longest sequence, the least ``ord`` of equals; others are aligned to it within ``band``
    diagonals around those between their ends. A gap column stands wherever any sequence has a base between two of the
    centre, as wide as the widest of these. Rows of a unit are aligned by many tasks; a unit's gap columns, at most one more than
    its centre's bases, are added up before they meet. Empty and null sequences become all gaps.
    Aligned rows are much longer than raw ones in deep units, so they are made where they are read and not kept.
    """
    names = stacks.columns

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, out in _laid_out(batch):
                size = out.shape[1]
                text = out.tobytes().decode("latin-1")
                seqs = pa.array([text[i * size : (i + 1) * size] for i in range(len(rows))], pa.string())
                some = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([seqs if c == "seq" else some.column(c) for c in names], names)

    pieces = star_pieces(stacks, keys, band)
    return pieces.mapInArrow(whole, ", ".join(f"`{c}` {t}" for c, t in stacks.dtypes))


def aligned_counts(stacks: DataFrame, keys: list[str], band: int = alignment.BAND) -> DataFrame:
    """``keys, col, base, n, first`` of ``star_alignment``'s rows: how many have a character in a column, and the least ``ord`` of these.

    Columns count from 0. A task adds up its rows by arrays, so what is moved is bounded by columns and characters, not by rows.
    """
    pieces = star_pieces(stacks, keys, band)
    types = dict(stacks.dtypes)

    def added(units: dict) -> Iterator[pa.RecordBatch]:
        for row, sums in units.values():
            for base, (n, first) in sums.items():
                cols = np.flatnonzero(n)
                unit = row.take(pa.array(np.zeros(len(cols), np.int64)))
                yield pa.RecordBatch.from_arrays([*unit.columns, pa.array(cols, pa.int32()), pa.array([chr(base)] * len(cols), pa.string()), pa.array(n[cols]), pa.array(first[cols])], [*keys, "col", "base", "n", "first"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: dict[tuple, tuple[pa.RecordBatch, dict]] = {}
        held = 0
        for whole in batches:
            members: dict[tuple, list[int]] = {}
            for i, name in enumerate(zip(*(whole.column(c).to_pylist() for c in keys), strict=True)):
                members.setdefault(name, []).append(i)
            for name, own in members.items():
                batch = whole.take(pa.array(own))
                ords = pc.fill_null(batch.column("ord"), 2**63 - 1).to_numpy()
                batch, ords = batch.take(pa.array(np.argsort(ords, kind="stable"))), np.sort(ords)
                bases = "".join({*"-", *"".join(batch.column("_kept").to_pylist()), *"".join(batch.column("_bases").to_pylist())}).encode("latin-1")
                _, sums = units.setdefault(name, (batch.select(keys).slice(0, 1), {}))
                for rows, out in _laid_out(batch):
                    for base in bases:
                        there = out == base
                        n, first = there.sum(axis=0), ords[rows][there.argmax(axis=0)]
                        if base in sums:
                            n_before, first_before = sums[base]
                            first = np.where(n > 0, np.minimum(first, np.where(n_before > 0, first_before, first)), first_before)
                            n = n + n_before
                        else:
                            held += n.nbytes + first.nbytes
                        sums[base] = n, first
            if held > SUMS:
                yield from added(units)
                units, held = {}, 0
        yield from added(units)

    pieces = pieces.select(*keys, F.col("ord").cast("long").alias("ord"), "_kept", "_at", "_width", "_bases", "_gaps")
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", col int, base string, n long, first long"
    return pieces.mapInArrow(work, schema).groupBy(*keys, "col", "base").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
