"""Profiles of star alignments beside those of the aligned rows themselves."""

import random
import time

from pyspark.sql import functions as F
from test_alignment import mutated

from spanwright.operators import alignment, consensus, stars


def test_counts_are_those_of_aligned_rows(spark, monkeypatch):
    """Ties between characters and with gaps, rows in many pieces, units of one row, of empty rows and of a null key."""
    rng = random.Random(8)
    rows = []
    for unit, n in (("deep", 60), ("two", 2), ("four", 4), (None, 5)):
        centre = "".join(rng.choices("ACGT", k=90))
        rows += [(unit, i * 7 % 61, mutated(rng, centre, 0.9, i % 4)) for i in range(n)]
    rows += [("one", 3, "ACGT"), ("none", 0, ""), ("none", 1, None), ("short", 5, "ACG"), ("short", 2, ""), ("short", 9, "A")]
    df = spark.createDataFrame(rows, "unit string, ord long, seq string").repartition(7)
    aligned = stars.star_alignment(df, ["unit"])
    exploded = aligned.select("unit", "ord", F.posexplode(F.split("seq", "")).alias("col", "base")).where(F.col("base") != "")
    want = {tuple(r) for r in exploded.groupBy("unit", "col", "base").agg(F.count("*"), F.min("ord")).collect()}
    profile = {tuple(r) for r in consensus.column_profile(aligned, ["unit"]).collect()}
    for made, sums in ((stars.MADE, stars.SUMS), (300, 1)):
        monkeypatch.setattr(stars, "MADE", made)
        monkeypatch.setattr(stars, "SUMS", sums)
        counts = stars.aligned_counts(df, ["unit"])
        assert {tuple(r) for r in counts.select("unit", "col", "base", "n", "first").collect()} == want
        assert {tuple(r) for r in consensus.majority(counts, ["unit"]).collect()} == profile


def test_alignments_do_not_depend_on_their_batch():
    """A pair that is aligned beside one of very different lengths has the band that it has alone."""
    rng = random.Random(2)
    base = lambda n: "".join(rng.choices("ACGT", k=n)).encode()
    pairs = [(base(80), base(rng.choice([10, 60, 80, 100, 200]))) for _ in range(60)] + [(b"", b"AC"), (b"AC", b"")]
    together = list(alignment.gapped(*zip(*pairs, strict=True), 4))
    assert together == [next(alignment.gapped([a], [b], 4)) for a, b in pairs]


def test_rows_of_deep_units_are_aligned_quickly():
    """A row of 500 bases took over two milliseconds, most of it step by step on the way back."""
    rng = random.Random(1)
    base = lambda n: "".join(rng.choices("ACGT", k=n)).encode()
    centre, others = base(500), [base(rng.randint(490, 500)) for _ in range(1500)]
    began = time.process_time()
    assert len(list(alignment.gapped([centre] * len(others), others, 16))) == 1500
    assert time.process_time() - began < 2.2
