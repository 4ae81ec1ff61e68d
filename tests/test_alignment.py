"""Alignments beside plain dynamic programming, gene clusters at low identity, star alignments, ranks and percentiles."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.operators import alignment, motifs, ranking, similarity, tiles
from spanwright.operators.stars import star_alignment


def mutated(rng, s, identity, indels=0):
    out = [c if rng.random() < identity else rng.choice([x for x in "ACGT" if x != c]) for c in s]
    for _ in range(indels):
        at, n = rng.randrange(len(out)), rng.randint(1, 10)
        if rng.random() < 0.5:
            del out[at : at + n]
        else:
            out[at:at] = rng.choices("ACGT", k=n)
    return "".join(out)


def plain_overlap(a, b):
    """Columns, matches and spans of the best alignment with free ends, by whole tables."""
    row = [(0, 0, j) for j in range(len(b) + 1)]
    ends = [(row[-1], 0, len(b))]
    for i in range(1, len(a) + 1):
        new = [(0, 0, -i)]
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            pair, up, left = row[j - 1], row[j], new[-1]
            new.append(max((pair[0] + (1 if same else -1), pair[1] + same, pair[2]), (up[0] - 1, *up[1:]), (left[0] - 1, *left[1:])))
        row = new
        ends.append((row[-1], i, len(b)))
    ends += [(v, len(a), j) for j, v in enumerate(row)]
    (score, matches, diagonal), i, j = max(ends, key=lambda e: e[0])
    return 2 * matches - score, matches, i - max(0, -diagonal), j - max(0, diagonal)


def pairs(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        a = "".join(rng.choices("ACGT", k=rng.randint(1, 90)))
        yield a, mutated(rng, a, rng.choice([0.85, 0.95, 1]), rng.randint(0, 1))


def test_overlaps_equal_plain_tables():
    both = [*pairs(1, 120), ("A", "A"), ("", ""), ("ACGT", ""), ("", "AC")]
    got = alignment.overlaps([a.encode() for a, _ in both], [b.encode() for _, b in both], [0] * len(both), band=60)
    for n, (a, b) in enumerate(both):
        assert tuple(int(got[k][n]) for k in ("columns", "matches", "span_a", "span_b")) == (plain_overlap(a, b) if a and b else (0, 0, 0, 0))


def test_gapped_alignments_are_best_and_keep_sequences():
    both = [*pairs(2, 120), ("", "ACG"), ("ACG", ""), ("", "")]
    for (a, b), (text, more) in zip(both, alignment.gapped([a.encode() for a, _ in both], [b.encode() for _, b in both], 100), strict=True):
        held = dict(more)
        assert len(text) == len(a)
        assert "".join(held.get(i, "") + text[i : i + 1].replace("-", "") for i in range(len(a) + 1)) == b
        row = list(range(0, -len(b) - 1, -1))
        for i in range(1, len(a) + 1):
            new = [-i]
            for j in range(1, len(b) + 1):
                new.append(max(row[j - 1] + (1 if a[i - 1] == b[j - 1] else -1), row[j] - 1, new[-1] - 1))
            row = new
        assert sum(1 if x == y else -1 for x, y in zip(a, text, strict=True)) - sum(map(len, held.values())) == row[-1]


@pytest.mark.parametrize(("identity", "indels"), [(0.86, 0), (0.88, 1), (0.9, 2)])
def test_similar_genes_recall(spark, identity, indels):
    """Of pairs that a plain aligner finds similar enough, nine in ten at least meet; none other does."""
    rng = random.Random(int(identity * 100))
    rows, wanted = [], set()
    for n in range(60):
        a = "".join(rng.choices("ACGT", k=400))
        b = mutated(rng, a, identity, indels)
        rows += [(f"a{n}", a), (f"b{n}", b)]
        columns, matches, span_a, span_b = plain_overlap(a, b)
        if 100 * matches >= 85 * columns and min(span_a / len(a), span_b / len(b)) >= 0.85:
            wanted.add(frozenset((f"a{n}", f"b{n}")))
    found = {frozenset((r.a, r.b)) for r in similarity.similar_genes(spark.createDataFrame(rows, "id string, seq string"), 85.0, 85.0, 15, similarity.SEEDS).collect()}
    assert found <= wanted
    assert len(found) >= 0.9 * len(wanted) > 0


def test_star_alignment(spark):
    """Copies with gaps line up: rows have one width, their bases stay, and columns of a planted family agree."""
    rng = random.Random(5)
    centre = "".join(rng.choices("ACGT", k=120))
    rows = [("u", i, mutated(rng, centre, 0.97, i % 3)) for i in range(40)] + [("v", 0, "ACGT"), ("v", 1, ""), ("v", 2, None), ("w", 0, "")]
    df = spark.createDataFrame(rows, "unit string, ord long, seq string")
    got = {(r.unit, r.ord): r.seq for r in star_alignment(df, ["unit"]).collect()}
    assert {k: s.replace("-", "") for k, s in got.items()} == {(u, o): s or "" for u, o, s in rows}
    for unit in "uvw":
        assert len({len(s) for (u, _), s in got.items() if u == unit}) == 1
    columns = list(zip(*(s for (u, _), s in got.items() if u == "u"), strict=True))
    good = [c for c in columns if max(map(c.count, "ACGT")) >= 0.8 * len(c)]
    assert len(good) >= 100
    assert star_alignment(df.limit(0), ["unit"]).count() == 0


def test_numbers_and_percentiles(spark):
    """A key with most rows, a null key and ties."""
    rng = random.Random(3)
    rows = [(None if i % 10 == 0 else "hot" if i % 7 else f"k{i % 5}", float(rng.randint(0, 50)) if i % 11 else None, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v double, id int")
    got = {(r.k, r.id): r.n for r in ranking.numbered(df, ["k"], ["v", "id"], "n", parts=13).collect()}
    by = {}
    for k, v, i in rows:
        by.setdefault(k, []).append((v is not None, v or 0.0, i))
    assert got == {(k, i): n for k, x in by.items() for n, (_, _, i) in enumerate(sorted(x), 1)}
    found = {r.k: r for r in ranking.percentiles(df, ["k"], "v", [0.25, 0.5, 1.0], ["a", "b", "c"]).collect()}
    assert len(found) == len(by)
    for k, x in by.items():
        values = [v for known, v, _ in x if known]
        assert (found[k].n, found[k].a, found[k].b, found[k].c) == (len(values), *(pytest.approx(float(np.percentile(values, p))) for p in (25, 50, 100)))
    assert ranking.percentiles(df.limit(0), ["k"], "v", [0.5], ["a"]).count() == 0


def test_slices_of_tiles(spark):
    """Windows over tile borders, at ends and beyond them, many of one tile."""
    rng = random.Random(4)
    seq = {c: "".join(rng.choices("ACGT", k=n)) for c, n in (("x", 5000), ("y", 1024), ("z", 3))}
    rows = [(i, rng.choice([*seq, "none"]), s := rng.randint(-50, 1100), s + rng.randint(0, 3000)) for i in range(400)] + [(1000 + i, "x", 10, 20) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, contig_id string, s int, e int")
    contigs = spark.createDataFrame(list(seq.items()), "contig_id string, seq string")
    got = {r.id: r.w for r in tiles.slices(df, tiles.tiled(contigs), {"w": (F.col("s"), F.col("e"))}, "id").collect()}
    for i, c, s, e in rows:
        assert (got.get(i) or "") == seq.get(c, "")[max(0, s) : max(0, e)]


def test_aligned_fractions_of_planted_mosaics(spark):
    """Blocks of one genome in another, turned round and shuffled on two contigs; fractions within two points."""
    rng = random.Random(7)
    base = lambda n: "".join(rng.choices("ACGT", k=n))
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    blocks = [base(6000) for _ in range(4)]
    rows = [("s", "a", "a1", blocks[0] + base(6000) + blocks[1]), ("s", "a", "a2", blocks[2] + blocks[3]), ("s", "b", "b1", turned(blocks[2]) + base(3000) + mutated(rng, blocks[0], 0.97, 5)), ("s", "b", "b2", mutated(rng, blocks[3], 0.99)), ("t", "c", "c1", blocks[0]), ("s", "d", "d1", "ACG"), (None, "e", "e1", blocks[0])]
    got = similarity.pairwise_similarity(spark.createDataFrame(rows, "speci string, genome string, contig_id string, seq string")).collect()
    assert [(r.ref, r.query) for r in got] == [("a", "b")]
    assert abs(got[0].af_ref - 100 * 18 / 30) < 2 and abs(got[0].af_query - 100 * 18 / 21) < 2
    assert 97.5 < got[0].ani < 99.8


def test_motif_places_equal_regular_expressions(spark):
    rng = random.Random(9)
    listed = [(k, p) for k, patterns in motifs.END_PATTERNS.items() for p in patterns]
    kinds = [*motifs.END_PATTERNS, "none", None]
    rows = [(i, rng.choice(kinds), "".join(rng.choices("ACGTNacgt", k=rng.randint(0, 90)))) for i in range(300)] + [(300, "DDE_Tnp_ISL3", None), (301, "DDE_Tnp_ISL3", "GGGé")]
    got = motifs.motif_places(spark.createDataFrame(rows, "id int, rec_type string, seq string"), spark.createDataFrame(listed, "rec_type string, pattern string"))
    want = set()
    for i, kind, seq in rows:
        for own, p in listed:
            if own == kind and seq:
                up, rx = seq.upper(), re.compile("(?=" + "".join(c if c.isupper() and c != "N" else "." for c in p) + ")")
                want |= {(i, p, "+", m.start()) for m in rx.finditer(up)}
                want |= {(i, p, "-", len(up) - m.start() - len(p)) for m in rx.finditer(up[::-1].translate(str.maketrans("ACGTN", "TGCAN")))}
    assert sorted(map(tuple, got.collect())) == sorted(want)
