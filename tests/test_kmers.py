"""K-mers made by arrays beside plain ones, and pairs that are told apart without an alignment."""

import hashlib
import random
import time

import numpy as np
from pyspark.sql import functions as F
from test_alignment import mutated

from spanwright.operators import alignment, kmers, similarity

TURNED = str.maketrans("ACGTNacgtn", "TGCANtgcan")


def some(seed, n=60, most=900):
    rng = random.Random(seed)
    return ["".join(rng.choices("ACGT", k=rng.randint(0, most))) for _ in range(n)] + ["", "A" * 60, "ACGTNNacgtACGTTGACCATGACé" * 20, "ACGTTGCA" * 300]


def plain_sketch(seqs, k):
    for row, s in enumerate(seqs):
        for i in range(len(s) - k + 1):
            own = s[i : i + k]
            least = min(own, own.translate(TURNED)[::-1])
            if hashlib.md5(least.encode()).hexdigest()[0] == "0":
                yield row, i + 1, least, least == own


def test_sketches_equal_plain_digests(monkeypatch):
    """Odd characters, k-mers at the ends, lengths that fill a word of the digest's block, and sequences cut into pieces."""
    for joined in (kmers.JOINED, 500):
        monkeypatch.setattr(kmers, "JOINED", joined)
        for k in (4, 15, 16, 31, 33):
            got = [x for r, p, m, f in kmers.sketched(some(k), k) for x in zip(r.tolist(), p.tolist(), m, f.tolist(), strict=True)]
            assert sorted(got) == sorted(plain_sketch(some(k), k))


def test_sketch_and_seeds_of_tables(spark, monkeypatch):
    seqs = some(1)
    df = spark.createDataFrame([(i, f"c{i % 7}", s) for i, s in enumerate(seqs)] + [(1000, "c", None)], "id int, contig string, seq string")
    got = {(r.id, r.pos, r.kmer, r.forward, r.contig) for r in similarity.sketch(df, ["id", "contig"]).collect()}
    assert got == {(i, p, m, f, f"c{i % 7}") for i, p, m, f in plain_sketch(seqs, 15)}
    monkeypatch.setattr(kmers, "JOINED", 500)
    short = df.where(F.col("seq").rlike("^[ACGT]*$"))
    each = F.transform(F.sequence(F.lit(1), F.length("seq") - 14), lambda i: F.struct(F.xxhash64(F.substr("seq", i, F.lit(15))).alias("h"), i.alias("at")))
    plain = short.where(F.length("seq") >= 15).select("id", F.length("seq").alias("size"), F.explode(F.slice(F.array_sort(each), 1, 20)).alias("x"))
    want = {tuple(r) for r in plain.groupBy("id", "size", F.col("x.h").alias("kmer")).agg(F.min("x.at").alias("at")).collect()}
    assert {tuple(r) for r in similarity._chosen(short, 15, 20).select("id", "size", "kmer", "at").collect()} == want


def test_sketches_of_many_bases_are_quick(spark):
    """A digest by column expressions took about ten microseconds of CPU time for each base."""
    df = spark.range(1600).select("id", F.expr("translate(repeat(sha2(cast(id as string), 512), 50), '0123456789abcdef', 'ACGTACGTACGTACGT')").alias("seq"))
    similarity.sketch(df.limit(10), ["id"]).count()
    began = time.time()
    assert similarity.sketch(df, ["id"]).count() > 100_000
    assert time.time() - began < 10


def test_pairs_told_apart_have_no_alignment():
    rng = random.Random(3)
    a, b, diagonal = [], [], []
    for _ in range(500):
        x = "".join(rng.choices("ACGT", k=rng.randint(0, 500)))
        y = mutated(rng, x, rng.choice([0.3, 0.7, 0.83, 0.85, 0.87, 0.95, 1]), rng.randint(0, 3)) if len(x) > 40 else x[:5]
        a.append(x.encode())
        b.append(y.encode())
        diagonal.append(rng.randint(-20, 20))
    found = alignment.overlaps(a, b, diagonal)
    for identity, coverage in ((85, 85), (95, 50), (70, 85), (100, 100), (30, 80)):
        cover = np.minimum(found["span_a"] / np.maximum([len(x) for x in a], 1), found["span_b"] / np.maximum([len(x) for x in b], 1))
        good = (100 * found["matches"] >= identity * found["columns"]) & (100 * cover >= coverage) & (found["columns"] > 0)
        may = alignment.may_agree(a, b, diagonal, identity, coverage)
        assert may[good].all()
        if identity == 85:
            assert (~may).sum() > 100 and good.sum() > 100


def test_clusters_align_few_pairs(spark, monkeypatch):
    """Of genes that share a run of bases but no more, none is aligned."""
    rng = random.Random(11)
    base = lambda n: "".join(rng.choices("ACGT", k=n))
    shared = base(40)
    rows = [(f"g{i}", base(300) + shared + base(300)) for i in range(40)] + [("copy", None)]
    rows[-1] = ("copy", rows[0][1][:-1] + "A" * 2)
    calls = []
    whole = alignment.overlaps
    monkeypatch.setattr(alignment, "overlaps", lambda a, *rest: calls.append(len(a)) or whole(a, *rest))
    batch = __import__("pyarrow").RecordBatch.from_pydict({"a": ["copy"] * 40, "b": [r[0] for r in rows[:-1]], "seq_a": [rows[-1][1]] * 40, "seq_b": [r[1] for r in rows[:-1]], "shift": [0] * 40})
    found = [x for out in similarity._verified(85.0, 85.0)(iter([batch])) for x in out.column("b").to_pylist()]
    assert found == ["g0"] and sum(calls) <= 3
    got = {r.member: r.rep for r in similarity.cluster_by_similarity(spark.createDataFrame(rows, "id string, seq string")).collect()}
    assert len(got) == 41 and got["g0"] == "copy" and len(set(got.values())) == 40
