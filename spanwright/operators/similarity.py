"""Similarity of genomes by shared k-mers, clusters of similar genes, and identical sequences on either strand.

Genes are clustered as by Linclust (Steinegger and Söding, 2018): sequences that share a k-mer are
compared with the longest of them only, so the work grows with the input and not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanwright.functions import expr as E
from spanwright.operators import alignment, kmers
from spanwright.operators.skew import even_join
from spanwright.session import Tables, small_batches

#: K-mers of a gene by which it meets others: at 85 % identity about one in eleven is intact in both, so
#: a pair that meets by none of 60 is rare (measured in tests).
SEEDS = 60
#: Bases between anchors of a chain at most, how far they may differ in both genomes, and anchors of a chain at least.
GAP, SLACK, LEAST_ANCHORS = 500, 50, 3


def sketch(seqs: DataFrame, keys: list[str], k: int = 15) -> DataFrame:
    """``keys, kmer, pos, forward``: canonical k-mers of ``seq`` whose digest begins with 0, one in sixteen (FracMinHash), with their places.

    Made in tasks by arrays, as digests of all k-mers by column expressions take fifty times as long.
    """
    small_batches(seqs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, pos, texts, forward in kmers.sketched(batch.column("seq").to_pylist(), k):
                row = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in keys), pa.array(texts, pa.string()), pa.array(pos, pa.int64()), pa.array(forward)], [*keys, "kmer", "pos", "forward"])

    types = dict(seqs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", kmer string, pos long, forward boolean"
    return seqs.where(F.length("seq") >= k).select(*keys, "seq").mapInArrow(work, schema)


def _covered(chains: DataFrame, own: str, start: str, end: str) -> DataFrame:
    """``ref, query, covered``: bases in any of a pair's chains, along the contigs of one of the two."""
    w = W.partitionBy("ref", "query", own).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.max(end).over(w), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start) - 1, before))
    return chains.withColumn("fresh", fresh).groupBy("ref", "query").agg(F.sum("fresh").alias("covered"))


def pairwise_similarity(genomes: DataFrame, block: str = "speci", id: str = "genome", contig: str = "contig_id", k: int = 15) -> DataFrame:
    """Similarities of genomes within a block, never across: ``ref, query, ani, af_ref, af_query``.

    Anchors are sketch k-mers that occur once in both genomes. Along a contig of the first, anchors on one contig and
    strand of the second are chained while both places go on by about as much (GAP, SLACK). Chains of
    LEAST_ANCHORS or more cover bases: their share of each genome is its aligned fraction. Identity is the
    k-th root of the share of the covered bases' sketch that is anchors. A k-mer of many genomes is dealt to several tasks.
    """
    kept = Tables(genomes.sparkSession)
    rows = genomes.select(F.col(block).alias("block"), F.col(id).alias("id"), F.col(contig).alias("contig"), "seq").where(F.col("block").isNotNull())
    sizes = rows.groupBy("block", "id").agg(F.sum(F.length("seq")).alias("size"))
    once = sketch(rows, ["block", "id", "contig"], k).groupBy("block", "id", "kmer").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("contig", "pos", "forward"))).where(F.col("n") == 1).drop("n")
    once = kept.keep(once)
    sizes = kept.keep(sizes.join(once.groupBy("block", "id").agg(F.count("*").alias("n")), ["block", "id"]))
    names = {"id": "query", "contig": "contig_b", "pos": "pos_b", "forward": "forward_b"}
    met = even_join(once, once.select("block", "kmer", *(F.col(a).alias(b) for a, b in names.items())), ["block", "kmer"]).where(F.col("id") < F.col("query"))
    turn = F.when(F.col("forward") == F.col("forward_b"), 1).otherwise(-1)
    met = met.select(F.col("id").alias("ref"), "query", F.col("contig").alias("contig_a"), "contig_b", turn.alias("turn"), "pos", (turn * F.col("pos_b")).alias("y"))
    line = W.partitionBy("ref", "query", "contig_a", "contig_b", "turn").orderBy("pos")
    dx, dy = (F.col(c) - F.lag(c).over(line) for c in ("pos", "y"))
    goes_on = F.coalesce((dy > 0) & (dx <= GAP) & (F.abs(dx - dy) <= SLACK), F.lit(False))
    met = met.withColumn("fresh", (~goes_on).cast("int")).withColumn("chain", F.sum("fresh").over(line))
    ends = [F.count("*").alias("n"), F.min("pos").alias("a0"), (F.max("pos") + k - 1).alias("a1"), F.min(F.abs("y")).alias("b0"), (F.max(F.abs("y")) + k - 1).alias("b1")]
    chains = kept.keep(met.groupBy("ref", "query", "contig_a", "contig_b", "turn", "chain").agg(*ends).where(F.col("n") >= LEAST_ANCHORS))
    total = chains.groupBy("ref", "query").agg(F.sum("n").alias("anchors"))
    s = total.join(_covered(chains, "contig_a", "a0", "a1").withColumnRenamed("covered", "cover_a"), ["ref", "query"]).join(_covered(chains, "contig_b", "b0", "b1").withColumnRenamed("covered", "cover_b"), ["ref", "query"])
    s = s.join(sizes.select(F.col("id").alias("ref"), F.col("size").alias("size_a"), F.col("n").alias("n_a")), "ref").join(sizes.select(F.col("id").alias("query"), F.col("size").alias("size_b"), F.col("n").alias("n_b")), "query")
    share = lambda x: F.col("anchors") * F.col(f"size_{x}") / (F.col(f"cover_{x}") * F.col(f"n_{x}"))
    ani = F.pow(F.least(F.lit(1.0), F.greatest(share("a"), share("b"))), F.lit(1.0 / k)) * 100
    return s.select("ref", "query", ani.alias("ani"), (100.0 * F.col("cover_a") / F.col("size_a")).alias("af_ref"), (100.0 * F.col("cover_b") / F.col("size_b")).alias("af_query"))


def greedy_clusters(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``member, rep``: longest first, a vertex that no earlier representative covers becomes one.

    ``vertices`` has ``id, size``; ``edges`` ``a, b``. In each round every open vertex that comes
    before all its open neighbours becomes a representative and takes its open neighbours; several do
    so at once, with the same result as one by one if a member goes to its first representative.
    A round reads the links between open vertices only; a vertex without any is its own representative.
    """
    kept = Tables(vertices.sparkSession)
    order = lambda p: F.struct((-F.col(f"{p}size")).alias("s"), F.col(f"{p}id").alias("id"))
    both = edges.select("a", "b").union(edges.select("b", "a")).where(F.col("a") != F.col("b")).distinct()
    ranked = vertices.select("id", order("").alias("rank"))
    links = both.join(ranked.select(F.col("id").alias("a"), F.col("rank").alias("rank_a")), "a").join(ranked.select(F.col("id").alias("b"), F.col("rank").alias("rank_b")), "b")
    links, done = kept.keep(links), []
    while not links.isEmpty():
        reps = links.groupBy(F.col("a").alias("id")).agg(F.count_if(F.col("rank_b") < F.col("rank_a")).alias("before")).where(F.col("before") == 0).select("id")
        reps = kept.keep(reps)
        taken = links.join(reps.withColumnRenamed("id", "b"), "b", "left_semi").groupBy(F.col("a").alias("id")).agg(F.min_by("b", "rank_b").alias("by"))
        done.append(kept.keep(reps.select("id", F.col("id").alias("by")).unionByName(taken)))
        marked = done[-1].select("id")
        left = kept.keep(links.join(marked.withColumnRenamed("id", "a"), "a", "left_anti").join(marked.withColumnRenamed("id", "b"), "b", "left_anti"))
        kept.drop(links, reps)
        links = left
    none = vertices.select("id", F.col("id").alias("by")).limit(0)
    marks = reduce(DataFrame.unionByName, done, none)
    return vertices.select("id").join(marks, "id", "left").select(F.col("id").alias("member"), F.coalesce("by", "id").alias("rep"))


def _chosen(genes: DataFrame, k: int, most: int) -> DataFrame:
    """``id, size, kmer, at``: the ``most`` k-mers of each sequence whose hashes are least, with their first places."""
    small_batches(genes.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column("seq").to_pylist()
            found = kmers.least_hashes(seqs, k, most)
            n = [len(h) for h, _ in found]
            size = pa.array(np.repeat([len(s) for s in seqs], n), pa.int32())
            h, at = (pa.array(np.concatenate([x[i] for x in found]), t) for i, t in ((0, pa.int64()), (1, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.repeat(np.arange(len(n)), n))), size, h, at], ["id", "size", "kmer", "at"])

    return genes.where(F.length("seq") >= k).select("id", "seq").mapInArrow(work, f"id {dict(genes.dtypes)['id']}, size int, kmer long, at int")


def _verified(identity: float, coverage: float):
    """Pairs (``a, b, seq_a, seq_b, shift``) whose best alignment along the seed's diagonal is as similar as asked.

    Pairs that have no such alignment are left out first; the others are aligned many at a time.
    """

    def agreed(pairs: list[tuple]) -> pa.RecordBatch:
        first, second, a, b, diagonal = zip(*pairs, strict=True)
        found = alignment.overlaps(a, b, diagonal)
        columns, least = np.maximum(found["columns"], 1), coverage - 1e-9
        same = 100 * found["matches"] / columns
        cover = 100 * np.minimum(found["span_a"] / np.maximum([len(x) for x in a], 1), found["span_b"] / np.maximum([len(x) for x in b], 1))
        keep = pa.array((same >= identity - 1e-9) & (cover >= least) & (found["columns"] > 0))
        return pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(same), pa.array(cover)], ["a", "b", "identity", "coverage"]).filter(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held = [], 0
        for batch in batches:
            a, b = ([s.encode() for s in batch.column(n).to_pylist()] for n in ("seq_a", "seq_b"))
            diagonal = -batch.column("shift").to_numpy()
            names = (batch.column(n).to_pylist() for n in "ab")
            for can, *pair in zip(alignment.may_agree(a, b, diagonal, identity, coverage), *names, a, b, diagonal, strict=True):
                if can:
                    pairs.append(pair)
                    held += len(pair[2]) + len(pair[3])
                    if held >= alignment.GATHERED:
                        yield agreed(pairs)
                        pairs, held = [], 0
        if pairs:
            yield agreed(pairs)

    return run


def similar_genes(genes: DataFrame, identity: float, coverage: float, k: int, most: int) -> DataFrame:
    """``a, b, identity, coverage``: sequences (``id, seq``, all different) as similar as asked to the longest one that shares a k-mer.

    The two are aligned with gaps in a band around the shared k-mer's diagonal. Identity is the share of
    equal bases in the alignment's columns, coverage the lesser share that it takes of either, both in
    percent. A pair with several seeds has its best alignment.
    """
    kept = Tables(genes.sparkSession)
    seeds = kept.keep(_chosen(genes, k, most))
    longest = seeds.groupBy("kmer").agg(F.max(F.struct("size", "id", "at")).alias("c"), F.count("*").alias("n")).where(F.col("n") > 1)
    longest = kept.keep(longest)
    met = even_join(seeds, longest.select("kmer", "c"), ["kmer"], counts=longest.select("kmer", "n")).where(F.col("id") != F.col("c.id"))
    shift = F.col("c.at") - F.col("at")
    overlap = F.least(F.col("c.size") - F.greatest(shift, F.lit(0)), F.col("size") - F.greatest(-shift, F.lit(0)))
    met = met.where((overlap + alignment.BAND) * 100 >= F.lit(coverage) * F.greatest("size", "c.size"))
    # Seeds within half a band of each other have one alignment
    near = F.floor(shift / (alignment.BAND // 2))
    pairs = kept.keep(met.groupBy(F.col("c.id").alias("a"), F.col("id").alias("b"), near.alias("near")).agg(F.min(shift).cast("bigint").alias("shift")).drop("near"))
    with_b = even_join(pairs, genes.select(F.col("id").alias("b"), F.col("seq").alias("seq_b")), ["b"])
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    both = even_join(with_b, genes.select(F.col("id").alias("a"), F.col("seq").alias("seq_a")), ["a"], counts=counts, total=pairs.count())
    id_type = dict(genes.dtypes)["id"]
    good = both.select("a", "b", "seq_a", "seq_b", "shift").mapInArrow(_verified(identity, coverage), f"a {id_type}, b {id_type}, identity double, coverage double")
    return kept.keep(good.groupBy("a", "b").agg(F.max(F.struct("identity", "coverage")).alias("x")).select("a", "b", "x.*"))


def cluster_by_similarity(genes: DataFrame, identity: float = 85.0, coverage: float = 85.0, k: int = 15, most: int = SEEDS) -> DataFrame:
    """``member, rep`` of genes (``id, seq``) as similar as asked to their representative.

    Equal sequences are one: the least id stands for them, so copies are together whatever their
    length. Representatives are taken from the longest sequence on.
    """
    kept = Tables(genes.sparkSession)
    named = kept.keep(genes.select("id", F.sha2(F.col("seq").cast("binary"), 256).alias("key"), F.length("seq").alias("size")))
    copies = named.groupBy("key", "size").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    copies = kept.keep(copies)
    once = kept.keep(genes.join(copies.select("id"), "id", "left_semi").dropDuplicates(["id"]))
    clusters = greedy_clusters(copies.select("id", "size"), similar_genes(once, identity, coverage, k, most))
    reps = kept.keep(copies.join(clusters.withColumnRenamed("member", "id"), "id").select("key", "size", "n", "rep"))
    return even_join(named, reps.drop("n"), ["key", "size"], counts=reps.select("key", "size", "n")).select(F.col("id").alias("member"), "rep")


def strand_aware_duplicates(seqs: DataFrame) -> DataFrame:
    """``group_no, member, sign, flip`` of sequences that are equal on one strand or the other.

    Groups of two or more; numbered by their first members' order. ``+`` means that a member is the
    reverse complement of the first one. Sequences are compared by 256-bit digests of the lesser of
    their two strands and by their lengths, so they themselves are read once and never moved.
    """
    other = E.revcomp("seq")
    digest = F.sha2(F.least("seq", other).cast("binary"), 256)
    kept = Tables(seqs.sparkSession)
    df = kept.keep(seqs.select("id", "ord", digest.alias("key"), F.length("seq").alias("size"), (F.col("seq") <= other).alias("is_least")))
    first = df.groupBy("key", "size").agg(F.min_by(F.struct("is_least", "ord"), "ord").alias("x"), F.count("*").alias("n")).where(F.col("n") > 1)
    named = first.select("key", "size", F.col("x.is_least").alias("first_least"), F.col("x.ord").alias("first_ord"))
    out = even_join(df, named, ["key", "size"])
    flip = F.col("is_least") != F.col("first_least")
    return out.select(F.col("first_ord").alias("group_no"), F.col("id").alias("member"), F.when(flip, "+").otherwise("-").alias("sign"), flip.alias("flip"))
