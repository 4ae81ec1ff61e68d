"""Joins between elements, genes, genomes, clusters, groups and results. All are equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.functions import expr as E
from spanwright.operators.filters import contained_in
from spanwright.operators.tiles import lengths, slices, tiled
from spanwright.session import Tables


def classify_genes(genes: DataFrame, islands: DataFrame) -> DataFrame:
    """Genes with a flag for those whose parent is among ``islands`` (all elements, ``is_target``): orphan, all or target."""
    known = islands.select(F.col("mge_id").alias("parent"), "is_target")
    out = genes.join(known, "parent", "left")
    return out.withColumn("class", F.when(F.col("is_target").isNull(), "orphan").when(F.col("is_target"), "target").otherwise("other")).drop("is_target")


def extract_gene_sequences(genes: DataFrame, genomes: DataFrame, contigs: DataFrame) -> DataFrame:
    """The sequence of each gene, or why there is none: bad_coords, no_genome or no_contig.

    Contigs are tiled, and a gene meets the tiles that it touches only; its contig's length is joined, not the contig.
    Rows are numbered in a kept table, so repeated ids have a sequence each.
    """
    kept = Tables(genes.sparkSession)
    sizes, tiles = kept.keep(lengths(contigs)), kept.keep(tiled(contigs))
    df = genes.join(genomes.select("genome_key", F.lit(True).alias("has_genome")).distinct(), "genome_key", "left").join(sizes, "contig_id", "left")
    bad = (F.col("g_start") < 1) | (F.col("g_end") < F.col("g_start"))
    reason = F.when(bad, "bad_coords").when(F.col("has_genome").isNull(), "no_genome").when(F.col("size").isNull(), "no_contig")
    df = kept.keep(df.withColumns({"reason": reason, "_row": F.monotonically_increasing_id()}))
    good = df.where(F.col("reason").isNull())
    cut = slices(good, tiles, {"gene_seq": (F.col("g_start") - 1, F.least(F.col("g_end"), F.col("size")))}, "_row", tables=kept)
    return df.join(cut, "_row", "left").withColumn("gene_seq", F.when(F.col("reason").isNull(), F.coalesce("gene_seq", F.lit("")))).drop("size", "has_genome", "_row")


def assign_species(genomes: DataFrame, accessions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Genome keys with accession (the first seen) and species, or why there is none."""
    first = accessions.groupBy("genome_key").agg(F.min_by("gca", "ord").alias("gca"))
    df = genomes.select("genome_key").distinct().join(first, "genome_key", "left").join(taxonomy.select("gca", "speci"), "gca", "left")
    return df.withColumn("reason", F.when(F.col("gca").isNull(), "no_gca").when(F.col("speci").isNull(), "no_specI"))


def element_gene_table(elements: DataFrame, genes: DataFrame, genomes: DataFrame, sequenced: DataFrame) -> DataFrame:
    """Table a: elements on representative genomes with their contained genes that have a sequence."""
    kept = elements.join(genomes.select("genome_key").distinct(), "genome_key", "left_semi").drop("doc_id")
    own = genes.where(F.col("recombinase").isNotNull()).join(sequenced.select("gene_id").distinct(), "gene_id", "left_semi")
    own = own.select("gene_id", "g_start", "g_end", "recombinase", F.col("parent").alias("mge_id"), F.col("doc_id").alias("ord"), "k")
    df = kept.join(own, "mge_id").where(contained_in())
    attribute = lambda name: F.try_element_at(E.attr_map("attrs"), F.lit(name)).alias(name)
    return df.select("mge_id", "gca", F.col("start_pos").alias("mge_start"), F.col("end_pos").alias("mge_end"), attribute("n_genes"), attribute("mgeR"), F.col("gene_id").alias("recombinase_id"), F.col("g_start").alias("recombinase_start"), F.col("g_end").alias("recombinase_end"), F.col("recombinase").alias("recombinase_type"), (F.col("ord") * 3 + F.col("k")).alias("ord"))


def append_clusters(table: DataFrame, membership: DataFrame) -> DataFrame:
    """Table b's mark: ``+|rep`` for a representative, ``-|rep`` for another member, else null."""
    reps = membership.select(F.col("rep").alias("recombinase_id"), F.lit(True).alias("is_rep")).distinct()
    members = membership.select(F.col("member").alias("recombinase_id"), "rep")
    df = table.join(reps, "recombinase_id", "left").join(members, "recombinase_id", "left")
    mark = F.when(F.col("is_rep"), F.concat(F.lit("+|"), "recombinase_id")).when(F.col("rep").isNotNull(), F.concat(F.lit("-|"), "rep"))
    return df.withColumn("rep", F.when(F.col("is_rep"), F.col("recombinase_id")).otherwise(F.col("rep"))).withColumn("is_representative", mark).drop("is_rep")


def append_species(table: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return table.join(taxonomy.select("gca", "speci"), "gca", "left")


def append_duplicates(table: DataFrame, groups: DataFrame) -> DataFrame:
    """Table c: each element's group, the last one of several, and its size in this table."""
    last = groups.groupBy(F.col("member").alias("mge_id")).agg(F.max("group_no").alias("duplicate_group_number"))
    df = table.join(last, "mge_id", "left")
    sizes = df.where(F.col("duplicate_group_number").isNotNull()).groupBy("duplicate_group_number").agg(F.count_distinct("mge_id").alias("duplicate_group_size"))
    df = df.join(sizes, "duplicate_group_number", "left")
    return df.withColumn("singleton", F.when(F.col("duplicate_group_number").isNull(), "yes").otherwise("no"))


def extract_flanks(elements: DataFrame, placement: DataFrame, genomes: DataFrame, contigs: DataFrame, signs: DataFrame, flank: int = 500, overlap: int = 30) -> DataFrame:
    """Windows at both ends of each placed element and its own body, on the strand of its group, or why there are none.

    Contigs are tiled: an element meets the tiles that its windows and body touch, and the length of its contig.
    """
    kept = Tables(elements.sparkSession)
    sizes, tiles = kept.keep(lengths(contigs)), kept.keep(tiled(contigs))
    df = elements.join(placement, "mge_id", "left").join(genomes.select("genome_key", F.lit(True).alias("has_genome")).distinct(), "genome_key", "left")
    df = df.join(sizes, "contig_id", "left").join(signs.select(F.col("member").alias("mge_id"), "sign"), "mge_id", "left")
    bad = (F.col("start_pos") < 1) | (F.col("end_pos") > F.col("size"))
    reason = F.when(F.col("rec_type").isNull(), "no_placement").when(F.col("has_genome").isNull(), "no_genome").when(F.col("size").isNull(), "no_contig").when(bad, "bad_coords")
    ls, le, rs, re = E.flank_windows(F.col("start_pos"), F.col("end_pos"), F.col("size"), flank, overlap)
    df = df.select("mge_id", "contig_id", "rec_type", "sign", reason.alias("reason"), ls.alias("ls"), le.alias("le"), rs.alias("rs"), re.alias("re"), "start_pos", "end_pos", F.monotonically_increasing_id().alias("_row"))
    df = kept.keep(df)
    at = {"l": (F.col("ls"), F.col("le")), "r": (F.col("rs"), F.col("re")), "b": (F.col("start_pos") - 1, F.col("end_pos"))}
    cut = slices(df.where(F.col("reason").isNull()), tiles, at, "_row", tables=kept)
    df = df.join(cut, "_row", "left")
    l, r, body = (F.coalesce(c, F.lit("")) for c in ("l", "r", "b"))
    sign, ok = F.coalesce("sign", F.lit("-")), F.col("reason").isNull()
    left, right = E.orient_flanks(l, r, sign)
    short = lambda s, e: ok & (F.col(e) - F.col(s) < flank)
    return df.select("mge_id", "rec_type", "reason", F.when(ok, left).alias("left"), F.when(ok, right).alias("right"), short("ls", "le").alias("short_left"), short("rs", "re").alias("short_right"), F.when(ok, E.orient_body(body, sign)).alias("body"))


def append_flanks(table: DataFrame, flanks: DataFrame) -> DataFrame:
    """Table d: a left and a right row for each row, with the window or null."""
    sides = table.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    df = sides.join(flanks.select("mge_id", "left", "right"), "mge_id", "left")
    return df.withColumn("flank_sequence", F.when(F.col("side") == "left", F.col("left")).otherwise(F.col("right"))).drop("left", "right")


def append_consensus(table: DataFrame, results: DataFrame) -> DataFrame:
    """Table e: the consensus of each row's type, cluster and side; stacking before alignment; none for singletons."""
    rank = F.when(F.col("consensus_source") == "stacking", 0).otherwise(1)
    best = results.groupBy("rec_type", "cluster_number", "side").agg(F.min_by(F.struct("method", "consensus_start", "consensus_length", "consensus_sequence"), rank).alias("c"))
    df = table.join(best, ["rec_type", "cluster_number", "side"], "left")
    ok = F.col("singleton") == "no"
    names = {"method": "consensus_method", "consensus_start": "consensus_start", "consensus_length": "consensus_length", "consensus_sequence": "consensus_sequence"}
    return df.withColumns({n: F.when(ok, F.col(f"c.{c}")) for c, n in names.items()}).drop("c")


def label_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """A label for each member that has a window: that of its type, cluster and side."""
    return members.join(labels, ["rec_type", "cluster_number", "side"])


def pending_keys(wanted: DataFrame, status: DataFrame) -> DataFrame:
    """Genome keys that are wanted and neither downloaded nor there already."""
    done = status.where(F.col("status").isin("downloaded", "skipped_exists"))
    return wanted.select("genome_key").distinct().join(done, "genome_key", "left_anti")


def segment_lookup(scores: DataFrame, segments: DataFrame) -> DataFrame:
    """Position scores with their example's segment or null and its window's own length."""
    return scores.join(segments, ["rec_type", "mge_id", "side"], "left")


def append_split(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    return rows.join(assigned, "component", "left")
