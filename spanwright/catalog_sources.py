"""Queries of sources and sinks: fixtures are written to scratch folders and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.catalog import Inputs, query
from spanwright.session import scratch
from spanwright.sources import tables as S

GFF = "concat_ws(char(9), contig_id, 'src', case when doc_id%3=0 then 'gene' else 'mobile_genetic_element' end, cast(start_pos as string), cast(end_pos as string), '.', '+', '.', attrs)"


def written(x: Inputs, lines, suffix: str = "") -> str:
    """Lines (``value``) as text files in a folder, all of one suffix."""
    path = scratch(x.spark)
    lines.write.option("lineSep", "\n").text(path)
    return path


def in_order(x: Inputs, df, *order: str) -> str:
    """Lines in part files whose names follow the order of the lines."""
    path = scratch(x.spark)
    df.orderBy(*order).select("value").write.text(path)
    return path


@query("s1_read_intervals", "select contig_id as seqid, start_pos as start, end_pos as end, attrs as attributes from elements where doc_id%3<>0")
def _(x):
    e = x("elements").select(F.expr(GFF).alias("value"))
    notes = x.table("documents").limit(3).select(F.lit("# comment").alias("value")).union(x.table("documents").limit(2).select(F.lit("short\tline")))
    path = scratch(x.spark)
    # A folder below, so that the walk is recursive; the text writer names its files .txt
    e.union(notes).write.text(f"{path}/deep")
    lines = x.spark.read.option("recursiveFileLookup", True).text(path)
    return S.intervals(lines, "mobile_genetic_element").select("seqid", "start", "end", "attributes")


@query("s2_read_sequences", "select contig_id as id, md5(upper(seq)) as seq from contigs")
def _(x):
    path = scratch(x.spark)
    body = F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")
    x("contigs").select(F.concat(F.lit(">"), "contig_id", F.lit(" len="), F.length("seq"), F.lit("\n"), body).alias("value")).write.option("compression", "gzip").text(path)
    return S.read_sequences(x.spark, path, upper=True).select("id", F.md5(F.col("seq").cast("binary")).alias("seq"))


@query("s3_read_taxonomy", "select gca, max(speci) as speci, label || ' strain' as label from taxonomy group by gca, label")
def _(x):
    t = x("taxonomy")
    lines = t.select(F.lit(0).alias("o"), "gca", F.concat_ws("\t", "gca", F.lit("old"), F.lit("1"), F.lit("x")).alias("value")).union(t.select(F.lit(1), "gca", F.concat_ws("\t", "gca", "speci", F.lit("1"), "label", F.lit("strain"))))
    lines = lines.union(t.limit(1).select(F.lit(2), "gca", F.lit("# note")))
    return S.taxonomy(S.numbered(x.spark, in_order(x, lines, "o", "gca")))


@query("s4_validate_columns", "select count(*) as n_lines, count(*) filter (where doc_id%4=0) as n_short from documents")
def _(x):
    d = x.table("documents").select(F.when(F.col("doc_id") % 4 == 0, "a\tb\tc").otherwise("a\tb\tc\td").alias("value"))
    return S.validate_columns(x.spark.read.text(written(x, d)))


@query("s5_read_pairs", "select a, b, ani, af_ref, af_query from pairs where cast(a as bigint)%10<>0")
def _(x):
    p, path = x("pairs"), scratch(x.spark)
    ani = F.when(F.col("a").cast("bigint") % 10 == 0, "n/a").otherwise(F.col("ani").cast("string"))
    p.select(F.col("a").alias("Ref_file"), F.col("b").alias("Query_file"), ani.alias("ANI"), F.col("af_ref").alias("Align_fraction_ref"), F.col("af_query").alias("Align_fraction_query")).write.csv(path, sep="\t", header=True)
    return S.read_pairs(x.spark, path)[1]


@query("s5b_pair_names", "select a as name from pairs union select b from pairs")
def _(x):
    return S.split_pairs(x("pairs").select(F.col("a").alias("Ref_file"), F.col("b").alias("Query_file"), F.lit("x").alias("ANI"), F.lit("1").alias("Align_fraction_ref"), F.lit("1").alias("Align_fraction_query")))[0]


@query("s6_read_membership", "select member, arg_max(rep,ord) as rep from membership group by member")
def _(x):
    lines = x("membership").select("ord", F.concat_ws("\t", "rep", F.concat(F.lit(" "), "member")).alias("value"))
    return S.membership(S.numbered(x.spark, in_order(x, lines, "ord")))


def group_lines(x: Inputs):
    token = F.concat("sign", "member")
    df = x("duplicates").groupBy("group_no").agg(F.array_join(F.array_sort(F.collect_list(token)), " ").alias("value"))
    blank = df.limit(1).select(F.lit(-1).cast("bigint").alias("group_no"), F.lit("  ").alias("value"))
    return S.numbered(x.spark, in_order(x, df.union(blank), "group_no"))


@query("s7_read_duplicate_groups", "select distinct dense_rank() over (order by group_no) as group_no, member from duplicates")
def _(x):
    return S.duplicate_groups(group_lines(x))


@query("s8_read_orientation", "select member, arg_max(sign,group_no) as sign from duplicates group by member")
def _(x):
    return S.orientation(group_lines(x))


@query("s9_read_manifest", "select genome_key, arg_max(status,ord) as status from manifest group by genome_key")
def _(x):
    path, m = scratch(x.spark), x("manifest")
    S.append_manifest(m.where(F.col("ord") % 2 == 0), path)
    S.append_manifest(m.where(F.col("ord") % 2 == 1), path)
    return S.last_status(x.spark.read.csv(path, sep="\t", schema="genome_key string, ord long, status string"))


@query("s10_read_table", "select mge_id, start_pos, case when doc_id%4=0 then null else mge end as mge from elements")
def _(x):
    path = scratch(x.spark)
    S.write_table(x("elements").select("mge_id", "start_pos", F.when(F.col("doc_id") % 4 != 0, F.col("mge")).alias("mge")), path)
    return S.read_table(x.spark, path, "mge_id string, start_pos long, mge string")


def tree(x: Inputs) -> str:
    path = scratch(x.spark)
    d = F.col("doc_id")
    group = F.when(d % 5 == 0, "singleton").otherwise(F.concat(F.lit("duplicate_group_"), (d % 3).cast("string")))
    S.write_flanks(x("stacks").select(F.col("unit").alias("rec_type"), (d % 4).alias("cluster_number"), group.alias("group_dir"), d.cast("string").alias("mge_id"), "side", "seq"), path)
    return path


@query("s11_read_flank_tree", "select cast(doc_id as string) as mge_id, side, doc_id%3 as group_no from stacks where doc_id%5<>0 and unit in ('src1','src2')")
def _(x):
    return S.read_flank_tree(x.spark, tree(x), "src1, src2").select("mge_id", "side", "group_no")


@query("s12_write_flanks", "select unit as rec_type, doc_id%4 as cluster_number, count(*) as n from stacks group by 1,2")
def _(x):
    return S.read_flank_tree(x.spark, tree(x), singletons=True).groupBy("rec_type", "cluster_number").agg(F.count("*").alias("n"))


@query("s13_write_table", "select gene_id, recombinase from genes")
def _(x):
    path = scratch(x.spark)
    S.write_table(x("genes").select("gene_id", "recombinase"), path)
    return S.read_table(x.spark, path, "gene_id string, recombinase string")


@query("s14_write_sequences", "select id, md5(min(seq)) as seq from strands group by id")
def _(x):
    path, s = scratch(x.spark), x("strands")
    S.write_sequences(s.union(s).select("id", "seq"), path, "gzip")
    return S.read_sequences(x.spark, path).select("id", F.md5(F.col("seq").cast("binary")).alias("seq"))


@query("s15_read_position_scores", "select doc_id, case when doc_id%2=0 then 'DDE_1' else 'DDE' end as rec_type, concat('MGE_',cast(doc_id as string)) as mge_id, case when doc_id%3=0 then 'left' else 'right' end as side from documents where doc_id%7<>0")
def _(x):
    d = F.col("doc_id")
    kind = F.when(d % 2 == 0, "DDE_1").otherwise("DDE")
    side = F.when(d % 7 == 0, "middle").when(d % 3 == 0, "left").otherwise("right")
    rows = x.table("documents").select("doc_id", F.concat(F.concat_ws("_", kind, F.lit("MGE"), d.cast("string"), side), F.lit(".tsv")).alias("name"))
    types = rows.select(F.explode(F.array(F.lit("DDE"), F.lit("DDE_1"))).alias("rec_type")).distinct()
    return S.position_scores(rows, types).select("doc_id", "rec_type", "mge_id", "side")


