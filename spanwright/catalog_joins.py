"""Queries of joins, clusters, groups, counts and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.catalog import Inputs, query
from spanwright.functions import expr as E
from spanwright.operators import aggregates as A
from spanwright.operators import chain as CH
from spanwright.operators import consensus as C
from spanwright.operators import graph as G
from spanwright.operators import joins as J
from spanwright.operators import similarity as K
from spanwright.operators import windows as WI
from spanwright.operators.stars import aligned_counts, star_alignment
from spanwright.sources import tables as S

ISLANDS = "(select mge_id, regexp_matches(mge,'(^|,)is_tn') and mge_type='non-nested' as is_target from elements) i"
SEQUENCED = "(select gene_id from genes where g_start>=1)"
#: Representative genomes: the least of each component of links between genomes.
KEPT_GENOMES = """(with recursive e as (select a, b from genome_links union select b, a from genome_links), r(id, c) as (select a, a from e union select e.b, r.c from r join e on e.a=r.id) select c as genome_key from (select id, min(c) as c from r group by id) q group by c)"""
TABLE_A = f"""(select e.mge_id, e.gca, start_pos as mge_start, end_pos as mge_end, cast(case when e.doc_id%6=0 then 9 else e.doc_id%4 end as varchar) as n_genes, '1' as "mgeR", gene_id as recombinase_id, g_start as recombinase_start, g_end as recombinase_end,
    recombinase as recombinase_type, g.doc_id*3+g.k as ord from elements e join genes g on g.parent=e.mge_id where recombinase is not null and g_start>=start_pos and g_end<=end_pos and e.genome_key in {KEPT_GENOMES})"""
REPS = "(select member, arg_max(rep,ord) as rep from membership group by member)"
TABLE_B0 = f"""(select a.*, case when r.rep is not null then a.recombinase_id else m.rep end as rep,
    case when r.rep is not null then concat('+|',a.recombinase_id) when m.rep is not null then concat('-|',m.rep) end as is_representative
    from {TABLE_A} a left join (select distinct rep from membership) r on r.rep=a.recombinase_id left join {REPS} m on m.member=a.recombinase_id)"""
TABLE_B = f"""(select b.*, n.cluster_number, t.speci from {TABLE_B0} b left join (select recombinase_type, rep, row_number() over (partition by recombinase_type order by min(ord), rep)::bigint as cluster_number
    from {TABLE_B0} where rep is not null group by recombinase_type, rep) n on n.recombinase_type=b.recombinase_type and n.rep=b.rep left join taxonomy t on t.gca=b.gca)"""
LAST = "(select member, max(group_no)::bigint as group_no from duplicates group by member)"
TABLE_C = f"""(select b.*, d.group_no as duplicate_group_number, case when d.group_no is null then 'yes' else 'no' end as singleton from {TABLE_B} b left join {LAST} d on d.member=b.mge_id)"""
COMPONENTS = """(with recursive e as (select src as a, dst as b from edges union select dst, src from edges), r(id, c) as (select a, a from e union select e.b, r.c from r join e on e.a=r.id) select id, min(c) as component from r group by id)"""


def islands(x: Inputs):
    e = x("elements")
    return e.select("mge_id", (F.map_contains_key(E.type_counts("mge"), "is_tn") & (F.col("mge_type") == "non-nested")).alias("is_target"))


def table_a(x: Inputs):
    def make():
        genomes = G.connected_components(x("genome_links"), "a", "b").groupBy("component").agg(F.min("id").alias("genome_key"))
        return J.element_gene_table(x.keep("elements"), x.keep("genes"), genomes, x("genes").where(F.col("g_start") >= 1))

    return x.keep("table_a", make)


def members(x: Inputs):
    m = x("membership")
    return m.groupBy("member").agg(F.max_by("rep", "ord").alias("rep"))


def table_b(x: Inputs):
    marked = lambda: J.append_clusters(table_a(x), members(x))
    return x.keep("table_b", lambda: J.append_species(WI.cluster_number(x.keep("table_b0", marked)), x("taxonomy")))


def table_c(x: Inputs):
    return x.keep("table_c", lambda: J.append_duplicates(table_b(x), x("duplicates")))


@query("j1_classify_genes", f"select gene_id, case when i.is_target is null then 'orphan' when i.is_target then 'target' else 'other' end as class from genes g left join {ISLANDS} on i.mge_id=g.parent")
def _(x):
    return J.classify_genes(x("genes"), islands(x)).select("gene_id", "class")


@query("j2_extract_gene_sequences", """select gene_id, case when g_start-40<1 or g_end<g_start-40 then 'bad_coords' when g.doc_id%9=0 then 'no_genome' when c.doc_id%5=0 then 'no_contig' end as reason,
    case when not (g_start-40<1 or g_end<g_start-40 or g.doc_id%9=0 or c.doc_id%5=0) then md5(substring(c.seq,g_start-40,g_end-(g_start-40)+1)) end as seq from genes g join contigs c on c.contig_id=g.contig_id""")
def _(x):
    genes = x("genes").withColumn("g_start", F.col("g_start") - 40).withColumn("genome_key", F.when(F.col("doc_id") % 9 == 0, F.lit("none")).otherwise(F.col("genome_key")))
    contigs = x("contigs").where(F.col("doc_id") % 5 != 0)
    out = J.extract_gene_sequences(genes, x("contigs").select("genome_key"), contigs)
    return out.select("gene_id", "reason", F.md5(F.col("gene_seq").cast("binary")).alias("seq"))


@query("j3_assign_species", """select k.genome_key, a.gca, t.speci, case when a.gca is null then 'no_gca' when t.speci is null then 'no_specI' end as reason from (select distinct genome_key from contigs) k
    left join (select genome_key, arg_min(gca,doc_id) as gca from contigs where g%5<>0 group by genome_key) a on a.genome_key=k.genome_key left join taxonomy t on t.gca=a.gca""")
def _(x):
    acc = x("contigs").where(F.col("g") % 5 != 0).select("genome_key", "gca", F.col("doc_id").alias("ord"))
    return J.assign_species(x("contigs"), acc, x("taxonomy")).select("genome_key", "gca", "speci", "reason")


@query("j4_element_gene_table", f"select * from {TABLE_A} a")
def _(x):
    return table_a(x)


@query("j5_append_clusters", f"select recombinase_id, is_representative, rep from {TABLE_B0} b")
def _(x):
    return J.append_clusters(table_a(x), members(x)).select("recombinase_id", "is_representative", "rep")


@query("j6_append_species", f"select recombinase_id, speci from {TABLE_B} b")
def _(x):
    return J.append_species(table_a(x), x("taxonomy")).select("recombinase_id", "speci")


@query("j7_append_duplicates", f"select recombinase_id, duplicate_group_number, singleton, (select count(distinct mge_id) from {TABLE_C} z where z.duplicate_group_number=c.duplicate_group_number) * case when singleton='no' then 1 end as duplicate_group_size from {TABLE_C} c")
def _(x):
    return table_c(x).select("recombinase_id", "duplicate_group_number", "singleton", "duplicate_group_size")


FLANKS = """(select e.mge_id, e.doc_id, case when p.rec_type is null then 'no_placement' when e.doc_id%19=0 then 'no_genome' when c.doc_id%23=0 then 'no_contig' when start_pos<1 or end_pos>length(seq) then 'bad_coords' end as reason,
    substring(seq,greatest(0,start_pos-1+30-500)+1,greatest(0,least(start_pos-1+30,length(seq))-greatest(0,start_pos-1+30-500))) as l, substring(seq,greatest(0,end_pos-30)+1,greatest(0,least(length(seq),end_pos-30+500)-greatest(0,end_pos-30))) as r,
    coalesce(s.sign,'-') as sign, p.rec_type, length(seq) as size, substring(seq,start_pos::int,(end_pos-start_pos+1)::int) as body, least(start_pos-1+30,length(seq))-greatest(0,start_pos-1+30-500)<500 as sl, least(length(seq),end_pos-30+500)-greatest(0,end_pos-30)<500 as sr from elements e left join (select parent, arg_min(recombinase,k) as rec_type from genes where recombinase is not null group by parent) p on p.parent=e.mge_id
    left join contigs c on c.contig_id=e.contig_id left join (select member, arg_max(sign,group_no) as sign from duplicates group by member) s on s.member=e.mge_id)"""
ORIENTED = f"""(select mge_id, rec_type, reason, case when reason is null then case when sign='+' then reverse(translate(r,'ACGT','TGCA')) else l end end as l,
    case when reason is null then case when sign='+' then reverse(translate(l,'ACGT','TGCA')) else r end end as r,
    case when reason is null then case when sign='+' then reverse(translate(body,'ACGT','TGCA')) else body end end as body, reason is null and sl as short_left, reason is null and sr as short_right from {FLANKS} f)"""


def flanks(x: Inputs):
    e = x.keep("elements").withColumn("genome_key", F.when(F.col("doc_id") % 19 == 0, F.lit("none")).otherwise(F.col("genome_key")))
    placement = x.keep("genes").where(F.col("recombinase").isNotNull()).groupBy(F.col("parent").alias("mge_id")).agg(F.min_by("recombinase", "k").alias("rec_type"))
    signs = x("duplicates").groupBy("member").agg(F.max_by("sign", "group_no").alias("sign"))
    return J.extract_flanks(e, placement, x("contigs").select("genome_key"), x("contigs").where(F.col("doc_id") % 23 != 0), signs)


@query("j8_extract_flanks", f"select mge_id, rec_type, reason, md5(l) as l, md5(r) as r, md5(body) as body, short_left, short_right from {ORIENTED} o")
def _(x):
    return flanks(x).select("mge_id", "rec_type", "reason", F.md5(F.col("left").cast("binary")).alias("l"), F.md5(F.col("right").cast("binary")).alias("r"), F.md5(F.col("body").cast("binary")).alias("body"), "short_left", "short_right")


@query("j9_append_flanks", f"select recombinase_id, s.side, md5(case when s.side='left' then l else r end) as flank from {TABLE_A} a cross join (select unnest(['left','right']) as side) s left join {ORIENTED} o on o.mge_id=a.mge_id")
def _(x):
    return J.append_flanks(table_a(x), flanks(x)).select("recombinase_id", "side", F.md5(F.col("flank_sequence").cast("binary")).alias("flank"))


RESULTS = f"""(select recombinase_type as rec_type, cluster_number, side, case when q=0 then 'alignment' else 'stacking' end as consensus_source, min(mge_id) as consensus_sequence, count(*)::bigint as consensus_length
    from {TABLE_C} c cross join (select unnest(['left','right']) as side) s cross join (select unnest([0,1]) as q) z where cluster_number is not null and (cluster_number+q)%3<>0 group by all)"""


def results(x: Inputs):
    df = table_c(x).where(F.col("cluster_number").isNotNull()).withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right")))).withColumn("q", F.explode(F.array(F.lit(0), F.lit(1))))
    df = df.where((F.col("cluster_number") + F.col("q")) % 3 != 0).groupBy(F.col("recombinase_type").alias("rec_type"), "cluster_number", "side", "q")
    df = df.agg(F.min("mge_id").alias("consensus_sequence"), F.count("*").alias("consensus_length"))
    source = F.when(F.col("q") == 0, "alignment").otherwise("stacking")
    return df.select("rec_type", "cluster_number", "side", source.alias("consensus_source"), source.alias("method"), F.lit(0).cast("bigint").alias("consensus_start"), "consensus_length", "consensus_sequence")


@query("j10_append_consensus", f"""select c.recombinase_id, s.side, case when c.singleton='no' then b.consensus_source end as consensus_method, case when c.singleton='no' then b.consensus_length end as consensus_length,
    case when c.singleton='no' then b.consensus_sequence end as consensus_sequence from {TABLE_C} c cross join (select unnest(['left','right']) as side) s
    left join (select * from {RESULTS} r qualify row_number() over (partition by rec_type,cluster_number,side order by consensus_source desc)=1) b on b.rec_type=c.recombinase_type and b.cluster_number=c.cluster_number and b.side=s.side""")
def _(x):
    d = table_c(x).withColumnRenamed("recombinase_type", "rec_type").withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    return J.append_consensus(d, results(x)).select("recombinase_id", "side", "consensus_method", "consensus_length", "consensus_sequence")


@query("j10b_final_table", f"""select c.recombinase_id, s.side, c.cluster_number, c.speci, c.duplicate_group_number, c.singleton, z.n as duplicate_group_size, md5(case when s.side='left' then o.l else o.r end) as flank,
    case when c.singleton='no' then b.consensus_source end as consensus_method, case when c.singleton='no' then b.consensus_length end as consensus_length, case when c.singleton='no' then b.consensus_sequence end as consensus_sequence
    from {TABLE_C} c cross join (select unnest(['left','right']) as side) s left join {ORIENTED} o on o.mge_id=c.mge_id
    left join (select duplicate_group_number, count(distinct mge_id) as n from {TABLE_C} t group by 1) z on z.duplicate_group_number=c.duplicate_group_number
    left join (select * from {RESULTS} r qualify row_number() over (partition by rec_type,cluster_number,side order by consensus_source desc)=1) b on b.rec_type=c.recombinase_type and b.cluster_number=c.cluster_number and b.side=s.side""")
def _(x):
    """Tables a to e as one job, with one shuffle of each input by element."""
    df = CH.final_table(table_b(x), x("duplicates"), flanks(x), results(x), kept=x.tables)
    shown = ["recombinase_id", "side", "cluster_number", "speci", "duplicate_group_number", "singleton", "duplicate_group_size", "consensus_method", "consensus_length", "consensus_sequence"]
    return df.select(*shown, F.md5(F.col("flank_sequence").cast("binary")).alias("flank"))


@query("j12_pending_keys", "select distinct genome_key from contigs where genome_key not in (select genome_key from (select genome_key, arg_max(status,ord) as status from manifest group by genome_key) m where status in ('downloaded','skipped_exists'))")
def _(x):
    return J.pending_keys(x("contigs"), S.last_status(x("manifest")))


@query("w1_cluster_number", f"select recombinase_id, recombinase_type, cluster_number, is_representative, speci from {TABLE_B} b")
def _(x):
    return table_b(x).select("recombinase_id", "recombinase_type", "cluster_number", "is_representative", "speci")


@query("w2_first_row_per_key", f"select mge_id, arg_min(recombinase_id,ord) as recombinase_id from {TABLE_A} a group by mge_id")
def _(x):
    return WI.first_row_per_key(table_a(x).select("mge_id", "recombinase_id", "ord"), "mge_id", "ord").select("mge_id", "recombinase_id")


@query("w3_last_row_per_key", f"select mge_id, arg_max(recombinase_id,ord) as recombinase_id from {TABLE_A} a group by mge_id")
def _(x):
    return WI.last_row_per_key(table_a(x).select("mge_id", "recombinase_id", "ord"), "mge_id", "ord").select("mge_id", "recombinase_id")


@query("w14_sample_per_key", "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by md5(concat(cast(doc_id as string),':42')), doc_id) as r from documents) t where r<=3")
def _(x):
    return WI.sample_per_key(x.table("documents").select("source", "doc_id"), "source", "doc_id", 3, 42)


@query("a1_stage_counters", f"select coalesce(reason,'ok') as reason, count(*) as n from {FLANKS} f group by 1")
def _(x):
    return A.stage_counters(flanks(x))


@query("a2_instance_census", """select count(*) as n_rows, sum(case doc_id%5 when 1 then 3 when 4 then 2 else 1 end)::bigint as n_instances, count(distinct e.gca) as n_accessions, count(distinct speci) as n_species from elements e left join taxonomy t on t.gca=e.gca""")
def _(x):
    return A.instance_census(x("elements"), x("taxonomy"))


@query("a3_type_census", """select count(*) as n_rows, sum(case when doc_id%5=1 then 2 else 1 end)::bigint as n_instances, count(distinct e.gca) as n_accessions, count(distinct speci) as n_species, count(*) filter (where speci is null) as n_unmapped
    from elements e left join taxonomy t on t.gca=e.gca where doc_id%5<>3""")
def _(x):
    return A.type_census(x("elements"), x("taxonomy"), "is_tn")


@query("a4_species_of_ids", "select speci, count(distinct e.gca) as n_accessions, count(distinct mge_id) as n_ids from elements e left join taxonomy t on t.gca=e.gca group by speci")
def _(x):
    return A.species_of_ids(x("elements"), x("taxonomy"))


@query("a4b_accessions_of_species", "select distinct speci, label, e.gca from elements e join taxonomy t on t.gca=e.gca")
def _(x):
    return A.accessions_of_species(x("elements"), x("taxonomy"))


SPECIES_N = "(select speci, count(*) as n from taxonomy group by speci)"


@query("a5_genomes_per_species", f"""select max(n) as max_n, string_agg(speci,',' order by speci) filter (where n=(select max(n) from {SPECIES_N} a)) as max_species, min(n) as min_n,
    string_agg(speci,',' order by speci) filter (where n=(select min(n) from {SPECIES_N} b)) as min_species, median(n)::double as median_n, round(coalesce(stddev_samp(n),0),9) as sd_n, count(*) as n_species from {SPECIES_N} s""")
def _(x):
    return A.genomes_per_species(x("taxonomy").groupBy("speci").agg(F.count("*").alias("n"))).withColumn("sd_n", F.round("sd_n", 9))


@query("a5b_extreme_species", f"select 'max' as extreme, speci, n from {SPECIES_N} s where n=(select max(n) from {SPECIES_N} a) union all select 'min', speci, n from {SPECIES_N} s where n=(select min(n) from {SPECIES_N} a)")
def _(x):
    return A.extreme_species(x("taxonomy").groupBy("speci").agg(F.count("*").alias("n")))


@query("a6_top_species", f"select speci, n from {SPECIES_N} s order by n desc, speci limit 10")
def _(x):
    return A.top_species(x("taxonomy").groupBy("speci").agg(F.count("*").alias("n")), 10)


@query("a7_genes_per_element", f"""select (select count(*) from (select mge_id from {TABLE_B} b group by mge_id having count(*)>1) q) as n_multi, (select count(*) from (select mge_id from {TABLE_B} b group by mge_id having count(*)=1) q) as n_single,
    count(distinct recombinase_type) as n_types, count(distinct gca) as n_accessions, count(distinct speci) as n_species from {TABLE_B} b""")
def _(x):
    return A.genes_per_element(table_b(x))


@query("a8_cluster_summary", f"""select (select count(*) from (select distinct recombinase_type,cluster_number from {TABLE_B} b where cluster_number is not null) q) as n_clusters,
    (select count(*) from (select 1 from {TABLE_B} b where cluster_number is not null group by recombinase_type,cluster_number having count(*)=1) q) as n_singletons,
    (select count(*) from (select mge_id from {TABLE_B} b group by mge_id having count(cluster_number)=0) q) as n_without""")
def _(x):
    return A.cluster_summary(table_b(x))


@query("a9_clusters_by_type", f"""select b.recombinase_type, count(distinct cluster_number) as n_clusters, (select count(*) from (select recombinase_type as t from {TABLE_B} y where cluster_number is not null group by recombinase_type,cluster_number having count(*)=1) q where t=b.recombinase_type) as n_singletons,
    count(distinct mge_id) as n_elements from {TABLE_B} b group by b.recombinase_type""")
def _(x):
    return A.clusters_by_type(table_a(x), table_b(x))


@query("a10_duplicate_summary", f"""select count(distinct mge_id) as n_elements, count(distinct duplicate_group_number) as n_groups, count(distinct mge_id) filter (where singleton='yes') as n_singletons, count(distinct mge_id) filter (where singleton='no') as n_grouped from {TABLE_C} c""")
def _(x):
    return A.duplicate_summary(table_c(x))


@query("a11_groups_by_type", f"""select recombinase_type, count(distinct cluster_number) as n_clusters, count(distinct duplicate_group_number) as n_groups, count(distinct mge_id) filter (where singleton='yes') as n_singletons from {TABLE_C} c group by recombinase_type""")
def _(x):
    return A.groups_by_type(table_c(x))


@query("a12_group_size_histogram", "with h as (select size, count(*) as n from (select group_no, count(distinct member) as size from duplicates group by group_no) g group by size) select s.size::bigint as size, coalesce(n,0) as n from (select unnest(range((select min(size) from h),(select max(size) from h)+1)) as size) s left join h on h.size=s.size".replace("with h as", "select * from (with h as") + ")")
def _(x):
    return A.group_size_histogram(x("duplicates"))


@query("a13_cluster_size", f"select recombinase_id, case when cluster_number is not null then count(*) over (partition by recombinase_type,cluster_number) end as cluster_size from {TABLE_B} b")
def _(x):
    return WI.cluster_size(table_b(x)).select("recombinase_id", "cluster_size")


@query("a14_duplicate_group_size", f"select duplicate_group_number, count(distinct mge_id) as duplicate_group_size from {TABLE_C} c where singleton='no' group by 1")
def _(x):
    return table_c(x).where(F.col("singleton") == "no").select("duplicate_group_number", "duplicate_group_size").distinct()


@query("a15_type_conflicts", f"select mge_id, count(distinct recombinase_type) as n_types from {TABLE_A} a group by mge_id having count(distinct recombinase_type)>1")
def _(x):
    return A.type_conflicts(table_a(x))


@query("o1_order_by_type", f"select recombinase_type, recombinase_id from {TABLE_A} a order by recombinase_type, ord")
def _(x):
    return table_a(x).orderBy("recombinase_type", "ord").select("recombinase_type", "recombinase_id")


@query("o2_top_k_with_rest", "select speci, concat(array_to_string(list_sort(list(gca))[1:3],', '), case when count(*)>3 then concat(' (+',(count(*)-3)::string,' more)') else '' end) as ids from taxonomy group by speci")
def _(x):
    return WI.top_k_with_rest(x("taxonomy"), "speci", "gca", 3)


@query("o3_distinct_keys", "select distinct genome_key, split_part(genome_key,'.',1) as taxid from contigs")
def _(x):
    return x("contigs").select("genome_key", F.substring_index("genome_key", ".", 1).alias("taxid")).distinct()


@query("o4_union_ids", f"select mge_id from {TABLE_A} a union select mge_id from elements where doc_id%4=0")
def _(x):
    return table_a(x).select("mge_id").union(x("elements").where(F.col("doc_id") % 4 == 0).select("mge_id")).distinct()


@query("o5_sample_headers", "select source as file, cast(doc_id as string) as header from (select source, doc_id, row_number() over (partition by source order by doc_id) as r from documents) t where r<=2 order by source, r limit 10")
def _(x):
    d = x.table("documents").select(F.col("source").alias("file"), F.col("doc_id").cast("string").alias("header"), F.col("doc_id").alias("ord"))
    return WI.sample_headers(d)


@query("g1_connected_components", f"select * from {COMPONENTS} c")
def _(x):
    return G.connected_components(x("edges"))


@query("g2_pick_representatives", f"select component, min(cast(id as string)) as representative from {COMPONENTS} c group by component")
def _(x):
    return G.connected_components(x("edges")).groupBy("component").agg(F.min(F.col("id").cast("string")).alias("representative"))


KMERS = """(select speci, gca, least(kmer, reverse(translate(kmer,'ACGT','TGCA'))) as kmer, min(contig_id) as contig, min(pos) as pos, min((kmer<=reverse(translate(kmer,'ACGT','TGCA')))::int) as fwd from (select speci, c.gca, contig_id, unnest(range(1,length(seq)-13)) as pos, substring(seq,pos,15) as kmer
    from contigs c join taxonomy t on t.gca=c.gca where length(seq)>=15) z where substring(md5(least(kmer, reverse(translate(kmer,'ACGT','TGCA')))),1,1)='0' group by 1,2,3 having count(*)=1)"""


def covered(own: str, start: str, end: str) -> str:
    return f"""(select ref, query, sum(greatest(0,{end}-greatest({start}-1,coalesce(before,0)))) as covered from (select *, max({end}) over (partition by ref,query,{own} order by {start},{end} rows between unbounded preceding and 1 preceding) as before from chains) q group by 1,2)"""


@query("k1_pairwise_similarity", f"""select * from (with km as materialized {KMERS}, met as (select a.gca as ref, b.gca as query, a.contig as ca, b.contig as cb, case when a.fwd=b.fwd then 1 else -1 end as turn, a.pos, case when a.fwd=b.fwd then b.pos else -b.pos end as y from km a join km b on a.speci=b.speci and a.kmer=b.kmer and a.gca<b.gca),
    steps as (select *, case when y-lag(y) over w>0 and pos-lag(pos) over w<=500 and abs(pos-lag(pos) over w-(y-lag(y) over w))<=50 then 0 else 1 end as fresh from met window w as (partition by ref,query,ca,cb,turn order by pos)),
    chained as (select *, sum(fresh) over (partition by ref,query,ca,cb,turn order by pos) as chain from steps),
    chains as materialized (select ref, query, ca, cb, count(*) as n, min(pos) as a0, max(pos)+14 as a1, min(abs(y)) as b0, max(abs(y))+14 as b1 from chained group by ref,query,ca,cb,turn,chain having count(*)>=3),
    sizes as (select c.gca, c.size, k.n from (select c.gca, sum(length(seq)) as size from contigs c join taxonomy t on t.gca=c.gca group by 1) c join (select gca, count(*) as n from km group by 1) k on k.gca=c.gca)
    select t.ref, t.query, round(pow(least(1.0::double,greatest(anchors*sa.size::double/(a.covered*sa.n),anchors*sb.size::double/(b.covered*sb.n))),1.0/15)*100,9) as ani, round(100.0::double*a.covered/sa.size,9) as af_ref, round(100.0::double*b.covered/sb.size,9) as af_query
    from (select ref, query, sum(n) as anchors from chains group by 1,2) t join {covered("ca", "a0", "a1")} a on a.ref=t.ref and a.query=t.query join {covered("cb", "b0", "b1")} b on b.ref=t.ref and b.query=t.query join sizes sa on sa.gca=t.ref join sizes sb on sb.gca=t.query)""")
def _(x):
    df = x.keep("contigs").join(x("taxonomy").select("gca", "speci"), "gca").select("speci", F.col("gca").alias("genome"), "contig_id", "seq")
    out = K.pairwise_similarity(df)
    return out.select("ref", "query", *(F.round(c, 9).alias(c) for c in ("ani", "af_ref", "af_query")))


@query("k2_cluster_by_similarity")
def _(x):
    x.keep("contigs")
    return K.cluster_by_similarity(x("strands").select("id", "seq"))


@query("k3_strand_aware_duplicates", """select first_ord as group_no, id as member, case when seq<>first_seq then '+' else '-' end as sign, seq<>first_seq as flip from strands s join (select least(seq,reverse(translate(seq,'ACGT','TGCA'))) as form,
    arg_min(seq,ord) as first_seq, min(ord) as first_ord, count(*) as n from strands group by 1) f on f.form=least(s.seq,reverse(translate(s.seq,'ACGT','TGCA'))) where n>1""")
def _(x):
    return K.strand_aware_duplicates(x("strands"))


COUNTED = ", ".join(f"sum(length(seq)-length(replace(seq,'{c}','')))::bigint as n_{c.lower()}" for c in "ACGT")


def aligned(x: Inputs):
    return star_alignment(x("stacks"), ["unit", "side"])


@query("k4_aligned_stacks", f"select unit, side, count(*) as n, {COUNTED}, true as one_width from stacks group by unit, side")
def _(x):
    bases = {f"n_{c.lower()}": F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit("")))) for c in "ACGT"}
    one_width = F.min(F.length("seq")) == F.max(F.length("seq"))
    return aligned(x).groupBy("unit", "side").agg(F.count("*").alias("n"), *(c.alias(n) for n, c in bases.items()), one_width.alias("one_width"))


@query("k4b_alignment_rows", "select unit, side, ord, seq from stacks")
def _(x):
    """Aligned rows without their gaps are the raw ones."""
    return aligned(x).select("unit", "side", "ord", F.replace("seq", F.lit("-"), F.lit("")).alias("seq"))


@query("k4c_alignment_profile")
def _(x):
    return C.majority(aligned_counts(x("stacks"), ["unit", "side"]), ["unit", "side"])


@query("k4d_alignment_boundaries")
def _(x):
    keys = ["unit", "side"]
    counts = x.keep("aligned_counts", lambda: aligned_counts(x("stacks"), keys))
    right = counts.where(F.col("side") == "right")
    sizes = right.groupBy(*keys).agg((F.max("col") + 1).alias("size"))
    back = right.join(sizes, keys).withColumn("col", F.col("size") - 1 - F.col("col"))
    segments = C.segments_of_sides(C.majority(counts.where(F.col("side") == "left"), keys), C.majority(back, keys), sizes, keys, 0.5, 2)
    return C.boundary_segment(segments, keys)
