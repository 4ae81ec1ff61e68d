"""Queries of scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.catalog import query
from spanwright.functions import expr as E
from spanwright.operators import filters as FI

#: Twin of attribute maps: items with ``=``, split at the first one, the last of a key wins.
ATTRS = """numbered as (select id, trim(unnest(string_split(a,';'))) as item, generate_subscripts(string_split(a,';'),1) as n from src),
    kv as (select id, substring(item,1,instr(item,'=')-1) as k, substring(item,instr(item,'=')+1) as v, n from numbered where instr(item,'=')>0),
    best as (select id, k, arg_max(v,n) as v from kv group by id,k)"""
ATTRS_HEAD = """numbered as (select id, unnest(string_split_regex(a,'[;\\s]+')) as item, generate_subscripts(string_split_regex(a,'[;\\s]+'),1) as n from src),
    kv as (select id, trim(lower(substring(item,1,instr(item,'=')-1))) as k, trim(substring(item,instr(item,'=')+1)) as v, n from numbered where instr(item,'=')>0),
    best as (select id, k, arg_max(v,n) as v from kv group by id,k)"""
COUNTS = """bag_items as (select id, trim(unnest(string_split(a,','))) as item from src),
    bag as (select id, trim(split_part(item,':',1)) as k, coalesce(try_cast(trim(split_part(item,':',2)) as int),1) as n from bag_items where item<>''),
    counts as (select id, k, sum(n)::bigint as n from bag group by id,k)"""
MESSY = "concat(mge,',,ce:',cast(doc_id%3 as string),', phage:x ,',mge)"


def _with(src: str, more: str, body: str) -> str:
    return f"select * from (with src as ({src}), {more} {body})"


@query("p1_attr_map", _with("select mge_id as id, attrs as a from elements", ATTRS, "select id as mge_id, string_agg(concat(k,'=',v),';' order by concat(k,'=',v)) as attrs from best group by id"))
def _(x):
    return x("elements").select("mge_id", E.render_map(E.attr_map("attrs")).alias("attrs"))


@query("p2_type_counts", _with(f"select mge_id as id, {MESSY} as a from elements", COUNTS, "select id as mge_id, string_agg(concat(k,'=',n::string),';' order by concat(k,'=',n::string)) as counts from counts group by id"))
def _(x):
    return x("elements").select("mge_id", E.render_map(E.type_counts(F.expr(MESSY))).alias("counts"))


@query("p3_type_count", _with(f"select mge_id as id, {MESSY} as a from elements", COUNTS, "select id as mge_id, coalesce(sum(n) filter (where k='ce'),0)::bigint as ce, sum(n)::bigint as total from counts group by id"))
def _(x):
    c = E.type_counts(F.expr(MESSY))
    return x("elements").select("mge_id", E.type_count(c, "ce").alias("ce"), E.total_count(c).alias("total"))


HEADER = "concat('>',mge_id,' MGE=',upper(mge),';Mge_Type=',mge_type,' note flag;mge=',mge)"


@query("p4_header_attrs", _with(f"select mge_id as id, substring({HEADER},2) as a from elements", ATTRS_HEAD, "select id as mge_id, string_agg(concat(k,'=',v),';' order by concat(k,'=',v)) as attrs from best group by id"))
def _(x):
    return x("elements").select("mge_id", E.render_map(E.header_attrs(F.expr(HEADER))).alias("attrs"))


@query("p5_header_type_fields", f"select mge_id, regexp_extract(lower({HEADER}),'(^|[>;\\s])mge=([^;\\s]+)',2) as mge, regexp_extract(lower({HEADER}),'(^|[>;\\s])mge_type=([^;\\s]+)',2) as mge_type from elements")
def _(x):
    mge, kind = E.header_type_fields(F.expr(HEADER))
    return x("elements").select("mge_id", mge.alias("mge"), kind.alias("mge_type"))


IDS = "case doc_id%4 when 0 then replace(mge_id,'GCA','GCF') when 1 then 'MGE_GCA' when 2 then mge_id else mge_id end"


@query("p6_accession_of", f"select mge_id, case when split_part({IDS},'_',2)='GCA' and len(string_split({IDS},'_'))>2 then concat('GCA_',split_part({IDS},'_',3)) end as gca from elements")
def _(x):
    return x("elements").select("mge_id", E.accession_of(F.expr(IDS)).alias("gca"))


@query("p7_genome_key_of_id", f"select mge_id, case when regexp_matches(split_part({IDS},'_',4),'^[0-9]+\\.') then concat(split_part(split_part({IDS},'_',4),'.',1),'.',split_part(split_part({IDS},'_',4),'.',2)) end as genome_key from elements")
def _(x):
    return x("elements").select("mge_id", E.genome_key_of_id(F.expr(IDS)).alias("genome_key"))


@query("p8_genome_key_of_contig", "select contig_id, lower(concat(split_part(contig_id,'.',1),'.',split_part(contig_id,'.',2))) as low, concat(split_part(contig_id,'.',1),'.',split_part(contig_id,'.',2)) as kept from contigs")
def _(x):
    return x("contigs").select("contig_id", E.genome_key_of_contig("contig_id").alias("low"), E.genome_key_of_contig("contig_id", True).alias("kept"))


@query("p9_revcomp", "select contig_id, md5(reverse(translate(seq,'ACGTNacgtn','TGCANtgcan'))) as rc from contigs")
def _(x):
    return x("contigs").select("contig_id", F.md5(E.revcomp("seq").cast("binary")).alias("rc"))


@query("p10_interval_substring", "select mge_id, md5(substring(seq,start_pos,end_pos-start_pos+1)) as body from elements join contigs using(contig_id)")
def _(x):
    df = x("elements").join(x("contigs").select("contig_id", "seq"), "contig_id")
    return df.select("mge_id", F.md5(E.interval_substring("seq", F.col("start_pos"), F.col("end_pos")).cast("binary")).alias("body"))


@query("p11_flank_windows", "select mge_id, greatest(0,start_pos-1+30-500)::bigint as ls, least(start_pos-1+30,length(seq))::bigint as le, greatest(0,end_pos-30)::bigint as rs, least(length(seq),end_pos-30+500)::bigint as re from elements join contigs using(contig_id)")
def _(x):
    df = x("elements").join(x("contigs").select("contig_id", "seq"), "contig_id")
    return df.select("mge_id", *(c.cast("bigint").alias(n) for n, c in zip(("ls", "le", "rs", "re"), E.flank_windows(F.col("start_pos"), F.col("end_pos"), F.length("seq"), 500, 30), strict=True)))


LEFT, RIGHT = "substring(seq,1,60)", "substring(seq,100,70)"


@query("p12_orient_flanks", f"select contig_id, case when doc_id%2=0 then reverse(translate({RIGHT},'ACGT','TGCA')) else {LEFT} end as l, case when doc_id%2=0 then reverse(translate({LEFT},'ACGT','TGCA')) else {RIGHT} end as r, md5(case when doc_id%2=0 then reverse(translate(seq,'ACGT','TGCA')) else seq end) as body from contigs")
def _(x):
    sign = F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-")
    left, right = E.orient_flanks(F.expr(LEFT), F.expr(RIGHT), sign)
    return x("contigs").select("contig_id", left.alias("l"), right.alias("r"), F.md5(E.orient_body(F.col("seq"), sign).cast("binary")).alias("body"))


@query("p13_strip_overlap", "select doc_id, case when length(seq)<=30 then '' when side='left' then substring(seq,1,length(seq)-30) else substring(seq,31) end as seq from stacks")
def _(x):
    return x("stacks").select("doc_id", E.strip_overlap("seq", "side", 30).alias("seq"))


@query("p14_anchor", "select doc_id, case when side='left' then right(seq,12) else left(seq,12) end as a, left(seq,12) as b from stacks")
def _(x):
    return x("stacks").select("doc_id", E.anchor("seq", "side", 12).alias("a"), E.anchor("seq", "side", 12, False).alias("b"))


@query("p15_motif_match", "select contig_id, regexp_matches(seq,'GG...TG') or regexp_matches(reverse(translate(seq,'ACGT','TGCA')),'GG...TG') as a, regexp_matches(seq,'GGC..TG') or regexp_matches(reverse(translate(seq,'ACGT','TGCA')),'GGC..TG') as b from contigs")
def _(x):
    return x("contigs").select("contig_id", E.motif_match("seq", "GGnnnTG").alias("a"), E.motif_match("seq", "GGCnnTG").alias("b"))


@query("p16_group_dir", "select doc_id, case when doc_id%3=0 then 'singleton' when doc_id%5=0 then 'singleton' else concat('duplicate_group_',cast(doc_id%7 as string)) end as d from documents")
def _(x):
    d = F.col("doc_id")
    return x.table("documents").select("doc_id", E.group_dir(F.when(d % 5 != 0, d % 7), F.when(d % 3 == 0, "yes").otherwise("no")).alias("d"))


@query("p17_variant_matches", "select mge_id, mge_type='nested' as nested, mge_type='non-nested' as non_nested, true as merged from elements")
def _(x):
    return x("elements").select("mge_id", *(E.variant_matches(F.col("mge_type"), v).alias(v) for v in ("nested", "non_nested", "merged")))


@query("p18_rec_type_subset", "select gene_id from genes where recombinase in ('Tnp_1','Tnp_3')")
def _(x):
    return x("genes").where(E.rec_type_subset(F.col("recombinase"), "Tnp_1, Tnp_3")).select("gene_id")


@query("p19_dynamic_threshold", "select unit, side, case when count(*)<=20 then cast(0.9 as double) else cast(0.7 as double) end as t from stacks group by unit, side")
def _(x):
    return x("stacks").groupBy("unit", "side").agg(F.count("*").alias("n")).select("unit", "side", E.dynamic_threshold(F.col("n"), 0.9, 0.7, 20).alias("t"))


@query("p20_dynamic_run_len", "select unit, side, cast(case when count(*)<=20 then 1 else 2 end as bigint) as run from stacks group by unit, side")
def _(x):
    return x("stacks").groupBy("unit", "side").agg(F.count("*").alias("n")).select("unit", "side", E.dynamic_run_len(F.col("n"), 2, 20).alias("run"))


@query("p21_resolve_species", "select mge_id, coalesce(speci, '__unresolved_gca__:' || e.gca) as species from elements e left join taxonomy t on e.gca=t.gca")
def _(x):
    df = x("elements").join(x("taxonomy").select("gca", "speci"), "gca", "left")
    return df.select("mge_id", E.resolve_species(F.col("speci"), F.col("mge_id")).alias("species"))


@query("p22_nearest_tier", "select doc_id, case when abs(prediction-0.3::double)<=abs(prediction-0.7::double) then 0.3::double when abs(prediction-0.7::double)<=abs(prediction-1.0::double) then 0.7::double else 1.0::double end as tier from predictions")
def _(x):
    return x("predictions").select("doc_id", E.nearest_tier(F.col("prediction")).alias("tier"))


@query("p23_one_hot", "select doc_id, array_to_string(list_transform(['A','C','G','T'], lambda b: array_to_string(list_transform(range(1,601), lambda i: case when substring(seq,i::int,1)=b then '1' else '0' end),'')),' ') as hot from stacks")
def _(x):
    rows = F.transform(E.one_hot("seq", 600), lambda row: F.array_join(F.transform(row, lambda v: v.cast("int").cast("string")), ""))
    return x("stacks").select("doc_id", F.array_join(rows, " ").alias("hot"))


@query("p24_model_orientation", "select doc_id, case when side='left' then reverse(translate(seq,'ACGT','TGCA')) else seq end as seq from stacks")
def _(x):
    return x("stacks").select("doc_id", E.model_orientation("seq", "side").alias("seq"))


@query("p25_flip_segment", "select doc_id, case when side='left' then length(seq)-(doc_id%9+5) else doc_id%9 end as s from stacks")
def _(x):
    return x("stacks").select("doc_id", E.flip_segment(F.col("doc_id") % 9, F.lit(5), F.length("seq"), F.col("side")).alias("s"))


@query("p26_score_magnitude", "select vec_id, round(abs(embedding[1]::double)+abs(embedding[2]::double)+abs(embedding[3]::double)+abs(embedding[4]::double),9) as m from embeddings")
def _(x):
    v = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    return x.table("embeddings").select("vec_id", F.round(E.score_magnitude(*v), 9).alias("m"))


@query("p27_soft_label", """select contig_id, case when length(seq)>500 and regexp_matches(seq,'GGGG') then 1.0::double when length(seq)>500 and regexp_matches(reverse(translate(seq,'ACGT','TGCA')),'GGGG') then 1.0::double when length(seq)>500 then 0.7::double else 0.3::double end as label,
    case when doc_id%11=0 then 'no_alignment_file' when doc_id%7=0 then 'no_sequence_outside_overlap' when length(seq)<=500 then 'no_segment_in_length_bucket'
    else (case when regexp_matches(seq,'GGGG') or regexp_matches(reverse(translate(seq,'ACGT','TGCA')),'GGGG') then 'found_literature_match_' else 'found_no_literature_match_' end) || (case when doc_id%2=0 then 'trailing_at_boundary' else 'closed_segment' end) end as reason from contigs""")
def _(x):
    d, found, matched = F.col("doc_id"), F.length("seq") > 500, E.motif_match("seq", "GGGG")
    reason = E.label_reason(d % 11 != 0, d % 7 != 0, found, matched, d % 2 == 0)
    return x("contigs").select("contig_id", E.soft_label(found, matched).cast("double").alias("label"), reason.alias("reason"))


@query("p28_length_bucket", "select doc_id, case when doc_id%30<4 then 'under_4' when doc_id%30>4 and doc_id%30<20 then '4_to_20' when doc_id%30>20 then 'over_20' end as b from documents")
def _(x):
    return x.table("documents").select("doc_id", E.length_bucket(F.col("doc_id") % 30).alias("b"))


@query("f1_target_islands", "select mge_id from elements where regexp_matches(mge,'(^|,)is_tn') and mge_type='non-nested'")
def _(x):
    return FI.target_islands(x("elements"), "is_tn").select("mge_id")


@query("f2_target_gene_sequences", "select mge_id from elements where regexp_matches(mge,'(^|,)ce') and mge_type='non-nested'")
def _(x):
    head = F.concat(F.lit(">"), "mge_id", F.lit(" MGE="), F.upper("mge"), F.lit(";mge_type="), "mge_type")
    return FI.target_gene_sequences(x("elements").select("mge_id", head.alias("header")), "ce").select("mge_id")


@query("f3_recombinase_genes", "select gene_id, recombinase from genes where recombinase is not null")
def _(x):
    return FI.recombinase_genes(x("genes")).select("gene_id", "recombinase")


@query("f4_accept_pairs", "select a, b, case when ani<99.6 then 'ani' when af_ref<90 or af_query<90 then 'fraction' end as reason from pairs")
def _(x):
    return x("pairs").select("a", "b", FI.pair_verdict(99.6, 90.0).alias("reason"))


@query("f5_contained_in", "select gene_id from genes g join elements e on g.parent=e.mge_id where g_start>=e.start_pos and g_end<=e.end_pos")
def _(x):
    e = x("elements").select(F.col("mge_id").alias("parent"), "start_pos", "end_pos")
    return x("genes").join(e, "parent").where(FI.contained_in()).select("gene_id")


@query("f6_valid_coords", "select mge_id from elements join contigs using(contig_id) where start_pos-20>=1 and end_pos+50<=length(seq)")
def _(x):
    df = x("elements").join(x("contigs").select("contig_id", "seq"), "contig_id")
    return df.where(FI.valid_coords(F.col("start_pos") - 20, F.col("end_pos") + 50, F.length("seq"))).select("mge_id")


@query("f7_empty_extract_guard", "select (select count(*) from elements) as n_islands, (select count(*) from genes where recombinase='none') as n_sequences, (select count(*) from elements)>0 as alarm")
def _(x):
    return FI.empty_extract_guard(x("elements"), x("genes").where(F.col("recombinase") == "none"))
