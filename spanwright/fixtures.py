"""Domain tables derived from the given tables, as SQL that Spark and DuckDB both run.

``@G`` stands for DuckDB's option to replace all matches, ``@K`` for a row of each k from 0 to doc_id%3.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

#: Letters by frequency to bases.
NT = "regexp_replace(upper(translate(lower(coalesce(text,'')),'etaoinshrdlucmfwypvbgkjqxz','ACGTACGTACGTACGTACGTACGTAC')),'[^ACGT]',''@G)"

SQL: dict[str, str] = {
    "contigs": f"""
        select doc_id, g, concat(cast(1000+g%40 as string),'.SAMN',lpad(cast(g as string),8,'0')) as genome_key,
          concat(cast(1000+g%40 as string),'.SAMN',lpad(cast(g as string),8,'0'),'.CTG',cast(doc_id as string)) as contig_id,
          concat('GCA_',lpad(cast(g as string),9,'0'),'.1') as gca, seq
        from (select doc_id, cast(floor(doc_id/3) as bigint) as g, {NT} as seq from documents) as x""",
    "elements": """
        select doc_id, g, genome_key, contig_id, gca, start_pos, end_pos, mge_id, mge, mge_type,
          concat('ID=',mge_id,';mge=',mge,';mge_type=',mge_type,';flag;n_genes=',cast(doc_id%4 as string),';mgeR=1',
            case when doc_id%6=0 then ';note=a=b;n_genes=9' else '' end) as attrs
        from (select *, concat('MGE_',gca,'_',contig_id,':',cast(start_pos as string),'-',cast(end_pos as string)) as mge_id,
          case doc_id%5 when 0 then 'is_tn:1' when 1 then 'is_tn:2,ce:1' when 2 then 'is_tn' when 3 then 'ce:1' else 'phage:1,is_tn:x' end as mge,
          case when doc_id%4=0 then 'nested' else 'non-nested' end as mge_type
        from (select *, 1+doc_id%50*4 as start_pos, length(seq)-doc_id%30*4 as end_pos from contigs where length(seq)>=400) as x) as y""",
    "genes": """
        select e.doc_id, k, concat(mge_id,'_g',cast(k as string)) as gene_id, contig_id, genome_key, start_pos+10+60*k as g_start,
          start_pos+10+60*k+150+case when e.doc_id%13=0 then 5000 else 0 end as g_end,
          case when e.doc_id%17=0 and k=2 then 'MGE_missing' else mge_id end as parent,
          case when (e.doc_id+k)%6=5 then null else concat('Tnp_',cast((e.doc_id+k)%6 as string)) end as recombinase
        from elements as e @K""",
    "taxonomy": """
        select gca, concat('specI_v4_',lpad(cast(g%25 as string),5,'0')) as speci, concat('species ',cast(g%25 as string)) as label
        from (select distinct gca, g from contigs) as x where g%11<>0""",
    "stacks": """
        select doc_id, unit, side, doc_id as ord, case when side='left' then concat(w,m) else concat(m,w) end as seq
        from (select c.doc_id, d.source as unit, m, case when c.doc_id%2=0 then 'left' else 'right' end as side,
            substring(seq,cast(greatest(1,floor(length(seq)/2)-250) as int),cast(500-c.doc_id%9 as int)) as w
          from contigs as c join (select doc_id, source, substring(translate(md5(source),'0123456789abcdef','ACGTACGTACGTACGT'),1,cast(4+length(source)*3 as int)) as m from documents) as d
            on c.doc_id=d.doc_id where length(seq)>=60) as x""",
    "lonely": """
        select doc_id, unit, side, ord, seq from stacks
        union all select doc_id, concat('only',cast(doc_id%7 as string)) as unit, 'left' as side, ord, substring(seq,1,cast(doc_id%9+3 as int)) as seq from stacks where doc_id%50<7""",
    "edges": """
        select a.doc_id as src, b.doc_id as dst from documents as a join documents as b on b.doc_id=a.doc_id+1+a.doc_id%7 where a.doc_id%3<>0""",
    "genome_links": """
        select distinct a.genome_key as a, b.genome_key as b from contigs as a join contigs as b on b.g=a.g+case when a.g%3=0 then 1 else 0 end""",
    "strands": """
        select contig_id as id, seq, doc_id as ord from contigs where length(seq)>0
        union all select concat(contig_id,'_rc') as id, reverse(translate(seq,'ACGT','TGCA')) as seq, doc_id+1000000000 as ord from contigs where doc_id%7=0 and length(seq)>0""",
    "duplicates": """
        select first_ord as group_no, mge_id as member, case when mge_ord%2=0 then '+' else '-' end as sign
        from (select mge_id, doc_id as mge_ord, min(doc_id) over (partition by floor(doc_id/20),mge) as first_ord,
          count(*) over (partition by floor(doc_id/20),mge) as n from elements) as x where n>1""",
    "membership": """
        select min(gene_id) over (partition by recombinase, h) as rep, gene_id as member, doc_id*3+k as ord
        from (select gene_id, recombinase, substring(md5(parent),1,1) as h, doc_id, k from genes where recombinase is not null and doc_id%19<>0) as x""",
    "pairs": """
        select cast(src as string) as a, cast(dst as string) as b, cast(99 as double)+cast(src%10 as double)/cast(5 as double) as ani, cast(85+dst%16 as double) as af_ref, cast(85+src%16 as double) as af_query
        from edges""",
    "label_rows": """
        select d.doc_id, d.lang as rec_type, d.doc_id%8 as cluster_number, cast(floor(d.doc_id/4) as bigint) as group_no,
          concat('MGE_',c.gca,'_',c.contig_id,':1-9') as mge_id, case when d.doc_id%2=0 then 'left' else 'right' end as side,
          cast(case when quality=1 and toxic=0 then 1.0 when quality=1 then 0.7 else 0.3 end as double) as label, c.gca
        from documents as d join labels as l on l.doc_id=d.doc_id join contigs as c on c.doc_id=d.doc_id""",
    "predictions": "select *, cast(doc_id*37%101 as double)/cast(100 as double) as prediction from label_rows",
    "manifest": """
        select genome_key, g as ord, case g%3 when 0 then 'downloaded' when 1 then 'skipped_exists' else 'failed_download' end as status
        from (select distinct genome_key, g from contigs) as x where g%4<>3
        union all select genome_key, g+1000000000 as ord, 'downloaded' as status from (select distinct genome_key, g from contigs) as y where g%12=2""",
    "train_log": """
        select epoch, cast(abs(epoch-5)*10+epoch%2 as double)/cast(10 as double) as val_loss from (select cast(l_linenumber as bigint) as epoch, count(*) as n from lineitem group by l_linenumber) as x""",
}


def needed(text: str, held: Collection[str] = ()) -> list[str]:
    """The fixtures that a query names, in an order in which each is defined before it is used."""
    out: list[str] = []

    def visit(body: str) -> None:
        for name, sql in SQL.items():
            if name not in out and name not in held and re.search(rf"\b(?:from|join)\s+{name}\b", body):
                visit(sql)
                if name not in out:
                    out.append(name)

    visit(text)
    return out


def twin(body: str) -> str:
    """A DuckDB query over fixtures and given tables."""
    parts = [f"{n} as materialized ({SQL[n]})" for n in needed(body)]
    return ((f"with {', '.join(parts)} " if parts else "") + body).replace("@G", ", 'g'").replace("@K", ", unnest(range(0, e.doc_id%3+1)) as n(k)")


def fixture(spark: SparkSession, sf_dir: str, name: str, held: dict[str, DataFrame]) -> DataFrame:
    """A fixture as a DataFrame, over given tables and fixtures that are ``held`` as tables."""
    text = SQL[name]
    parts = [f"{n} as ({SQL[n]})" for n in needed(text, held)]
    text = ((f"with {', '.join(parts)} " if parts else "") + text).replace("@G", "").replace("@K", "lateral view explode(sequence(0L, e.doc_id%3)) n as k")
    named = lambda t: re.search(rf"\b(?:from|join)\s+{t}\b", text)
    given = {t: held[t] for t in held if named(t)} | {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "lineitem", "embeddings") if named(t)}
    for t in given:
        text = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **given)
