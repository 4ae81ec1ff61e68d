"""Queries of stacks, profiles, segments and the strategy comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.catalog import Inputs, query
from spanwright.functions import expr as E
from spanwright.operators import consensus as C
from spanwright.operators import joins as J
from spanwright.operators.motifs import motif_places

UNIT = ["unit", "side"]
#: Columns of the longest window and more.
RANGE = "(select unnest(range(1,600)) as p)"


def prof(src: str, trim: int = 0, seq: str = "seq") -> str:
    """Twin of a column profile of a source with unit, side, ord and seq."""
    return f"""(select unit, side, col, n, tot, n::double/tot as ident, base from (select unit, side, col, base, n, sum(n) over (partition by unit,side,col)::bigint as tot,
        row_number() over (partition by unit,side,col order by n desc, first) as r from (select unit, side, (p-1)::bigint as col, substring(s,p::int,1) as base, count(*) as n, min(ord) as first
        from (select unit, side, ord, substring({seq},{trim + 1}) as s from {src} src where length(seq)>{trim}) q join {RANGE} ps on p<=length(s) group by 1,2,3,4) c) d where r=1)"""


def seg(p: str, thr: str, run: str) -> str:
    """Twin of the segments of a profile (with further columns that ``thr`` and ``run`` may name)."""
    return f"""(with pr as (select *, {thr} as t, {run} as rn from {p} p0), sz as (select unit, side, max(col) as last_col, string_agg(base,'' order by col) as full_text from pr group by unit, side),
        hi as (select *, case when col-lag(col) over w -1 < rn then 0 else 1 end as fresh from pr where ident>=t window w as (partition by unit,side order by col)),
        se as (select *, sum(fresh) over (partition by unit,side order by col) as seg_no from hi), ag as (select unit, side, seg_no::bigint as seg_no, min(col) as s, max(col) as e, min(rn) as rn from se group by 1,2,3)
        select unit, side, seg_no, s as start, case when last_col-e<rn then last_col-s+1 else e-s+1 end as length, substring(full_text,(s+1)::int,(case when last_col-e<rn then last_col-s+1 else e-s+1 end)::int) as text, last_col-e<rn as is_open
        from ag join sz using(unit,side))"""


def cut_run(p: str, thr: str, run: str) -> str:
    return f"""(with pr as (select *, {thr} as t, {run} as rn from {p} p0), lo as (select *, col-row_number() over (partition by unit,side order by col) as g from pr where ident<=t),
        nt as (select *, row_number() over (partition by unit,side,g order by col) as nth from lo), cu as (select unit, side, min(case when nth>=rn then col-rn+1 end) as cut, min(col) as first_low from nt group by 1,2),
        fu as (select unit, side, count(*) as n_cols, string_agg(base,'' order by col) as f from pr group by 1,2)
        select unit, side, coalesce(cut,n_cols)::bigint as length, case when first_low=0 then 'pos1_low' when cut is not null then 'cutoff' else 'maxed_out' end as reason, left(f,coalesce(cut,n_cols)::int) as text from fu left join cu using(unit,side))"""


def cut_one(p: str, thr: str) -> str:
    return f"""(select unit, side, coalesce(cut,n_cols)::bigint as length, case when cut is null then 'maxed_out' when cut=0 then 'low_start' else 'normal' end as reason, left(f,coalesce(cut,n_cols)::int) as text
        from (select unit, side, min(case when ident<={thr} then col end) as cut, count(*) as n_cols, string_agg(base,'' order by col) as f from {p} p0 group by 1,2) q)"""


def rated(profile, threshold: float, run):
    return profile.withColumns({"threshold": F.lit(threshold), "run": run if not isinstance(run, int) else F.lit(run)})


def stacks(x: Inputs):
    return x.keep("stacks")


CONSISTENCY = """(select u.unit, sd.side, coalesce(n,0) as n, coalesce(n_variants,0) as n_variants, coalesce(n_short,0) as n_short, case when n is null then 'empty' when n=1 then 'lonely' when n_variants=1 then 'multi_matching' else 'multi_mismatching' end as verdict
    from (select distinct unit from lonely) u cross join (select unnest(['left','right']) as side) sd left join (select unit, side, count(*) as n, count(distinct a) as n_variants, count(*) filter (where length(seq)<12) as n_short
    from (select *, case when side='left' then right(seq,12) else left(seq,12) end as a from lonely) q group by unit, side) c on c.unit=u.unit and c.side=sd.side)"""


def lonely(x: Inputs):
    """Stacks, and units that have windows on one side only."""
    return x("lonely")


@query("a16_anchor_consistency", f"select * from {CONSISTENCY} c")
def _(x):
    return C.anchor_consistency(lonely(x), UNIT, 12)


@query("a16b_anchor_variants", "select unit, side, case when side='left' then right(seq,12) else left(seq,12) end as anchor, count(*) as n from stacks group by 1,2,3")
def _(x):
    return C.anchor_variants(stacks(x), UNIT, 12)


@query("a16c_anchor_members", "select unit, side, doc_id, case when side='left' then right(seq,12) else left(seq,12) end as anchor, length(seq)<12 as is_short, case when length(seq)<12 then length(seq) end as short_length from lonely")
def _(x):
    return C.anchor_members(lonely(x), UNIT, 12, "doc_id")


@query("a17_anchor_tally", f"select coalesce(side,'TOTAL') as side, count(*) filter (where verdict='lonely') as lonely, count(*) filter (where verdict='multi_matching') as multi_matching, count(*) filter (where verdict='multi_mismatching') as multi_mismatching, count(*) filter (where verdict='empty') as empty from {CONSISTENCY} q group by rollup(side)")
def _(x):
    return C.anchor_tally(C.anchor_consistency(lonely(x), UNIT, 12), "side")


POOLED = "(select unit as rec_type, doc_id%4 as cluster_number, side, case when doc_id%5=0 then 'yes' else 'no' end as singleton, concat('duplicate_group_',cast(doc_id%3 as string)) as group_dir, cast(doc_id as string) as mge_id, seq from stacks)"


def flank_rows(x: Inputs):
    d = F.col("doc_id")
    return stacks(x).select(F.col("unit").alias("rec_type"), (d % 4).alias("cluster_number"), "side", F.when(d % 5 == 0, "yes").otherwise("no").alias("singleton"), F.concat(F.lit("duplicate_group_"), (d % 3).cast("string")).alias("group_dir"), d.cast("string").alias("mge_id"), "seq")


@query("a18_pool_stacks", f"select mge_id, 'group' as level, row_number() over (partition by rec_type,cluster_number,side,group_dir order by mge_id) as ord from {POOLED} q where singleton='no' union all select mge_id, 'cluster', row_number() over (partition by rec_type,cluster_number,side order by group_dir,mge_id) from {POOLED} q where singleton='no'")
def _(x):
    parts = [C.pool_stacks(flank_rows(x), level).select("mge_id", F.lit(level).alias("level"), "ord") for level in ("group", "cluster")]
    return parts[0].unionByName(parts[1])


@query("a19_column_profile", f"select * from {prof('stacks')} p")
def _(x):
    return C.column_profile(stacks(x), UNIT)


def with_empty(cut: str, trim: int) -> str:
    """Twin of a cut, with units of which nothing is left behind the trimmed columns."""
    return f"select * from {cut} c union all select unit, side, 0::bigint, 'empty', '' from (select unit, side, max(length(seq)) as m from lonely group by 1,2) z where m<={trim}"


@query("w4_cutoff_single", with_empty(cut_one(prof("lonely", 12), "0.35::double"), 12))
def _(x):
    df = lonely(x)
    return C.cutoff_single(rated(C.column_profile(df, UNIT, 12), 0.35, 1), UNIT, df.select(*UNIT).distinct())


@query("w5_cutoff_run", with_empty(cut_run(prof("lonely", 12), "0.4::double", "2"), 12))
def _(x):
    df = lonely(x)
    return C.cutoff_run(rated(C.column_profile(df, UNIT, 12), 0.4, 2), UNIT, df.select(*UNIT).distinct())


@query("w6_segments_strict", f"select * from {seg(prof('stacks'), '0.5::double', '1')} s where not is_open")
def _(x):
    return C.segments(rated(C.column_profile(stacks(x), UNIT), 0.5, 1), UNIT).where(~F.col("is_open"))


@query("w7_segments_tolerant", f"select * from {seg(prof('stacks'), '0.5::double', '3')} s where not is_open")
def _(x):
    return C.segments(rated(C.column_profile(stacks(x), UNIT), 0.5, 3), UNIT).where(~F.col("is_open"))


@query("w8_segments_trailing", f"select * from {seg(prof('stacks'), '0.5::double', '3')} s")
def _(x):
    return C.segments(rated(C.column_profile(stacks(x), UNIT), 0.5, 3), UNIT)


def aware(thr: str, run: str) -> str:
    right = "(select * from stacks where side='right')"
    return f"""(select * from {seg(prof("(select * from stacks where side='left')"), thr, run)} l union all
        select unit, side, seg_no, m-start-length as start, length, reverse(text) as text, is_open from {seg(prof(right, 0, 'reverse(seq)'), thr, run)} r join (select unit, side, max(length(seq)) as m from stacks group by 1,2) z using(unit,side))"""


@query("w9_segments_side_aware", f"select * from {aware('0.5::double', '2')} s")
def _(x):
    return C.segments_side_aware(stacks(x), UNIT, 0.5, 2)


SIZES = "(select unit, max(n) as n_members from (select unit, side, count(*) as n from stacks group by 1,2) q group by unit)"
DYNAMIC = f"(select p.*, n_members from {prof('stacks')} p join {SIZES} z using(unit))"


@query("w10_segments_dynamic", f"select * from {seg(DYNAMIC, '0.5::double', 'case when n_members<=5 then 1 else 2 end')} s")
def _(x):
    sized = C.unit_sizes(stacks(x), ["unit"])
    run = F.when(F.col("n_members") <= 5, 1).otherwise(2)
    return C.segments(rated(C.column_profile(stacks(x), UNIT).join(sized, "unit"), 0.5, run), UNIT)


@query("w11_boundary_segment", f"select unit, side, start, length, text, is_open from (select *, row_number() over (partition by unit,side order by is_open desc, case when side='left' then start else -start end desc) as r from {aware('0.5::double', '2')} s where length between 4 and 20) q where r=1")
def _(x):
    return C.boundary_segment(C.segments_side_aware(stacks(x), UNIT, 0.5, 2), UNIT)


STRIPPED = "(select unit, side, ord, case when length(seq)<=6 then '' when side='left' then substring(seq,1,length(seq)-6) else substring(seq,7) end as seq from stacks)"
NONEMPTY = f"(select * from {STRIPPED} s0 where length(seq)>0)"
SIZED = f"(select unit, max(n) as n_members from (select unit, side, count(*) as n from {NONEMPTY} q group by 1,2) q group by unit)"
PARAMS = "case when n_members<=5 then 0.9::double else 0.4::double end"
RUNS = "case when n_members<=5 then 1 else 2 end"


def with_size(p: str) -> str:
    return f"(select p.*, n_members from {p} p join {SIZED} z using(unit))"


RIGHT = f"(select * from {NONEMPTY} n0 where side='right')"
LEFT = f"(select * from {NONEMPTY} n0 where side='left')"
ALL_SEGS = f"""(select * from {seg(with_size(prof(LEFT)), PARAMS, RUNS)} l union all select unit, side, seg_no, m-start-length as start, length, reverse(text) as text, is_open
    from {seg(with_size(prof(RIGHT, 0, 'reverse(seq)')), PARAMS, RUNS)} r join (select unit, side, max(length(seq)) as m from {NONEMPTY} n1 group by 1,2) z using(unit,side))"""


@query("w12_build_consensus", f"""select u.unit, u.side, c.start as consensus_start, coalesce(c.length,0)::bigint as length, coalesce(c.text,'') as text, coalesce(o.has_open,false) and not coalesce(c.is_open,false) as maxed, n_members,
    case when n_members<=5 then 0.9::double else 0.4::double end as threshold, 'alignment' as consensus_source from (select distinct unit, side from {NONEMPTY} n2) u join {SIZED} z using(unit)
    left join (select unit, side, bool_or(is_open) as has_open from {ALL_SEGS} s group by 1,2) o on o.unit=u.unit and o.side=u.side
    left join (select * from (select *, row_number() over (partition by unit,side order by is_open desc, case when side='left' then start else -start end desc) as r from {ALL_SEGS} s where length between 4 and 20) q where r=1) c on c.unit=u.unit and c.side=u.side
    union all select c.unit, c.side, case when c.length>0 then 0::bigint end, c.length, c.text, reason='maxed_out', n_members, case when n_members<=5 then 0.9::double else 0.4::double end, 'stacking' from {cut_run(with_size(prof(NONEMPTY)), PARAMS, RUNS)} c join {SIZED} z using(unit)""")
def _(x):
    parts = [C.build_consensus(stacks(x), ["unit"], s, overlap=6, small=0.9, large=0.4, cutoff=5, run=2) for s in ("alignment", "stacking")]
    return parts[0].unionByName(parts[1])


@query("a20_universe_totals", f"select sum(n_members)::bigint as n_elements, count(distinct unit) as n_clusters, count(*) as n_groups from (select unit, grp, max(n) as n_members from (select unit, doc_id%3 as grp, side, count(*) as n from stacks group by 1,2,3) q group by 1,2) s")
def _(x):
    return C.universe_totals(grouped(x), ["unit", "grp"], ["unit"])


def grouped(x: Inputs):
    return stacks(x).withColumn("grp", F.col("doc_id") % 3)


def strategies(x: Inputs, level: str | None = None):
    df = x.spark.createDataFrame(C.STRATEGIES, C.STRATEGY_SCHEMA)
    return df.where(F.col("level") == level) if level else df


def units(x: Inputs, level: str):
    """Units of one level with one key, so that both levels have the same columns."""
    df = grouped(x).withColumn("grp", F.col("grp") if level == "group" else F.lit(-1).cast("bigint"))
    return C.strategy_units(df, ["unit", "grp"], strategies(x, level))


def all_units(x: Inputs):
    return x.keep("units", lambda: units(x, "group").unionByName(units(x, "cluster")))


def strategy_sql() -> str:
    """Twin of the units of all strategies: for each one the twin of its own scan."""
    out = []
    for name, kind, level, small, large, run_small, run_large, cutoff in C.STRATEGIES:
        src = f"(select concat(unit,'#',{'cast(doc_id%3 as string)' if level == 'group' else chr(39) + '-1' + chr(39)}) as unit, side, ord, seq from stacks)"
        sizes = f"(select unit, max(n) as n_members from (select unit, side, count(*) as n from {src} s group by 1,2) q group by unit)"
        p = f"(select p.*, n_members from {prof(src, 10)} p join {sizes} z using(unit))"
        thr, run = f"case when n_members<={cutoff} then {small}::double else {large}::double end", f"case when n_members<={cutoff} then {run_small} else {run_large} end"
        if kind == "S":
            rows = f"(select unit, side, is_open as maxed, case when not is_open then length end as length from {seg(p, thr, run)} s)"
        else:
            cut = cut_run(p, thr, run) if kind == "A" else cut_one(p.replace("select p.*, n_members", f"select p.unit, p.side, p.col, p.base, case when p.ident<=({thr}) then 0 else 1 end as ident"), "0")
            rows = f"""(select z.unit, sd.side, coalesce(c.reason='maxed_out',false) as maxed, case when not coalesce(c.reason='maxed_out',false) then coalesce(c.length,0) end as length from {sizes} z cross join (select unnest(['left','right']) as side) sd
                left join {cut} c on c.unit=z.unit and c.side=sd.side)"""
        multi = f"(select unit, max(case when k>1 then 1 else 0 end) as multi from (select unit, side, count(length) as k from {rows} r group by 1,2) q group by unit)" if kind == "S" else "(select '' as unit, 0 as multi)"
        out.append(f"""select '{name}' as strategy, split_part(z.unit,'#',1) as unit, split_part(z.unit,'#',2)::bigint as grp, n_members, coalesce(r.maxed,false) as maxed, coalesce(n_found,0)::bigint as n_found, coalesce(len_found,0)::bigint as len_found,
            coalesce(n_in,0)::bigint as n_in, coalesce(n_under,0)::bigint as n_under, coalesce(n_over,0)::bigint as n_over, coalesce(m.multi,0)::bigint as multi from {sizes} z left join (select unit, bool_or(maxed) as maxed, count(length) as n_found, sum(length) as len_found,
            count(*) filter (where length>4 and length<20) as n_in, count(*) filter (where length<4) as n_under, count(*) filter (where length>20) as n_over from {rows} q group by unit) r on r.unit=z.unit left join {multi} m on m.unit=z.unit""")
    return "(" + " union all ".join(out) + ")"


UNITS = strategy_sql()
OUTCOME = f"""(select strategy, sum(case when not maxed then n_members else 0 end)::bigint as n_elements_found, sum(case when maxed then n_members else 0 end)::bigint as n_elements_maxed, count(*) filter (where not maxed) as n_units_found, count(*) filter (where maxed) as n_units_maxed,
    (select count(*) from (select strategy as st, bool_and(maxed) as a from {UNITS} u2 group by strategy, unit) q where st=u.strategy and a) as n_clusters_all_maxed, count(distinct unit) filter (where not maxed) as n_clusters_any_found from {UNITS} u group by strategy)"""
LENGTHS = f"""(select strategy, sum(n_found)::bigint as n_consensuses, sum(len_found)::double/nullif(sum(n_found),0) as avg_length, sum(n_under)*100.0::double/nullif(sum(n_found),0) as pct_under_4, sum(n_in)*100.0::double/nullif(sum(n_found),0) as pct_4_to_20,
    sum(n_over)*100.0::double/nullif(sum(n_found),0) as pct_over_20 from {UNITS} u group by strategy)"""


@query("a21_strategy_outcome", f"select * from {OUTCOME} o")
def _(x):
    return C.strategy_outcome(all_units(x), ["unit"])


@query("a22_length_stats", f"select * from {LENGTHS} l")
def _(x):
    return C.length_stats(all_units(x))


TOTALS = "(select sum(n_members)::bigint as n_elements, count(distinct unit) as n_clusters, count(*) as n_groups from (select unit, grp, max(n) as n_members from (select unit, doc_id%3 as grp, side, count(*) as n from stacks group by 1,2,3) q group by 1,2) s)"
KINDS = " union all ".join(f"select '{s[0]}' as strategy, '{s[1]}' as kind, '{s[2]}' as level" for s in C.STRATEGIES)


@query("a23_strategy_comparison", f"""select o.strategy, t.n_elements, o.n_elements_found, o.n_elements_maxed, t.n_clusters, n_clusters_all_maxed, n_clusters_any_found, case when level='group' then t.n_groups end as n_groups, case when level='group' then n_units_found end as n_groups_found,
    case when level='group' then n_units_maxed end as n_groups_maxed, n_elements_found*100.0::double/t.n_elements as pct_elements_found, n_clusters_any_found*100.0::double/t.n_clusters as pct_clusters_any_found, case when level='group' then n_units_found*100.0::double/t.n_groups end as pct_groups_found,
    case when kind='S' then n_consensuses::double/t.n_clusters end as avg_per_cluster, case when kind='S' and level='group' then n_consensuses::double/t.n_groups end as avg_per_group, avg_length, pct_under_4, pct_4_to_20, pct_over_20
    from {OUTCOME} o join {LENGTHS} l using(strategy) join ({KINDS}) k using(strategy) cross join {TOTALS} t""")
def _(x):
    return C.strategy_comparison(all_units(x), C.universe_totals(grouped(x), ["unit", "grp"], ["unit"]), strategies(x), ["unit"])


@query("a24_multi_segment_units", f"select strategy, unit, grp, row_number() over (partition by strategy order by md5(concat_ws('#',unit,cast(grp as varchar),'42')), unit, grp)<=5 as in_sample from {UNITS} u where multi=1")
def _(x):
    return C.multi_segment_units(all_units(x), ["unit", "grp"])


@query("a25_segments_per_unit", f"select strategy, n_consensuses::double/t.n_clusters as per_cluster, n_consensuses::double/t.n_groups as per_group from {LENGTHS} l cross join {TOTALS} t")
def _(x):
    df = C.length_stats(all_units(x)).join(F.broadcast(C.universe_totals(grouped(x), ["unit", "grp"], ["unit"])))  # one row
    return df.select("strategy", (F.col("n_consensuses") / F.col("n_clusters")).alias("per_cluster"), (F.col("n_consensuses") / F.col("n_groups")).alias("per_group"))


#: Patterns of units: the table that gene types have.
UNIT_PATTERNS = "(select distinct unit, unnest(case when length(unit)%2=0 then ['GG'] when right(unit,1)>'4' then ['GTAA','Gagg'] else ['GGnnnTG'] end) as pattern from stacks)"
PLACES = f"""(select q.*, p.pattern, strand, start from (select unit, side, text from BOUNDARY b) q join {UNIT_PATTERNS} p using(unit) cross join (select unnest(range(0,20)) as start) s cross join (select unnest(['+','-']) as strand) t
    where start+length(pattern)<=length(text) and regexp_full_match(case when strand='+' then substring(text,start+1,length(pattern)) else reverse(translate(substring(text,start+1,length(pattern)),'ACGT','TGCA')) end, regexp_replace(pattern,'[a-zN]','.','g')))"""
BOUNDARY = f"(select unit, side, start, length, text, is_open from (select *, row_number() over (partition by unit,side order by is_open desc, case when side='left' then start else -start end desc) as r from {aware('0.5::double', '2')} s where length between 4 and 20) q where r=1)"
PLACES = PLACES.replace("BOUNDARY", BOUNDARY)


def unit_patterns(x: Inputs):
    unit = F.col("unit")
    listed = F.when(F.length(unit) % 2 == 0, F.array(F.lit("GG"))).when(F.right(unit, F.lit(1)) > "4", F.array(F.lit("GTAA"), F.lit("Gagg"))).otherwise(F.array(F.lit("GGnnnTG")))
    return stacks(x).select("unit").distinct().select("unit", F.explode(listed).alias("pattern"))


def boundaries(x: Inputs):
    return x.keep("boundaries", lambda: C.boundary_segment(C.segments_side_aware(stacks(x), UNIT, 0.5, 2), UNIT))


def boundary_places(x: Inputs):
    named = boundaries(x).withColumn("id", F.concat_ws("#", "side", "unit"))
    found = motif_places(named.select("id", "unit", "text"), unit_patterns(x), kind="unit", seq="text")
    return found.join(named.select("id", "unit", "side", "text"), "id").select("unit", "side", "text", "pattern", "strand", "start")


@query("p15b_motif_places", f"select * from {PLACES} p")
def _(x):
    return boundary_places(x)


@query("j11b_labelled_rows", f"""select d.doc_id, d.unit, d.side, md5(d.seq) as flank, case when b.start is null then 0.3::double when m.unit is not null then 1.0::double else 0.7::double end as label,
    case when b.start is null then 'no_segment_in_length_bucket' else concat(case when m.unit is not null then 'found_literature_match_' else 'found_no_literature_match_' end, case when is_open then 'trailing_at_boundary' else 'closed_segment' end) end as label_reason,
    b.start as segment_start, b.length as segment_length, b.text as segment_sequence from stacks d left join {BOUNDARY} b on b.unit=d.unit and b.side=d.side left join (select distinct unit, side from {PLACES} p) m on m.unit=d.unit and m.side=d.side""")
def _(x):
    """Labels with their reasons and segments, for each member of a unit; patterns come from a table by type."""
    hits = boundary_places(x).select("unit", "side").distinct().withColumn("hit", F.lit(True))
    found, matched = F.col("start").isNotNull(), F.coalesce("hit", F.lit(False))
    sides = stacks(x).select(*UNIT).distinct().join(boundaries(x), UNIT, "left").join(hits, UNIT, "left")
    reason = E.label_reason(F.lit(True), F.lit(True), found, matched, F.coalesce("is_open", F.lit(False)))
    labels = sides.select(F.col("unit").alias("rec_type"), F.lit(0).alias("cluster_number"), "side", E.soft_label(found, matched).alias("label"), reason.alias("label_reason"), F.col("start").alias("segment_start"), F.col("length").alias("segment_length"), F.col("text").alias("segment_sequence"))
    members = stacks(x).select("doc_id", F.col("unit").alias("rec_type"), F.lit(0).alias("cluster_number"), "side", F.md5(F.col("seq").cast("binary")).alias("flank"))
    return J.label_members(members, labels).withColumnRenamed("rec_type", "unit").drop("cluster_number")
