"""Queries of labels, splits, predictions, position scores and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.catalog import Inputs, query
from spanwright.functions import expr as E
from spanwright.operators import aggregates as A
from spanwright.operators import joins as J
from spanwright.operators import split as S
from spanwright.operators import windows as WI
from spanwright.plans import filters, ml

SPECIES = "(select l.*, coalesce(t.speci, '__unresolved_gca__:' || l.gca) as species from label_rows l left join taxonomy t on t.gca=l.gca)"
SPECIES_COMPONENTS = f"""(with recursive s as (select distinct group_no, species from {SPECIES} q), e as (select distinct a.species as a, b.species as b from s a join s b on a.group_no=b.group_no),
    r(id, c) as (select a, a from e union select e.b, r.c from r join e on e.a=r.id) select id as species, min(c) as component from r group by id)"""
GROUPS = f"(select rec_type, cluster_number, group_no, component from (select rec_type, cluster_number, group_no, min(species) as species from {SPECIES} q group by 1,2,3) g join {SPECIES_COMPONENTS} c using(species))"
TYPES = "(select distinct rec_type from predictions)"


def with_species(x: Inputs):
    df = x("label_rows").join(x("taxonomy").select("gca", "speci"), "gca", "left")
    return df.withColumn("species", E.resolve_species(F.col("speci"), F.col("mge_id")))


def groups(x: Inputs):
    rows = with_species(x)
    return S.group_components(rows, S.species_components(rows))


def assigned(per_group, names=("train", "val", "test"), shares=(0.8, 0.1, 0.1), seed=42):
    return S.assign_buckets(S.component_footprint(per_group), list(names), list(shares), seed)


def split_rows(x: Inputs):
    rows = with_species(x)
    comps = S.species_components(rows)
    split = assigned(S.group_components(rows, comps)).withColumnRenamed("bucket", "split")
    return J.append_split(rows.join(comps, "species"), split)


def scores(x: Inputs):
    """Position scores of vectors: one base of each four is made of an element."""
    v = x.table("embeddings").select("vec_id", F.concat(F.lit("type"), (F.col("label") % 5).cast("string")).alias("rec_type"), F.posexplode("embedding").alias("position", "a"))
    a = F.col("a").cast("double")
    mag = E.score_magnitude(a, -a / 2, a / 3, F.lit(0.0))
    return v.select("vec_id", "rec_type", F.col("position").cast("bigint").alias("position"), F.round(mag * 1000000).cast("bigint").alias("magnitude"))


SCORES = "(select vec_id, concat('type',(label%5)::string) as rec_type, (p-1)::bigint as position, round((abs(embedding[p]::double)+abs(-embedding[p]::double/2)+abs(embedding[p]::double/3)+0)*1000000)::bigint as magnitude from embeddings cross join (select unnest(range(1,65)) as p) ps)"


@query("j11_label_members", "select d.doc_id, d.side, l.label from label_rows d join (select rec_type, cluster_number, side, max(label) as label from label_rows group by 1,2,3) l on l.rec_type=d.rec_type and l.cluster_number=d.cluster_number and l.side=d.side")
def _(x):
    rows = x("label_rows")
    labels = rows.groupBy("rec_type", "cluster_number", "side").agg(F.max("label").alias("label"))
    return J.label_members(rows.drop("label"), labels).select("doc_id", "side", "label")


@query("j13_segment_lookup", f"select vec_id, position, magnitude, case when vec_id%3<>0 then vec_id%40 end as seg_start from {SCORES} s")
def _(x):
    df = scores(x).withColumn("mge_id", F.col("vec_id").cast("string")).withColumn("side", F.lit("left"))
    segs = x.table("embeddings").where(F.col("vec_id") % 3 != 0).select(F.concat(F.lit("type"), (F.col("label") % 5).cast("string")).alias("rec_type"), F.col("vec_id").cast("string").alias("mge_id"), F.lit("left").alias("side"), (F.col("vec_id") % 40).alias("seg_start"))
    return J.segment_lookup(df, segs).select("vec_id", "position", "magnitude", "seg_start")


@query("j14_append_split", f"select doc_id, component from {SPECIES} s join {SPECIES_COMPONENTS} c using(species)")
def _(x):
    return split_rows(x).where(F.col("split").isNotNull()).select("doc_id", "component")


@query("a26_label_counts", "select label, null::varchar as rec_type, count(*) as n from label_rows group by label union all select null::double, rec_type, count(*) from label_rows group by rec_type")
def _(x):
    return A.label_counts(x("label_rows"))


GROUPS_OF = "(select distinct rec_type, cluster_number, group_no, group_no%3 as s, group_no%5 as f from label_rows)"


@query("a27_split_crosstab", f"select rec_type, count(*) as n_groups, count(*) filter (where s=0) as n_train, count(*) filter (where s=1) as n_val, count(*) filter (where s=2) as n_test, count(*) filter (where s=1)=0 or count(*) filter (where s=2)=0 as empty_split from {GROUPS_OF} q group by rec_type")
def _(x):
    g = F.col("group_no") % 3
    return A.split_crosstab(x("label_rows").withColumn("split", F.when(g == 0, "train").when(g == 1, "val").otherwise("test")))


@query("a27b_fold_crosstab", "select rec_type, count(*) as n_groups, " + ", ".join(f"count(*) filter (where f={i}) as n_{i}" for i in range(5)) + ", " + " or ".join(f"count(*) filter (where f={i})=0" for i in range(5)) + f" as empty_fold from {GROUPS_OF} q group by rec_type")
def _(x):
    folds = tuple(range(5))
    return A.split_crosstab(x("label_rows").withColumn("fold", F.col("group_no") % 5), "fold", folds, folds)


TIER = "case when abs({c}-0.3::double)<=abs({c}-0.7::double) then 0.3 when abs({c}-0.7::double)<=abs({c}-1.0::double) then 0.7 else 1.0 end"
RIGHT = f"avg(case when {TIER.format(c='prediction')}={TIER.format(c='label')} then 1.0::double else 0.0::double end)"


@query("a28_regression_metrics", f"select rec_type, count(*) as n, round(avg((prediction-label)*(prediction-label)),9) as mse, round(avg(abs(prediction-label)),9) as mae, round({RIGHT},9) as tier_accuracy from predictions group by rollup(rec_type)")
def _(x):
    return A.regression_metrics(x("predictions")).select("rec_type", "n", *(F.round(c, 9).alias(c) for c in ("mse", "mae", "tier_accuracy")))


FOLDS = f"(select rec_type, doc_id%5 as fold, avg((prediction-label)*(prediction-label)) as mse, {RIGHT} as tier_accuracy from predictions group by 1,2)"


@query("a29_cv_summary", f"select rec_type, count(*) as n_folds, round(avg(tier_accuracy),9) as mean_tier_accuracy, round(stddev_samp(tier_accuracy),9) as std_tier_accuracy, round(avg(mse),9) as mean_mse, round(stddev_samp(mse),9) as std_mse from {FOLDS} f group by rec_type")
def _(x):
    p = x("predictions").withColumn("fold", F.col("doc_id") % 5)
    e, ok = F.col("prediction") - F.col("label"), (E.nearest_tier(F.col("prediction")) == E.nearest_tier(F.col("label"))).cast("double")
    out = A.cv_summary(p.groupBy("rec_type", "fold").agg(F.avg(e * e).alias("mse"), F.avg(ok).alias("tier_accuracy")))
    return out.select("rec_type", "n_folds", *(F.round(c, 9).alias(c) for c in ("mean_tier_accuracy", "std_tier_accuracy", "mean_mse", "std_mse")))


@query("a30_prediction_quantiles", "select rec_type, label, count(*) as n, quantile_cont(prediction,0.25) as q25, quantile_cont(prediction,0.5) as q50, quantile_cont(prediction,0.75) as q75 from predictions group by 1,2")
def _(x):
    return A.prediction_quantiles(x("predictions"))


@query("a31_accuracy_ranking", f"select t.rec_type, round(m.tier_accuracy,9) as tier_accuracy, coalesce(m.n,0) as n from (select * from {TYPES} a union all select 'none' as rec_type) t left join (select rec_type, {RIGHT} as tier_accuracy, count(*) as n from predictions group by 1) m on m.rec_type=t.rec_type order by 2 desc nulls last, 1")
def _(x):
    p = x("predictions")
    types = p.select("rec_type").distinct().union(p.sparkSession.range(1).select(F.lit("none")))
    return A.accuracy_ranking(types, A.regression_metrics(p).where(F.col("rec_type").isNotNull())).withColumn("tier_accuracy", F.round("tier_accuracy", 9))


@query("a32_best_epoch", "select epoch, val_loss from train_log order by val_loss, epoch limit 1")
def _(x):
    return A.best_epoch(x("train_log"))


SEGMENTED = f"(select *, vec_id%40 as s, 8 as l from {SCORES} q)"


@query("a33_peak_in_segment", f"""select vec_id, arg_max(position, magnitude*100-position) as peak, arg_max(position, magnitude*100-position)>=any_value(s) and arg_max(position, magnitude*100-position)<any_value(s)+8 as in_segment,
    sum(case when position>=s and position<s+8 then magnitude else 0 end)::double/sum(magnitude) as share from {SEGMENTED} g group by vec_id""")
def _(x):
    df = scores(x).withColumns({"seg_start": F.col("vec_id") % 40, "seg_length": F.lit(8), "magnitude": F.col("magnitude").cast("double")})
    return A.peak_in_segment(df, ["vec_id"])


@query("a34_position_weight_matrix", f"""select rec_type, (p-1)::bigint as position, count(*) filter (where b='A') as "A", count(*) filter (where b='C') as "C", count(*) filter (where b='G') as "G", count(*) filter (where b='T') as "T"
    from (select unit as rec_type, p, substring(right(seq,15),p::int,1) as b from stacks cross join (select unnest(range(1,16)) as p) z where length(seq)>=15 and unit in (select unit from stacks where length(seq)>=15 group by unit having count(*)>1)) q group by 1,2""")
def _(x):
    w = x("stacks").where(F.length("seq") >= 15).select(F.col("unit").alias("rec_type"), F.right("seq", F.lit(15)).alias("seq"))
    return A.position_weight_matrix(w).withColumn("position", F.col("position").cast("bigint"))


@query("w13_best_window", f"select vec_id, position as start, total from (select *, row_number() over (partition by vec_id order by total desc, position) as r from (select vec_id, position, sum(magnitude) over (partition by vec_id order by position rows between current row and 14 following)::bigint as total from {SCORES} q) w where position<=49) z where r=1")
def _(x):
    return WI.best_window(scores(x), ["vec_id"], 15).select("vec_id", "start", "total")


@query("a35_group_species_report", f"select count(*) as n_groups, count(*) filter (where n>1) as n_spanning, (select count(*) from {SPECIES} s where species like '\\_\\_unresolved%' escape '\\') as n_unresolved, (select count(distinct component) from {SPECIES_COMPONENTS} c) as n_components from (select group_no, count(distinct species) as n from {SPECIES} s group by 1) g")
def _(x):
    rows = with_species(x)
    return A.group_species_report(rows, S.species_components(rows))


@query("g3_species_components", f"select * from {SPECIES_COMPONENTS} c")
def _(x):
    return S.species_components(with_species(x))


@query("g4_component_footprint", f"select component, rec_type, count(*) as n from {GROUPS} g group by 1,2 union all select component, null, count(*) from {GROUPS} g group by 1")
def _(x):
    return S.component_footprint(groups(x))


@query("g5_assign_buckets")
def _(x):
    return assigned(groups(x))


@query("g5_assign_folds")
def _(x):
    return assigned(groups(x), [f"fold{i}" for i in range(5)], [0.2] * 5)


@query("g6_leakage_check", f"select species, count(distinct group_no%3)::bigint as n from {SPECIES} s group by species having count(distinct group_no%3)>1")
def _(x):
    """A split by groups, which leaks."""
    return S.leakage_check(with_species(x).withColumn("split", F.col("group_no") % 3), "split")


@query("g6b_no_leakage", f"select count(*) as n_rows, count(distinct species) as n_species, 0::bigint as n_leaking from {SPECIES} s")
def _(x):
    """The split of components, which must not leak."""
    rows = x.keep("split_rows", lambda: split_rows(x)).select("doc_id", "species", "split")
    totals = rows.where(F.col("split").isNotNull()).agg(F.count("*").alias("n_rows"), F.count_distinct("species").alias("n_species")).withColumn("one", F.lit(1))
    leaks = S.leakage_check(rows, "split").agg(F.count("*").alias("n_leaking")).withColumn("one", F.lit(1))
    return totals.join(leaks, "one").drop("one")


def features(x: Inputs):
    rows = split_rows(x).select("doc_id", "rec_type", "side", "label", "split")
    seqs = x("contigs").select("doc_id", "seq")
    return ml.boundary_features(rows.join(seqs, "doc_id"))


@query("m1_boundary_features")
def _(x):
    return features(x).select("doc_id", F.col("features").cast("string").alias("features"))


@query("m2_fit_predict")
def _(x):
    return ml.fit_predict(features(x)).select("doc_id", "label", "prediction")


def filtered(x: Inputs):
    """Windows of the labelled rows, kept as each step reads them, and the model that is fitted on them."""
    rows = split_rows(x).select("doc_id", "rec_type", "side", "label", "split").join(x("contigs").select("doc_id", "seq"), "doc_id")
    kept = x.keep("filter_windows", lambda: filters.windows(rows).drop("seq"))
    return kept, filters.fit(kept)


@query("m2b_filter_predictions")
def _(x):
    rows, model = filtered(x)
    return filters.predict(rows.where(F.col("split") == "test").select("doc_id", "label", "window", "type_slot", "side_slot"), model).select("doc_id", "label", "prediction")


@query("m2c_attributed_windows")
def _(x):
    """The 15 bases of each tested window that add most to its prediction."""
    rows, model = filtered(x)
    rows = rows.where(F.col("split") == "test").select("doc_id", "side", "window", "type_slot", "side_slot")
    scores = filters.attributions(rows, model, ["doc_id", "side"]).select("doc_id", "side", "position", F.round(E.score_magnitude(*map(F.col, "ACGT")) * 1000000).cast("bigint").alias("magnitude"))
    best = WI.best_window(scores, ["doc_id", "side"], 15)
    return best.join(rows, ["doc_id", "side"]).select("doc_id", "side", "start", "total", F.substr("window", F.col("start").cast("int") + 1, F.lit(15)).alias("bases"))


@query("m3_fold_rotation", "select doc_id, run, case when doc_id%5=run then 'test' when doc_id%5=(run+1)%5 then 'val' else 'train' end as role from label_rows cross join (select unnest(range(5)) as run) r")
def _(x):
    return ml.fold_rotation(x("label_rows").withColumn("fold", F.col("doc_id") % 5)).select("doc_id", "run", "role")
