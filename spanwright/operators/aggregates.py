"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.functions import expr as E
from spanwright.operators.ranking import ROW_BITS, in_ranges, percentiles
from spanwright.operators.windows import first_row_per_key
from spanwright.session import Tables


def stage_counters(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(reason), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def instance_census(elements: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Rows, summed instances of all types, distinct accessions and species."""
    df = elements.join(taxonomy.select("gca", "speci"), "gca", "left")
    return df.agg(F.count("*").alias("n_rows"), F.sum(E.total_count(E.type_counts("mge"))).cast("bigint").alias("n_instances"), F.count_distinct("gca").alias("n_accessions"), F.count_distinct("speci").alias("n_species"))


def type_census(elements: DataFrame, taxonomy: DataFrame, kind: str) -> DataFrame:
    """The same for one type, and the rows whose accession has no species."""
    df = elements.join(taxonomy.select("gca", "speci"), "gca", "left").withColumn("c", E.type_count(E.type_counts("mge"), kind)).where(F.col("c") > 0)
    return df.agg(F.count("*").alias("n_rows"), F.sum("c").cast("bigint").alias("n_instances"), F.count_distinct("gca").alias("n_accessions"), F.count_distinct("speci").alias("n_species"), F.count_if(F.col("speci").isNull()).alias("n_unmapped"))


def species_of_ids(ids: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """By species: how many accessions, and how many distinct ids; null species are unmapped accessions."""
    acc = ids.select("mge_id").distinct().select(E.accession_of("mge_id").alias("gca")).where(F.col("gca").isNotNull()).groupBy("gca").agg(F.count("*").alias("n"))
    return acc.join(taxonomy.select("gca", "speci"), "gca", "left").groupBy("speci").agg(F.count("*").alias("n_accessions"), F.sum("n").alias("n_ids"))


def accessions_of_species(ids: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``speci, label, gca``: the accessions of each species that ids name."""
    acc = ids.select(E.accession_of("mge_id").alias("gca")).where(F.col("gca").isNotNull()).distinct()
    return acc.join(taxonomy, "gca").select("speci", "label", "gca")


def genomes_per_species(counts: DataFrame) -> DataFrame:
    """Extremes with all their species sorted, median, sample deviation (0 of one) and number of ``speci, n``.

    Very many species can share an extreme: each range of them becomes a text, and the last task joins
    a text from each range. ``extreme_species`` has them as a row each.
    """
    kept = Tables(counts.sparkSession)
    counts = kept.keep(counts)
    tied = in_ranges(extreme_species(counts).where(F.col("speci").isNotNull()), ["extreme", "speci"], "at", kept)
    texts = tied.groupBy("extreme", F.shiftrightunsigned("at", ROW_BITS).alias("range")).agg(F.array_join(F.array_sort(F.collect_list("speci")), ",").alias("ids"))
    joined = texts.groupBy("extreme").agg(F.array_join(F.array_sort(F.collect_list(F.struct("range", "ids")))["ids"], ",").alias("ids"))
    names = joined.agg(*(F.max(F.when(F.col("extreme") == e, F.col("ids"))).alias(f"{e}_species") for e in ("max", "min")))
    middle = percentiles(counts, [], "n", [0.5], ["median_n"], kept).select("median_n")
    df = counts.agg(F.max("n").alias("max_n"), F.min("n").alias("min_n"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("sd_n"), F.count("*").alias("n_species"))
    return df.join(F.broadcast(names)).join(F.broadcast(middle)).select("max_n", "max_species", "min_n", "min_species", "median_n", "sd_n", "n_species")  # one row each


def extreme_species(counts: DataFrame) -> DataFrame:
    """``extreme, speci, n``: every species with the most (``max``) or the fewest (``min``) genomes."""
    ends = counts.agg(F.max("n").alias("max"), F.min("n").alias("min"))
    each = ends.select(F.explode(F.array(*(F.struct(F.lit(e).alias("extreme"), F.col(e).alias("n")) for e in ("max", "min")))).alias("x")).select("x.*")
    return counts.join(F.broadcast(each), "n").select("extreme", "speci", "n")  # two rows


def top_species(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "speci").limit(k)


def genes_per_element(table: DataFrame) -> DataFrame:
    per = table.groupBy("mge_id").agg(F.count("*").alias("n"))
    a = per.agg(F.count_if(F.col("n") > 1).alias("n_multi"), F.count_if(F.col("n") == 1).alias("n_single"))
    b = table.agg(F.count_distinct("recombinase_type").alias("n_types"), F.count_distinct("gca").alias("n_accessions"), F.count_distinct("speci").alias("n_species"))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")


def cluster_summary(table: DataFrame) -> DataFrame:
    """Clusters by type and number, those of one row, and elements none of whose rows has a cluster."""
    clusters = table.where(F.col("cluster_number").isNotNull()).groupBy("recombinase_type", "cluster_number").agg(F.count("*").alias("n"))
    a = clusters.agg(F.count("*").alias("n_clusters"), F.count_if(F.col("n") == 1).alias("n_singletons"))
    per = table.groupBy("mge_id").agg(F.bool_or(F.col("cluster_number").isNotNull()).alias("some"))
    b = per.agg(F.count_if(~F.col("some")).alias("n_without"))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")


def clusters_by_type(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per type: clusters, clusters of one row, elements of both tables."""
    clusters = b.where(F.col("cluster_number").isNotNull()).groupBy("recombinase_type", "cluster_number").agg(F.count("*").alias("n"))
    per = clusters.groupBy("recombinase_type").agg(F.count("*").alias("n_clusters"), F.count_if(F.col("n") == 1).alias("n_singletons"))
    ids = a.select("recombinase_type", "mge_id").union(b.select("recombinase_type", "mge_id")).groupBy("recombinase_type").agg(F.count_distinct("mge_id").alias("n_elements"))
    return ids.join(per, "recombinase_type", "left").select("recombinase_type", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), F.coalesce("n_singletons", F.lit(0)).alias("n_singletons"), "n_elements")


def duplicate_summary(table: DataFrame) -> DataFrame:
    """By the first row of each element: elements, groups, singletons and others."""
    df = first_row_per_key(table.select("mge_id", "ord", "singleton", "duplicate_group_number"), "mge_id", "ord")
    return df.agg(F.count("*").alias("n_elements"), F.count_distinct("duplicate_group_number").alias("n_groups"), F.count_if(F.col("singleton") == "yes").alias("n_singletons"), F.count_if(F.col("singleton") == "no").alias("n_grouped"))


def groups_by_type(table: DataFrame) -> DataFrame:
    df = table.groupBy("recombinase_type").agg(F.count_distinct("cluster_number").alias("n_clusters"), F.count_distinct("duplicate_group_number").alias("n_groups"), F.count_distinct(F.when(F.col("singleton") == "yes", F.col("mge_id"))).alias("n_singletons"))
    return df.orderBy(F.desc(F.col("n_clusters") + F.col("n_groups") + F.col("n_singletons")), "recombinase_type")


def group_size_histogram(groups: DataFrame) -> DataFrame:
    """Groups by size; sizes between the least and the greatest that no group has count 0."""
    hist = groups.groupBy("group_no").agg(F.count_distinct("member").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    full = hist.agg(F.min("size").alias("lo"), F.max("size").alias("hi")).where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias("size"))
    return full.join(hist, "size", "left").select("size", F.coalesce("n", F.lit(0)).alias("n"))


def type_conflicts(table: DataFrame) -> DataFrame:
    return table.groupBy("mge_id").agg(F.count_distinct("recombinase_type").alias("n_types")).where(F.col("n_types") > 1)


def label_counts(rows: DataFrame) -> DataFrame:
    """Rows per tier and rows per type."""
    return rows.groupingSets([["label"], ["rec_type"]], "label", "rec_type").agg(F.count("*").alias("n"))


def split_crosstab(rows: DataFrame, by: str = "split", values: tuple = ("train", "val", "test"), needed: tuple = ("val", "test")) -> DataFrame:
    """Groups per type, in all and by ``values`` of ``by``, 0 where a type has none; whether a needed one is 0."""
    groups = rows.select("rec_type", "cluster_number", "group_no", by).distinct()
    out = groups.groupBy("rec_type").agg(F.count("*").alias("n_groups"), *(F.count_if(F.col(by) == v).alias(f"n_{v}") for v in values))
    empty = F.lit(False)
    for v in needed:
        empty = empty | (F.col(f"n_{v}") == 0)
    return out.withColumn(f"empty_{by}", empty)


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """Number, squared and absolute error and share of right tiers, per type and in all (null type)."""
    error = F.col("prediction") - F.col("label")
    right = (E.nearest_tier(F.col("prediction")) == E.nearest_tier(F.col("label"))).cast("double")
    return predictions.rollup("rec_type").agg(F.count("*").alias("n"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.avg(right).alias("tier_accuracy"))


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and sample deviation over folds; the deviation is null for one fold."""
    return folds.groupBy("rec_type").agg(F.count("*").alias("n_folds"), F.avg("tier_accuracy").alias("mean_tier_accuracy"), F.stddev_samp("tier_accuracy").alias("std_tier_accuracy"), F.avg("mse").alias("mean_mse"), F.stddev_samp("mse").alias("std_mse"))


def prediction_quantiles(predictions: DataFrame) -> DataFrame:
    """Quartiles of the predictions of each type and label; a group of any size is ranked by many tasks."""
    return percentiles(predictions, ["rec_type", "label"], "prediction", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])


def accuracy_ranking(types: DataFrame, metrics: DataFrame) -> DataFrame:
    """Types by accuracy, those without data last."""
    df = types.join(metrics.select("rec_type", "tier_accuracy", "n"), "rec_type", "left")
    return df.withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.desc_nulls_last("tier_accuracy"), "rec_type")


def best_epoch(log: DataFrame) -> DataFrame:
    return log.agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("epoch"), F.min("val_loss").alias("val_loss"))


def peak_in_segment(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The first position of the largest magnitude, and the magnitude's share inside ``seg_start``, ``seg_length``."""
    inside = (F.col("position") >= F.col("seg_start")) & (F.col("position") < F.col("seg_start") + F.col("seg_length"))
    df = scores.groupBy(*keys).agg(F.max(F.struct("magnitude", (-F.col("position")).alias("back"))).alias("x"), F.sum(F.when(inside, F.col("magnitude")).otherwise(0.0)).alias("part"), F.sum("magnitude").alias("whole"), F.max("seg_start").alias("s"), F.max("seg_length").alias("l"))
    peak = (-F.col("x.back")).cast("bigint")
    return df.select(*keys, peak.alias("peak"), ((peak >= F.col("s")) & (peak < F.col("s") + F.col("l"))).alias("in_segment"), F.try_divide("part", "whole").alias("share"))


def position_weight_matrix(windows: DataFrame, kind: str = "rec_type", seq: str = "seq", least: int = 2) -> DataFrame:
    """Counts of bases by type and position, for types with enough windows."""
    enough = windows.groupBy(kind).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(kind)
    bases = windows.join(enough, kind, "left_semi").select(kind, F.posexplode(F.split(F.col(seq), "")).alias("position", "base"))
    return bases.groupBy(kind, "position").pivot("base", list("ACGT")).count().na.fill(0)


def group_species_report(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Groups that span several species, rows whose species is a stand-in, and components of species (``component``)."""
    per = rows.groupBy("group_no").agg(F.count_distinct("species").alias("n"))
    a = per.agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_spanning"))
    b = rows.agg(F.count_if(F.col("species").startswith("__unresolved")).alias("n_unresolved"))
    c = components.agg(F.count_distinct("component").alias("n_components"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(a).join(one(b), "one").join(one(c), "one").drop("one")
