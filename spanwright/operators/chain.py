"""The final table of elements, put together with one shuffle of each input by element.

Marks, clusters, species and consensus are joined while rows are narrow. Then rows, groups and windows
are written in buckets of the element, as many for each, and joined bucket by bucket, so the
sequences are never shuffled again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.skew import frequent_keys
from spanwright.session import Tables

SIDES = ("left", "right")
CONSENSUS = {"method": "consensus_method", "consensus_start": "consensus_start", "consensus_length": "consensus_length", "consensus_sequence": "consensus_sequence"}


def consensus_of_sides(results: DataFrame) -> DataFrame:
    """``rec_type, cluster_number`` with the consensus of both sides; stacking before alignment."""
    rank = F.when(F.col("consensus_source") == "stacking", 0).otherwise(1)
    value, keyed = F.struct(*CONSENSUS), ["rec_type", "cluster_number"]
    sides = [F.min_by(F.when(F.col("side") == s, value), F.when(F.col("side") == s, rank)).alias(f"c_{s}") for s in SIDES]
    return results.groupBy(*keyed).agg(*sides)


def groups_of_elements(elements: DataFrame, groups: DataFrame) -> DataFrame:
    """Elements with the last of their groups, and that one's size among ``elements``."""
    last = groups.groupBy(F.col("member").alias("mge_id")).agg(F.max("group_no").alias("duplicate_group_number"))
    own = elements.select("mge_id").distinct().join(last, "mge_id")
    sizes = own.groupBy("duplicate_group_number").agg(F.count("*").alias("duplicate_group_size"))
    return own.join(sizes, "duplicate_group_number")


def final_table(table: DataFrame, groups: DataFrame, flanks: DataFrame, results: DataFrame, buckets: int | None = None, kept: Tables | None = None) -> DataFrame:
    """Tables c to e in one: two rows, left and right, for each row of ``table`` (table b, a kept table).

    ``flanks`` has a row for each element (``mge_id, left, right``), ``groups`` the members of duplicate
    groups, ``results`` the consensus by type, cluster, side and source. An element of very many rows is
    spread over several buckets by its genes, with its group and windows repeated in each. Null elements
    have no group and no windows; missing clusters no consensus. Empty tables give empty results.
    """
    spark = table.sparkSession
    kept = kept or Tables(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = frequent_keys(table, ["mge_id"])
    rows = table.join(consensus_of_sides(results).withColumnRenamed("rec_type", "recombinase_type"), ["recombinase_type", "cluster_number"], "left")
    own = groups_of_elements(table, groups)
    windows = flanks.select("mge_id", "left", "right")
    if hot is None:
        rows, own, windows = (df.withColumn("part", F.lit(0)) for df in (rows, own, windows))
    else:
        rows = rows.join(F.broadcast(hot), "mge_id", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("recombinase_id", "ord"), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
        every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
        own, windows = (df.join(F.broadcast(hot), "mge_id", "left").withColumn("part", every).drop("_parts") for df in (own, windows))
    keys = ["mge_id", "part"]
    rows, own, windows = (kept.bucketed(df, keys, buckets) for df in (rows, own, windows))
    # Merge joins of buckets: a broadcast of windows would grow with the elements
    df = rows.join(own.hint("merge"), keys, "left").join(windows.hint("merge"), keys, "left")
    df = df.withColumn("singleton", F.when(F.col("duplicate_group_number").isNull(), "yes").otherwise("no")).withColumn("side", F.explode(F.array(*map(F.lit, SIDES))))
    left = F.col("side") == "left"
    best = F.when(F.col("singleton") == "no", F.when(left, F.col("c_left")).otherwise(F.col("c_right")))
    df = df.withColumn("flank_sequence", F.when(left, F.col("left")).otherwise(F.col("right"))).withColumns({n: best[c] for c, n in CONSENSUS.items()})
    return df.drop("c_left", "c_right", "left", "right", "part")
