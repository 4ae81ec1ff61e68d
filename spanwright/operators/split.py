"""Splits of labelled groups that keep a species on one side."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwright.operators.graph import connected_components
from spanwright.operators.skew import even_join
from spanwright.session import Tables

#: Components of one footprint up to this number are placed one by one; of more the bulk is computed.
ONE_BY_ONE = 1000


def species_components(rows: DataFrame) -> DataFrame:
    """``species, component``: species that occur together in a group are united.

    ``rows`` has ``group_no, species``. A group's least species stands for the group, so a group of
    many species makes as many edges, not their square.
    """
    first = rows.groupBy("group_no").agg(F.min("species").alias("first"))
    edges = rows.join(first, "group_no").select(F.col("first").alias("src"), F.col("species").alias("dst")).distinct()
    return connected_components(edges).select(F.col("id").alias("species"), "component")


def group_components(rows: DataFrame, components: DataFrame) -> DataFrame:
    """``group_no, rec_type, component`` of each group."""
    per = rows.groupBy("rec_type", "cluster_number", "group_no").agg(F.min("species").alias("species"))
    return per.join(components, "species").drop("species")


def component_footprint(groups: DataFrame) -> DataFrame:
    """``component, rec_type, n``: groups by component and type; null type is their total."""
    return groups.groupingSets([["component", "rec_type"], ["component"]], "component", "rec_type").agg(F.count("*").alias("n"))


def place(footprints: list[tuple[np.ndarray, int]], targets: np.ndarray) -> list[np.ndarray]:
    """How many components of each footprint go to each bucket, placed in this order.

    A footprint is counts in all and by type, with the number of components that have it. Each
    component goes to the bucket whose fullest count, in all or of one of its types, stays lowest
    against its target; earlier buckets win ties. Components of one footprint fill the buckets in
    steps that grow, so the bulk of very many is found by the height they reach.
    """
    filled, out = np.zeros_like(targets), []
    for add, m in footprints:
        touched, counts = add > 0, np.zeros(len(targets), np.int64)
        room = targets[:, touched]
        height = lambda n: np.where(room > 0, (filled[:, touched] + n[:, None] * add[touched]) / np.where(room > 0, room, 1), np.inf).max(1)  # noqa: B023, E731
        if m > ONE_BY_ONE:
            low, high = 0.0, float(height(np.full(len(targets), float(m))).max())
            for _ in range(100):
                middle = (low + high) / 2
                fit = np.floor(np.where(room > 0, (middle * room - filled[:, touched]) / add[touched], -np.inf).min(1)).clip(0, m)
                low, high = (middle, high) if fit.sum() <= m - len(targets) else (low, middle)
            fit = np.floor(np.where(room > 0, (low * room - filled[:, touched]) / add[touched], -np.inf).min(1)).clip(0, m)
            counts = np.maximum(fit.astype(np.int64) - 1, 0)
        for _ in range(m - int(counts.sum())):
            counts[int(np.argmin(height(counts + 1.0)))] += 1
        filled += counts[:, None] * add
        out.append(counts)
    return out


def assign_buckets(footprint: DataFrame, names: list[str], shares: list[float], seed: int) -> DataFrame:
    """``component, bucket``: whole components dealt to buckets so that totals and types come near their shares.

    Largest components are placed first, as ``place`` says; among equals in size those of one
    footprint follow each other, and in it a digest of the component and the seed tells which goes
    where. The driver holds a row for each different footprint, not for each component: small
    components, of which there can be very many, have few different ones.
    """
    kept = Tables(footprint.sparkSession)
    types = footprint.where(F.col("rec_type").isNotNull())
    everything = {r["rec_type"]: r["n"] for r in types.groupBy("rec_type").agg(F.sum("n").alias("n")).collect()}  # a row for each type
    # A component has as many entries as there are types
    shape = F.array_sort(F.collect_list(F.struct("rec_type", "n")))
    mark = F.md5(F.concat(F.col("component").cast("string"), F.lit(f":{seed}")).cast("binary"))
    shaped = types.groupBy("component").agg(F.sum("n").alias("total"), F.to_json(shape).alias("shape"), F.first(F.lit(1)).alias("one")).drop("one")
    shaped = kept.keep(shaped.withColumn("mark", mark).withColumn("block", F.substring("mark", 1, 3)))
    classes = shaped.groupBy("total", "shape").agg(F.count("*").alias("m")).orderBy(F.desc("total"), "shape").withColumn("entries", F.from_json("shape", "array<struct<rec_type: string, n: long>>")).collect()
    column = {t: i + 1 for i, t in enumerate(sorted(everything))}
    whole = sum(everything.values())
    targets = np.array([[s * whole] + [s * everything[t] for t in column] for s in shares])
    footprints = []
    for r in classes:
        add = np.zeros(targets.shape[1])
        add[0] = r["total"]
        for e in r["entries"]:
            add[column[e["rec_type"]]] += e["n"]
        footprints.append((add, r["m"]))
    ends = [(r["shape"], np.cumsum(c).tolist()) for r, c in zip(classes, place(footprints, targets), strict=True)]
    until = footprint.sparkSession.createDataFrame(ends, "shape string, ends array<long>")
    # The place of a component in its footprint: blocks of marks are counted first, so none is ranked in one task
    blocks = shaped.groupBy("shape", "block").agg(F.count("*").alias("n"))  # 4096 blocks of a footprint at most
    before = blocks.select("shape", "block", (F.sum("n").over(W.partitionBy("shape").orderBy("block")) - F.col("n")).alias("before"))
    ranked = shaped.withColumn("nth", F.row_number().over(W.partitionBy("shape", "block").orderBy("mark", "component"))).join(before, ["shape", "block"])
    ranked = kept.keep(ranked.select("component", "shape", (F.col("nth") + F.col("before")).alias("nth")))
    bucket = F.size(F.filter("ends", lambda e: e < F.col("nth")))
    return even_join(ranked, until, ["shape"]).select("component", F.get(F.array(*map(F.lit, names)), bucket).alias("bucket"))


def leakage_check(rows: DataFrame, by: str) -> DataFrame:
    """Species in more than one bucket; none if the split is right."""
    return rows.groupBy("species").agg(F.count_distinct(by).alias("n")).where(F.col("n") > 1)
