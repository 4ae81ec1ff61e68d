"""Filters over annotated intervals, sequence records and similarity pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions import expr as E


def target_islands(elements: DataFrame, kind: str) -> DataFrame:
    """Non-nested elements whose type counts have the wanted type."""
    return elements.where(F.map_contains_key(E.type_counts("mge"), kind) & (F.col("mge_type") == "non-nested"))


def target_gene_sequences(records: DataFrame, kind: str) -> DataFrame:
    """Sequence records whose header passes the same test."""
    mge, mge_type = E.header_type_fields("header")
    return records.where(F.map_contains_key(E.type_counts(mge), kind) & (mge_type == "non-nested"))


def recombinase_genes(genes: DataFrame) -> DataFrame:
    return genes.where(F.col("recombinase").isNotNull())


def pair_verdict(ani: float, fraction: float) -> Column:
    """Why a pair is rejected, the similarity being looked at first; null if it is accepted."""
    low = (F.col("af_ref") < fraction) | (F.col("af_query") < fraction)
    return F.when(F.col("ani") < ani, "ani").when(low, "fraction")


def accept_pairs(pairs: DataFrame, ani: float, fraction: float) -> DataFrame:
    return pairs.where(pair_verdict(ani, fraction).isNull())


def contained_in() -> Column:
    """Whether a gene lies inside its element."""
    return (F.col("g_start") >= F.col("start_pos")) & (F.col("g_end") <= F.col("end_pos"))


def valid_coords(start: Column, end: Column, length: Column) -> Column:
    return (start >= 1) & (end <= length)


def empty_extract_guard(islands: DataFrame, records: DataFrame) -> DataFrame:
    """A row that says whether islands were found but no sequence for any of them."""
    a, b = islands.agg(F.count("*").alias("n_islands")), records.agg(F.count("*").alias("n_sequences"))
    both = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("alarm", (F.col("n_islands") > 0) & (F.col("n_sequences") == 0))
