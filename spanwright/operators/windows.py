"""Ordered scans: numbering, first and last rows, best windows and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanwright.operators.ranking import least_per_key, numbered
from spanwright.session import Tables


def cluster_number(table: DataFrame, kind: str = "recombinase_type", rep: str = "rep", ord: str = "ord") -> DataFrame:
    """``cluster_number``: representatives of a type, numbered by the first appearance of any member.

    One row for each representative is numbered, in ranges: a type of all representatives is numbered by all tasks.
    """
    firsts = table.where(F.col(rep).isNotNull()).groupBy(kind, rep).agg(F.min(ord).alias("first"))
    kept = Tables(table.sparkSession)
    numbers = numbered(kept.keep(firsts), [kind], ["first", rep], "cluster_number", kept).drop("first")
    return table.join(numbers, [kind, rep], "left")


def cluster_size(table: DataFrame, kind: str = "recombinase_type", number: str = "cluster_number") -> DataFrame:
    """``cluster_size``: rows of the same type and number; null without a number."""
    sizes = table.where(F.col(number).isNotNull()).groupBy(kind, number).agg(F.count("*").alias("cluster_size"))
    return table.join(sizes, [kind, number], "left")


def first_row_per_key(df: DataFrame, key: str, ord: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), ord).alias("x")).select(key, "x.*")


def last_row_per_key(df: DataFrame, key: str, ord: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), ord).alias("x")).select(key, "x.*")


def best_window(scores: DataFrame, keys: list[str], k: int = 15) -> DataFrame:
    """``start, total`` of the k positions in a row with the largest magnitude, the earliest of equals.

    ``scores`` has ``position`` from 0 without holes, and ``magnitude``.
    """
    w = W.partitionBy(*keys).orderBy("position").rowsBetween(W.currentRow, k - 1)
    sums = scores.select(*keys, "position", F.sum("magnitude").over(w).alias("total"), F.count("*").over(w).alias("n")).where(F.col("n") == k)
    best = sums.groupBy(*keys).agg(F.max(F.struct("total", (-F.col("position")).alias("back"))).alias("x"))
    return best.select(*keys, (-F.col("x.back")).cast("bigint").alias("start"), F.col("x.total").alias("total"))


def sample_per_key(df: DataFrame, key: str, id: str, n: int, seed: int) -> DataFrame:
    """n rows of each key in an order that the seed and the ids give."""
    mark = F.md5(F.concat(F.col(id).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return least_per_key(df, [key], [mark, id], n, "_rank").drop("_rank")


def sample_headers(records: DataFrame, per_file: int = 2, total: int = 10) -> DataFrame:
    """The first headers of each file, and few in all."""
    return least_per_key(records, ["file"], ["ord"], per_file).orderBy("file", "rank").limit(total).select("file", "header")


def top_k_with_rest(df: DataFrame, key: str, id: str, k: int) -> DataFrame:
    """``key, ids``: the first k distinct ids of each key in their order, and how many more there are.

    k ids of a key and task are shuffled at most, so a key may have any number.
    """
    ids = df.select(key, id).distinct()
    sizes = ids.groupBy(key).agg(F.count(id).alias("n"))
    first = least_per_key(ids.where(F.col(id).isNotNull()), [key], [id], k).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(id)), ", ").alias("first"))
    rest = F.when(F.col("n") > k, F.concat(F.lit(" (+"), (F.col("n") - k).cast("string"), F.lit(" more)"))).otherwise("")
    return sizes.join(first, key, "left").select(key, F.concat(F.coalesce("first", F.lit("")), rest).alias("ids"))
