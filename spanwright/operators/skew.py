"""Joins whose frequent keys are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent if it holds more than one in SHARE of the left rows, and more than LEAST rows.
SHARE, LEAST = 2000, 100
#: So few left rows are joined as they are.
FEW = 1000


def frequent_keys(left: DataFrame, keys: list[str], counts: DataFrame | None = None, total: int | None = None) -> DataFrame | None:
    """``keys, _parts`` of the keys that hold more than one in SHARE of the rows, or None: fewer than SHARE of them."""
    total = left.count() if total is None else total
    counts = left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    least = max(LEAST, total // SHARE)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    frequent = counts.where((F.col("n") > least) & known).select(*keys, F.ceil(F.col("n") / least).cast("int").alias("_parts")).collect()
    if not frequent:
        return None
    return left.sparkSession.createDataFrame(frequent, counts.select(*keys, F.lit(1).alias("_parts")).schema)


def even_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` by equal ``keys``, which no task gets too many rows of.

    Fewer than SHARE keys can be frequent, whatever the input's size, so their list is bounded: it is
    taken to the driver and broadcast. Left rows of such a key are dealt by a hash of the row; the
    right rows are repeated for each part. ``counts`` has the keys and ``n``, the left rows of each,
    where that is known already, and ``total`` the number of left rows or of those with frequent keys.
    ``left`` is read up to three times, so it should be a kept table. Null keys meet nothing and stay where ``how`` keeps them.
    """
    total = left.count() if total is None else total
    if total <= FEW:
        return left.join(right, keys, how)
    hot = frequent_keys(left, keys, counts, total)
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    part = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_parts")).cast("int"), F.lit(0))
    dealt = left.join(hot, keys, "left").withColumn("_part", part).drop("_parts")
    repeated = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [*keys, "_part"], how).drop("_part")
