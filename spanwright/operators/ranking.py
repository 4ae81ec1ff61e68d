"""Numbers and running sums within keys, made by all tasks however few the keys are.

Rows are dealt to ranges of (key, order); what a key has in earlier ranges is summed from one row
for each key and range. So one key that holds all rows is numbered by as many tasks as there are ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanwright.session import Tables

#: Bits of Spark's row ids that count the rows of a partition.
ROW_BITS = 33


def _free(name: str, df: DataFrame) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def in_ranges(df: DataFrame, by: Sequence[Column | str], at: str, tables: Tables, parts: int | None = None) -> DataFrame:
    """A kept table of ``df`` sorted by ``by`` in ranges; ``at`` is the range and the place in it, as one number."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tables.keep(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, tables: Tables | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the place (1, 2, ...) of each row among those of its ``keys``, by ``order``.

    Null keys are a key of their own. Rows that ``keys`` and ``order`` don't tell apart get different
    numbers, one of them any; give a whole order for results that repeat. ``df`` is read twice, so it
    should be a kept table or cheap. An empty table gives an empty table.
    """
    tables = tables or Tables(df.sparkSession)
    at, part, first, base, before = (_free(n, df) for n in ("_at", "_range", "_first", "_base", "_before"))
    rows = in_ranges(df, [*keys, *order], at, tables, parts)
    rows = rows.withColumn(part, F.shiftrightunsigned(at, ROW_BITS))
    held = rows.groupBy(*keys, part).agg(F.min(at).alias(first), F.count("*").alias(base))
    # A row for each range at most is in a window
    earlier = F.coalesce(F.sum(base).over(W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn(before, earlier).select(*(F.col(k).alias(f"{base}{i}") for i, k in enumerate(keys)), F.col(part).alias(f"{base}p"), first, before)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{base}{i}")) for i, k in enumerate(keys)), F.col(part) == F.col(f"{base}p"))
    return rows.join(held, same).select(*df.columns, (F.col(before) + F.col(at) - F.col(first) + 1).alias(name))


def least_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key by ``order``, with their places in ``name``.

    Places are limited before rows are shuffled (Spark's partial group limit), so ``k`` rows of a
    key leave a task at most, and ``k`` times the tasks meet.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= k)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], names: Sequence[str], tables: Tables | None = None) -> DataFrame:
    """``keys, n`` and the exact percentiles of each key's values, between two neighbours by their distance.

    Values are numbered in ranges, and the two that a fraction lies between are picked by their numbers, so no task
    holds a key's values. Null values don't count; a key without any has null percentiles and ``n`` 0.
    """
    tables = tables or Tables(df.sparkSession)
    rows = tables.keep(df.select(*keys, F.col(value).alias("_value")))
    placed = numbered(rows.where(F.col("_value").isNotNull()), keys, ["_value"], "_place", tables)
    counts = tables.keep(rows.groupBy(*keys).agg(F.count("_value").alias("n")))
    at = lambda f: (F.col("n") - 1) * F.lit(f)
    asked = F.array(*(F.struct(F.lit(i).alias("_i"), at(f).alias("_at"), (x(at(f)) + 1).alias("_place"), F.lit(up).alias("_up")) for i, f in enumerate(fractions) for up, x in enumerate((F.floor, F.ceil))))
    wanted = counts.where(F.col("n") > 0).select(*keys, F.explode(asked).alias("x")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "x.*")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), placed["_place"] == wanted["_place"])
    met = placed.join(wanted, same)
    far = F.col("_at") - F.floor("_at")
    share = F.when(F.col("_up") == 1, far).otherwise(F.when(far == 0, 1.0).otherwise(1 - far))
    found = met.groupBy(*keys).agg(*(F.sum(F.when(F.col("_i") == i, F.col("_value") * share)).alias(n) for i, n in enumerate(names)))
    if not keys:
        return counts.join(F.broadcast(found))  # one row each
    alike = reduce(lambda a, b: a & b, (counts[k].eqNullSafe(found[k]) for k in keys))
    return counts.join(found, alike, "left").select(*(counts[k] for k in keys), "n", *names)
