"""Long sequences as tiles, so that an interval meets the tiles that it touches and not its whole contig."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.operators.skew import even_join
from spanwright.session import Tables

TILE = 1024


def tiled(contigs: DataFrame, id: str = "contig_id", seq: str = "seq", size: int = TILE) -> DataFrame:
    """``id, tile, bases``: the pieces of each sequence, numbered from 0; empty and null ones have none."""
    starts = F.sequence(F.lit(0), ((F.length(seq) - 1) / size).cast("int"))
    pieces = F.transform(starts, lambda t: F.struct(t.alias("tile"), F.substr(F.col(seq), t * size + 1, F.lit(size)).alias("bases")))
    return contigs.where(F.length(seq) > 0).select(id, F.explode(pieces).alias("x")).select(id, "x.tile", "x.bases")


def lengths(contigs: DataFrame, id: str = "contig_id", seq: str = "seq") -> DataFrame:
    return contigs.select(id, F.length(seq).alias("size"))


def slices(rows: DataFrame, tiles: DataFrame, windows: dict[str, tuple[Column, Column]], key: str, id: str = "contig_id", size: int = TILE, tables: Tables | None = None) -> DataFrame:
    """``key`` and a column for each of ``windows``: the bases from a place up to another (from 0, end excluded) of the row's contig.

    ``key`` tells rows apart, ``tiles`` is a kept table. Places are clamped at 0 and the sequence's end; a window without bases is
    null here. Pieces are cut out of a tile where they meet, so what is shuffled on is bounded by the windows; a tile
    with very many intervals is dealt to several tasks.
    """
    kept = tables or Tables(rows.sparkSession)
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("window"), F.greatest(s, F.lit(0)).cast("bigint").alias("s"), e.cast("bigint").alias("e")) for n, (s, e) in windows.items()))).alias("w")
    asked = rows.select(key, id, named).select(key, id, "w.*").where(F.col("e") > F.col("s"))
    div = lambda c: F.floor(c / size).cast("int")
    asked = kept.keep(asked.withColumn("tile", F.explode(F.sequence(div(F.col("s")), div(F.col("e") - 1)))))
    met = even_join(asked, tiles, [id, "tile"])
    base = F.col("tile") * size
    first = F.greatest(F.col("s") - base, F.lit(0))
    cut = F.substr("bases", (first + 1).cast("int"), (F.least(F.col("e") - base, F.lit(size)) - first).cast("int"))
    pieces = met.select(key, "window", "tile", cut.alias("cut"))
    joined = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("window") == n, F.struct("tile", "cut")))), lambda x: x["cut"]), "")
    return pieces.groupBy(key).agg(*(joined(n).alias(n) for n in windows))
