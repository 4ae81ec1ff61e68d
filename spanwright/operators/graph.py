"""Graph operators: components of a graph given by edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.skew import even_join
from spanwright.session import Tables


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rows: int | None = None) -> DataFrame:
    """``id, component`` for every vertex that an edge names; a component is its least vertex.

    Labels spread along edges and are then replaced by their own labels (pointer jumping), so the
    rounds grow with the logarithm of a component's width. Each round is a table in the shared
    folder, deleted when the next one stands; a vertex with very many edges is dealt to several
    tasks. ``rows`` is the number of edges, if known. Null ends and loops make no edge but a loop names its vertex. An empty table gives an
    empty result.
    """
    kept = Tables(edges.sparkSession)
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = kept.keep(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), None if rows is None else 2 * rows)
    most = both.count()
    degrees = kept.keep(both.groupBy("b").agg(F.count("*").alias("n")), most)
    # The first labels: the least of a vertex and its neighbours
    labels = kept.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component"), F.lit(True).alias("changed")), most)
    while not labels.where("changed").isEmpty():
        near = even_join(both, labels.select(F.col("id").alias("b"), "component"), ["b"], counts=degrees).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        spread = kept.keep(labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("now")), most)
        jump = labels.select(F.col("id").alias("now"), F.col("component").alias("further"))
        now = F.least("now", F.coalesce("further", "now"))
        after = kept.keep(even_join(spread, jump, ["now"], "left").select("id", now.alias("component"), (now != F.col("was")).alias("changed")), most)
        kept.drop(spread, labels)
        labels = after
    kept.drop(both, degrees)
    return labels.select("id", "component")
