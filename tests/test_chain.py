"""The final table: equal to the single joins, no shuffle behind the buckets, hot elements dealt."""

import pytest
from pyspark.sql import functions as F

from spanwright.operators import chain, joins, skew
from spanwright.session import Tables

COLUMNS = ["recombinase_id", "side", "duplicate_group_number", "duplicate_group_size", "singleton", "flank_sequence", "consensus_method", "consensus_start", "consensus_length", "consensus_sequence"]


@pytest.fixture(scope="module")
def tables(spark):
    """Element e0 holds a third of the rows; e1 has no windows, e2 and null ones no group."""
    rows = [("e0" if i % 3 == 0 else None if i % 50 == 1 else f"e{i % 40 + 1}", f"g{i}", f"t{i % 2}", i % 7 or None, i) for i in range(900)]
    table = spark.createDataFrame(rows, "mge_id string, recombinase_id string, recombinase_type string, cluster_number long, ord long")
    groups = spark.createDataFrame([(f"e{i}", g) for i in range(40) if i != 2 for g in (i % 9, i % 4)], "member string, group_no long")
    flanks = spark.createDataFrame([(f"e{i}", "A" * i, "C" * i) for i in range(60) if i != 1], "mge_id string, left string, right string")
    made = [(f"t{t}", c, side, source, source, 5, t + c, side[0] * c) for t in (0, 1) for c in range(1, 6) for side in ("left", "right") for source in ("alignment", "stacking") if (c, source) != (2, "stacking")]
    results = spark.createDataFrame(made[1:], "rec_type string, cluster_number long, side string, consensus_source string, method string, consensus_start long, consensus_length long, consensus_sequence string")
    return table, groups, flanks, results


def test_final_table_equals_the_single_joins(tables):
    table, groups, flanks, results = tables
    step = joins.append_duplicates(table, groups).withColumnRenamed("recombinase_type", "rec_type")
    want = joins.append_consensus(joins.append_flanks(step, flanks), results)
    got = chain.final_table(table, groups, flanks, results, buckets=6)
    rows = lambda df: sorted(map(repr, df.select(*COLUMNS).collect()))
    assert rows(got) == rows(want) and got.count() == 1800


def test_buckets_are_joined_without_a_shuffle(tables, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 10)
    table, groups, flanks, results = tables
    got = chain.final_table(table, groups, flanks, results, buckets=6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Broadcast" not in plan
    tasks = got.where("mge_id = 'e0'").select(F.spark_partition_id().alias("task")).distinct().count()
    assert got.count() == 1800 and tasks > 1


def test_a_hot_element_is_spread(tables, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 10)
    hot = {r["mge_id"]: r["_parts"] for r in skew.frequent_keys(tables[0], ["mge_id"]).collect()}
    assert hot == {"e0": 3}


def test_empty_tables(tables):
    none = [df.where("false") for df in tables]
    assert chain.final_table(*none, buckets=2).count() == 0
    got = chain.final_table(tables[0], *none[1:], buckets=2)
    assert got.count() == 1800 and got.where("flank_sequence is not null or consensus_method is not null or singleton = 'no'").count() == 0


def test_dropped_buckets_leave_no_table(spark):
    kept, before = Tables(spark), len(spark.catalog.listTables())
    df = kept.bucketed(spark.range(10), ["id"], 2)
    assert df.count() == 10 and len(spark.catalog.listTables()) == before + 1
    kept.drop(df)
    assert len(spark.catalog.listTables()) == before and not kept.paths
