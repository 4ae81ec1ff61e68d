"""Worked examples of scalar functions."""

from pyspark.sql import functions as F

from spanwright.functions import expr as E


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_attributes_split_at_the_first_equals_sign_and_the_last_key_wins(spark):
    assert value(spark, E.attr_map(F.lit("a=1; b=x=y;flag;;a=2"))) == {"a": "2", "b": "x=y"}
    assert value(spark, E.attr_map(F.lit(""))) == {}


def test_type_counts(spark):
    assert value(spark, E.type_counts(F.lit("is_tn:2,ce:1,is_tn:x,,phage"))) == {"is_tn": 3, "ce": 1, "phage": 1}
    assert value(spark, E.type_counts(F.lit(None).cast("string"))) == {}


def test_ids(spark):
    assert value(spark, E.accession_of(F.lit("MGE_GCA_000001.1_12.SAM.c:1-2"))) == "GCA_000001.1"
    assert value(spark, E.accession_of(F.lit("MGE_GCF_000001.1_12.SAM.c:1-2"))) is None
    assert value(spark, E.genome_key_of_id(F.lit("MGE_GCA_000001.1_12.SAM.c:1-2"))) == "12.SAM"
    assert value(spark, E.genome_key_of_id(F.lit("MGE_x"))) is None
    assert value(spark, E.genome_key_of_contig(F.lit("12.SAM.c1"))) == "12.sam"


def test_reverse_complement_keeps_other_characters(spark):
    assert value(spark, E.revcomp(F.lit("AcG-N"))) == "N-CgT"


def test_windows_are_clamped(spark):
    one = lambda *a: [value(spark, c) for c in E.flank_windows(*map(F.lit, a), 50, 30)]
    assert one(1, 10, 40) == [0, 30, 0, 30]
    assert one(100, 200, 220) == [79, 129, 170, 220]


def test_overlap_longer_than_the_window_leaves_nothing(spark):
    assert value(spark, E.strip_overlap(F.lit("ACGT"), F.lit("left"), 4)) == ""
    assert value(spark, E.strip_overlap(F.lit("ACGTA"), F.lit("left"), 4)) == "A"
    assert value(spark, E.strip_overlap(F.lit("ACGTA"), F.lit("right"), 0)) == "ACGTA"


def test_motifs_match_on_both_strands(spark):
    assert value(spark, E.motif_match(F.lit("ttggaaatgtt"), "GGnnnTG"))
    assert value(spark, E.motif_match(F.lit("CATTTCC"), "GGnnnTG"))
    assert not value(spark, E.motif_match(F.lit("GGA"), "GGnnnTG"))


def test_tiers_and_buckets(spark):
    assert value(spark, E.nearest_tier(F.lit(0.85))) == 0.7  # of two equally close tiers the earlier
    assert [value(spark, E.length_bucket(F.lit(n))) for n in (3, 4, 5, 20, 21)] == ["under_4", None, "4_to_20", None, "over_20"]


def test_flipping_twice_gives_the_start_back(spark):
    once = E.flip_segment(F.lit(7), F.lit(5), F.lit(100), F.lit("left"))
    assert value(spark, E.flip_segment(once, F.lit(5), F.lit(100), F.lit("left"))) == 7
