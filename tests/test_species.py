"""All species of an extreme are named, however many share it."""

from pyspark.sql import functions as F

from spanwright.operators import aggregates as A

SCHEMA = "speci string, n long"


def test_every_tied_species_is_named(spark):
    rows = [(f"s{i:03}", 9 if i % 2 else 2) for i in range(40)] + [("between", 5), (None, 9)]
    got = A.genomes_per_species(spark.createDataFrame(rows, SCHEMA).orderBy(F.hash("speci"))).first()
    assert got["max_species"] == ",".join(sorted(s for s, n in rows if n == 9 and s))
    assert got["min_species"] == ",".join(sorted(s for s, n in rows if n == 2))
    assert (got["max_n"], got["min_n"], got["median_n"], got["n_species"]) == (9, 2, 7.0, 42)


def test_no_species(spark):
    got = A.genomes_per_species(spark.createDataFrame([], SCHEMA)).first()
    assert (got["max_n"], got["max_species"], got["min_species"], got["n_species"]) == (None, None, None, 0)
    assert A.genomes_per_species(spark.createDataFrame([(None, 3)], SCHEMA)).first()["max_species"] is None
