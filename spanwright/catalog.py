"""Every query of the library by name, with its DuckDB twin where SQL can express it.

A query is written as a function of ``x``: ``x("name")`` is a fixture derived from the given tables,
``x.table("name")`` a given table, ``x.spark`` the session. ``x.keep`` writes what a query reads more
than once as a table of the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.fixtures import fixture, twin
from spanwright.session import Tables, configured

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


@dataclass
class Inputs:
    spark: SparkSession
    sf_dir: str
    held: dict[str, DataFrame] = field(default_factory=dict)
    tables: Tables = field(init=False)

    def __post_init__(self) -> None:
        self.tables = Tables(self.spark)

    def __call__(self, name: str) -> DataFrame:
        return self.held.get(name) or fixture(self.spark, self.sf_dir, name, self.held)

    def keep(self, name: str, make: Callable[[], DataFrame] | None = None) -> DataFrame:
        """A fixture, or what ``make`` gives, as a table that is made once for a query."""
        if name not in self.held:
            self.held[name] = self.tables.keep(make() if make else self(name))
        return self.held[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, so that results have the types that the twins have."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of ``x`` under a name, with the body of its twin."""

    def add(f: Callable[[Inputs], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: widened(f(Inputs(configured(spark), sf_dir)))
        if sql:
            SQL[name] = twin(sql)
        return f

    return add


from spanwright import catalog_functions, catalog_joins, catalog_labels, catalog_sources, catalog_stacks  # noqa: E402, F401  (they register their queries)
