"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: texts are long, so batches are smaller than Spark's default.
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers by the rows and the bytes of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def blocks(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Slices of neighbouring items of ``most`` in all, or of one item that is larger alone."""
    at = held = n = 0
    for size in sizes:
        if n > at and held + size > most:
            yield slice(at, n)
            at, held = n, 0
        held += size
        n += 1
    if n > at:
        yield slice(at, n)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def row_key(doc_id: Column, text: Column) -> Column:
    """A key that equal (id, text) rows share, null ids and texts included."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.hex(F.xxhash64(text)), F.length(text).cast("string"))


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, lengthened until no column has it (names don't tell cases apart)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name
