"""Document fingerprints by content-defined chunking.

A gear hash runs over the bytes of a text; a chunk ends where its top bits are zero, more bits
being asked for before the normal chunk length than after it. Bounds depend on the last 32 bytes
only, so chunks on both sides of an edit stay the same wherever they stand. A fingerprint is the
set of chunk digests with the bytes that each covers; containment is the share of the smaller
text's bytes that lie in chunks of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanwright.llm.common import blocks, small_batches

#: Bytes of a chunk: least, normal and most; zero bits asked for before and after the normal length.
LEAST, NORMAL, MOST = 16, 48, 192
STRICT, LOOSE = 7, 4
#: Texts of about this many bytes are hashed together.
BLOCK_BYTES = 1_000_000
#: Bytes of a range of documents, about; ranges, at most, that bytes ask for; sampled ids for each of them.
PART_BYTES, RANGES, SAMPLED = 32_000_000, 50_000, 20


def _gear() -> np.ndarray:
    """A random 32-bit number for each byte value, derived from the value's digest."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)


GEAR = _gear()


def bounds(data: bytes, spans: list[tuple[int, int]]) -> list[list[int]]:
    """The chunk ends of each text, given its span in ``data``; 32 bytes stand between texts."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    reach = 1
    while reach < min(32, len(h)):  # the sum of the last 32 bytes' numbers, each shifted by its distance
        h[reach:] += h[:-reach].copy() << np.uint32(reach)
        reach *= 2
    places = np.flatnonzero(h < (1 << (32 - LOOSE)))
    strict = (h[places] < (1 << (32 - STRICT))).tolist()
    firsts = np.searchsorted(places, spans).tolist()
    places = (places + 1).tolist()  # a chunk ends behind its last byte
    out = []
    for (at, end), (i, last) in zip(spans, firsts, strict=True):
        ends = []
        while end - at > LEAST:
            while i < last and places[i] < at + LEAST:
                i += 1
            while i < last and places[i] < at + NORMAL and not strict[i]:
                i += 1
            at = min(places[i] if i < last else end, at + MOST, end)
            ends.append(at)
        if at < end:
            ends.append(end)
        out.append(ends)
    return out


def chunk_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """Per text the digest of each chunk with the bytes that it covers in the text."""
    pad, at, spans = bytes(32), 0, []
    for t in texts:  # the pad makes a text's first bytes count alike wherever it stands
        spans.append((at + 32, at + 32 + len(t)))
        at += 32 + len(t)
    data = pad + pad.join(texts)
    digest = xxhash.xxh3_64_intdigest
    out = []
    for (at, _), ends in zip(spans, bounds(data, spans), strict=True):
        found: dict[int, int] = {}
        for end in ends:
            d = digest(data[at:end])
            found[d] = found.get(d, 0) + end - at
            at = end
        out.append(found)
    return out


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Shared bytes by the bytes of the smaller text; two empty texts are alike, one is not."""
    if not a or not b:
        return float(not a and not b)
    if len(a) > len(b):
        a, b = b, a
    shared = sum(min(n, b[d]) for d, n in a.items() if d in b)
    return shared / min(sum(a.values()), sum(b.values()))


def as_text(found: dict[int, int]) -> str:
    """A fingerprint as a string: digest and bytes of each chunk, sorted."""
    return " ".join([f"{d:016x}.{n:x}" for d, n in sorted(found.items())])


def from_text(fingerprint: str) -> dict[int, int]:
    return {int(d, 16): int(n, 16) for d, n in (x.split(".") for x in fingerprint.split())}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every whole text, without any shuffle; a null text counts as empty."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            texts = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            for part in blocks(map(len, texts), BLOCK_BYTES):
                prints += map(as_text, chunk_sets(texts[part]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "doc_id long, fingerprint string")


def _cuts(rows: DataFrame, total: int, parts: int) -> np.ndarray:
    """Ids, ascending, that cut ``rows`` (``doc_id, text``, no null ids) into ``parts`` ranges of about equal bytes.

    From a sample by bytes: a row is drawn once for each so many of its bytes, the rest by a hash, so
    about SAMPLED ids a range reach the driver, whatever the rows. They decide nothing but where ranges end.
    """
    step = max(1.0, total / (SAMPLED * parts))
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = F.floor((F.octet_length("text") + 1) / F.lit(step) + chance).alias("n")
    found = rows.select("doc_id", drawn).where(F.col("n") > 0).groupBy("doc_id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = (found.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "n"))
    order = np.argsort(ids)
    if not len(order):
        return np.array([], np.int64)
    ends = np.cumsum(n[order])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts)
    return np.unique(ids[order][at])


def in_order(docs: DataFrame) -> DataFrame:
    """Deal documents into ranges of descending ids, each range followed by the first row of the next.

    Returns ``doc_id, text, range, guest``, a partition for each range and sorted within; ``guest``
    marks the row that is there only as a neighbour. After the last range comes the first document
    again. Rows of equal ids are ordered by their texts; null ids come last, in an order of hashes
    and then of texts, and are spread over ranges by the hash. Texts are shuffled once, to the
    partition of their range's number.

    There is a range for each PART_BYTES, at least as many as shuffle partitions and at most RANGES,
    beyond which ranges get longer: a range is read as a stream, so its bytes do not have to fit in memory.
    """
    spark = docs.sparkSession
    null = F.col("doc_id").isNull()
    size = F.octet_length("text").cast("long") + 1
    total, nulls = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(null, size)), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(RANGES, -(-total // PART_BYTES)))
    known_parts = max(1, round(parts * (total - nulls) / max(1, total)))
    cuts = _cuts(docs.where(~null), total - nulls, known_parts)
    ranges = len(cuts) + 1 + max(1, parts - known_parts)  # the last ones hold null ids

    @F.pandas_udf("long")
    def range_of(ids: pd.Series, mark: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        spread = ranges - len(cuts) - 1
        out = len(cuts) + 1 + ((mark.to_numpy(np.int64).astype(float) / 2.0**64 + 0.5) * spread).astype(np.int64).clip(0, spread - 1)
        out[known] = len(cuts) - np.searchsorted(cuts, ids[known].to_numpy(np.int64))
        return pd.Series(out)

    none = F.lit(0).cast("long")
    rows = docs.withColumn("mark", F.when(null, F.xxhash64("text")).otherwise(none) if nulls else none)
    rows = rows.withColumn("range", range_of("doc_id", "mark"))
    heads = rows.groupBy("range").agg(F.max("doc_id").alias("head"), F.min("mark").alias("head_mark"))  # a row for each range
    all_heads = W.orderBy("range")
    before = F.coalesce(F.lag("range").over(all_heads), F.max("range").over(W.partitionBy()))
    heads = heads.withColumn("to", before).withColumnRenamed("range", "from")
    first = (F.col("range") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("mark") == F.col("head_mark"))
    guests = rows.join(F.broadcast(heads), first).groupBy("to").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"), F.first("mark").alias("mark")).withColumnRenamed("to", "range")
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests.select("doc_id", "text", "mark", "range", F.lit(True).alias("guest")))
    both = both.repartitionById(ranges, F.col("range").cast("int"))
    return both.sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "mark", "text")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The next document is that of the next lower id, after the last one the first. The edited text
    has the last third of code points replaced by the first as many of the next document. Returns
    one row per input row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. Null texts count as empty; a table of one row is its own next; an empty
    table gives an empty result. Rows of equal ids follow each other by text, those of null ids by a
    hash of the text and then the text. Repeated rows each give their row; other columns are not
    read, whatever their names. A range ends with the row that follows it.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, in this range: id, text, chunks
        for batch in batches:
            ids, texts, _, guest = (c.to_pylist() for c in batch.columns)
            encoded, prints, pairs = [t.encode("utf-8", "replace") for t in texts], [], []
            for part in blocks(map(len, encoded), BLOCK_BYTES):
                prints += chunk_sets(encoded[part])
            for doc_id, text, found, is_guest in zip(ids, texts, prints, guest, strict=True):
                if last:
                    pairs.append((*last, text, found))
                last = None if is_guest else (doc_id, text, found)
            edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for _, t, _, n, _ in pairs]
            encoded = [e.encode("utf-8", "replace") for e in edited]
            after = []
            for part in blocks(map(len, encoded), BLOCK_BYTES):
                after += chunk_sets(encoded[part])
            rows = [
                (doc_id, len(t), hashlib.sha256(e).hexdigest(), as_text(a), as_text(b), containment(a, b), containment(a, c))
                for (doc_id, t, a, _, c), e, b in zip(pairs, encoded, after, strict=True)
            ]
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(rows).select("doc_id", "text", "range", "guest").mapInArrow(work, schema)
