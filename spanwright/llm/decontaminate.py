"""Benchmark decontamination by winnowing, with DataFrame functions only.

Both sides hash every run of GRAM words and keep the least hash of every WINDOW consecutive runs,
so any span of GRAM + WINDOW - 1 shared words has a run that both sides keep. Kept runs are joined
by hash, compared word by word and extended to both sides; spans shorter than that are no hits.
Items of fewer words are one span of their own length and are joined by the hash of all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanwright.llm.common import row_key, unused
from spanwright.operators.skew import even_join
from spanwright.session import Tables

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
#: Word characters before lower-casing: digits, ASCII letters and all beyond ASCII.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Bits for a word's position in its text, more than any text has words.
POSITION = 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fingerprints of the benchmark up to this number and these bytes of words are broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 100_000_000


def words(text: Column) -> Column:
    """The words of a text, not yet lower-cased; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _grams(df: DataFrame, *lengths: int) -> DataFrame:
    """``v``: for each length, per word the hash of it and the ``length`` - 1 next ones, above the word's position.

    Hashes take the words as ``lower`` gives them. Equal words have equal hashes; the words
    themselves are compared later, so a collision can't make a hit. The position stands negated in
    the low bits, so that of equal hashes the least value is the last one.
    """
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(F.lower(w))))

    def runs(length: int) -> Column:
        starts = F.when(F.size("h") >= length, F.sequence(F.lit(0), F.size("h") - length)).otherwise(F.array().cast("array<int>"))
        run = lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(length)))
        packed = lambda i: F.shiftleft(F.shiftrightunsigned(run(i), POSITION), POSITION).bitwiseOR(F.lit(2**POSITION - 1) - i)
        return F.transform(starts, packed)

    # ``h`` is named more than once, so that the optimizer doesn't compute it anew for each word
    return df.withColumn("v", runs(lengths[0]) if len(lengths) == 1 else F.concat(*map(runs, lengths)))


def _unpacked(v: Column) -> tuple[Column, Column]:
    """The hash and the position of a packed value."""
    return F.shiftrightunsigned(v, POSITION), (F.lit(2**POSITION - 1) - v.bitwiseAND(F.lit(2**POSITION - 1))).cast("int")


def kept_runs(rows: DataFrame) -> DataFrame:
    """``rows``, which has an array ``words``, with ``kept``: the packed least runs of its windows."""
    df = _grams(rows, GRAM)
    windows = F.when(F.size("v") >= WINDOW, F.sequence(F.lit(0), F.size("v") - WINDOW)).otherwise(F.array().cast("array<int>"))
    least = F.transform(windows, lambda j: F.least(*(F.get("v", j + k) for k in range(WINDOW))))
    return df.withColumn("kept", F.array_distinct(least)).drop("h", "v")


def _around(reach: int, length: int) -> Column:
    """Lower-cased words from ``reach`` before the run to ``reach`` after it; null beyond the text."""
    at = F.sequence(F.lit(-reach), F.lit(length + reach - 1))
    fixed = lambda w: F.translate(w, UPPER, LOWER)
    return F.transform(at, lambda o: F.when(F.col("p") + o >= 0, fixed(F.get(F.col("words"), F.col("p") + o))))


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by ``g``; the benchmark's side is broadcast only if it is small, else frequent runs are dealt to several tasks."""
    n, size = right.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("there", " "))), F.lit(0))).first()
    if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), "g", how)
    kept = Tables(left.sparkSession)
    counts = kept.keep(left.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    return even_join(left, right, ["g"], how, counts=counts, total=counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _first_false(flags: list[Column]) -> Column:
    """How many of the flags hold before the first that doesn't."""
    out = F.lit(len(flags))
    for i in reversed(range(len(flags))):
        out = F.when(~flags[i], F.lit(i)).otherwise(out)
    return out


def _extended(met: DataFrame) -> DataFrame:
    """Joined runs as spans of equal words around them: ``start``, ``stop``; null if too short."""
    reach = WINDOW - 1
    flag = lambda i: F.get("same", F.lit(i))
    before = _first_false([flag(reach - 1 - i) for i in range(reach)])
    after = _first_false([flag(i) for i in range(reach, 2 * reach + GRAM)])
    met = met.withColumn("same", F.when(F.col("there").isNotNull(), F.zip_with(_around(reach, GRAM), "there", lambda a, b: F.coalesce(a == b, F.lit(False)))))
    met = met.withColumn("before", before).withColumn("after", after)
    good = F.col("there").isNotNull() & (F.col("after") >= GRAM) & (F.col("before") + F.col("after") >= SPAN)
    return met.withColumn("start", F.when(good, F.col("p") - F.col("before"))).withColumn("stop", F.when(good, F.col("p") + F.col("after")))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Hit spans, and a row for each document.

    ``docs`` has ``doc_id, key, text``. Returns ``doc_id, key, n_words, start, stop, item_id, own``:
    word positions from 0, stop exclusive; ``own`` marks the row of a row of ``docs``. It and runs
    that were not long enough have null start and stop. The texts are read once; a document's own
    row takes part in the join under a value of its own.
    """
    item_rows = items.select("item_id", words(F.col("text")).alias("words"))
    doc_rows = docs.select("doc_id", "key", words(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    there = kept_runs(item_rows.where(F.size("words") >= SPAN))
    # The outer form keeps the optimizer from testing the array before it is exploded, which would compute it twice
    there = there.select("item_id", "words", F.explode_outer("kept").alias("v")).where(F.col("v").isNotNull())
    there = there.withColumns(dict(zip(("g", "p"), _unpacked(F.col("v")), strict=True)))
    there = there.select("g", "item_id", _around(WINDOW - 1, GRAM).alias("there")).distinct()
    own = F.concat(F.array(F.lit(None).cast("long")), F.col("kept"))
    here = kept_runs(doc_rows).withColumn("kept", own).select("doc_id", "key", "n_words", "words", F.explode_outer("kept").alias("v"))
    here = here.withColumns(dict(zip(("g", "p"), _unpacked(F.col("v")), strict=True)))
    here = here.withColumn("g", F.coalesce("g", -F.abs(F.hash("key").cast("long")) - 1))  # no hash is negative
    # This filter runs in generated code, so only rows that met leave it with their words; what the
    # lambdas find stays a column, as a filter on it would be merged with this one and leave that code
    met = _extended(_joined(here, there, "left").where(F.col("v").isNull() | F.col("there").isNotNull()))
    out = met.select("doc_id", "key", "n_words", "start", "stop", F.when(F.col("start").isNotNull(), F.col("item_id")).alias("item_id"), F.col("v").isNull().alias("own"))
    short = item_rows.where((F.size("words") > 0) & (F.size("words") < SPAN))
    lengths = [r[0] for r in short.select(F.size("words").alias("n")).distinct().collect()]  # below SPAN
    if not lengths:
        return out
    # Runs of all lengths in one more pass; a run of another length than the item's differs in its words
    size = F.size("words")
    fixed = F.transform("words", lambda w: F.translate(w, UPPER, LOWER))
    one = None
    for n in sorted(lengths):
        part = _grams(short.where(size == n), n).select(_unpacked(F.get("v", F.lit(0)))[0].alias("g"), "item_id", fixed.alias("there"))
        one = part if one is None else one.unionByName(part)
    runs = _grams(doc_rows, *sorted(lengths)).select("doc_id", "key", "n_words", "words", F.explode_outer("v").alias("v")).where(F.col("v").isNotNull())
    runs = runs.withColumns(dict(zip(("g", "p"), _unpacked(F.col("v")), strict=True)))
    here = F.transform(F.slice("words", F.col("p") + 1, F.size("there")), lambda w: F.translate(w, UPPER, LOWER))
    # As above: a filter on what the lambda finds would move into the join, and all rows would leave the code with their words
    met = _joined(runs, one, "inner").withColumn("good", here == F.col("there"))
    good = lambda c: F.when(F.col("good"), c)
    out = out.unionByName(met.select("doc_id", "key", "n_words", good(F.col("p")).alias("start"), good(F.col("p") + F.size("there")).alias("stop"), good(F.col("item_id")).alias("item_id"), F.lit(False).alias("own")))
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document the words inside benchmark windows and the items whose windows occur.

    Returns one row per input row: ``doc_id, key, n_words, n_hit, n_items, items array<string>``
    (sorted as strings) ``, contaminated``. Null and empty texts have no words and are clean.
    Repeated rows each give their row; items of null id count as no item but hit words; other
    columns are not read; an empty benchmark leaves all documents clean.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    items = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    # One shuffle by document serves the three groupings; a document's rows are as many as its hits
    found = hits(rows, items).repartition("key")
    own = F.count(F.when(F.col("own"), F.lit(1)))
    spans = found.groupBy("key", "start").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("stop").alias("stop"), F.collect_set("item_id").alias("items"), own.alias("rows"))
    earlier = W.partitionBy("key").orderBy(F.col("start").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(earlier), F.lit(0))))
    spans = spans.withColumn("fresh", F.when(F.col("start").isNotNull(), fresh).otherwise(0))
    per = spans.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("fresh").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("rows").alias("rows"))
    per = per.select("doc_id", "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
    return per.drop("copy")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without benchmark windows, all their columns and repeated rows kept.

    Null and empty texts are kept; an empty benchmark keeps all documents.
    """
    key = unused("key", docs.columns)
    docs = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    bad = hits(docs.select("doc_id", F.col(key).alias("key"), "text"), items.select(F.col("item_id").cast("string").alias("item_id"), "text"))
    bad = bad.groupBy(F.col("key").alias(key)).agg(F.max("start").alias("start")).where(F.col("start").isNotNull()).drop("start")
    return docs.join(bad, key, "left_anti").drop(key)
