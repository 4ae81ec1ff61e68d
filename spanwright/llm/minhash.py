"""Near-duplicate documents by BagMinHash.

A text is the multiset of its runs of five words. Each run's weight, its number of occurrences, is
cut at powers of two; every interval of weights has a Poisson process of points in time, seeded by
the run and the interval, whose points fall on signature components. Intervals below the weight
count whole, the one that holds it is split: points above the weight are left out. The earliest
point of each component is equal in two texts with the probability of their weighted Jaccard
similarity.

Texts whose signatures agree in a band of components are candidates and stand in one bucket of that
band. Candidates are compared by the overlap of their multisets. Buckets are worked on in rounds: a
few centres of a bucket are compared with its members of other groups, and what is alike becomes one
group. The first centre is the text that shares most buckets with others, so one round joins most
copies of a text. A bucket is done when its members are one group, or when all members outside its
largest group have been centres: then every two members of different groups have been compared, and no
link between groups is lost. Members of one group are never compared with each other.

Texts that are still apart after the first round are often just below the similarity, so before two of
them are compared, their parity sketches are: a bit for each of 1024 classes of occurrences, telling
whether a text has an odd number of them. Two sketches differ in no more bits than the multisets
differ in occurrences, which proves most of such pairs too far apart. Long texts have sketches of a
half, a quarter and so on of their occurrences, and a margin of six deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import blocks, row_key, small_batches, unused
from spanwright.operators.graph import connected_components
from spanwright.operators.skew import even_join
from spanwright.session import Tables

WORDS = 5
BANDS, ROWS = 21, 6
COMPONENTS = BANDS * ROWS
SIMILARITY = 0.8
#: Centres of a bucket in the first round is one; each further round has so many times more.
MORE = 32
#: 64-bit words of a parity sketch; occurrences of a text up to which all are in it.
PARITY, WHOLE = 16, 1024
#: Texts of about this many characters are signed or compared together.
TOGETHER = 1_000_000
#: Pairs that a task compares, at least, where there are few.
PAIRS = 300
#: Sketch bits that may differ: at a similarity of 0.8 one bit in ten does, and six deviations more are allowed.
BITS_APART = 33
#: Word hashes that a worker keeps.
KEPT = 100_000
#: Words are runs of digits, letters and bytes beyond ASCII; A to Z are lower-cased.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class _Hashes(dict):
    """Hashes of words, computed once while they are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of all texts: text number, run hash, occurrences; sorted by the first two.

    A text of fewer than five words is one run; one without words has none.
    """
    lists = [(t or "").encode("utf-8", "replace").translate(TABLE).split() for t in texts]
    n = np.array([len(w) for w in lists], np.int64)
    h = np.fromiter((_hashes[w] for words in lists for w in words), np.uint64, int(n.sum()))
    owner = np.repeat(np.arange(len(texts)), n)
    ends = np.repeat(np.cumsum(n), n)
    runs = max(0, len(h) - WORDS + 1)
    x = np.zeros(runs, np.uint64)
    for k in range(WORDS):
        x = _mix(x + h[k : k + runs])
    whole = np.arange(runs) + WORDS <= ends[:runs]
    x, owner_x = x[whole], owner[:runs][whole]
    short = [(i, xxhash.xxh3_64_intdigest(b" ".join(lists[i]))) for i in np.flatnonzero((n > 0) & (n < WORDS))]
    if short:
        owner_x = np.concatenate([owner_x, np.array([i for i, _ in short])])
        x = np.concatenate([x, np.array([v for _, v in short], np.uint64)])
    order = np.lexsort((x, owner_x))
    owner_x, x = owner_x[order], x[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (owner_x[1:] != owner_x[:-1])])) if len(x) else np.zeros(0, np.int64)
    return owner_x[first], x[first], np.diff(np.append(first, len(x)))


def signatures(texts: int, owner: np.ndarray, run: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The earliest point of each component for each text; infinite for texts without runs."""
    sig = np.full(texts * COMPONENTS, np.inf)
    # Interval 0 holds weights up to 1, interval k those from 2^(k-1) to 2^k
    last = np.where(weight == 1, 0, np.ceil(np.log2(weight)).astype(np.int64))
    which = np.repeat(np.arange(len(run)), last + 1)
    level = np.arange(len(which)) - np.repeat(np.cumsum(last + 1) - last - 1, last + 1)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(float)
    rate = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(float)
    top = (weight[which] - low) / rate  # the share of the interval below the weight, 1 or more for all of it
    seed = _mix(run[which] + np.uint64(0x9E3779B97F4A7C15) * (level + 1).astype(np.uint64))
    text, time = owner[which], np.zeros(len(which))
    while len(text):
        seed = seed + np.uint64(0xA0761D6478BD642F)
        a = _mix(seed)
        b = _mix(a + np.uint64(0xE7037ED1A0B428DB))
        time = time - np.log(((a >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / rate
        inside = ((b >> np.uint64(32)).astype(float) * 2.0**-32) < top
        at = text * COMPONENTS + ((b & np.uint64(0xFFFFFFFF)) % np.uint64(COMPONENTS)).astype(np.int64)
        np.minimum.at(sig, at[inside], time[inside])
        go = time < sig.reshape(texts, COMPONENTS).max(1)[text]
        if not go.all():
            text, time, seed, rate, top = text[go], time[go], seed[go], rate[go], top[go]
    return sig.reshape(texts, COMPONENTS)


def parities(texts: int, owner: np.ndarray, run: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The level of each text and its parity sketches of that level and of the next one.

    Of level k is one of 2^k occurrences, chosen by their hashes. Texts whose sizes allow the
    similarity are of the same level or of neighbouring ones.
    """
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    h = _mix(np.repeat(run, weight) + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    text = np.repeat(owner, weight)
    level = np.maximum(np.ceil(np.log2((np.bincount(text, minlength=texts) + 1) / WHOLE)), 0).astype(np.int64)
    sketches = []
    for more in (0, 1):
        chosen = (h >> np.uint64(40)) % (np.uint64(1) << (level[text] + more).astype(np.uint64)) == 0
        bits = np.bincount(text[chosen] * 64 * PARITY + (h[chosen] % np.uint64(64 * PARITY)).astype(np.int64), minlength=texts * 64 * PARITY) % 2
        sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64).reshape(texts, PARITY))
    return level, np.concatenate(sketches, 1)


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, row, bag, runs, s1, s2, bands, level, parity`` of each row of ``doc_id, row, text``.

    ``bag`` is a digest of the multiset, null without words; ``s1`` and ``s2`` hold a bit for each
    component; ``bands`` are hashes of the components of a band.
    """
    small_batches(docs.sparkSession)

    def signed_block(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = block.column(2).to_pylist()
        owner, run, weight = bags(texts)
        values = _mix(signatures(len(texts), owner, run, weight).view(np.uint64))
        band = np.zeros((len(texts), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            band = _mix(band + values.reshape(len(texts), BANDS, ROWS)[:, :, k])
        bits = np.packbits((values & np.uint64(1)).astype(np.uint8), axis=1)
        bits = np.pad(bits, ((0, 0), (0, 16 - bits.shape[1]))).view(np.int64)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        keys, counts = [], []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            keys.append(xxhash.xxh3_128_digest(run[i:j].tobytes() + weight[i:j].tobytes()) if j > i else None)
            counts.append(int(weight[i:j].sum()))
        columns = [block.column(0), block.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(band.view(np.int64).tolist(), pa.list_(pa.int64()))]
        level, parity = parities(len(texts), owner, run, weight)
        columns += [pa.array(level), pa.array(parity.tolist(), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "bag", "runs", "s1", "s2", "bands", "level", "parity"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks((len(t or "") for t in batch.column(2).to_pylist()), TOGETHER):
                yield signed_block(batch.slice(part.start, part.stop - part.start))

    return docs.select("doc_id", "row", "text").mapInArrow(work, "doc_id long, row string, bag binary, runs long, s1 long, s2 long, bands array<long>, level long, parity array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``la, lb`` of the pairs ``a, b`` whose texts are as similar as asked; ``texts`` has ``id, text``, each id once."""

    def alike(block: pa.RecordBatch) -> list[bool]:
        ids_a, ids_b, _, _, texts_a, texts_b = (c.to_pylist() for c in block.columns)
        number: dict[int, int] = {}
        once: list[str] = []
        for i, t in zip(ids_a + ids_b, texts_a + texts_b, strict=True):
            if i not in number:
                number[i] = len(once)
                once.append(t)
        owner, run, weight = bags(once)
        cuts = np.searchsorted(owner, np.arange(len(once) + 1)).tolist()
        out = []
        for i, j in zip(ids_a, ids_b, strict=True):
            x, y = slice(*cuts[number[i] : number[i] + 2]), slice(*cuts[number[j] : number[j] + 2])
            _, at_x, at_y = np.intersect1d(run[x], run[y], assume_unique=True, return_indices=True)
            both = int(np.minimum(weight[x][at_x], weight[y][at_y]).sum())
            out.append(both >= SIMILARITY * (int(weight[x].sum()) + int(weight[y].sum()) - both) - 1e-9)
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(map(len, batch.column(5).to_pylist()), TOGETHER):
                block = batch.slice(part.start, part.stop - part.start)
                yield block.select([2, 3]).filter(pa.array(alike(block), pa.bool_()))

    both = even_join(pairs, texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), ["b"])
    n = pairs.count()
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    both = even_join(both, texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), ["a"], counts=counts, total=n)
    both = both.coalesce(1 + n // PAIRS)
    return both.select("a", "b", "la", "lb", "text_a", "text_b").mapInArrow(work, "la long, lb long")


def _alike(x: str, y: str) -> Column:
    """Whether sketches and sizes allow the similarity; sizes do so without exception."""
    apart = F.bit_count(F.col(f"{x}.s1").bitwiseXOR(F.col(f"{y}.s1"))) + F.bit_count(F.col(f"{x}.s2").bitwiseXOR(F.col(f"{y}.s2")))
    sizes = F.least(f"{x}.runs", f"{y}.runs") >= SIMILARITY * F.greatest(f"{x}.runs", f"{y}.runs")
    return (apart <= BITS_APART) & sizes


def _not_apart(x: str, y: str) -> Column:
    """Whether parity sketches of the higher one of two levels allow the similarity."""
    lx, ly = F.col(f"{x}.level"), F.col(f"{y}.level")
    differ = F.lit(0)
    for k in range(PARITY):
        mine = F.when(lx >= ly, F.col(f"{x}.p{k}")).otherwise(F.col(f"{x}.p{k + PARITY}"))
        other = F.when(ly >= lx, F.col(f"{y}.p{k}")).otherwise(F.col(f"{y}.p{k + PARITY}"))
        differ = differ + F.bit_count(mine.bitwiseXOR(other))
    level = F.greatest(lx, ly)
    most = (F.col(f"{x}.runs") + F.col(f"{y}.runs")) * (1 - SIMILARITY) / (1 + SIMILARITY) / F.pow(F.lit(2.0), level)
    return differ <= most + F.when(level > 0, 6 * F.sqrt(most)).otherwise(1e-6)


def _open(members: DataFrame) -> DataFrame:
    """Buckets of more than one label: ``bucket, n, apart, largest``: members, those outside the largest group, its label."""
    groups = members.groupBy("bucket", "label").agg(F.count("*").alias("m"))
    sizes = groups.groupBy("bucket").agg(F.sum("m").alias("n"), (F.sum("m") - F.max("m")).alias("apart"), F.max_by("label", F.struct("m", "label")).alias("largest"))
    return sizes.where(F.col("apart") > 0)


def _centres(members: DataFrame, most: int, me: Column) -> DataFrame:
    """Centres of each bucket: all members outside the largest group if they are ``most`` at most, else one of each of ``most`` parts."""
    few = members.where((F.col("apart") <= most) & (F.col("label") != F.col("largest"))).select("bucket", me.alias("x"))
    part = F.pmod(F.xxhash64("id"), F.lit(most))
    some = members.where(F.col("apart") > most).groupBy("bucket", part.alias("part")).agg(F.max_by(me, F.struct("weight", "id")).alias("x"))
    return few.unionByName(some.drop("part"))


def _labels(members: DataFrame, reps: DataFrame, texts: DataFrame, kept: Tables) -> DataFrame:
    """``id, label``: the group of each member of a bucket, by the links between members.

    ``members`` has ``bucket, id, weight``, ``reps`` sizes and sketches of each id, ``texts`` its text;
    all are kept tables.
    """
    labels = kept.keep(members.groupBy("id").agg(F.first("id").alias("label")), members.count())
    sketch = [F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(2 * PARITY)]
    left, most = members, 1
    while True:
        n = left.count()
        named = kept.keep(left.join(labels, "id"), n)
        sizes = kept.keep(_open(named), n)
        if sizes.isEmpty():
            kept.drop(named, sizes)
            return labels
        known = reps.select("id", "runs", "s1", "s2", *(["level", *sketch] if most > 1 else []))
        now = kept.keep(even_join(named, sizes.drop("n"), ["bucket"], counts=sizes).join(known, "id"), n)
        me = F.struct("label", *known.columns)
        centres = kept.keep(_centres(now, most, me), n)
        met = even_join(now.select("bucket", me.alias("y")), centres, ["bucket"], counts=sizes)
        met = met.where((F.col("x.label") != F.col("y.label")) & _alike("x", "y") & (_not_apart("x", "y") if most > 1 else F.lit(True)))
        swap = F.col("x.id") < F.col("y.id")
        side = lambda of, name: F.when(swap, F.col(f"x.{of}") if name == "a" else F.col(f"y.{of}")).otherwise(F.col(f"y.{of}") if name == "a" else F.col(f"x.{of}"))
        pairs = kept.keep(met.select(side("id", "a").alias("a"), side("id", "b").alias("b"), side("label", "a").alias("la"), side("label", "b").alias("lb")).distinct())
        links = kept.keep(verified(pairs, texts))
        # Groups grow together by links between their labels
        joined = connected_components(links, "la", "lb", links.count()).select(F.col("id").alias("label"), F.col("component").alias("now"))
        before, labels = labels, kept.keep(even_join(labels, joined, ["label"], "left").select("id", F.coalesce("now", "label").alias("label")), labels.count())
        # A centre has been compared with all members of other groups, so its bucket needs it no more
        rest = now.where(F.col("apart") > most).select("bucket", "id", "weight")
        left = kept.keep(rest.join(centres.select("bucket", F.col("x.id").alias("id")), ["bucket", "id"], "left_anti"), n)
        kept.drop(before, named, now, sizes, centres, pairs, links)
        most *= MORE


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of near-duplicates of each document.

    Returns one row per input row: ``doc_id, row, group_id, keep``. ``group_id`` is the least id of
    the class (null if it has none); classes are the components of links of SIMILARITY or more,
    for which bands and sketch bound are set. Runs are compared by 64-bit hashes of their words.
    ``keep`` marks one row of each class: the least id. Texts without words (null and empty ones
    too) are alone in their classes. Rows of equal ids and texts share ``row`` and ``keep``;
    ``deduplicated`` leaves one of them. An empty table gives an empty result. Other columns are
    not read, whatever their names.
    """
    spark = docs.sparkSession
    kept = Tables(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    rows = kept.keep(signed(docs))
    n_rows = rows.count()
    # One row for each multiset of runs, with its least id and row
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("kept")
    sized = rows.where(F.col("bag").isNotNull()).groupBy("bag")
    reps = sized.agg(first, F.min("doc_id").alias("least"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("runs", "s1", "s2", "bands", "level", "parity")))
    reps = kept.keep(reps.withColumn("id", F.monotonically_increasing_id()), n_rows)
    n_reps = reps.count()
    banded = reps.select("id", F.explode("bands").alias("bucket"))
    shared = kept.keep(banded.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1), BANDS * n_reps)
    members = kept.keep(even_join(banded, shared, ["bucket"], counts=shared, total=BANDS * n_reps), BANDS * n_reps)
    # The share of a text in buckets of many is its weight as a centre
    weights = members.groupBy("id").agg(F.sum("n").alias("weight"))
    told = kept.keep(members.drop("n").join(weights, "id"), members.count())
    wanted = members.select("id").distinct().join(reps.select("id", F.col("kept.row").alias("row")), "id")
    texts = kept.keep(docs.groupBy("row").agg(F.first("text").alias("text")).join(wanted, "row").select("id", "text"))
    kept.drop(shared, members)
    labels = _labels(told, reps, texts, kept)
    # Classes of more than one text take the least id and row of their texts
    joined = kept.keep(reps.select("id", "bag", "n", "least", "kept").join(labels, "id"), n_reps)
    least = joined.groupBy("label").agg(F.min("least").alias("group_id"), F.min("kept").alias("first"))
    grouped = even_join(joined.select("bag", "n", "label"), least, ["label"]).select("bag", "n", "group_id", F.col("first.row").alias("kept"))
    apart = reps.join(labels, "id", "left_anti").select("bag", "n", F.col("least").alias("group_id"), F.col("kept.row").alias("kept"))
    classes = kept.keep(grouped.unionByName(apart), n_reps)
    kept.drop(told, texts, joined, labels, reps)
    of_bag = even_join(rows.where(F.col("bag").isNotNull()).select("doc_id", "row", "bag"), classes.drop("n"), ["bag"], counts=classes.select("bag", "n"), total=n_rows)
    out = of_bag.select("doc_id", "row", "group_id", (F.col("row") == F.col("kept")).alias("keep"))
    return out.unionByName(rows.where(F.col("bag").isNull()).select("doc_id", "row", F.col("doc_id").alias("group_id"), F.lit(True).alias("keep")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class of near-duplicates, with all columns of ``docs``.

    Of rows of one id and text, which may differ in other columns, any one stays.
    """
    row = unused("row", docs.columns)
    kept = near_duplicates(docs).where("keep").select(F.col("row").alias(row)).distinct()
    once = docs.withColumn(row, row_key(F.col("doc_id"), F.col("text"))).dropDuplicates([row])
    return once.join(kept, row, "left_semi").drop(row)
