"""How far the sources of a language differ in their words.

Words are counted by sorting pointers. A task gathers texts up to ``SLICE_BYTES``, marks where words
start in their Arrow buffers and sorts these pointers by the words that they point at (multikey
quicksort, eight bytes being a character). Equal pointers then stand in runs: a run's documents
give a word's document frequency, its sources the counts. Spark adds the slices up by word and source.

Shares are compared in batches of words: each batch of a language meets all sources of it, and
adds their divergences up before they are shuffled. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanwright.llm.common import small_batches
from spanwright.operators.ranking import least_per_key
from spanwright.operators.skew import even_join
from spanwright.session import Tables

#: Bytes of text that are sorted at once (one longer text is sorted alone).
SLICE_BYTES = 16_000_000
#: Documents of a language that a term must be in, the unit of shares, and terms listed for a source.
LEAST_DOCS, UNIT, TOP = 3, 1_000_000_000, 200
#: Terms of a batch, and sources that a batch is compared with at once.
BATCH_TERMS, BLOCK = 20_000, 256
#: So few languages or groups are broadcast; more are joined by their keys.
FEW = 10_000

#: Bytes of terms: ASCII letters, and all bytes of characters beyond ASCII. Upper-case letters are lowered first.
IS_TERM = np.zeros(256, bool)
IS_TERM[97:123] = True
IS_TERM[128:] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

COUNTS = "lang string, term string, source string, n bigint, docs bigint"
VALUES = "lang string, source string, part string, item string, value bigint"


def word_pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in lowered ``data``, and their lengths; no word crosses one of the texts' ``offsets``."""
    inside = IS_TERM[data]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    fresh = np.ones(len(data), bool)
    fresh[1:] = ~inside[:-1]
    fresh[cuts] = True
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    last[cuts - 1] = True
    starts = np.flatnonzero(inside & fresh)
    return starts, np.flatnonzero(inside & last) + 1 - starts


def _eight_bytes(padded: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number that sorts like them; zeros behind the ``left`` bytes of a word."""
    chunk = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view(">u8")[:, 0].astype(np.uint64)
    short = left < 8
    chunk[short] &= ~np.uint64(0) << (8 * (8 - np.maximum(left[short], 1))).astype(np.uint64)
    chunk[left <= 0] = 0
    return chunk


def sorted_pointers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the pointers by their words' bytes, and marks of the first pointer of each run of equal words.

    Multikey quicksort: slices of pointers that agree so far are sorted by their next eight bytes, and
    what agrees in these too, and goes on, is a slice of the next round. No word has a zero byte, so
    a word that ends stands before those that it begins.
    """
    padded = np.append(data, np.zeros(8, np.uint8))
    chunk = _eight_bytes(padded, starts, lengths)
    order = np.argsort(chunk, kind="quicksort")
    chunk = chunk[order]
    heads = np.ones(len(order), bool)
    heads[1:] = chunk[1:] != chunk[:-1]
    depth = 8
    while True:
        runs = np.cumsum(heads) - 1
        more = np.bincount(runs[lengths[order] > depth], minlength=runs[-1] + 1 if len(runs) else 0) > 0
        more &= np.bincount(runs) > 1
        at = np.flatnonzero(more[runs]) if len(runs) else np.empty(0, np.int64)
        if not len(at):
            return order, heads
        own = order[at]
        chunk = _eight_bytes(padded, np.minimum(starts[own] + depth, len(data)), lengths[own] - depth)
        by = np.lexsort((chunk, runs[at]))  # slices keep their places
        order[at] = own[by]
        chunk = chunk[by]
        heads[at[1:]] |= (chunk[1:] != chunk[:-1]) & (at[1:] == at[:-1] + 1)
        depth += 8


def slice_counts(langs: pa.Array, sources: pa.Array, texts: pa.StringArray) -> pa.RecordBatch | None:
    """Occurrences and documents of each word by language and source, in texts that are sorted as one slice."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    first = offsets[0]
    data = LOWERED[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first : offsets[-1]]]
    offsets -= first
    starts, lengths = word_pointers(data, offsets)
    if not len(starts):
        return None
    of_lang, of_source = langs.dictionary_encode(), sources.dictionary_encode()
    group = of_lang.indices.to_numpy().astype(np.int64) * len(of_source.dictionary) + of_source.indices.to_numpy()
    # Documents are numbered by their group, so that pairs of word and document are in groups too
    place = np.argsort(group, kind="stable")
    rank = np.empty_like(place)
    rank[place] = np.arange(len(place))
    doc = rank[np.searchsorted(offsets, starts, side="right") - 1]
    order, heads = sorted_pointers(data, starts, lengths)
    word = np.cumsum(heads) - 1
    pair = np.sort(word * len(texts) + doc[order])
    new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    times = np.diff(np.append(new, len(pair)))
    word, in_group = pair[new] // len(texts), group[place[pair[new] % len(texts)]]
    row = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (in_group[1:] != in_group[:-1])))
    held, in_group = word[row], in_group[row]
    heads = order[heads]
    size = lengths[heads]
    ends = np.append(0, np.cumsum(size))
    letters = data[np.repeat(starts[heads] - ends[:-1], size) + np.arange(ends[-1])]
    words = pa.StringArray.from_buffers(len(heads), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters))
    lang, source = np.divmod(in_group, len(of_source.dictionary))
    columns = [of_lang.dictionary.take(pa.array(lang)), words.take(pa.array(held)), of_source.dictionary.take(pa.array(source)), pa.array(np.add.reduceat(times, row)), pa.array(np.diff(np.append(row, len(word))))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.RecordBatch]:
        lang, source, text = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
        held.clear()
        if (out := slice_counts(lang, source, text)) is not None:
            for at in range(0, out.num_rows, 50_000):
                yield out.slice(at, 50_000)

    size = 0
    for b in batches:
        if held and size + b.nbytes > SLICE_BYTES:
            yield from done()
            size = 0
        held.append(b)
        size += b.nbytes
    if held:
        yield from done()


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, term, source, n, docs``: occurrences and documents of each word; null text, lang and source are ''."""
    small_batches(docs.sparkSession)
    whole = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return whole.mapInArrow(_counted, COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), by three digits at a time, so totals up to 9 * 10**15 are exact."""
    out, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _compared(key: tuple[pa.Scalar, ...], terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Values of a batch of a language's terms: by pair of sources added up, and the batch's highest terms of each source."""
    lang, _, block = (k.as_py() for k in key)
    groups = groups.sort_by("source")
    names = groups["source"].combine_chunks()
    totals = groups["n"].to_numpy() + groups["v"].to_numpy()
    n_sources, v = len(names), len(terms)
    low, high = block * BLOCK, min((block + 1) * BLOCK, n_sources)
    by = terms["by"].combine_chunks()
    of_term = np.repeat(np.arange(v), pc.list_value_length(by).to_numpy(zero_copy_only=False)) if v else np.empty(0, np.int64)
    entries = by.flatten() if v else None
    source = pc.index_in(entries.field("source"), value_set=names).to_numpy() if v else of_term
    counts = entries.field("n").to_numpy() if v else of_term
    share = shares(counts, totals[source]) if v else of_term
    none = shares(np.zeros(n_sources, np.int64), np.maximum(totals, 1))
    sums = np.zeros((n_sources, high - low), np.int64)
    step = max(1, 1_000_000 // n_sources)
    for at in range(0, v, step):
        own = slice(*np.searchsorted(of_term, [at, at + step]))
        p = np.tile(none, (min(step, v - at), 1))
        p[of_term[own] - at, source[own]] = share[own]
        for h in range(low, high):
            sums[:, h - low] += divergence(p, p[:, h : h + 1]).sum(0)
    g, h = (x.ravel() for x in np.indices(sums.shape))
    apart = g != h + low
    parts = [(names.take(pa.array(g[apart])), "pair", names.take(pa.array(h[apart] + low)), pa.array(sums.ravel()[apart]))]
    if block == 0 and v:
        whole = shares(terms["total"].to_numpy(), int(groups["lang_n"][0].as_py() + groups["v"][0].as_py()))[of_term]
        more = np.flatnonzero(share > whole)
        value = divergence(share[more], whole[more])
        text = terms["term"].combine_chunks()
        rank = np.empty(v, np.int64)
        rank[pc.sort_indices(text).to_numpy()] = np.arange(v)
        order = np.lexsort((rank[of_term[more]], -value, source[more]))
        more, value = more[order], value[order]
        starts = np.searchsorted(source[more], np.arange(n_sources))
        first = np.arange(len(more)) - starts[source[more]] < TOP  # no later one can be among the language's first
        more, value = more[first], value[first]
        parts.append((names.take(pa.array(source[more])), "term", text.take(pa.array(of_term[more])), pa.array(value)))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    return pa.concat_tables(pa.table([pa.repeat(pa.scalar(lang, pa.string()), len(s)), s, pa.repeat(pa.scalar(part), len(s)), item, value], schema=schema) for s, part, item, value in parts)


def _sized(left: DataFrame, right: DataFrame, keys: list[str], n_right: int) -> DataFrame:
    """A join with a side that is broadcast if it is counted to be short, else dealt by its keys."""
    return left.join(F.broadcast(right), keys) if n_right <= FEW else even_join(left, right, keys)


def audited(docs: DataFrame) -> DataFrame:
    """The divergence of each source from the others of its language, and the terms that set it off from the language.

    ``lang, source, part, item, value, rank``. Null text, lang and source are ''. A source without
    terms has shares too; a language without kept terms has pairs of value 0. Repeated rows count as
    documents each; an empty table has no rows; other columns are not read. One source or word may hold
    any part of the rows: words are counted in slices first, and each word has a row for each source at most
    when its sources meet. The result has all pairs of a language's sources, so sources must be few enough for that.
    """
    kept = Tables(docs.sparkSession)
    terms = word_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by"))
    terms = kept.keep(terms.where(F.col("docs") >= LEAST_DOCS).drop("docs"))
    langs = kept.keep(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n")))
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    in_kept = terms.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    groups = named.join(in_kept, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = kept.keep(groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n", "v", "lang_n"))))
    # Batches of a language's terms, and blocks of its sources
    per_lang = groups.groupBy("lang").agg(F.max("v").alias("v"), F.count("*").alias("sources"))
    per_lang = per_lang.select("lang", F.greatest(F.lit(1), F.ceil(F.col("v") / BATCH_TERMS)).alias("batches"), F.ceil(F.col("sources") / BLOCK).alias("blocks"))
    per_lang = kept.keep(per_lang)
    n_langs = per_lang.count()
    zero = F.lit(0).cast("bigint")
    blocks = F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block")
    dealt = _sized(terms, per_lang, ["lang"], n_langs).select("lang", F.pmod(F.xxhash64("term"), "batches").alias("batch"), blocks, "term", "total", "by")
    met = _sized(groups, per_lang, ["lang"], n_langs).withColumn("batch", F.explode(F.sequence(zero, F.col("batches") - 1)))
    met = met.select("lang", "batch", blocks, "source", "n", "v", "lang_n")
    keys = ["lang", "batch", "block"]
    values = kept.keep(dealt.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(_compared, VALUES))
    pairs = values.where(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order)))
    top = least_per_key(values.where(F.col("part") == "term"), ["lang", "source"], order, TOP)
    return pairs.unionByName(top.select(*pairs.columns))
