"""Language-model scores of documents: a unigram model over subword pieces.

Texts are read as words with a space before each, A to Z lower-cased; no piece crosses words. One
pass counts all words of the corpus. The vocabulary's own scores (ranks) give first weights to its
pieces; every segmentation of every training word is weighed by them, as often as the word occurs,
and the expected counts of pieces give the model. A word's log probability is the sum over all its
segmentations, found once for each distinct word; a document's is the sum of its words'. The word
counts also give a base score: add-one word frequencies. The end of a text is a piece of its own, as
often as there are training texts.

Frequent words, a bounded number chosen by their counts, go to the tasks; all other words are joined
with their counts and probabilities by a shuffle. Words over SHORT bytes go by digests of 128 bits, so
a frequent one is sent as any other, and none that is left has more than one in FREQUENT / 2 of the tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import fold, small_batches
from spanwright.llm.lattice import SPACE, Lattice
from spanwright.session import with_checkpoints

#: Words whose counts are sent to all tasks, at most, and bytes of each, at most: longer ones go by digests.
FREQUENT, SHORT = 200_000, 64
#: Distinct words that a task gathers before it hands on their counts, and words weighed at a time.
GATHERED, TOGETHER = 200_000, 20_000
#: Bytes of words that are gathered at most, beside the text or the batch at hand.
GATHERED_BYTES, TOGETHER_BYTES = 32_000_000, 8_000_000
#: Expected counts are rounded to thousandths word by word, so that sums depend on no order and no batch.
SCALE = 1000
#: Weight of the vocabulary's own scores against the corpus, in pieces.
PRIOR = 1000.0
END = b" end"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces and their first log weights: by the rank that a score gives, as words are by theirs."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    scores = np.array([model.get_score(i) for i in range(len(pieces))])
    rank = np.empty(len(pieces))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(pieces))
    weight = 1 / (rank + 10)
    weight[[model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(len(pieces))]] = weight.min() / 10
    return pieces, np.log(weight / weight.sum())


_lattices: dict[int, Lattice] = {}


def lattice(pieces: list[str]) -> Lattice:
    """One lattice per worker and vocabulary."""
    key = hash(tuple(pieces))
    if key not in _lattices:
        _lattices[key] = Lattice(pieces)
    return _lattices[key]


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A to Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split()


def named(words: list[bytes]) -> list[bytes]:
    """Words as they are joined: longer ones than SHORT bytes as a line break, which no word has, and a digest."""
    return [w if len(w) <= SHORT else b"\n" + xxhash.xxh3_128_digest(w) for w in words]


def word_counts(docs: DataFrame) -> DataFrame:
    """``word binary, n_all, n``: how often each word occurs in all texts and in those with ``train``.

    The end of a text counts as the word END, which has a space as no other word does.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
        long = 0  # bytes of long words

        def rows() -> pa.RecordBatch:
            words = list({**both[0], **both[1]})
            trained = [both[1][w] for w in words]
            every = [both[0][w] + n for w, n in zip(words, trained, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(every, pa.int64()), pa.array(trained, pa.int64())], names=["word", "n_all", "n"])

        for batch in batches:
            for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = both[bool(train)]
                words = tokens(text)
                own.update(words)
                own[END] += 1
                long += sum([len(w) for w in words if len(w) > SHORT])
                if len(own) >= GATHERED or long >= GATHERED_BYTES:
                    yield rows()
                    long = 0
                    both[0].clear()
                    both[1].clear()
        yield rows()

    found = docs.select("text", "train").mapInArrow(work, "word binary, n_all long, n long")
    return found.groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n").alias("n"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER or sum(b.nbytes for b in held) >= TOGETHER_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _stretches(words: pa.ChunkedArray) -> list[str]:
    return [SPACE + w.decode("utf-8", "replace") for w in words.to_pylist()]


def expected_counts(counts: DataFrame, pieces: list[str], logp: np.ndarray) -> DataFrame:
    """``piece, n``: how often each piece is expected in the training words, in thousandths."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, model = np.zeros(len(pieces)), lattice(pieces)
        for t in _gathered(batches):
            total += model.expected(_stretches(t["word"]), t["n"].to_numpy().astype(float) * SCALE, logp, whole=True)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64))], names=["piece", "n"])

    words = counts.where((F.col("n") > 0) & (F.col("word") != F.lit(END))).select("word", "n")
    return words.mapInArrow(work, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def weighted(counts: DataFrame, pieces: list[str], logp: np.ndarray) -> DataFrame:
    """``word, n_all, n, weight``: the counts and the log10 probability of each distinct word, named as it is joined."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(pieces)
        for t in _gathered(batches):
            weights = model.likelihood(_stretches(t["word"]), logp) / math.log(10)
            words = pa.array(named(t["word"].to_pylist()), pa.binary())
            yield from t.select(["n_all", "n"]).add_column(0, "word", words).append_column("weight", pa.array(weights)).to_batches()

    return counts.where(F.col("word") != F.lit(END)).select("word", "n_all", "n").mapInArrow(work, "word binary, n_all long, n long, weight double")


def _frequent(counts: DataFrame) -> tuple[int, pa.Table]:
    """The least count of which at most FREQUENT words have as much, and those words: bounded in bytes, as names are."""
    sizes = counts.groupBy(F.floor(F.log2(F.col("n_all").cast("double"))).cast("int").alias("size")).count().collect()  # a row for each power of 2
    least, held = 62, 0  # no word is as frequent
    for r in sorted(sizes, key=lambda r: -r["size"]):
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["size"]
    return 2**least, counts.where(F.col("n_all") >= 2**least).select("word", "n", "weight").toArrow()


def scored(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """Base and model scores of every whole text.

    The model learns from documents whose crc32(id as text) mod ``folds`` isn't ``held`` (null ids
    count as 0). Returns one row per input row: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``. A null or empty text has one token, the end, whose
    probability is its score. Without training rows the vocabulary's weights stand and the end has
    the chance of one piece in PRIOR. Repeated rows each give their row; other columns are not read,
    whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with_checkpoints(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out_of_model = fold(F.col("doc_id"), folds) == held
    pieces, first = vocabulary(path or default_vocabulary())
    counts = word_counts(docs.withColumn("train", ~out_of_model)).checkpoint()
    n, v, n_end = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))).first()
    expected = np.exp(first) * PRIOR * SCALE
    for r in expected_counts(counts, pieces, first).collect():  # a row for each piece at most
        expected[r["piece"]] += r["n"]
    pieces_in_all, ends = expected.sum() / SCALE, n_end + 1
    log_end = math.log10(ends / (pieces_in_all + ends))
    table = weighted(counts, pieces, np.log(expected / SCALE / (pieces_in_all + ends))).checkpoint()
    least, frequent = _frequent(table)
    values = zip(np.log10(frequent["n"].to_numpy() + 1.0).tolist(), frequent["weight"].to_pylist(), [int(c > 0) for c in frequent["n"].to_pylist()], strict=True)
    sent = spark.sparkContext.broadcast(dict(zip(frequent["word"].to_pylist(), values, strict=True)))
    names = ["key", "doc_id", "n_tokens", "known", "logs", "score", "word", "tf"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values_of = sent.value.get
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = xxhash.xxh3_128_digest(f"{doc_id}:{text}".encode("utf-8", "replace"))
                words = named(tokens(text))
                values = [*map(values_of, words)]
                rare = Counter([w for w, x in zip(words, values, strict=True) if x is None])
                logs, weights, known = zip(*x, strict=True) if (x := [x for x in values if x is not None]) else ((), (), ())
                # A word of its own, with a space, spreads the document's row over the join
                rows.append((key, doc_id, len(words) + 1, sum(known), math.fsum(logs), math.fsum(weights), b" " + key, 0))
                rows += [(key, None, None, None, None, None, w, tf) for w, tf in rare.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    rare = table.where(F.col("n_all") < least)
    schema = "key binary, doc_id long, n_tokens long, known long, logs double, score double, word binary, tf long"
    joined = docs.mapInArrow(work, schema).join(rare.drop("n_all"), "word", "left")
    # Equal rows meet under one key, each with all its words
    copies = F.count("n_tokens")
    per = joined.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        F.max("known").alias("known"),
        F.max("logs").alias("logs"),
        F.max("score").alias("score"),
        (F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)) / copies).cast("long").alias("rare_known"),
        (F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))) / copies).alias("rare_logs"),
        (F.sum(F.col("tf") * F.coalesce("weight", F.lit(0.0))) / copies).alias("rare_score"),
        copies.alias("copies"),
    )
    each = F.lit(math.log10(n + v + 1))
    return per.select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("rare_known") + (1 if n_end else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") + math.log10(n_end + 1) - F.col("n_tokens") * each).alias("base_score"),
        (F.col("score") + F.col("rare_score") + log_end).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")
