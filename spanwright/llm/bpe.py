"""BPE encoding and decoding by tree concatenation.

A text is split into words as the vocabulary file says. Each distinct word is encoded once per
worker. A long unsplit word is cut into leaves; neighbouring encodings are joined pairwise, level
by level, by encoding anew a window of tokens around the join. The window grows until its first
and last tokens are those that the two sides had there, so that every adjacent pair of tokens is
one that some exact encoding holds: then the joined tokens are the exact encoding of the whole.
Spark spreads documents over tasks; a task streams Arrow batches and keeps a bounded cache.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import small_batches

#: Words of more symbols than this are encoded as a tree of leaves of this many symbols.
LEAF = 48
#: Words whose encoding a worker keeps.
CACHE = 300_000
CONTROLS = regex.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary file with word-end symbols and no decoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.word_re = regex.compile(next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"])
        chars = _byte_chars()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + self.end] for c in chars]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.symbols = [()] * (max(self.strings) + 1)  # the byte symbols of each token
        for c, i in (*zip(chars, self.inner, strict=True), *((c + self.end, i) for c, i in zip(chars, self.last, strict=True))):
            self.symbols[i] = (i,)
        for a, b in pairs:
            if not self.symbols[vocab[a + b]]:
                self.symbols[vocab[a + b]] = self.symbols[vocab[a]] + self.symbols[vocab[b]]
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the best-ranked merge, the leftmost of equals, until none applies."""
        ids, get = list(ids), self.merges.get
        found = [get(a << 20 | b) for a, b in zip(ids, ids[1:], strict=False)]
        while any(found):
            at = min((m[0], i) for i, m in enumerate(found) if m)[1]
            ids[at : at + 2] = [found[at][1]]
            del found[at]
            if at:
                found[at - 1] = get(ids[at - 1] << 20 | ids[at])
            if at < len(found):
                found[at] = get(ids[at] << 20 | ids[at + 1])
        return ids

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The exact encoding of two neighbouring exact encodings' text."""
        width = 4
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.merge([s for i in (*left[a:], *right[:b]) for s in self.symbols[i]])
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            width *= 2

    def tree(self, symbols: list[int]) -> list[int]:
        level = [self.merge(symbols[i : i + LEAF]) for i in range(0, len(symbols), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def word(self, word: str) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        data = word.encode("utf-8", "replace")
        symbols = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        ids = array("I", self.merge(symbols) if len(symbols) <= LEAF else self.tree(symbols)).tobytes()
        if len(word) <= 4 * LEAF:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    @staticmethod
    def lower(text: str) -> str:
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # no final sigma

    def chunk(self, chunk: str) -> bytes:
        """Ids of a stretch without white space; no word crosses white space."""
        text = self.lower(chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk))
        words = self.word_re.findall(text)
        ids = b"".join([self.cache.get(w) or self.word(w) for w in words])
        if len(words) > 1 or text != chunk:
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            if len(chunk) <= 4 * LEAF:
                self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; special tokens' strings stand for their ids."""
        out, word, chunk = [], self.cache.get, self.chunks.get
        for part in self.special_re.split(text) if self.special_re and "<|" in text else (text,):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                # str.split() also splits at the four separator controls, which are no white space here
                pieces = part.split() if part.isprintable() or not CONTROLS.search(part) else regex.split(r"\s+", part)
                out += [word(c) or chunk(c) or self.chunk(c) for c in pieces]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with a space between, as a vocabulary file without decoder asks."""
        strings = self.strings
        return " ".join([strings[i] for i in array("I", ids)])


_loaded: dict[str, WordBpe] = {}


def vocabulary(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again.

    Returns one row per input row: ``doc_id, ids binary`` (little-endian unsigned 32-bit),
    ``n_tokens, decoded``. A null or empty text has no tokens and decodes to an empty text.
    Repeated rows and null ids each give their row; other columns of ``docs`` are not read;
    an empty table gives an empty result. ``path`` must be readable on every executor.
    """
    path = path or default_vocabulary()
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            ids = [bpe.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([bpe.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids binary, n_tokens long, decoded string")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """The token count and digests of encoded documents, and further columns of theirs."""
    return encoded.select("doc_id", *more, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


