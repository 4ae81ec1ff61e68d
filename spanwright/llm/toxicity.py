"""Toxicity of documents: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector and the vectors of its character n-grams and beginnings, all
looked up by hashes. Two gated recurrent layers read a window of words forwards and backwards;
attention weighs their states; a logistic unit scores the window. All overlapping windows of a
text are scored, its score is that of its worst window, calibrated on documents kept apart.

The network is fitted by a task on a bounded, balanced sample of labelled documents, with a fixed
number of steps; the driver holds its weights, no texts. Scoring runs in tasks over whole texts; the inputs' share in the gates is
computed once per distinct word.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import fold, small_batches

#: Words of a window and between the starts of neighbouring windows: each overlaps the next.
WINDOW, STRIDE = 48, 36
#: Sizes: rows of the vector table, vector length, states of each direction.
SLOTS, INPUT, STATE = 1 << 17, 16, 8
#: The sample: documents of each label, and the longest text in it. A fifth of it is for calibration.
SAMPLE, LONGEST = 2000, 20_000
STEPS, DOCUMENTS, WINDOWS, RATE = 250, 24, 12, 0.01
#: Words whose gate inputs a worker keeps.
KEPT = 150_000
GRAMS = (4, 6)
WORD = re.compile(r"\w+")
#: Characters of a word: a longer run becomes pieces that overlap by half, so none of it is left out.
LONG = 40


def features(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of words, and how many each word has: itself, its beginnings and its character n-grams."""
    if not vocabulary:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) + 2
    codes = np.frombuffer("".join([f"^{w}$" for w in vocabulary]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    starts = np.cumsum(n) - n
    parts = []
    h, live = np.zeros(len(n), np.uint64), np.arange(len(n))
    for k in range(int(n.max())):
        h[live] = _mix(h[live] * np.uint64(31) + codes[starts[live] + k])
        if 4 <= k + 1 < 10:
            parts.append((live, h[live]))
        ended = live[n[live] == k + 1]
        parts.append((ended, ~h[ended]))
        live = live[n[live] > k + 1]
    owner, left = np.repeat(np.arange(len(n)), n), np.repeat(starts + n, n) - np.arange(len(codes))
    for size in GRAMS:
        if len(codes) >= size:
            g = np.full(len(codes) - size + 1, size, np.uint64)
            for k in range(size):
                g = g * np.uint64(1_000_003) + codes[k : k + len(g)]
            inside = left[: len(g)] >= size
            parts.append((owner[: len(g)][inside], _mix(g[inside])))
    of, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(of, kind="stable")
    return (hashes[order] % np.uint64(SLOTS)).astype(np.int64), np.bincount(of, minlength=len(n))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words(text: str | None) -> list[str]:
    half = LONG // 2
    return [w[i : i + LONG] for w in WORD.findall((text or "").lower()) for i in range(0, max(1, len(w) - half), half)]


def window_starts(n: int) -> list[int]:
    """Starts of the windows of a text of n words; the last one reaches its end."""
    return [*range(0, max(1, n - WINDOW + STRIDE), STRIDE)] if n else []


@dataclass
class Network:
    """Weights; gates stand in the order update, reset, candidate."""

    table: np.ndarray
    gates: list[np.ndarray]  # per direction (INPUT, 3 STATE)
    back: list[np.ndarray]  # per direction (STATE, 3 STATE)
    bias: list[np.ndarray]
    look: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    share: float = 0.0  # of label 1 among the labelled rows: the score of a text without words
    kept: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray = field(default_factory=lambda: np.empty((0, 2, 3 * STATE), np.float32))

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        g = np.random.default_rng(seed)
        r = lambda *s: (g.standard_normal(s) * 0.3).astype(np.float32)
        return cls(r(SLOTS, INPUT) * 0.3, [r(INPUT, 3 * STATE) for _ in "fb"], [r(STATE, 3 * STATE) for _ in "fb"], [np.zeros(3 * STATE, np.float32) for _ in "fb"], r(2 * STATE), r(2 * STATE), np.zeros(1, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.gates, *self.back, *self.bias, self.look, self.out, self.shift]

    def vectors(self, vocabulary: list[str]) -> np.ndarray:
        """A vector for each word: the sum of its features' ones, scaled by their number."""
        slots, n = features(vocabulary)
        return np.add.reduceat(self.table[slots], np.cumsum(n) - n) / np.sqrt(n)[:, None].astype(np.float32)

    def inputs(self, vocabulary: list[str]) -> np.ndarray:
        """Each word's share in the gates of both directions, (word, direction, 3 STATE); kept while they fit."""
        fresh = [w for w in vocabulary if w not in self.kept]
        if len(self.kept) + len(fresh) > KEPT:
            self.kept.clear()
            fresh = vocabulary
        if fresh:
            v = self.vectors(fresh)
            rows = np.stack([v @ self.gates[d] + self.bias[d] for d in (0, 1)], 1)
            at = len(self.kept)
            if at + len(rows) > len(self.rows):
                grown = np.empty((max(KEPT, at + len(rows)), 2, 3 * STATE), np.float32)
                grown[:at] = self.rows[:at]
                self.rows = grown
            self.rows[at : at + len(rows)] = rows
            self.kept.update(zip(fresh, range(at, at + len(rows)), strict=True))
        return self.rows[[self.kept[w] for w in vocabulary]]

    def run(self, x: list[np.ndarray], mask: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of windows. x: per direction the inputs' share in the gates, (time, window, 3 STATE)."""
        t, b = mask.shape
        states, trace = [], []
        for d in (0, 1):
            h, hs, kept = np.zeros((b, STATE), np.float32), np.zeros((t, b, STATE), np.float32), []
            for i in range(t) if d == 0 else reversed(range(t)):
                a = h @ self.back[d]
                zr = 1 / (1 + np.exp(-(x[d][i, :, : 2 * STATE] + a[:, : 2 * STATE])))
                z, r = zr[:, :STATE], zr[:, STATE:]
                c = np.tanh(x[d][i, :, 2 * STATE :] + r * a[:, 2 * STATE :])
                m = mask[i][:, None]
                new = h + m * z * (c - h)
                kept.append((i, h, z, r, c, a[:, 2 * STATE :], m))
                h = hs[i] = new
            states.append(hs)
            trace.append(kept)
        s = np.concatenate(states, 2)
        e = np.where(mask > 0, s @ self.look, -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[..., None] * s).sum(0)
        return pooled @ self.out + self.shift, {"trace": trace, "s": s, "w": w, "pooled": pooled}

    def gradients(self, g: np.ndarray, x: list[np.ndarray], memo: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Gradients of the weights and of x, given those of the logits."""
        s, w, pooled = memo["s"], memo["w"], memo["pooled"]
        d_pooled = g[:, None] * self.out
        d_w = (s * d_pooled).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        d_s = w[..., None] * d_pooled + d_e[..., None] * self.look
        d_look, d_out, d_shift = np.einsum("tb,tbk->k", d_e, s), g @ pooled, np.array([g.sum()], np.float32)
        d_x, d_back = [], []
        for d in (0, 1):
            dx, db, dh = np.zeros_like(x[d]), np.zeros_like(self.back[d]), np.zeros_like(pooled[:, :STATE])
            for i, h, z, r, c, ac, m in reversed(memo["trace"][d]):
                dh = dh + d_s[i, :, d * STATE : (d + 1) * STATE]
                dc = dh * m * z * (1 - c * c)
                dz = dh * m * (c - h) * z * (1 - z)
                dr = dc * ac * r * (1 - r)
                dx[i] = np.concatenate([dz, dr, dc], 1)
                da = np.concatenate([dz, dr, dc * r], 1)
                db += h.T @ da
                dh = dh * (1 - m * z) + da @ self.back[d].T
            d_x.append(dx)
            d_back.append(db)
        return [*(np.zeros_like(k) for k in self.gates), *d_back, *(k.sum((0, 1)) for k in d_x), d_look, d_out, d_shift], d_x


def _laid_out(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of word numbers as (time, window), with a mask."""
    t = max(map(len, lists))
    ids, mask = np.zeros((t, len(lists)), np.int64), np.zeros((t, len(lists)), np.float32)
    for k, x in enumerate(lists):
        ids[: len(x), k], mask[: len(x), k] = x, 1
    return ids, mask


def fit(texts: list[str], labels: list[int], share: float, seed: int = 7, steps: int | None = None) -> Network:
    """Fit the network: a text's logit is that of its highest window.

    ``share`` is the share of label 1 among all labelled rows, to which scores are calibrated. Without
    texts of both labels the network stays unfitted and scores are the share.
    """
    steps = steps or STEPS
    net = Network.fresh(seed)
    net.share = share
    g = np.random.default_rng(seed)
    y = np.array(labels)
    if len(set(labels)) < 2:
        net.out[:] = 0
        net.scale = (0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
        return net
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int64) for t in texts]
    vocabulary = list(number)
    order = g.permutation(len(docs))
    apart = set(order[: len(order) // 5].tolist())
    groups = [[i for i in order if y[i] == k and i not in apart and len(docs[i])] for k in (0, 1)]
    if not all(groups):
        groups = [[i for i in order if y[i] == k] for k in (0, 1)]
    all_slots, n_slots = features(vocabulary)
    feature_lists = np.split(all_slots, np.cumsum(n_slots)[:-1])
    params = net.weights()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    table_second = np.zeros(SLOTS, np.float32)
    for step in range(1, steps + 1):
        chosen = [k[g.integers(len(k))] for k in groups for _ in range(DOCUMENTS // 2)]
        lists, owner = [], []
        for n, i in enumerate(chosen):
            starts = window_starts(len(docs[i]))
            if len(starts) > WINDOWS and not y[i]:
                starts = g.choice(starts, WINDOWS, replace=False).tolist()
            elif len(starts) > 4 * WINDOWS:  # only the worst one has a gradient: found without a trace
                starts = [_worst(net, feature_lists, docs[i], starts)]
            for s in starts:
                lists.append(docs[i][s : s + WINDOW])
                owner.append(n)
        if not lists:
            continue
        ids, mask = _laid_out(lists)
        used, where = np.unique(ids, return_inverse=True)
        where = where.reshape(ids.shape)
        n_f = np.array([len(feature_lists[u]) for u in used])
        slots = np.concatenate([feature_lists[u] for u in used])
        of = np.repeat(np.arange(len(used)), n_f)
        norm = np.sqrt(n_f)[:, None].astype(np.float32)
        v = np.add.reduceat(net.table[slots], np.cumsum(n_f) - n_f) / norm
        x = [(v @ net.gates[d] + net.bias[d])[where] for d in (0, 1)]
        logits, memo = net.run(x, mask)
        owner = np.array(owner)
        grad, target = np.zeros(len(lists), np.float32), y[chosen]
        for n in set(owner.tolist()):
            mine = np.flatnonzero(owner == n)
            best = mine[np.argmax(logits[mine])]
            grad[best] = (1 / (1 + np.exp(-logits[best])) - target[n]) / len(chosen)
        grads, d_x = net.gradients(grad, x, memo)
        d_v = np.zeros_like(v)
        for d in (0, 1):
            per_word = np.zeros((len(used), 3 * STATE), np.float32)
            np.add.at(per_word, where.ravel(), d_x[d].reshape(-1, 3 * STATE))
            grads[d] = v.T @ per_word
            d_v += per_word @ net.gates[d].T
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, (p, q) in enumerate(zip(params, grads, strict=True)):
            first[k] = 0.9 * first[k] + 0.1 * q
            second[k] = 0.99 * second[k] + 0.01 * q * q
            p -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        rows, back = np.unique(slots, return_inverse=True)
        d_t = np.zeros((len(rows), INPUT), np.float32)
        np.add.at(d_t, back, (d_v / norm)[of])
        table_second[rows] += (d_t * d_t).mean(1)  # a rate of its own for each row
        net.table[rows] -= 5 * rate * d_t / (np.sqrt(table_second[rows])[:, None] + 1e-6)
    order = np.array([i for i in order if len(docs[i])])
    scores = np.array([_best(net, vocabulary, docs[i]) for i in order])
    held = np.array([i in apart for i in order])
    held = held if len(set(y[order[held]])) == 2 else np.ones(len(order), bool)
    net.scale = _calibrated(scores[held], y[order[held]], share)
    return net


def _worst(net: Network, feature_lists: list[np.ndarray], doc: np.ndarray, starts: list[int]) -> int:
    """The start of the window with the highest logit among all windows of a text in training."""
    used, where = np.unique(doc, return_inverse=True)
    n = np.array([len(feature_lists[u]) for u in used])
    slots = np.concatenate([feature_lists[u] for u in used])
    v = np.add.reduceat(net.table[slots], np.cumsum(n) - n) / np.sqrt(n)[:, None].astype(np.float32)
    ids, mask = _laid_out([where[s : s + WINDOW] for s in starts])
    return starts[int(np.argmax(_logits(net, [v @ net.gates[d] + net.bias[d] for d in (0, 1)], ids, mask)))]


def _best(net: Network, vocabulary: list[str], doc: np.ndarray) -> float:
    used, where = np.unique(doc, return_inverse=True)
    v = net.vectors([vocabulary[u] for u in used])
    ids, mask = _laid_out([where[s : s + WINDOW] for s in window_starts(len(doc))])
    return float(net.run([(v @ net.gates[d] + net.bias[d])[ids] for d in (0, 1)], mask)[0].max())


def _calibrated(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve over logits, labels weighted to their share in all rows."""
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    weight = weight * len(z) / weight.sum()
    a, b = 1.0, 0.0
    for _ in range(200):  # damped steps, and a pull to slope 1 and shift 0, as labels may be separable
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (p - y) * z).sum() + a - 1, (weight * (p - y)).sum() + 0.1 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = max(0.05, a - step[0]), b - step[1]
    return float(a), float(b)


def scores(net: Network, texts: list[str | None]) -> list[float]:
    """A probability for each whole text; a text without words has the share of label 1."""
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int64) for t in texts]
    rows = net.inputs(list(number))
    x = [np.ascontiguousarray(rows[:, d]) for d in (0, 1)]
    best = np.full(len(texts), -np.inf)
    spans = [(n, s, min(s + WINDOW, len(d))) for n, d in enumerate(docs) for s in window_starts(len(d))]
    spans.sort(key=lambda k: k[2] - k[1])
    for at in range(0, len(spans), 2048):
        part = spans[at : at + 2048]
        ids, mask = _laid_out([docs[n][i:j] for n, i, j in part])
        np.maximum.at(best, [n for n, _, _ in part], _logits(net, x, ids, mask))
    a, b = net.scale
    found = 1 / (1 + np.exp(-np.clip(a * np.maximum(best, -1e6) + b, -30, 30)))
    return np.where([len(d) > 0 for d in docs], found, net.share).tolist()


def _logits(net: Network, x: list[np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """As Network.run, without a trace."""
    t, b = ids.shape
    s = np.zeros((t, b, 2 * STATE), np.float32)
    whole = bool(mask.all())
    for d in (0, 1):
        h = np.zeros((b, STATE), np.float32)
        for i in range(t) if d == 0 else reversed(range(t)):
            u, a = x[d][ids[i]], h @ net.back[d]
            zr = u[:, : 2 * STATE]
            zr += a[:, : 2 * STATE]
            np.negative(zr, zr)
            np.exp(zr, zr)
            zr += 1
            np.reciprocal(zr, zr)
            c = a[:, 2 * STATE :]
            c *= zr[:, STATE:]
            c += u[:, 2 * STATE :]
            np.tanh(c, c)
            c -= h
            c *= zr[:, :STATE]
            if not whole:
                c *= mask[i][:, None]
            h = h + c
            s[i, :, d * STATE : (d + 1) * STATE] = h
    e = np.where(mask > 0, s @ net.look, -1e9)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    return np.einsum("tb,tbk->bk", w, s) @ net.out + net.shift


def sample(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> tuple[DataFrame, float]:
    """A bounded sample of labelled training texts (``doc_id, toxic, text``), SAMPLE of each label at most, in an order given by hashes; the share of label 1 in all rows.

    A document with several labels is toxic if one of them says so; rows without id or label are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    mark = F.xxhash64("doc_id")
    parts = [known.where(F.col("toxic") == k).orderBy(mark, "doc_id").limit(SAMPLE) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # bounded: 2 SAMPLE rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= LONGEST)
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), toxic / n if n else 0.0


def fitted(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> Network:
    """The network, fitted by one task, which holds the bounded sample."""
    rows, share = sample(docs, labels, folds, held)
    steps = STEPS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        net = pickle.dumps(fit(texts, marks, share, steps=steps))
        yield pa.RecordBatch.from_arrays([pa.array([net], pa.binary())], names=["net"])

    ordered = rows.repartition(1).sortWithinPartitions("doc_id").select(F.col("text").cast("string"), "toxic")
    found = ordered.mapInArrow(work, "net binary").collect()  # a row; none if the planner sees that there is no text
    return pickle.loads(found[0]["net"]) if found else fit([], [], share)


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Toxicity of every whole text of ``docs`` (``doc_id, text``).

    Labels of documents whose crc32(id as text) mod ``folds`` is ``held`` are never read, and neither
    is anything but texts for a score. Returns one row per input row: ``doc_id, held_out, score,
    predicted``. Texts without words (null and empty ones
    too) get the share of label 1. Repeated rows each give their row;
    without usable labels every score is the share of label 1, 0 if there are none.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, folds, held))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(net, batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(work, "doc_id long, score double")
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without rows whose text is scored 0.5 or more; all columns stay.

    The network learns from texts of ``labelled`` that ``labels`` marks.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fitted(labelled, labels, 5, 0))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(sent.value, texts.tolist()))

    return docs.where(score("text") < 0.5)
