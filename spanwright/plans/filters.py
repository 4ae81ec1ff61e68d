"""A regression of soft labels by learned motif filters, and its attributions to bases.

Filters slide along the oriented window; the best place of each counts, with the type and the side, in
a layer of hidden units. Every step is a Spark job: tasks add up the gradients of their rows, Spark adds
those up by parameter, and the driver, which holds the parameters only, moves them. The loss of the val
rows comes from the same job, so a step reads the windows once. Attributions are made in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.functions import expr as E

FILTERS, WIDTH, HIDDEN = 16, 11, 8
#: Bases of the words that filters start from.
SEED = 6
#: Types share slots by their hashes; sides are left, right and others.
TYPES, SIDES = 64, 3
#: Rows worked on at a time in a task, and midpoints of the path of an attribution.
TOGETHER, MIDPOINTS = 64, 64
#: Sums of gradients are whole numbers of this unit, so that they depend on no order.
UNIT = 2.0**-24
SHAPES = {"filters": (WIDTH, 4, FILTERS), "bias": (FILTERS,), "mix": (FILTERS, HIDDEN), "types": (TYPES, HIDDEN), "sides": (SIDES, HIDDEN), "hidden": (HIDDEN,), "out": (HIDDEN,), "level": ()}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
CODES = np.full(256, 4, np.uint8)
CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)


@dataclass
class Model:
    """``flat`` has the parameters in the order of SHAPES; ``log`` the epoch, train loss, val loss and rate of each step."""

    flat: np.ndarray
    log: list[tuple[int, float, float, float]] = field(default_factory=list)


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parameters by name."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start(seed: int, motifs: Sequence[str] = ()) -> np.ndarray:
    """First parameters: filters that look for ``motifs``, and small random numbers."""
    rng, flat = np.random.default_rng(seed), np.zeros(SIZE)
    p = parts(flat)
    for name, spread in (("filters", 0.05), ("mix", 0.3), ("out", 0.5)):
        p[name][...] = rng.normal(0, spread, SHAPES[name])
    left = (WIDTH - SEED) // 2
    for c, motif in enumerate(motifs):
        p["filters"][left : left + SEED, :, c] -= 0.15
        p["filters"][range(left, left + SEED), ["ACGT".index(b) for b in motif], c] += 0.65
        p["bias"][c] = -2.5  # so that the best place is near 0 with a base or two amiss
    return flat


def telling(fitting: DataFrame) -> list[str]:
    """The SEED bases in a row that tell most about the labels of the rows that have them: one for each filter.

    A word of n rows scores by how far the sum of their labels is from n mean ones, over the root of n. There are 4**SEED words at most, counted by Spark before they are shuffled.
    """
    mean = fitting.agg(F.avg("label")).first()[0]
    if mean is None:
        return []
    places = F.sequence(F.lit(1), F.length("window") - (SEED - 1))
    words = F.array_distinct(F.transform(places, lambda i: F.substr(F.col("window"), i, F.lit(SEED))))
    each = fitting.select(F.explode(words).alias("word"), F.rint((F.col("label") - mean) / UNIT).cast("long").alias("over"))
    score = F.abs(F.sum("over")) / F.sqrt(F.count("*") + F.lit(1.0))
    found = each.where(F.col("word").rlike("^[ACGT]+$")).groupBy("word").agg(score.alias("score"))
    return [r["word"] for r in found.orderBy(F.desc("score"), "word").limit(FILTERS).collect()]


def windows(rows: DataFrame, length: int = 500) -> DataFrame:
    """``window, type_slot, side_slot`` of each row with ``rec_type, side, seq``, beside its own columns.

    Sequences are oriented first and then cut to ``length`` bases; shorter and null ones are filled up
    with N, which no filter counts. Null types and sides have slots of their own kind (of the empty name).
    """
    oriented = E.model_orientation(F.coalesce("seq", F.lit("")), F.coalesce("side", F.lit("")))
    side: Column = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(2)
    return rows.withColumns(
        {
            "window": F.rpad(F.left(oriented, F.lit(max(length, WIDTH))), max(length, WIDTH), "N"),
            "type_slot": F.pmod(F.xxhash64(F.coalesce("rec_type", F.lit(""))), F.lit(TYPES)).cast("int"),
            "side_slot": side.cast("int"),
        }
    )


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the bases, one row each, and slots of the types and sides."""
    texts = batch.column("window").to_pylist()
    codes = CODES[np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)].reshape(len(texts), -1)
    return codes, batch.column("type_slot").to_numpy(), batch.column("side_slot").to_numpy()


def _best(p: dict[str, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place where each filter fits best, the first of equals, and how well it fits there."""
    places = codes.shape[1] - WIDTH + 1
    filters = np.concatenate([p["filters"], np.zeros((WIDTH, 1, FILTERS))], axis=1)
    fit = np.zeros((len(codes), places, FILTERS))
    for j in range(WIDTH):
        fit += filters[j][codes[:, j : j + places]]
    at = fit.argmax(axis=1)
    return at, np.take_along_axis(fit, at[:, None], axis=1)[:, 0]


def _head(p: dict[str, np.ndarray], z: np.ndarray, types: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    units = np.tanh(z @ p["mix"] + p["types"][types] + p["sides"][sides] + p["hidden"])
    return units, 1 / (1 + np.exp(-(units @ p["out"] + p["level"])))


def predictions(flat: np.ndarray, codes: np.ndarray, types: np.ndarray, sides: np.ndarray) -> np.ndarray:
    p = parts(flat)
    return _head(p, _best(p, codes)[1] + p["bias"], types, sides)[1]


def gradient(flat: np.ndarray, codes: np.ndarray, types: np.ndarray, sides: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """The summed gradient of the squared errors, and their sum."""
    p, total = parts(flat), np.zeros(SIZE)
    g = parts(total)
    at, fit = _best(p, codes)
    z = fit + p["bias"]
    units, y = _head(p, z, types, sides)
    out = 2 * (y - labels) * y * (1 - y)
    inner = out[:, None] * p["out"] * (1 - units**2)
    pooled = inner @ p["mix"].T
    g["out"][...], g["level"][...] = units.T @ out, out.sum()
    g["mix"][...], g["hidden"][...], g["bias"][...] = z.T @ inner, inner.sum(axis=0), pooled.sum(axis=0)
    np.add.at(g["types"], types, inner)
    np.add.at(g["sides"], sides, inner)
    by_filter = np.arange(FILTERS)[None, :]
    for j in range(WIDTH):
        base = np.take_along_axis(codes, at + j, axis=1)
        known = base < 4
        np.add.at(g["filters"][j], (base[known], np.broadcast_to(by_filter, base.shape)[known]), pooled[known])
    return total, float(((y - labels) ** 2).sum())


def attributed(flat: np.ndarray, codes: np.ndarray, types: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """What each base adds to the prediction, along the straight path from even bases to the window's own.

    Evenly mixed bases fit a filter alike at every place, so its best place stays the same along the path
    and the integral runs over the hidden units only. Sums over a window are its prediction less that of
    even bases, up to the error of the midpoints.
    """
    p = parts(flat)
    at, fit = _best(p, codes)
    even = 0.25 * p["filters"].sum(axis=(0, 1))
    slope = np.zeros_like(fit)
    for a in (np.arange(MIDPOINTS) + 0.5) / MIDPOINTS:
        units, y = _head(p, a * fit + (1 - a) * even + p["bias"], types, sides)
        slope += ((y * (1 - y))[:, None] * p["out"] * (1 - units**2)) @ p["mix"].T / MIDPOINTS
    out = np.zeros((len(codes), codes.shape[1], 4))
    row = np.arange(len(codes))[:, None]
    one = np.eye(5)[:, :4] - 0.25
    for j in range(WIDTH):
        base = np.take_along_axis(codes, at + j, axis=1)
        np.add.at(out, (np.broadcast_to(row, at.shape), at + j), slope[:, :, None] * one[base] * p["filters"][j].T[None])
    return out


def _sums(df: DataFrame, flat: np.ndarray) -> np.ndarray:
    """Gradient, and losses and counts of train and val rows, of one step."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 4)
        for whole in batches:
            for i in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(i, TOGETHER)
                codes, types, sides = _read(batch)
                labels, watch = batch.column("label").to_numpy(), batch.column("watch").to_numpy(zero_copy_only=False)
                if not watch.all():
                    t = ~watch
                    step, loss = gradient(flat, codes[t], types[t], sides[t], labels[t])
                    total[:SIZE] += step
                    total[SIZE : SIZE + 2] += loss, t.sum()
                if watch.any():
                    y = predictions(flat, codes[watch], types[watch], sides[watch])
                    total[SIZE + 2 :] += ((y - labels[watch]) ** 2).sum(), watch.sum()
        whole_units = np.rint(total / UNIT).astype(np.int64)
        at = np.flatnonzero(whole_units)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(whole_units[at])], names=["at", "n"])

    out = np.zeros(SIZE + 4)
    for r in df.mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each parameter
        out[r["at"]] = r["n"] * UNIT
    return out


def fit(rows: DataFrame, steps: int = 40, patience: int = 8, rate: float = 0.05, seed: int = 7) -> Model:
    """Fit on the train split, and keep the parameters of the step with the least loss on the val split.

    ``rows`` has ``window, type_slot, side_slot, label, split`` and is read once in each step, so it should
    be a kept table. Rows without a label or of other splits don't count. Steps end after ``patience`` ones
    that did not improve the loss; the rate is halved after three. Without train rows the first parameters
    stand; without val rows the train loss is watched.
    """
    fitting = rows.where(F.col("split").isin("train", "val") & F.col("label").isNotNull())
    fitting = fitting.select("window", "type_slot", "side_slot", F.col("label").cast("double").alias("label"), (F.col("split") == "val").alias("watch"))
    flat, best, model = start(seed, telling(fitting.where(~F.col("watch")))), float("inf"), None
    mean, square, waited, log = np.zeros(SIZE), np.zeros(SIZE), 0, []
    for step in range(1, steps + 1):
        sums = _sums(fitting, flat)
        loss, n, val_loss, n_val = sums[SIZE:]
        if not n:
            break
        watched = val_loss / n_val if n_val else loss / n
        log.append((step, loss / n, watched, rate))
        if watched < best - 1e-6:
            best, waited, model = watched, 0, flat.copy()
        else:
            waited += 1
            rate = rate / 2 if waited % 3 == 0 else rate
            if waited >= patience:
                break
        grad = sums[:SIZE] / n
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        flat = flat - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(flat if model is None else model, log)


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """``prediction`` to four decimals, beside the columns of ``rows`` (made by ``windows``)."""
    flat = model.flat

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(i, TOGETHER)
                yield batch.append_column("prediction", pa.array(predictions(flat, *_read(batch)).round(4)))

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField("prediction", T.DoubleType())]))


def attributions(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``position`` from 0 and the scores ``A, C, G, T`` of each base of each window, by ``keys``."""
    flat = model.flat

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(i, TOGETHER)
                scores = attributed(flat, *_read(batch))
                n, length = scores.shape[:2]
                row = pa.array(np.repeat(np.arange(n), length))
                columns = [batch.column(k).take(row) for k in keys] + [pa.array(np.tile(np.arange(length), n))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(scores[:, :, b].ravel()) for b in range(4))], names=[*keys, "position", *"ACGT"])

    fields = [rows.schema[k] for k in keys] + [T.StructField("position", T.LongType())] + [T.StructField(b, T.DoubleType()) for b in "ACGT"]
    return rows.select(*keys, "window", "type_slot", "side_slot").mapInArrow(work, T.StructType(fields))
