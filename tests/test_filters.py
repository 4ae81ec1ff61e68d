"""The motif filters: gradients, planted motifs, attributions and edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.functions import expr as E
from spanwright.operators import aggregates as A
from spanwright.plans import filters

MOTIF = "TTAGCATCGA"


def inputs(rng, n=5, length=40):
    return rng.integers(0, 5, (n, length)).astype(np.uint8), rng.integers(0, filters.TYPES, n), rng.integers(0, 3, n)


def plain_prediction(flat, codes, kind, side):
    """One row at a time, base by base."""
    p = filters.parts(flat)
    best = [max(sum(p["filters"][j, codes[s + j], c] for j in range(filters.WIDTH) if codes[s + j] < 4) for s in range(len(codes) - filters.WIDTH + 1)) for c in range(filters.FILTERS)]
    total = float(p["level"])
    for h in range(filters.HIDDEN):
        inner = sum((best[c] + p["bias"][c]) * p["mix"][c, h] for c in range(filters.FILTERS)) + p["types"][kind, h] + p["sides"][side, h] + p["hidden"][h]
        total += np.tanh(inner) * p["out"][h]
    return 1 / (1 + np.exp(-total))


def test_predictions_and_gradients_equal_plain_ones():
    rng = np.random.default_rng(1)
    flat = filters.start(3) + rng.normal(0, 0.05, filters.SIZE)
    codes, types, sides = inputs(rng)
    labels = rng.random(len(codes))
    got = filters.predictions(flat, codes, types, sides)
    assert np.allclose(got, [plain_prediction(flat, *row) for row in zip(codes, types, sides, strict=True)])
    grad, loss = filters.gradient(flat, codes, types, sides, labels)
    assert np.isclose(loss, ((got - labels) ** 2).sum())
    for at in [*rng.integers(0, filters.SIZE, 60), *np.flatnonzero(grad)[::25], filters.SIZE - 1]:
        move = np.zeros(filters.SIZE)
        move[at] = 1e-6
        ends = [((filters.predictions(flat + m, codes, types, sides) - labels) ** 2).sum() for m in (move, -move)]
        assert np.isclose(grad[at], (ends[0] - ends[1]) / 2e-6, atol=1e-6)


def test_attributions_sum_to_the_difference():
    rng = np.random.default_rng(2)
    flat = filters.start(4) + rng.normal(0, 0.05, filters.SIZE)
    codes, types, sides = inputs(rng, 20, 60)
    p = filters.parts(flat)
    even = 0.25 * p["filters"].sum(axis=(0, 1)) + p["bias"]
    base = filters._head(p, np.tile(even, (len(codes), 1)), types, sides)[1]
    sums = filters.attributed(flat, codes, types, sides).sum(axis=(1, 2))
    assert np.allclose(sums, filters.predictions(flat, codes, types, sides) - base, atol=1e-4)


@pytest.fixture(scope="module")
def planted(spark):
    """Windows whose label tells whether they hold the motif; left ones hold it on the other strand."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        seq, has, side, place = "".join(rng.choice(list("ACGT"), 120)), i % 2 == 0, ("left", "right")[i // 2 % 2], int(rng.integers(0, 100))
        if has:
            seq = seq[:place] + MOTIF + seq[place + len(MOTIF) :]
        if side == "left":
            seq = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        rows.append((i, f"type{i % 3}", side, seq, 1.0 if has else 0.3, ("train", "train", "train", "val", "test")[i // 4 % 5], place if has else None))
    df = spark.createDataFrame(rows, "doc_id long, rec_type string, side string, seq string, label double, split string, place int")
    kept = filters.windows(df, 120).checkpoint()
    return kept, filters.fit(kept, steps=60)


def test_a_planted_motif_is_learned_and_found(planted):
    rows, model = planted
    test = rows.where("split = 'test'")
    got = filters.predict(test, model).select("label", "prediction").toPandas()
    assert len(got) == test.count() and ((got["prediction"] > 0.65) == (got["label"] > 0.65)).mean() >= 0.95
    assert [e for e, *_ in model.log] == list(range(1, len(model.log) + 1)) and min(v for _, _, v, _ in model.log) < model.log[0][2] / 4
    scores = filters.attributions(test.where("label = 1"), model, ["doc_id"])
    scores = scores.select("doc_id", "position", E.score_magnitude(*map(F.col, "ACGT")).alias("magnitude"))
    places = test.select("doc_id", F.col("place").alias("seg_start"), F.lit(len(MOTIF)).alias("seg_length"))
    peaks = A.peak_in_segment(scores.join(places, "doc_id"), ["doc_id"]).toPandas()
    assert len(peaks) == (got["label"] == 1).sum() and peaks["in_segment"].mean() >= 0.9


def test_sums_do_not_depend_on_the_partitions(planted):
    rows, model = planted
    fitting = rows.where("split <> 'test'").withColumn("watch", F.col("split") == "val")
    one, many = (filters._sums(fitting.repartition(n), model.flat) for n in (1, 7))
    assert np.allclose(one, many, atol=1e-5) and one[filters.SIZE + 1] + one[filters.SIZE + 3] == fitting.count()


def test_edge_rows(spark):
    rows = [(1, None, None, None, 0.3, "train"), (2, "t", "left", "", None, "train"), (3, "t", "right", "acgtn-é" * 90, 1.0, "val"), (3, "t", "right", "acgtn-é" * 90, 1.0, "test"), (4, "t", "odd", "A", 0.7, None)]
    df = filters.windows(spark.createDataFrame(rows, "doc_id long, rec_type string, side string, seq string, label double, split string"))
    model = filters.fit(df, steps=2)
    got = filters.predict(df, model).select("doc_id", F.length("window").alias("n"), "prediction").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 3, 4] and all(r["n"] == 500 and 0 < r["prediction"] < 1 for r in got)
    assert len({r["prediction"] for r in got if r["doc_id"] == 3}) == 1
    none = filters.fit(df.where("false"))
    assert not none.log and filters.attributions(df, none, ["doc_id"]).count() == 5 * 500 and filters.predict(df.where("false"), none).count() == 0
