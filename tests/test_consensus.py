"""Scans of profiles against plain loops over columns."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spanwright.operators import consensus as C

KEYS = ["unit"]


def plain_segments(idents, threshold, run):
    """(start, length, open) of segments, found by walking over the columns."""
    out, start, last = [], None, None
    for i, x in enumerate(idents):
        if x >= threshold:
            start, last = (i if start is None else start), i
        elif start is not None and i - last >= run:
            out.append((start, last - start + 1, False))
            start = None
    if start is not None:
        out.append((start, len(idents) - start, True))
    return out


def plain_cut(idents, threshold, run):
    low = 0
    for i, x in enumerate(idents):
        low = low + 1 if x <= threshold else 0
        if low == run:
            return i - run + 1
    return len(idents)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from([0.2, 0.5, 0.8, 1.0]), min_size=1, max_size=14), min_size=5, max_size=12), st.integers(1, 3))
def test_scans_equal_plain_loops(spark, units, run):
    rows = [(u, i, x, "ACGT"[i % 4], 0.5, run) for u, xs in enumerate(units) for i, x in enumerate(xs)]
    profile = spark.createDataFrame(rows, "unit int, col long, ident double, base string, threshold double, run int")
    got = {}
    for r in C.segments(profile, KEYS).collect():
        got.setdefault(r["unit"], []).append((r["start"], r["length"], r["is_open"]))
        assert r["text"] == "".join("ACGT"[i % 4] for i in range(r["start"], r["start"] + r["length"]))
    cut = {r["unit"]: r["length"] for r in C.cutoff_run(profile, KEYS).collect()}
    for u, xs in enumerate(units):
        assert sorted(got.get(u, [])) == plain_segments(xs, 0.5, run)
        assert cut[u] == plain_cut(xs, 0.5, run)


def test_ties_go_to_the_character_met_first(spark):
    rows = [(0, 1, "CA"), (0, 2, "AA"), (0, 3, "A"), (0, 4, "C")]
    got = C.column_profile(spark.createDataFrame(rows, "unit int, ord int, seq string"), KEYS).orderBy("col").collect()
    assert [(r["base"], r["tot"]) for r in got] == [("C", 4), ("A", 2)]


def test_order_of_rows_does_not_matter(spark):
    rows = [(0, i, "ACGT"[i % 4] * 3) for i in range(20)]
    df = spark.createDataFrame(rows, "unit int, ord int, seq string")
    a, b = (sorted(map(tuple, C.column_profile(x, KEYS).collect())) for x in (df, df.repartition(7).orderBy("seq")))
    assert a == b
