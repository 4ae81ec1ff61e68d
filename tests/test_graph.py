"""Components, clusters, duplicates and splits on small inputs."""

import random

from spanwright.operators import graph, similarity, skew, split


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(None, 3), (200, 200)]
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[200] == 200


def test_no_edges_make_no_components(spark):
    assert graph.connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_greedy_clusters_follow_size(spark):
    vertices = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7), ("d", 1)], "id string, size int")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    got = {r["member"]: r["rep"] for r in similarity.greedy_clusters(vertices, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_reverse_complements_are_duplicates(spark):
    rows = [("x", "AACG", 0), ("y", "CGTT", 1), ("z", "AAAA", 2), ("w", "AACG", 3)]
    got = {r["member"]: (r["group_no"], r["sign"]) for r in similarity.strand_aware_duplicates(spark.createDataFrame(rows, "id string, seq string, ord int")).collect()}
    assert got == {"x": (0, "-"), "y": (0, "+"), "w": (0, "-")}


def test_split_gives_each_component_one_bucket_near_its_share(spark):
    rows = [(f"c{i}", f"t{i % 3}", 1 + i % 5) for i in range(200)]
    rows += [(f"c{i}", None, 1 + i % 5) for i in range(200)]
    got = split.assign_buckets(spark.createDataFrame(rows, "component string, rec_type string, n long"), ["train", "val", "test"], [0.8, 0.1, 0.1], 1).collect()
    assert len(got) == len({r["component"] for r in got}) == 200
    size = {b: sum(1 + int(r["component"][1:]) % 5 for r in got if r["bucket"] == b) for b in ("train", "val", "test")}
    assert 420 < size["train"] < 520 and 30 < size["val"] < 100 and 30 < size["test"] < 100


def plain_buckets(components, shares):
    """The reference rule one component after the other, from the largest on: how full each bucket gets by type."""
    everything = {}
    for fp in components.values():
        for t, n in fp.items():
            everything[t] = everything.get(t, 0) + n
    whole = sum(everything.values())
    filled = [{} for _ in shares]
    for name in sorted(components, key=lambda c: (-sum(components[c].values()), sorted(components[c].items()))):
        fp = components[name]
        best, score = None, None
        for b, share in enumerate(shares):
            worst = (sum(filled[b].values()) + sum(fp.values())) / (share * whole)
            for t, n in fp.items():
                worst = max(worst, (filled[b].get(t, 0) + n) / (share * everything[t]))
            if score is None or worst < score:
                best, score = b, worst
        for t, n in fp.items():
            filled[best][t] = filled[best].get(t, 0) + n
    return filled


def test_buckets_are_as_full_as_one_by_one(spark, monkeypatch):
    rng = random.Random(7)
    components = {f"c{i}": {f"t{t}": rng.choice([1, 1, 2, 5, 30]) for t in rng.sample(range(4), rng.choice([1, 1, 2]))} for i in range(400)}
    rows = [(c, t, n) for c, fp in components.items() for t, n in fp.items()] + [(c, None, sum(fp.values())) for c, fp in components.items()]
    df = spark.createDataFrame(rows, "component string, rec_type string, n long")
    for shares in ([0.8, 0.1, 0.1], [0.2] * 5):
        for one_by_one in (1000, 3):
            monkeypatch.setattr(split, "ONE_BY_ONE", one_by_one)
            got = split.assign_buckets(df, [str(i) for i in range(len(shares))], shares, 42).collect()
            assert len(got) == len({r["component"] for r in got}) == 400
            filled = [{} for _ in shares]
            for r in got:
                for t, n in components[r["component"]].items():
                    filled[int(r["bucket"])][t] = filled[int(r["bucket"])].get(t, 0) + n
            assert filled == plain_buckets(components, shares)


def test_genes_with_changes_and_copies_cluster(spark):
    rng = random.Random(3)
    gene = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    changed = lambda s, n: "".join(rng.choice("ACGT".replace(c, "")) if i in places else c for places in [set(rng.sample(range(len(s)), n))] for i, c in enumerate(s))
    a, b = gene(900), gene(600)
    rows = [("a0", a), ("a1", changed(a, 60)), ("a2", a), ("a3", a[30:]), ("a4", a[:500]), ("b0", b), ("b1", changed(b, 40)), ("s0", "ACGTAC"), ("s1", "ACGTAC"), ("s2", "ACGTAA")]
    got = {r["member"]: r["rep"] for r in similarity.cluster_by_similarity(spark.createDataFrame(rows, "id string, seq string")).collect()}
    assert got == {"a0": "a0", "a1": "a0", "a2": "a0", "a3": "a0", "a4": "a4", "b0": "b0", "b1": "b0", "s0": "s0", "s1": "s0", "s2": "s2"}


def test_frequent_keys_join_as_others_do(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 10)
    monkeypatch.setattr(skew, "FEW", 0)
    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(500)] + [(None, 999)], "k int, v int")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)
        assert sorted(map(tuple, skew.even_join(left, right, ["k"], how).collect()), key=repr) == want
