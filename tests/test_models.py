"""Windows that the model reads."""

from spanwright import catalog, catalog_labels
from spanwright.plans import ml


def test_windows_are_oriented_before_they_are_cut(spark):
    near, far = "ACGTTGCAAC" * 50, "TTAGC" * 40
    rows = [(1, "left", far + near), (2, "left", near), (3, "right", near + far), (4, "right", near), (5, "left", near + far)]
    df = spark.createDataFrame([(i, "t", side, seq) for i, side, seq in rows], "doc_id long, rec_type string, side string, seq string")
    got = {r["doc_id"]: r["features"] for r in ml.boundary_features(df).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[5] != got[2]


def test_models_get_whole_sequences(spark, monkeypatch):
    x = catalog.Inputs(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(ml, "boundary_features", lambda rows: rows)
    got = {r["doc_id"]: r["seq"] for r in catalog_labels.features(x).select("doc_id", "seq").collect()}
    whole = {r["doc_id"]: r["seq"] for r in x("contigs").collect()}
    assert got and max(map(len, got.values())) > 500 and all(whole[i] == seq for i, seq in got.items())


def test_features_come_without_what_they_are_made_of(spark):
    """Sequences, their k-mers and counts of these beside the features were over ten times as large as these when rows were held in memory."""
    df = spark.createDataFrame([(i, "t", "left", "ACGTTGCAAC" * (40 + i), i / 20, ("train", "val", "test")[i % 3]) for i in range(20)], "doc_id long, rec_type string, side string, seq string, label double, split string")
    got = ml.boundary_features(df)
    assert got.columns == ["doc_id", "rec_type", "side", "label", "split", "features"]
    assert {r["doc_id"] for r in ml.fit_predict(got).collect()} == {i for i in range(20) if i % 3 == 2}
