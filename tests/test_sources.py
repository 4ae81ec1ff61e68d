"""Readers on small files."""

import gzip

from spanwright.sources import tables as S


def test_intervals_are_read_below_a_folder_without_comments_and_short_lines(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    row = "c1\tsrc\tgene\t5\t9\t.\t+\t.\tID=x;note=\"q\""
    (deep / "one.gff3").write_text(f"##gff\n\n{row}\nshort\tline\n" + row.replace("gene", "mobile_genetic_element") + "\n")
    (deep / "two.txt").write_text(row + "\n")
    got = S.read_intervals(spark, str(tmp_path), "gene").collect()
    assert [(r["seqid"], r["start"], r["end"], r["attributes"]) for r in got] == [("c1", 5, 9, 'ID=x;note="q"')]


def test_sequences_span_lines_and_may_be_gzipped(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">s1 first one\nACG\nTac\n>s2\n>s3 x\nGG\n")
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(">s4\nAA\nCC")
    got = sorted((r["id"], r["seq"]) for r in S.read_sequences(spark, str(tmp_path), upper=True).collect())
    assert got == [("s1", "ACGTAC"), ("s2", ""), ("s3", "GG"), ("s4", "AACC")]


def test_group_lines_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "g.txt").write_text("+a -b\n\nc +a a\n")
    lines = S.numbered(spark, str(tmp_path / "g.txt"))
    assert sorted(map(tuple, S.duplicate_groups(lines).collect())) == [(1, "a"), (1, "b"), (2, "a"), (2, "c")]
    assert {r["member"]: r["sign"] for r in S.orientation(lines).collect()} == {"a": "-", "b": "-", "c": "-"}


def test_the_last_line_of_an_accession_and_of_a_member_wins(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("#x\nG1\told\t1\tsp\nG1\tnew\t1\tsp\tst\nG2\tb\t1\nG3\tc\t1\tsp3\n")
    got = {r["gca"]: (r["speci"], r["label"]) for r in S.taxonomy(S.numbered(spark, str(tmp_path / "t.tsv"))).collect()}
    assert got == {"G1": ("new", "sp st"), "G3": ("c", "sp3")}
    (tmp_path / "m.tsv").write_text("r1\tm\nr2\tm \nonly\n")
    assert [tuple(r) for r in S.membership(S.numbered(spark, str(tmp_path / "m.tsv"))).collect()] == [("m", "r2")]


def test_null_is_na_in_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ("", 'q"t', None)], "x string, y string, n long")
    S.write_table(df, str(tmp_path / "t"))
    assert any("NA" in p.read_text() for p in (tmp_path / "t").glob("part-*"))
    got = sorted(map(tuple, S.read_table(spark, str(tmp_path / "t"), "x string, y string, n long").collect()), key=repr)
    assert got == [("a", None, 1), (None, 'q"t', None)]
