"""Readers and writers round trip small files."""

import zipfile

from pyspark.sql import functions as F

from loomcount import sources as so


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line long, value string")


def test_lines_and_compression(spark, tmp_path):
    so.write_lines(spark.createDataFrame([("a b",), ("c",)], "value string"), str(tmp_path / "stream7"))
    got = so.lines(spark, str(tmp_path / "stream7"))
    assert sorted(r["value"] for r in got.collect()) == ["a b", "c"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "week12.txt").write_text("x\n")
    (tmp_path / "in" / "other.dat").write_text("y\n")
    assert [(r["value"], r["period"]) for r in so.lines(spark, str(tmp_path / "in"), "*.txt").collect()] == [("x", 12)]


def test_counts(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("a b\t3\nbad line\nc\tx\nd\t1\n")
    assert sorted(map(tuple, so.ngram_counts(spark, str(tmp_path / "c.tsv")).collect())) == [("a b", 2, 3), ("d", 1, 1)]


def test_series(spark):
    got = so.series_matrix(rows(spark, ["h1 h2", "1/2 3", "4/5 -1"]), skip=1)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 3.0), (2, 0, 0, 4.0), (2, 0, 1, 5.0), (2, 1, 0, -1.0)]
    assert [r["value"] for r in so.gold_column(rows(spark, ["1 2/3", "4 5/6"]), part=1).orderBy("line").collect()] == [3.0, 6.0]


def test_weak_outputs(spark, tmp_path):
    (tmp_path / "w").write_text("0\t1\t0.25\t0.75\t1\t0\t\n")
    got = so.weak_outputs(spark, str(tmp_path / "w"), 2)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 0, 0.25, 1, 0), (0, 1, 1, 0.75, 1, 0)]
    so.write_weak_outputs(got, str(tmp_path / "again"))
    assert sorted(map(tuple, so.weak_outputs(spark, str(tmp_path / "again"), 2).collect())) == sorted(map(tuple, got.collect()))


def test_web_formats(spark, tmp_path):
    (tmp_path / "f.csv").write_text("#c\n2,0.5,1\n")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted((r["id"], r["f"]) for r in so.feature_csv(spark, str(tmp_path / "f.csv"), ids, 2).collect()) == [(1, [0.0, 0.0]), (2, [0.5, 1.0])]
    (tmp_path / "l").write_text("1 spam\n2 undecided\n3 nonspam\n")
    assert sorted(map(tuple, so.labels(spark, str(tmp_path / "l")).collect())) == [(1, 1), (3, -1)]
    assert sorted(map(tuple, so.host_graph(rows(spark, ["5:2 7:1", ""])).collect())) == [(0, 5, 2), (0, 7, 1)]
    (tmp_path / "w").write_text("warc/0.9 1 response http://a.b/c 2\nhdr\n<html><p>x</p></html>\nwarc/0.9 1 http://d/ \n<HTML>y</HTML>\n")
    got = so.warc_pages(spark, str(tmp_path / "w")).collect()
    assert sorted(r["url"] for r in got) == ["http://a.b/c", "http://d/"]
    so.write_by_host(spark.createDataFrame([("http://a.b/c", "x")], "url string, html string"), str(tmp_path / "by"))
    assert (tmp_path / "by" / "host=a.b").is_dir()
    assert sorted(r["text"] for r in so.page_dump(rows(spark, ["a", "b", "===", "c"]), "===").collect()) == ["a\nb", "c"]


def test_articles_and_archives(spark, tmp_path):
    got = so.articles(rows(spark, ["t1", "t2", "AN X1", "u", "AN ZZ"]), {"X1": "J"}, ["J"])
    assert sorted((r["source"], r["text"]) for r in got.collect()) == [("J", "t1\nt2"), ("OT", "u")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "hello")
    assert [(r["name"], r["content"]) for r in so.documents_in(spark, str(tmp_path / "z.zip")).collect()] == [("a.txt", "hello")]
    (tmp_path / "n.xml").write_text("<r><newsitem date='2001-01-02'><headline>H</headline><text><p>a</p><p>b</p></text></newsitem></r>")
    assert [tuple(r) for r in so.news(spark, str(tmp_path / "n.xml")).collect()] == [("2001-01-02", "H", "a\nb")]


def test_parallel_formats(spark, tmp_path):
    got = so.parallel(rows(spark, ["a b", "c d e"]), rows(spark, ["x", "y"]), 2).collect()
    assert [(r["sid"], r["src"], r["trg"]) for r in got] == [(0, ["a", "b"], ["x"])]
    a = so.alignments(rows(spark, ["0-1 2-0", ""]))
    assert sorted(map(tuple, a.collect())) == [(0, 0, 1), (0, 2, 0)]
    assert [r["value"] for r in so.alignment_lines(a).collect()] == ["0-1 2-0"]
    (tmp_path / "g").write_text("A --> < x B ||| B y > 3\n")
    g = so.grammar(spark, str(tmp_path / "g"))
    assert [tuple(r) for r in g.collect()] == [("A", ["x", "B"], ["B", "y"], 3)]
    assert so.grammar_lines(g).first()["value"] == "A --> < x B ||| B y > 3"
    (tmp_path / "t").write_text("s t 0 1.0\n")
    assert [tuple(r) for r in so.translation_table(spark, str(tmp_path / "t")).collect()] == [("s", "t", 0.0)]


def test_models(spark, tmp_path):
    so.save(spark.range(3), str(tmp_path / "m"))
    assert so.load(spark, str(tmp_path / "m")).agg(F.sum("id")).first()[0] == 3
    (tmp_path / "p").write_text("1 0.5\n0 0.25\n")
    assert sorted(map(tuple, so.metric_pairs(spark, str(tmp_path / "p")).collect())) == [(0.0, 0.25), (1.0, 0.5)]
