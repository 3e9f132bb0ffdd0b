"""Files, word tables and profiles."""

from quizloom.operators import geometry
from quizloom.sources import readers


def test_intake_routes_and_rejects(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1. Q?")
    (tmp_path / "b.html").write_text("<p>x</p>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.md").write_bytes(b"\xff\xfe\x00")
    rows = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["body"], r["reject"]) for r in readers.intake(spark, str(tmp_path)).collect()}
    assert rows["a.txt"] == ("text", "1. Q?", None) and rows["b.html"][0] == "page"
    assert rows["c.pdf"][2] == "unsupported file type" and rows["d.md"][2] == "not UTF-8"


def test_word_tables_keep_quotes(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "w.tsv").write_text(head + '5\t1\t1\t1\t1\t1\t0\t0\t9\t10\t96\tHello\n5\t1\t1\t1\t1\t2\t20\t0\t9\t12\t96\t"world\n5\t1\t1\t1\t2\t1\t0\t40\t9\t10\t90\tSecond\n5\t1\t1\t1\t2\t2\t9\t40\t9\t10\t5\tnoise\n')
    rows = geometry.text_lines(readers.word_table(spark, f"{tmp_path}/w.tsv")).orderBy("line_no").collect()
    assert [(r["text"], r["size"]) for r in rows] == [('Hello "world', 11.0), ("Second", 10.0)]


def test_profiles_fail_closed(spark, tmp_path):
    for k, (text, want) in enumerate([('{"capabilities": ["a", "b"]}', ["a", "b"]), ('{"capabilities": "not-a-list"}', ["mcq.single"]), ("{}", ["mcq.single"]), ("not json", ["mcq.single"]), ("", ["mcq.single"])]):
        (tmp_path / f"p{k}.json").write_text(text)
        assert readers.capabilities(spark, f"{tmp_path}/p{k}.json") == want
    assert readers.capabilities(spark, None) == ["mcq.single"]


def test_size_clusters_and_roles(spark):
    sizes = [49.0] * 5 + [29.0] * 9 + [62.0] * 1
    rows = spark.createDataFrame([(1, s) for s in sizes] + [(2, 20.0), (2, 20.0)], "doc_id long, size double")
    got = {r["doc_id"]: (r["question_size"], r["choice_size"]) for r in geometry.role_sizes(rows).collect()}
    assert got == {1: (49.0, 29.0), 2: (20.0, 20.0)}
