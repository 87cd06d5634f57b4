"""Releases: whole or not at all."""

import pytest

from cadastra.sinks import release


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "n long, json string")


def test_a_failure_leaves_the_release_before(spark, tmp_path):
    path = str(tmp_path / "out")
    assert release.released(spark, path) is None
    with release.Release(spark, path) as out:
        out.lines("a", lines(spark, '{"x":1}', '{"x":2}'), ["n"])
        out.texts("t", spark.createDataFrame([("b.txt", "two\nlines\n"), ("a.txt", ""), ("c é.txt", None), ("d.txt", "\n\nü\r\n")], "file string, text string"))
    first, version = release.released(spark, path), out.version
    assert first.endswith(version)
    errors = spark.createDataFrame([("warning",), ("error",)], "level string")
    with pytest.raises(release.Refused, match="1 error"):
        with release.Release(spark, path, errors) as out:
            out.lines("a", lines(spark, '{"x":3}'), ["n"])
    with pytest.raises(release.Refused, match="bytes"):
        with release.Release(spark, path, errors.where("level = 'warning'")) as out:
            out.lines("a", lines(spark, '{"x":3}'), ["n"], budget=3)
    with pytest.raises(release.Refused, match="two texts"):
        with release.Release(spark, path) as out:
            out.texts("t", spark.createDataFrame([("a", "1"), ("a", "2")], "file string, text string"))
    with pytest.raises(RuntimeError):
        with release.Release(spark, path) as out:
            out.lines("a", lines(spark, '{"x":3}'), ["n"])
            raise RuntimeError("stopped half way")
    assert release.released(spark, path) == first
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == sorted(["CURRENT", version])
    assert [r[0] for r in spark.read.text(f"{first}/a").collect()] == ['{"x":1}', '{"x":2}']
    back = {r.file: r.text for r in release.read_texts(spark, f"{first}/t").collect()}
    assert back == {"b.txt": "two\nlines\n", "a.txt": "", "c é.txt": "", "d.txt": "\n\nü\r\n"}


def test_the_same_content_is_the_same_version(spark, tmp_path):
    versions = []
    for rows in (lines(spark, "1", "2", "3").repartition(3), lines(spark, "1", "2", "3").coalesce(1), lines(spark, "1", "2")):
        with release.Release(spark, str(tmp_path)) as out:
            out.lines("a", rows, ["n"])
        versions.append(out.version)
        assert release.released(spark, str(tmp_path)).endswith(out.version)
    assert versions[0] == versions[1] != versions[2]


def test_a_text_is_one_file_of_its_name(spark, tmp_path):
    texts = spark.createDataFrame([("a.txt", "ä\n"), ("b/c%.txt", "two"), ("..", "")], "file string, text string")
    with release.Release(spark, str(tmp_path)) as out:
        out.texts("t", texts)
    first = release.released(spark, str(tmp_path))
    assert (tmp_path / out.version / "t" / "a.txt").read_bytes() == "ä\n".encode()
    assert len(list((tmp_path / out.version / "t").iterdir())) == 3
    assert sorted(map(tuple, release.read_texts(spark, f"{first}/t").collect())) == sorted(map(tuple, texts.collect()))
    assert out.parts["t"]["bytes"] == 6
    with pytest.raises(release.Refused, match="bytes"):
        with release.Release(spark, str(tmp_path)) as out:
            out.texts("t", texts, budget=5)
