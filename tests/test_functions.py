"""Scalar functions on known values and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from quillfind.functions import dates, extract, text, vectors


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", type(None): "string"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'array<float>')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


def test_truncate_and_preview(spark):
    c = F.col("t")
    assert one(spark, text.truncate_chars(c, 5), t="abcde") == "abcde"
    assert one(spark, text.truncate_chars(c, 5), t="abc  fgh") == "abc…"
    assert one(spark, text.preview(c, 9), t=" a \n b  ") == "a b"
    assert one(spark, text.truncate_chars(c, 5), t=None) is None


@pytest.mark.parametrize(("t", "n"), [("a\nb\nc\nd\n", 4), ("a\r\nb", 2), ("a\n\nb", 3), ("é\n漢", 2), ("a", 1)])
def test_lines(spark, t, n):
    assert one(spark, text.count_lines(F.col("t")), t=t) == n


def test_slice_lines(spark):
    cut = lambda a, b, t="a\r\nb\nc\n": one(spark, text.slice_lines(F.col("t"), a, b), t=t)
    assert cut(1, 2) == "a\nb" and cut(2, 99) == "b\nc" and cut(3, 3) == "c"
    assert cut(0, 1) is None and cut(2, 1) is None and cut(4, 5) is None


def test_html_links_and_senders(spark):
    html = "<html><style>x{}</style><p>Tom &amp; <b>Ann</b></p><script>1<2</script><div>two&nbsp;  words</div></html>"
    assert one(spark, text.strip_html(F.col("t")), t=html) == "Tom & Ann\ntwo words"
    assert one(spark, text.strip_links(F.col("t")), t="see [the page](http://x/y) now") == "see the page now"
    assert one(spark, text.sender_name(F.col("t")), t='"Ann Lee" <a@x>') == "Ann Lee"
    assert one(spark, text.sender_name(F.col("t")), t="<a@x>") == "a@x"


def test_types_and_globs(spark):
    assert one(spark, text.parameter(F.col("t"), "variant"), t="text/x; a=1; Variant=note") == "note"
    assert one(spark, text.detect_type(F.col("t")), t="a/b.MD") == "text/markdown"
    assert one(spark, text.detect_type(F.col("t")), t="a/b.rs") == "text/plain"
    assert one(spark, text.detect_type(F.col("t")), t="README") == "application/octet-stream"
    for glob, path, hits, misses in (("a/*.md", True, ["a/x.md"], ["a/b/x.md"]), ("**/x.md", True, ["x.md", "a/b/x.md"], ["ax.md"]), ("a/**", True, ["a/b/c"], ["b/a"]), ("t*c", False, ["t/c"], ["tcx"])):
        for t in hits + misses:
            assert one(spark, F.col("t").rlike(text.glob_regex(glob, path)), t=t) is (t in hits), (glob, t)
    assert text.patterns_overlap("text/*", "text/plain") and not text.patterns_overlap("text/a", "text/b")
    assert one(spark, text.base64url(F.col("t")), t="-_-_") == one(spark, F.unbase64(F.col("t")), t="+/+/")
    assert bytes(one(spark, text.base64url(F.col("t")), t="aGk")) == b"hi"


def test_tokens_and_shapes(spark):
    assert one(spark, text.vocabulary_tokens(F.col("t")), t="The (user-id) v1.2, don't: a_b/c.") == ["The", "user-id", "v1.2", "don't", "a_b/c"]
    for t, want in (("the", None), ("12", None), ("v1.2", "identifier"), ("a_b", "identifier"), ("user-id", "term"), ("iPhone", "term"), ("museum", "term"), ("cat", None)):
        assert one(spark, text.shape_of(F.col("t")), t=t) == want, t
    assert one(spark, text.strip_stopwords(F.col("t")), t="the and of") == ["the", "and", "of"]
    assert one(spark, text.strip_stopwords(F.col("t")), t="the red fox") == ["red", "fox"]
    assert one(spark, text.json_part(F.col("t")), t='so: [1, {"a": 2}] ok') == '[1, {"a": 2}]'


def test_excerpts(spark):
    found = one(spark, text.excerpts(F.col("t"), F.array(F.lit("fox"), F.lit("hen")), 10, 5, 2), t="a fox......................hen fox.....")
    assert [(e["hits"], e["start"]) for e in found] == [(2, 25), (1, 0)]
    assert one(spark, text.excerpts(F.col("t"), F.array(F.lit("zzz"))), t="nothing") == []


def test_dates(spark):
    ymd = lambda t: one(spark, dates.parse_ymd_epoch(F.col("t")), t=t)
    assert ymd("1970-01-02") == 86400 and ymd("2024-02-31") == ymd("2024-03-02")
    assert all(ymd(t) is None for t in ("2024-13-01", "2024-00-10", "2024-01-32", "24-01-01", "x", "2024-01-01x"))
    rfc = lambda t: one(spark, dates.parse_rfc3339_epoch(F.col("t")), t=t)
    assert rfc("1970-01-01T01:00:00.9+01:00") == 0 and rfc("1970-01-01T00:00:01Z") == 1 and rfc("1970-01-02") == 86400
    assert rfc("1970-01-01T00:00:01") is None and rfc("nonsense") is None
    assert one(spark, dates.epoch_to_ymd(F.col("n")), n=-1) == "1969-12-31"


def test_vectors(spark):
    cos = lambda a, b: one(spark, vectors.cosine(F.col("a"), F.col("b")), a=a, b=b)
    assert abs(cos([1.0, 0.0], [1.0, 1.0]) - math.sqrt(0.5)) < 1e-9 and cos([0.0, 0.0], [1.0, 1.0]) == 0.0 and cos([1.0], [1.0, 2.0]) is None
    assert vectors.fnv1a(b"") == 0xCBF29CE484222325 and vectors.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    v = one(spark, vectors.hashed_embedding(F.col("t"), 16), t="Red fox red")
    assert abs(sum(x * x for x in v) - 1) < 1e-6
    assert one(spark, vectors.unpack(vectors.pack(F.col("a"))), a=[1.5, -2.0]) == [1.5, -2.0]
    assert one(spark, vectors.quantized(F.col("a")), a=[0.5, -1.0]) == [64, -127]


def test_extractive_kernels():
    t = "# Head\n\nThe red fox jumps. The red fox sleeps at noon. Nobody saw it.\n\n## Next\n\nA hen walks by the river. " + "More words follow here. " * 30
    told, how = extract.summary(t, 120)
    assert how == "extractive" and len(told) <= 121 and told.startswith("Head: ")
    assert extract.summary("Short text.", 120) == ("Short text.", "verbatim") and extract.summary(None)[1] == "empty"
    assert "red fox" in extract.keywords(t) and "red" not in extract.keywords(t)
    assert extract.keywords(None) == [] and extract.select("", 10) == ""
    assert extract.title_and_body("A title\n\nBody here.") == ("A title", "Body here.")


def test_written_tables_are_forgotten(spark):
    import os

    from quillfind.functions import session

    session.forget(spark)
    df = session.written(spark.range(3), "three")
    assert df.count() == 3
    path = session._WRITTEN[spark.sparkContext.applicationId][0].removeprefix("file://")
    assert os.path.isdir(path) and session.forget(spark) == 1 and not os.path.exists(path) and session.forget(spark) == 0


def test_selection_covers_sections_and_prefers_the_new():
    fox = "The red fox met the red hen near the old barn."
    text = f"{fox} {fox[:-1]} again.\nA word more.\n\nOnly owls live in that tower, owls and mice.\n\n" + "Rain fell over the hills for many days. " * 8
    got = extract.select(text, 150)
    assert got == "The red fox met the red hen near the old barn again. A word more.\nOnly owls live in that tower, owls and mice.\nRain fell over the hills for many days."
    assert sum(map(len, got.split("\n"))) <= 150 and extract.select("x" * 30, 10) == "x" * 9 + "…"
    assert extract.sections("# A\n\nOne. Two.\n\nThree.\n# B\nFour.") == [["One.", "Two.", "Three."], ["Four."]]
    assert extract.sections("One. Two.\n\nThree.\n```\ncode\n```\nFour.") == [["One.", "Two."], ["Three.", "Four."]]
    assert extract.units("Risk of prostate cancer, cancer cancer 12") == ["risk", "prostate", "prostate cancer", "cancer", "cancer", "cancer"]


def test_small_tables_in_few_files_are_spread(spark, tmp_path):
    from quillfind.functions.session import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "four"))
    one, four = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "four"))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 100
    assert spread(four) is four and spread(one, most=10) is one and spread(df := spark.range(5)) is df
