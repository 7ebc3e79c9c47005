"""Connectors, sinks and streams on temporary folders."""

import json
import random

import pytest

from quillfind.operators import changefeed
from quillfind.sources import connectors, render, sinks
from quillfind.streaming import log_stream


def test_files(spark, tmp_path):
    for name, body in (("a.md", "# x"), ("sub/b.py", "1"), ("sub/deep/c.txt", "é"), (".hidden/x.md", "y"), ("empty.md", ""), ("out/skip.md", "z"), (".gitignore", "out/\n*.log\n"), ("sub/n.log", "l")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    got = {r["locator"]: (r["content_type"], r["raw_bytes"]) for r in connectors.enumerate_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("text/markdown", 3), "sub/b.py": ("text/plain", 1), "sub/deep/c.txt": ("text/plain", 2)}
    assert connectors.admitted(str(tmp_path / "sub"), [str(tmp_path)]).endswith("sub")
    for bad in ("/etc", f"{tmp_path}/../x"):
        with pytest.raises(ValueError):
            connectors.admitted(bad, [str(tmp_path)])


def test_paged_source(spark, tmp_path):
    (tmp_path / "0.json").write_text(json.dumps({"items": [{"id": 1}, {"id": 2}], "nextPageToken": "1.json"}))
    (tmp_path / "1.json").write_text(json.dumps({"items": [{"id": 3}]}))
    connectors.register(spark)
    read = lambda **o: sorted(json.loads(r["item"])["id"] for r in spark.read.format("paged").options(path=str(tmp_path), **o).load().collect())
    assert read() == [1, 2, 3] == read(pages_max=2, items_max=3)
    for bound in ({"pages_max": 1}, {"items_max": 2}):  # nothing is left out silently
        with pytest.raises(Exception, match="more"):
            read(**bound)


def test_nested_ignore_files(spark, tmp_path):
    for name, body in {
        ".gitignore": "*.log\n/top.txt\nbuild/\n!keep.log\ndocs/*.tmp\n", "sub/.gitignore": "!again.log\nb.txt\n# no rule\n\n", "a.log": "x", "keep.log": "x", "top.txt": "x", "sub/top.txt": "x", "sub/again.log": "x",
        "sub/deep/again.log": "x", "sub/b.txt": "x", "b.txt": "x", "build/keep.log": "x", "sub/build/x.txt": "x", "docs/a.tmp": "x", "docs/deep/a.tmp": "x", "c.md": "x",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    got = {r["locator"] for r in connectors.enumerate_files(spark, str(tmp_path), ["*.md"]).collect()}
    assert got == {"keep.log", "sub/top.txt", "sub/again.log", "sub/deep/again.log", "b.txt", "docs/deep/a.tmp"}
    assert {r["locator"] for r in connectors.enumerate_files(spark, f"file://{tmp_path}/sub").collect()} == {"top.txt", "again.log", "deep/again.log", "build/x.txt"}


def test_web_and_hosts():
    assert connectors.web_address("https://X.example/a?b") == ("web-x.example", "https/x.example/a?b")
    assert connectors.url_of("https/x.example/a?b") == "https://x.example/a?b" and connectors.web_address("ftp://x") is None
    assert connectors.public_host("*.x.example", "a.x.example") and not connectors.public_host("*.x.example", "x.example")
    assert connectors.public_address("8.8.8.8") and not connectors.public_address("10.0.0.1") and not connectors.public_address("127.0.0.1")


def test_render(spark):
    mail = spark.createDataFrame([(1, "Ann <a@x>", "b@x", "s", None, "", "<p>Hi</p>", None)], "id long, from string, to string, subject string, date string, plain string, html string, labels array<string>")
    r = render.mails(mail).first()
    assert r["text"] == "From: Ann <a@x>\nTo: b@x\nSubject: s\n\nHi" and r["author"] == "Ann" and r["labels"] == []
    event = spark.createDataFrame([(1, "E", None, None, "here", ["a", "b"], None, None), (2, "X", None, None, None, None, None, "cancelled")], "id long, summary string, start string, end string, location string, attendees array<string>, description string, status string")
    assert [tuple(x) for x in render.events(event).collect()] == [(1, "Event: E\nWhere: here\nAttendees: a, b")]
    files = spark.createDataFrame([(1, "d", "document", None), (2, "f", "form", None), (3, "p", None, "image/png")], "id long, name string, kind string, mimetype string")
    assert {tuple(x) for x in render.drive_files(files).collect()} == {(1, "d", "text/plain"), (3, "p", "image/png")}


def test_snapshots_and_runs(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        sinks.snapshot(spark, root, "t")
    assert sinks.publish({"t": spark.range(2)}, root) == 1 and sinks.publish({"t": spark.range(5)}, root) == 2
    (tmp_path / "store" / "v=3" / "t").mkdir(parents=True)  # a version that was never published
    assert sinks.snapshot(spark, root, "t").count() == 5 and sinks.snapshot(spark, root, "t", 1).count() == 2
    run = spark.createDataFrame([(1, 7, 1, 0.5)], "query_id long, id long, rank int, score double")
    sinks.write_run(run, str(tmp_path / "run"))
    assert [tuple(r) for r in sinks.read_run(spark, str(tmp_path / "run")).collect()] == [("1", "7", 1, 0.5)]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.choice([1, 2]), rng.randint(1, 40), f"k{rng.randint(0, 9)}", rng.random() < 0.3, None, None) for _ in range(300)]
    once = {}
    rows = [once.setdefault(r[:3], r) for r in rows]
    for i in range(3):
        spark.createDataFrame(rows[i::3], log_stream.LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    root = str(tmp_path / "state")
    log_stream.keep_state(log_stream.read_stream(spark, str(tmp_path / "log")), root).awaitTermination(120)
    got = {tuple(r) for r in log_stream.standing(sinks.snapshot(spark, root, "state")).collect()}
    want = {tuple(r) for r in changefeed.current_state(spark.read.parquet(str(tmp_path / "log"))).collect()}
    assert got == want and len(want) > 5 and sinks.versions(spark, root) == [2, 3]


def test_positions_in_state(spark, tmp_path):
    path = str(tmp_path / "log")
    for part in ([("a", 1, 1), ("a", 1, 3)], [("a", 1, 2), ("a", 2, 1), ("a", None, 1)]):
        spark.createDataFrame([(o, e, s, "k", False, None, None) for o, e, s in part], log_stream.LOG).coalesce(1).write.mode("append").parquet(path)
    q = log_stream.applied_stream(log_stream.read_stream(spark, path, 99)).writeStream.format("memory").queryName("taken").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    total = [sum(x) for x in zip(*[(r["applied"], r["skipped"], r["refused"]) for r in spark.table("taken").collect()])]
    assert total == [4, 0, 1] or total == [3, 1, 1]  # the two files come in either order within a batch


def test_watermark_in_state(spark, tmp_path):
    """Gaps are held until they are filled, over micro-batches that come one file at a time, as in the batch."""
    path, rng = str(tmp_path / "log"), random.Random(3)
    rows = [("a", 2, s, "k") for s in range(1, 60) if s not in (17, 41)] + [("a", 1, 99, "k"), ("b", 1, 2, "k"), ("b", 1, 0, "k"), ("b", 1, 1, " ")] * 2
    rng.shuffle(rows)
    for i in range(4):
        spark.createDataFrame([(*r, False, None, None) for r in rows[i::4]], log_stream.LOG).coalesce(1).write.mode("append").parquet(path)
    q = log_stream.committed_stream(log_stream.read_stream(spark, path, 1)).writeStream.format("memory").queryName("committed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    told = [(r["origin"], r["epoch"], r["watermark"], r["held"]) for r in spark.table("committed").collect()]
    want = {(r["origin"], r["epoch"], r["watermark"]) for r in changefeed.watermarks(spark.read.parquet(path)).collect()}
    assert want == {("a", 2, 16), ("b", 1, 0)} and max(t for t in told if t[0] == "a") == ("a", 2, 16, 2)
    assert all(b[2] >= a[2] for a, b in zip([t for t in told if t[:2] == ("a", 2)], [t for t in told if t[:2] == ("a", 2)][1:]))
