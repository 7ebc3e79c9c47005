"""Operators on small tables: ties, nulls, empty tables, and properties of fusion and walk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfind.operators import catalog, finder, graph, ladder, metrics, replication, search, transforms, vocabulary

SOURCES = "id long, host string, locator string, content_type string, modified long, observed long, raw_bytes long, indexed boolean, shape_stamp string, text string, source_type string, address string, digest string"


def sources(spark, rows):
    return spark.createDataFrame([(i, h, l, "text/plain", m, o, b, x, s, "t", "fs", f"disc://{h}/{l}", None) for i, h, l, m, o, b, x, s in rows], SOURCES)


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_dirty_and_upsert(spark):
    stored = sources(spark, [(1, "h", "a", 1, 1, 1, True, "s"), (2, "h", "b", 1, 1, 1, True, "s"), (3, "h", "c", None, 1, 1, True, "s"), (4, "h", "d", 1, 1, 1, True, None), (5, "h", "gone/x", 1, 1, 1, True, "s")])
    seen = sources(spark, [(1, "h", "a", 1, 2, 1, True, "s"), (2, "h", "b", 9, 2, 1, True, "s"), (3, "h", "c", None, 1, 1, True, "s"), (4, "h", "d", 1, 1, 1, True, "s"), (6, "h", "new", 5, 1, 1, True, "s")])
    assert rows_of(catalog.dirty(stored, seen)) == {("h", "a", "skip"), ("h", "b", "deep"), ("h", "c", "skip"), ("h", "d", "deep"), ("h", "new", "deep")}
    assert rows_of(catalog.dirty(stored, seen, cut_off=6, budget=1)) == {("h", "a", "skip"), ("h", "b", "deep"), ("h", "c", "skip"), ("h", "d", "catalog"), ("h", "new", "catalog")}
    assert rows_of(catalog.vanished(stored, seen)) == {("h", "gone/x")} and catalog.vanished(stored, seen, "gone/y").count() == 0
    up = {r["locator"]: (r["change"], r["modified"], r["indexed"]) for r in catalog.upsert(stored, seen).collect()}
    assert up == {"a": ("touched", 1, True), "b": ("updated", 9, False), "c": ("kept", None, True), "d": ("kept", 1, True), "gone/x": ("kept", 1, True), "new": ("new", 5, False)}
    remote = {r["locator"]: r["change"] for r in catalog.upsert(stored, seen, remote=True).collect()}
    assert remote["b"] == "kept" and remote["new"] == "new"
    # nothing changes the second time
    again = catalog.upsert(catalog.upsert(stored, seen).drop("change"), seen)
    assert {r["change"] for r in again.collect()} == {"kept"}


def test_folders_round_trip(spark):
    src = sources(spark, [(1, "h", "a/b/x.md", 1, 1, 1, True, "s"), (2, "h", "a/y.md", 1, 1, 1, True, "s"), (3, "h", "z.md", 1, 1, 1, False, None)])
    assert rows_of(catalog.folders_above(src)) == {("h", "a"), ("h", "a/b")}
    content = {r["folder"]: r["content"] for r in catalog.listings(src).collect()}
    assert content["a"].split("\n") == ["# a", "b\tinode/directory\t", "y.md\ttext/plain\tt"]
    parsed = rows_of(catalog.parse_listing(catalog.listings(src).select("host", "folder", "content")).select("folder", "name"))
    assert parsed == {("", "a"), ("", "z.md"), ("a", "b"), ("a", "y.md"), ("a/b", "x.md")}
    stored = catalog.listings(src).select("host", "folder", F.sha2("content", 256).alias("digest"))
    assert catalog.dirty_folders(stored, src).count() == 0
    assert rows_of(catalog.dirty_folders(stored.limit(0), src)) == {("h", "a"), ("h", "a/b")}
    assert rows_of(catalog.holding_folders(spark.createDataFrame([("h", "a"), ("h", "q")], "host string, folder string"), src)) == {("h", "a")}


def test_ignore_keyed_and_relink(spark):
    src = sources(spark, [(1, "h", "a/b/x.md", 1, 1, 1, True, "s"), (2, "h", "y.md", 1, 1, 1, True, "s")])
    assert rows_of(src.where(catalog.ignored([{"locator": "a/**"}])).select("id")) == {(1,)}
    assert src.where(catalog.ignored([{"digest": "*"}])).count() == 0 and src.where(catalog.ignored([])).count() == 0
    frag = spark.createDataFrame([(7, None, "disc://h/y.md"), (8, 1, None)], "id long, source long, content_address string")
    assert rows_of(catalog.relink(frag, src)) == {(7, "contains", 2)}
    voc = spark.createDataFrame([(9, "term", "Fox "), (3, "term", "fox"), (3, "alias", None)], "fragment long, kind string, normalized string")
    assert rows_of(catalog.keyed_first(voc)) == {("term:fox", 3, "term", "fox")}
    assert rows_of(catalog.get_or_create(spark.createDataFrame([("term:fox", 1)], "key string, fragment long"), voc)) == {("term:fox", 1, False)}
    assert rows_of(catalog.orphans(frag, voc)) == {(7,)}


def test_bm25_prefers_rare_terms_and_short_texts(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red fox and a long text about other things entirely"), (3, "red hen"), (4, None), (5, ""), (6, "red red red")], "id long, text string")
    q = spark.createDataFrame([(1, "the fox"), (2, "zzz"), (3, None)], "query_id long, text string")
    got = search.ranked(search.bm25(docs, q)).collect()
    assert [(r["query_id"], r["id"], r["rank"]) for r in got] == [(1, 1, 1), (1, 2, 2)]
    assert search.bm25(docs.limit(0), q).count() == 0 and search.bm25(docs, q.limit(0)).count() == 0
    ph = spark.createDataFrame([(1, "Red fox"), (2, "fox red"), (3, "red red")], "phrase_id long, text string")
    assert rows_of(search.phrase_search(docs, ph)) == {(1, 1), (1, 2), (3, 6)}


def test_fusion_bounds_and_collapse(spark):
    rng = random.Random(0)
    rows = [(1, c, i, r + 1) for c in ("a", "b") for r, i in enumerate(rng.sample(range(100), 20))]
    fused = search.fuse_plain(spark.createDataFrame(rows, "query_id long, channel string, id long, rank int")).collect()
    assert all(0 < r["score"] <= 2 / 61 + 1e-12 for r in fused) and len(fused) == len({r[2] for r in rows})
    res = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4)], "query_id long, source long, rank int")
    dig = spark.createDataFrame([(1, "x"), (2, None), (3, "x"), (4, None)], "id long, digest string")
    assert rows_of(search.collapse(res, dig)) == {(1, 1, 1, 1), (1, 2, 2, 0), (1, 4, 4, 0)}
    nodes = spark.createDataFrame([(1, "local", "p", 1), (1, "local", "q", 2), (2, "local", "p", 1), (2, "n1", "q", 1), (2, "n1", "p", 2), (2, "n2", "q", 3)], "query_id long, node string, address string, rank int")
    got = {(r["query_id"], r["rank"]): (r["address"], r["node"]) for r in search.merge_nodes(nodes, 5).collect()}
    assert got == {(1, 1): ("p", "local"), (1, 2): ("q", "local"), (2, 1): ("p", "local"), (2, 2): ("q", "n1")}


def random_graph(rng, spark):
    n = rng.randint(2, 20)
    edges = [(1, f"v{rng.randrange(n)}", "mentions", f"v{rng.randrange(n)}") for _ in range(rng.randint(0, 40))]
    seeds = [(1, f"v{i}", rng.choice("ab"), rng.uniform(0.01, 1)) for i in rng.sample(range(n), rng.randint(1, min(n, 9)))]
    return spark.createDataFrame(edges, "query_id long, src string, kind string, dst string"), spark.createDataFrame(seeds, "query_id long, id string, channel string, weight double"), seeds


def test_walk_is_a_distribution_with_a_floor(spark):
    rng = random.Random(4)
    for k in range(5):
        edges, seeds, raw = random_graph(rng, spark)
        g, total = graph.build(edges), sum(s[3] for s in raw)
        one = seeds.withColumn("channel", F.lit("x"))
        mass = {r["id"]: r["mass"] for r in graph.pagerank(g, one).collect()}
        assert abs(sum(mass.values()) - 1) < 1e-9
        assert all(mass[i] >= 0.5 * w / total - 1e-9 for _, i, _, w in raw)
        # what a channel loses comes back by its own restart only
        split = {(r["channel"], r["id"]): r["mass"] for r in graph.walked(g, seeds).collect()}
        assert sum(split.values()) <= 1 + 1e-9 and all(split[c, i] >= 0.5 * w / total - 1e-9 for _, i, c, w in raw)
        if k == 0:
            large = {(r["channel"], r["id"]): r["mass"] for r in graph.walked(g, seeds, slice_edges=0).collect()}
            assert all(abs(large.get(v, 0) - split.get(v, 0)) < 1e-9 for v in {*large, *split})


def test_hubs_and_degree(spark):
    rel = spark.createDataFrame([("h", "x", f"v{i}") for i in range(5)] + [("v0", "x", "v1"), ("v2", "x", "v2")], "src string, kind string, dst string")
    deg = {r["id"]: r["degree"] for r in graph.degrees(rel).collect()}
    assert deg["h"] == 5 and deg["v2"] == 3 and deg["v0"] == 2
    assert rows_of(graph.without_hubs(rel, 4)) == {("v0", "x", "v1"), ("v2", "x", "v2")}
    seeds = spark.createDataFrame([(1, "v0")], "query_id long, id string")
    assert {(r["src"], r["dst"], r["hop"]) for r in graph.neighbourhood(rel, seeds, 2, 4).collect()} == {("v0", "v1", 1)}
    near = {(r["src"], r["dst"], r["hop"]) for r in graph.neighbourhood(rel, seeds, 2, 99).collect()}
    assert ("h", "v0", 1) in near and ("h", "v4", 2) in near and ("v2", "v2", 2) not in near


def test_ledger_adds_up_to_the_score(spark):
    from quillfind.plans import search_queries as Q

    sf = "/root/testdata/sf0.01"

    lists = Q._lists(spark, sf)
    entries = finder.ledger(lists, Q._relations(spark, sf))
    rows = Q._rows(spark, sf)
    by_source = {(r["query_id"], r["source"]): r["s"] for r in finder.source_ledger(entries, rows).groupBy("query_id", "source").agg(F.sum(F.col("seed") + F.col("walked")).alias("s")).collect()}
    scores = entries.groupBy("query_id", "id").agg(F.sum(F.col("seed") + F.col("walked")).alias("score"))
    for r in search.source_scores(scores, rows).collect():
        assert abs(by_source[r["query_id"], r["source"]] - r["score"]) < 1e-9


def test_metrics_known_values(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1)], "query_id long, id string, rank int")
    qrels = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "y", 1), (3, "q", 0)], "query_id long, id string, grade int")
    got = {r["query_id"]: r for r in metrics.scored(run, qrels, 10).collect()}
    want = (2 / np.log2(3) + 1 / np.log2(4)) / (2 + 1 / np.log2(3))
    assert abs(got[1]["ndcg"] - want) < 1e-9 and abs(got[1]["map"] - (1 / 2 + 2 / 3) / 2) < 1e-9 and got[1]["recall"] == 1
    assert got[2]["ndcg"] == 0 and set(got) == {1, 2}
    gold = spark.createDataFrame([(1, ["b", "x"]), (2, ["z"]), (3, [])], "query_id long, ids array<string>")
    r = metrics.retrieval(run, gold).first()
    assert (r["recall"], r["hit"], r["mrr"], r["queries"]) == (75.0, 100.0, 0.75, 2)


def test_transforms():
    md = "intro line\n\n# One\ntext http://x.example/a.\n\n## Two\n```\n# no heading\n```\nmore\n\n# Three\nend"
    tree = transforms.plan("text/markdown", md)
    shape = [(p, q, m) for p, q, _, m, *_ in tree]
    assert shape[:6] == [(0, None, "text/markdown"), (1, 0, "text/markdown"), (2, 0, "text/markdown"), (3, 2, "text/uri-list"), (4, 2, "text/markdown"), (5, 0, "text/markdown")]
    assert tree[2][5:7] == (3, 11) and tree[4][5:7] == (6, 11) and tree[3][7] == "http://x.example/a"
    assert all(q is None or q < p for p, q, *_ in tree)
    assert transforms.plan("text/plain", None) == [(0, None, None, "text/plain", None, None, None, None)]
    assert len(transforms.plan("text/markdown", "\n".join(f"# h{i}" for i in range(900)))) == transforms.FRAGMENTS
    text = "\n".join(["x" * 99] * 15 + [""] + ["y" * 99] * 60)
    parts = transforms.chunks(text)
    assert all(len(t.encode()) <= transforms.HARD for _, _, t in parts)
    assert [t for _, _, t in transforms.chunks("a\n\nb", 2)] == ["a", "b"]
    assert parts[0][0] == 1 and parts[-1][1] == 76


def test_vocabulary_and_replication(spark):
    docs = spark.createDataFrame([(i, f"alpha museum v1.{i}" if i < 4 else "the museum and more") for i in range(60)] + [(99, None)], "doc_id long, text string")
    band = rows_of(vocabulary.band_of(docs))
    assert ("alpha", "term:alpha", 4) in band and not any(r[0] == "museum" for r in band)
    terms = spark.createDataFrame([("a", 3), ("b", 3), ("c", 3)], "term string, df int")
    sight = spark.createDataFrame([(t, s) for t, ss in (("a", (1, 2, 3)), ("b", (1, 2, 9)), ("c", (7, 8, 9))) for s in ss], "term string, source long")
    assert rows_of(vocabulary.clustered(terms, sight)) == {("a", 0), ("b", 0), ("c", 1)}
    log = spark.createDataFrame([("o", 1, 1, "k", False, None), ("o", 1, 3, "k", False, None), ("o", 1, 2, "l", False, None), ("o", 2, 1, "k", False, None), ("o", 2, 1, "k", False, None), (None, 1, 1, "k", None, None)], "origin string, epoch long, seq long, key string, tombstone boolean, record string")
    assert rows_of(replication.version_vector(log)) == {("o", 2, 1)}
    assert rows_of(replication.delta(log, replication.version_vector(log.limit(0)))) == {("o", 2, 1, "k")}
    timed = log.withColumn("arrived", F.col("epoch") * 10 + F.monotonically_increasing_id() * 0)
    assert {r["origin"]: tuple(r)[1:] for r in replication.applied(timed).collect()} == {"o": (4, 1, 0), None: (0, 0, 1)}


def test_ladder():
    assert ladder.clamp(0) == 1 and ladder.clamp(999) == 50
    c = finder.FinderConfig().overridden(["damping=0.25", "weights.prose=2"])
    assert c.damping == 0.25 and c.weights_prose == 2.0
    for bad in ("nope=1", "damping=2", "damping"):
        with pytest.raises(ValueError):
            finder.FinderConfig().overridden([bad])
    s = ladder.Session()
    assert s.retain(["a", "b"]) == {"a": 1, "b": 2} and s.retain(["b", "c"]) == {"b": 2, "c": 3}
    text = "one\ntwo\nthree\nfour"
    part, nxt, digest = s.window(text, 1, 8)
    assert part == "one\ntwo" and nxt == 3 and s.window(text, nxt, 99, digest)[:2] == ("three\nfour", 0)
    with pytest.raises(ValueError):
        s.window(text + "!", 1, 8, digest)
    s.bus.guards.append(lambda op, **_: "no" if op == "find" else None)
    with pytest.raises(PermissionError):
        s.act([lambda: "x"])


def test_index_upkeep(spark):
    from quillfind.operators import index

    rows = spark.createDataFrame([(1, 1, "content", "red fox"), (2, 1, "content", "red fox"), (3, 1, "summary", "hen"), (4, 1, "content", None)], "id long, source long, role string, text string")
    cache = spark.createDataFrame([(9, "x", "m", 4, [1.0, 0.0, 0.0, 0.0])], "id long, digest string, model string, dimensions int, vector array<float>").withColumn("digest", F.sha2(F.lit("hen"), 256))
    got = {r["id"]: (r["fresh"], len(r["vector"])) for r in index.embedded(rows, cache, "m", 4).collect()}
    assert got == {1: (True, 4), 2: (True, 4), 3: (False, 4)}
    assert {r["id"] for r in index.embedded(rows, cache, "m", 4, "summaries").collect()} == {3}
    assert index.stale_vectors(cache, "m", 4).count() == 0 and rows_of(index.stale_vectors(cache, "other", 4)) == {(9,)}
    hits, misses = index.cached(rows.select("id"), spark.createDataFrame([(1, "v")], "id long, out string"), ["id"])
    assert rows_of(hits) == {(1, "v")} and rows_of(misses) == {(2,), (3,), (4,)}
    clusters = spark.createDataFrame([(1, [1.0, 0.0], 5, 1), (2, [1.0, 0.01], 2, 1), (3, [0.0, 1.0], 9, 1), (4, None, 1, 1), (5, [1.0, 0.02], 2, 0)], "id long, vector array<float>, member_count int, changed_sweep long")
    assert rows_of(index.merges(clusters, 1)) == {(2, 1)}
    assert index.merges(clusters.limit(0), 1).count() == 0
    told = spark.createDataFrame([("a", "node:a", "node"), ("a", "node:b", "node"), ("a", "source:x", "source"), ("a", "k", None)], "origin string, key string, kind string")
    assert {(r["key"], r["allowed"]) for r in index.authorised(told).collect()} == {("node:a", True), ("node:b", False), ("source:x", True), ("k", True)}
    assert index.purged(told, spark.createDataFrame([("a",)], "node string"), "a").count() == 4 and index.purged(told, spark.createDataFrame([("a",)], "node string"), "b").count() == 0


def test_merges_of_more_than_ten_thousand_clusters(spark):
    """Each pair of twins is merged, in whatever block its two stand."""
    import numpy as np

    from quillfind.operators import index

    v = np.random.default_rng(4).standard_normal((5100, 32)).round(3)
    rows = [(i, v[i % 5100].tolist(), 1 + i // 5100, 1) for i in range(10200)]
    got = {tuple(r) for r in index.merges(spark.createDataFrame(rows, "id long, vector array<float>, member_count long, changed_sweep long"), 1).collect()}
    assert got == {(i, i + 5100) for i in range(5100)}


def test_remote_upsert_guards_our_own_rows(spark):
    fields = "host string, locator string, content_type string, modified long, observed long, raw_bytes long, indexed boolean"
    stored = spark.createDataFrame([("h", "ours", "t", 1, 1, 5, True, None), ("h", "theirs", "t", 1, 1, 5, True, "n2"), ("h", "kept", "t", 1, 1, 5, True, "n2")], fields + ", origin string")
    seen = spark.createDataFrame([("h", "ours", "t", 2, 2, 6, False), ("h", "theirs", "t", 2, 2, 6, False), ("h", "new", "t", 2, 2, 6, False)], fields)
    got = {r["locator"]: (r["change"], r["raw_bytes"], r["indexed"]) for r in catalog.upsert(stored, seen, remote=True).collect()}
    assert got == {"ours": ("kept", 5, True), "theirs": ("updated", 6, False), "kept": ("kept", 5, True), "new": ("new", 6, False)}
    assert {r["change"] for r in catalog.upsert(stored.drop("origin"), seen, remote=True).collect()} == {"kept", "new"}
    assert {r["locator"]: r["change"] for r in catalog.upsert(stored, seen).collect()}["ours"] == "updated"


def test_deletion_and_pages(spark):
    fragments = spark.createDataFrame([(1, 10, "text/plain", "a"), (2, 10, "text/plain", "b"), (3, 11, "text/plain", "c"), (4, None, "text/plain", "d"), (5, 11, "text/x-derived-summary", "e"), (6, 11, "text/plain", " ")], "id long, source long, mimetype string, text string")
    words = spark.createDataFrame([(1, "x"), (3, "x"), (4, "y")], "fragment long, normalized string")
    edges = spark.createDataFrame([("s10", "contains", "f1"), ("s11", "contains", "f3"), ("f1", "mentions", "vx"), ("f3", "mentions", "vx"), ("f3", "links-to", "f2")], "src string, kind string, dst string")
    left, rows, kept = catalog.deleted(spark.createDataFrame([(10,)], "id long"), fragments, words, edges)
    assert {r["id"] for r in left.collect()} == {3, 4, 5, 6} and {r["fragment"] for r in rows.collect()} == {3, 4}
    assert rows_of(kept) == {("s11", "contains", "f3"), ("f3", "mentions", "vx")}
    assert [r["id"] for r in catalog.content_page(fragments, 1, 1).collect()] == [2] and [r["id"] for r in catalog.content_page(fragments, 2, 9).collect()] == [3]
    raw = ladder.fetch_bytes(spark.createDataFrame([(1, "aé漢"), (2, "ab"), (3, None)], "id long, text string"), 2, 5).collect()
    assert [(r["id"], r["first"], r["end"], bytes(r["content"])) for r in raw] == [(1, 2, 5, "aé漢".encode()[2:5])]


def test_percentiles_over_bins(spark):
    rng = random.Random(1)
    values = [rng.choice([1.0, 2.0, 1e6]) if rng.random() < 0.4 else rng.uniform(0, 100) for _ in range(501)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)] * 4 + [(None, 1.0), ("c", None)], "p string, v double")
    got = {r["phase"]: (r["n"], r["median"], r["p95"], r["most"]) for r in metrics.phases(df, "p", "v").collect()}
    s = sorted(values)
    assert got == {"a": (501, s[250], s[int(-(-0.95 * 501 // 1)) - 1], s[-1]), "b": (4, 7.0, 7.0, 7.0), None: (1, 1.0, 1.0, 1.0)}
