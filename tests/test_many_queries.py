"""Many queries and phrases against many rows: the rows are not shuffled, and nothing is lost in blocks."""

import random

from quillfind.operators import search, vocabulary
from quillfind.plans import corpus_queries

WORDS = [f"w{i}" for i in range(12)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(rng, n, longest):
    return [(i, rng.choice(["", " ", ". "]).join([" ".join(rng.choices(WORDS, k=rng.randint(1, longest)))] * 2)) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "ẞ Über 1")]


def test_best_rows_equal_the_ranking_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "HELD", 64)
    monkeypatch.setattr(search, "PUT_OUT", 7)
    monkeypatch.setattr(search, "ASKED", 9)
    rng = random.Random(3)
    docs = spark.createDataFrame(texts(rng, 200, 9), "id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(rng.choices([*WORDS, "the", "zzz"], k=rng.randint(1, 5)))) for i in range(40)] + [(40, None), (41, "über über")], "query_id long, text string")
    for k in (1, 5, 1000):
        want = {(r["query_id"], r["id"], round(r["score"], 8), r["rank"]) for r in search.ranked(search.bm25(docs, asked), k).collect()}
        assert {(r["query_id"], r["id"], round(r["score"], 8), r["rank"]) for r in search.bm25_best(docs, asked, k).collect()} == want
    assert search.bm25_best(docs.limit(0), asked, 3).count() == 0 and search.bm25_best(docs, asked.limit(0), 3).count() == 0


def test_questions_that_share_terms_are_scored_once(spark, monkeypatch):
    rng = random.Random(8)
    docs = spark.createDataFrame(texts(rng, 200, 9), "id long, text string").repartition(3)
    said = [" ".join(rng.choices(WORDS, k=rng.randint(1, 7))) for _ in range(30)]
    asked = spark.createDataFrame([(100 - i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in enumerate(said * 3)], "query_id long, text string")
    want = {(r["query_id"], r["id"], round(r["score"], 8), r["rank"]) for r in search.ranked(search.bm25(docs, asked), 4).collect()}
    turns = []
    inner = search._in_turn
    monkeypatch.setattr(search, "_in_turn", lambda *a: turns.append(inner(*a)) or turns[-1])
    for dense, levels, first in ((0, 1, 10), (2, 2, 5), (16, 12, 20)):
        for name, value in (("DENSE", dense), ("LEVELS", levels), ("FIRST", first)):
            monkeypatch.setattr(search, name, value)
        assert {(r["query_id"], r["id"], round(r["score"], 8), r["rank"]) for r in search.bm25_best(docs, asked, 4).collect()} == want
    assert len(turns[0][0]) == 90 and len(turns[0][2]) <= 30 and turns[0][2].sum() > 0


def shuffled(spark):
    """Bytes that this application has written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_texts_of_few_files_are_not_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "HELD", 5000)
    rng = random.Random(6)
    other = lambda n: " ".join("%012x" % rng.getrandbits(48) for _ in range(n))
    docs = [(i, f"{other(60)} {' '.join(rng.choices(WORDS, k=rng.randint(0, 6)))}") for i in range(3000)] + [(3000, None), (3001, ""), (3002, "ẞ Über 1"), (3003, "zzz")]
    spark.createDataFrame(docs, "id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    rows = spark.read.parquet(str(tmp_path / "docs"))
    for terms in (WORDS, WORDS + [f"v{i}" for i in range(1 << 15)]):  # their numbers take two bytes or four
        asked = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=3))) for i in range(40)] + [(40, None), (41, "über über"), (42, " ".join(terms))], "query_id long, text string")
        before = shuffled(spark)
        got = {(r["query_id"], r["id"], round(r["score"], 8), r["rank"]) for r in search.bm25_best(rows, asked, 5).collect()}
        assert len(terms) > 1 << 15 or shuffled(spark) - before < sum(len(t or "") for _, t in docs) / 4
        assert got == {(r["query_id"], r["id"], round(r["score"], 8), r["rank"]) for r in search.ranked(search.bm25(rows, asked), 5).collect()}


def test_metrics_shuffle_no_pairs_of_a_question_and_a_document(spark, sf):
    for name in ("mrr_hit", "ndcg_map_recall"):
        text = plan(corpus_queries.queries()[name](spark, sf))
        assert "term#" not in text.replace("AS term", ""), name


def test_phrases_equal_brute_force_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(search, "PHRASES", 10)
    monkeypatch.setattr(search, "PUT_OUT", 5)
    rng = random.Random(4)
    rows = texts(rng, 120, 8)
    spoken = [(i, rng.choice([" ", "-"]).join(rng.choices(WORDS, k=rng.randint(1, 4)))) for i in range(60)] + [(60, None), (61, "..."), (62, "W1 w2"), (63, "w1, w2"), (64, "nowhere w1"), (65, "über")]
    got = search.phrase_search(spark.createDataFrame(rows, "id long, text string").repartition(3), spark.createDataFrame(spoken, "phrase_id long, text string"))
    import re

    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    flat = lambda t: f" {' '.join(tokens(t))} "
    want = [(p, i) for p, a in spoken for i, b in rows if tokens(a) and flat(a) in flat(b)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "hashpartitioning" not in plan(got)


def test_matches_equal_brute_force_and_bring_no_sightings_together(spark, monkeypatch):
    monkeypatch.setattr(search, "PHRASES", 10)
    monkeypatch.setattr(vocabulary, "KEPT", 50)
    monkeypatch.setattr(vocabulary, "SAMPLES", 6)
    rng = random.Random(5)
    rows = texts(rng, 150, 8)
    spoken = [" ".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(50)] + [None, "", " ", " W1  w2 ", "w1 w2", "nowhere w1", "über"]
    got = vocabulary.matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(w,) for w in spoken], "normalized string"))
    flat = lambda t: f" {' '.join(w.strip('.-') for w in (t or '').lower().split())} "
    want = {}
    for s in {" ".join(s.lower().split()) for s in spoken if s and s.strip()}:
        if ids := sorted(i for i, t in rows if f" {s} " in flat(t)):
            want[s] = (len(ids), ids[:6])
    assert {r["spelling"]: (r["df"], r["samples"]) for r in got.collect()} == want
    assert "Window" not in plan(got)  # a task would hold all sightings of a spelling
    assert vocabulary.matches(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "normalized string")).count() == 0


def test_mrr_hit_asks_every_question(spark, sf):
    got = corpus_queries.queries()["mrr_hit"](spark, sf).first()
    assert got["queries"] == spark.read.parquet(f"{sf}/selected_questions.parquet").where("size(expected_doc_ids) > 0").count()


def test_vocabulary_matches_keep_every_document_and_spellings_of_many_words(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vocabulary, "KEPT", 100)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(WORDS, k=9)) + (" eins zwei drei vier fünf. Sechs" if i % 3 == 0 else "")) for i in rng.sample(range(1000), 600)]
    labels = ["W1", "w2 w3", "Eins zwei drei vier fünf", "zwei drei vier fünf sechs", "eins zwei drei vier fünf sechs sieben", None, " "]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(w,) for w in labels], "label string").write.parquet(str(tmp_path / "clusters.parquet"))
    got = {r["spelling"]: (r["df"], r["samples"]) for r in corpus_queries.queries()["vocabulary_matches"](spark, str(tmp_path)).collect()}
    flat = lambda t: f" {t.lower().replace('.', '')} "
    found = {s: sorted(i for i, t in rows if f" {s} " in flat(t)) for s in (w.lower() for w in labels if w and w.strip())}
    assert got == {s: (len(ids), ids) for s, ids in found.items() if ids} and len(got["w1"][1]) > vocabulary.SAMPLES
