"""Queries over the full-text, vector and vocabulary indexes, the graph and the Finder.

The questions asked are those whose number is divisible by 50, against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfind.functions import text as X
from quillfind.functions import vectors as V
from quillfind.functions.session import cut
from quillfind.operators import finder, model
from quillfind.operators import graph as G
from quillfind.operators import search as S


#: Dimensions of the hashed embeddings.
DIMS = 256


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _asked(s, d, every=50):
    number = F.substring("question_id", 5, 20).cast("long")
    return _t(s, d, "selected_questions").where(number % every == 0).select(number.alias("query_id"), F.col("question").alias("text"))


def _spoken(s, d):
    """Sentences that name a value of the vocabulary, one for each fragment whose number is divisible by 50."""
    named = _t(s, d, "vocabulary_rows").where("fragment % 50 = 0 AND normalized IS NOT NULL").groupBy("fragment").agg(F.min("normalized").alias("v"))
    return named.select(F.col("fragment").alias("query_id"), F.concat(F.lit("where is "), "v", F.lit(" kept?")).alias("text"))


def _rows(s, d):
    return model.search_rows_of(_t(s, d, "fragments"))


def _documents(s, d):
    return _t(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _relations(s, d):
    return model.relations_of(_t(s, d, "fragments"), _t(s, d, "vocabulary_rows"))


def _vectors(s, d):
    return _t(s, d, "embedding_cache").select("id", "vector").union(_t(s, d, "clusters").select("id", "vector"))


def _query_vectors(s, d):
    return _t(s, d, "embedding_cache").where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def _embedded(df, text, *keep):
    """Hashed embeddings of a text, empty ones left out."""
    return df.where(F.length(text) > 0).select(*keep, V.hashed_embedding(F.col(text), DIMS).alias("vector"))


#: A query may weigh its lists otherwise, and walk less far.
OVERRIDES = ["weights.lexical=0.5", "weights.vector=0.25", "damping=0.3", "hops=1", "limit=5"]


def _seed_lists(s, d, asked):
    """All five lists: rows and questions by their hashed embeddings, clusters by those of their labels."""
    return finder.seed_lists(
        _rows(s, d), asked, _t(s, d, "vocabulary_rows"), _embedded(_rows(s, d), "text", "id"), _embedded(asked, "text", "query_id"), _embedded(_t(s, d, "clusters"), "label", "id")
    )


def _lists(s, d):
    return cut(_seed_lists(s, d, _asked(s, d)))  # read by several steps


def _seeds(s, d):
    """The ten best fragments of each question, as vertices."""
    best = S.ranked(S.bm25(_rows(s, d), _asked(s, d)), 10)
    return best.select("query_id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("id"), F.lit("prose").alias("channel"), (1.0 / (60 + F.col("rank"))).alias("weight"))


def _graph(s, d):
    return G.build(G.neighbourhood(_relations(s, d), _seeds(s, d), 2))


def _walk(s, d):
    """Graph and seeds, written once: the walk reads them several times."""
    seeds = cut(_seeds(s, d))
    return cut(G.build(G.neighbourhood(_relations(s, d), seeds, 2))), seeds


def _arrivals(s, d):
    graph, seeds = _walk(s, d)
    return G.arrivals(graph, G.pagerank(graph, seeds))


def _phrases(s, d):
    """Spellings of clusters, looked up as phrases in the documents."""
    return _t(s, d, "clusters").where("length(label) > 0").select(F.col("id").alias("phrase_id"), F.col("label").alias("text"))


def _rounded(df, *cols):
    return df.select(*(F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns))


def _nodes(s, d):
    """Two nodes that answer the questions: ours over the notes and mails, another over all documents."""
    docs = _t(s, d, "documents")
    ranked = lambda df, node: S.ranked(S.bm25(df.select(F.col("doc_id").alias("id"), "text"), _asked(s, d)), 20).select("query_id", F.lit(node).alias("node"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("address"), "rank")
    return ranked(docs.where("source IN ('fs', 'gmail')"), "local").union(ranked(docs, "far"))


def flagship(s, d):
    """The whole Finder over every question."""
    lists = cut(_seed_lists(s, d, _asked(s, d, 1)))
    return finder.discover(lists, _rows(s, d), model.sources_of(_t(s, d, "documents")), _relations(s, d))


def queries() -> dict:
    return {
        "tokenize": lambda s, d: _documents(s, d).select("id", F.array_join(X.words(F.col("text")), " ").alias("tokens")),
        "postings": lambda s, d: S.postings(_documents(s, d)),
        "bm25_topk": lambda s, d: _rounded(S.ranked(S.bm25(_documents(s, d), _asked(s, d)), S.SEEDS), "score"),
        "bm25_two_roles": lambda s, d: _rounded(S.by_role(_rows(s, d), _asked(s, d)), "score"),
        "phrase_search": lambda s, d: S.phrase_search(_documents(s, d), _phrases(s, d)),
        "exact_grounding": lambda s, d: S.exact_grounding(_spoken(s, d), _t(s, d, "vocabulary_rows")).select("query_id", "fragment", "normalized", "n", "document_frequency", "rank"),
        "vector_topk": lambda s, d: _rounded(S.nearest_rows(_query_vectors(s, d), _vectors(s, d), 10), "score").select("query_id", "id", "score"),
        "nearest_clusters": lambda s, d: _rounded(S.nearest_rows(_query_vectors(s, d), _t(s, d, "clusters"), 3, 0.55), "score").select("query_id", "id", "score"),
        "cluster_members": lambda s, d: S.cluster_members(S.nearest_rows(_query_vectors(s, d), _t(s, d, "clusters"), 3, 0.55), _t(s, d, "vocabulary_rows")),
        "rank_gate": lambda s, d: _lists(s, d).select("query_id", "channel", "id", "rank"),
        "rrf_fuse": lambda s, d: _rounded(S.fuse(_lists(s, d)), "score"),
        "source_score": lambda s, d: _rounded(S.source_scores(S.fuse(_lists(s, d)), _rows(s, d)), "score"),
        "source_hints": lambda s, d: S.hints(S.fuse(_lists(s, d)), _rows(s, d)),
        "digest_collapse": lambda s, d: S.collapse(S.ranked(S.bm25(_documents(s, d), _asked(s, d)), 20).select("query_id", F.col("id").alias("source"), "rank"), model.sources_of(_t(s, d, "documents"))),
        "crossnode_merge": lambda s, d: _rounded(S.merge_nodes(_nodes(s, d), 10), "score"),
        "finder_lean": lambda s, d: _rounded(finder.discover(_lists(s, d), _rows(s, d), model.sources_of(_t(s, d, "documents"))), "score", "share"),
        "finder_end_to_end": lambda s, d: _rounded(finder.discover(_lists(s, d), _rows(s, d), model.sources_of(_t(s, d, "documents")), _relations(s, d)), "score", "share"),
        "finder_overrides": lambda s, d: _rounded(finder.discover(_lists(s, d), _rows(s, d), model.sources_of(_t(s, d, "documents")), _relations(s, d), finder.FinderConfig().overridden(OVERRIDES)), "score", "share"),
        "finder_ledger": lambda s, d: _rounded(finder.source_ledger(finder.ledger(_lists(s, d), _relations(s, d)), _rows(s, d)), "seed", "walked"),
        "vertex_degree": lambda s, d: G.degrees(_relations(s, d)),
        "hub_list": lambda s, d: G.hubs(_relations(s, d), 100),
        "hub_bound": lambda s, d: G.without_hubs(_relations(s, d), 100),
        "edges_touching": lambda s, d: G.touching(_relations(s, d), _seeds(s, d)),
        "neighborhood_2hop": lambda s, d: G.neighbourhood(_relations(s, d), _seeds(s, d), 2),
        "graph_build": lambda s, d: _rounded(_graph(s, d), "weight"),
        "ppr_12_rounds": lambda s, d: _rounded(G.pagerank(*_walk(s, d)), "mass"),
        "walk_arrivals": lambda s, d: _rounded(_arrivals(s, d), "arrived"),
        "expand_sources": lambda s, d: G.expand(_relations(s, d), _t(s, d, "fragments"), model.sources_of(_t(s, d, "documents")).where("id % 50 = 0")),
    }


SPACES = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _bm25_sql(name: str, rows: str) -> str:
    """CTEs that score `rows` (id, text) for the asked terms, as {name}(query_id, id, score)."""
    return f"""{name}_tok AS MATERIALIZED (SELECT id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM {rows} WHERE text IS NOT NULL),
 {name}_len AS (SELECT id, len(ws) AS dl FROM {name}_tok WHERE len(ws) > 0), {name}_c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_len),
 {name}_p AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM {name}_tok) WHERE term IN (SELECT term FROM asked_terms) GROUP BY id, term),
 {name}_df AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
 {name}_w AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE {S.LEAST_IDF} END AS idf FROM {name}_df, {name}_c),
 {name} AS MATERIALIZED (SELECT query_id, p.id, sum(qtf * idf * (tf * {S.K1 + 1} / (tf + {S.K1} * ({1 - S.B} + {S.B} * dl / avgdl)))) AS score
   FROM {name}_p p JOIN {name}_len USING (id) JOIN {name}_w USING (term) JOIN asked_terms USING (term), {name}_c GROUP BY query_id, p.id)"""


def oracle_sql() -> dict[str, str]:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS)
    asked = f"""asked AS (SELECT CAST(substring(question_id, 5) AS BIGINT) AS query_id, question AS text FROM selected_questions WHERE CAST(substring(question_id, 5) AS BIGINT) % 50 = 0),
 asked_tok AS (SELECT query_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM asked),
 asked_kept AS (SELECT query_id, CASE WHEN len(list_filter(ws, lambda x: x NOT IN ({stop}))) > 0 THEN list_filter(ws, lambda x: x NOT IN ({stop})) ELSE ws END AS ws FROM asked_tok),
 asked_terms AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(ws) AS term FROM asked_kept) GROUP BY query_id, term)"""
    docs = "docs AS (SELECT doc_id AS id, text FROM documents)"
    rows = """rws AS MATERIALIZED (SELECT id, source, CASE WHEN mimetype LIKE 'text/x-derived-summary%' THEN 'summary' WHEN source IS NULL OR mimetype LIKE 'text/x-derived-%' THEN 'lexical' ELSE 'content' END AS role, text FROM fragments WHERE length(trim(text, ' ')) > 0),
 r_all AS (SELECT id, text FROM rws), r_prose AS (SELECT id, text FROM rws WHERE role = 'content'), r_lex AS (SELECT id, text FROM rws WHERE role = 'lexical')"""
    rank = lambda t: f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {t}"
    roles = f"""{_bm25_sql("bp", "r_prose")}, {_bm25_sql("bl", "r_lex")},
 roles AS MATERIALIZED (SELECT query_id, 'prose' AS channel, id, score, rank FROM ({rank("bp")}) WHERE rank <= 60 UNION ALL SELECT query_id, 'lexical', id, score, rank FROM ({rank("bl")}) WHERE rank <= 60)"""
    exact = f"""voc AS MATERIALIZED (SELECT DISTINCT fragment, lower(trim(regexp_replace(normalized, '{SPACES}', ' ', 'g'))) AS normalized FROM vocabulary_rows WHERE normalized IS NOT NULL),
 spelled AS (SELECT * FROM voc WHERE normalized <> ''), sdf AS (SELECT normalized, count(*) AS document_frequency FROM spelled GROUP BY normalized),
 spoken AS (SELECT query_id, string_split(lower(trim(regexp_replace(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_./''-]+', ' ', 'g'), '{SPACES}', ' ', 'g'))), ' ')[1:48] AS ws FROM asked),
 grams AS (SELECT DISTINCT query_id, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM spoken, (SELECT unnest([1, 2, 3, 4]) AS n), LATERAL unnest(generate_series(1, len(ws) - n + 1)) AS u(i)),
 g AS (SELECT * FROM grams WHERE n > 1 OR (gram NOT IN ({stop}) AND length(gram) > 1)),
 each AS (SELECT * FROM spelled QUALIFY row_number() OVER (PARTITION BY normalized ORDER BY fragment) <= 16),
 exact AS MATERIALIZED (SELECT query_id, fragment, e.normalized, n, document_frequency, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, document_frequency, fragment, e.normalized COLLATE "C") AS rank
   FROM g JOIN each e ON g.gram = e.normalized JOIN sdf USING (normalized))"""
    embedded = f"""said AS (SELECT 'r' AS side, id, text FROM rws UNION ALL SELECT 'q', query_id, text FROM asked UNION ALL SELECT 'c', id, label FROM clusters WHERE length(label) > 0),
 said_tok AS MATERIALIZED (SELECT side, id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS t FROM said),
 fnv AS MATERIALIZED (SELECT t, list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(range(octet_length(encode(t))), lambda i: ('0x' || substr(hex(encode(t)), CAST(2 * i + 1 AS INTEGER), 2))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h FROM (SELECT DISTINCT t FROM said_tok)),
 cells AS MATERIALIZED (SELECT side, id, CAST(h % {DIMS} AS INTEGER) AS dim, sum(CASE WHEN (h // 4294967296) % 2 = 1 THEN -1 ELSE 1 END) AS x FROM said_tok JOIN fnv USING (t) GROUP BY 1, 2, 3),
 sized AS (SELECT side, id, sqrt(sum(x * x)) AS size FROM cells GROUP BY side, id HAVING sum(x * x) > 0),
 unit AS MATERIALIZED (SELECT side, id, dim, CAST(CAST(x / size AS FLOAT) AS DOUBLE) AS x FROM cells JOIN sized USING (side, id)),
 long AS MATERIALIZED (SELECT side, id, sqrt(sum(x * x)) AS len FROM unit GROUP BY side, id),
 cosines AS MATERIALIZED (SELECT q.id AS query_id, r.side, r.id, round(sum(q.x * r.x) / any_value(lq.len) / any_value(lr.len), 9) AS score FROM unit q JOIN unit r USING (dim) JOIN long lq ON lq.side = 'q' AND lq.id = q.id JOIN long lr ON lr.side = r.side AND lr.id = r.id WHERE q.side = 'q' AND r.side <> 'q' GROUP BY q.id, r.side, r.id),
 by_vector AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cosines WHERE side = 'r' AND score >= 0.25),
 by_cluster AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cosines WHERE side = 'c' AND score >= 0.55),
 cdf AS (SELECT normalized, count(DISTINCT fragment) AS df FROM vocabulary_rows GROUP BY normalized),
 held AS (SELECT cluster_id AS id, fragment, min(df) AS df FROM vocabulary_rows JOIN cdf USING (normalized) WHERE cluster_id IS NOT NULL GROUP BY 1, 2),
 held_top AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, fragment) <= 128),
 of_cluster AS (SELECT query_id, fragment, min({{'c': rank, 'df': df}}) AS pl FROM by_cluster c JOIN held_top h USING (id) WHERE rank <= 3 GROUP BY query_id, fragment)"""
    lists = f"""{asked}, {rows}, {roles}, {exact}, {embedded},
 lists AS MATERIALIZED (SELECT query_id, channel, id, rank FROM roles UNION ALL SELECT query_id, 'exact', fragment, rank FROM exact WHERE rank <= 20 UNION ALL SELECT query_id, 'vector', id, rank FROM by_vector WHERE rank <= 60
   UNION ALL SELECT query_id, 'cluster', fragment, rank FROM (SELECT query_id, fragment, row_number() OVER (PARTITION BY query_id ORDER BY pl, fragment) AS rank FROM of_cluster) WHERE rank <= 5),
 shares AS MATERIALIZED (SELECT query_id, channel, id, CASE channel WHEN 'lexical' THEN 0.1 WHEN 'cluster' THEN 0.5 ELSE 1.0 END / (60 + rank) AS weight FROM (SELECT query_id, channel, id, min(rank) AS rank FROM lists GROUP BY ALL)),
 fused AS MATERIALIZED (SELECT query_id, id, sum(CASE channel WHEN 'lexical' THEN 0.1 WHEN 'cluster' THEN 0.5 ELSE 1.0 END / (60 + rank)) AS score FROM (SELECT query_id, channel, id, min(rank) AS rank FROM lists GROUP BY ALL) GROUP BY query_id, id)"""
    scored = """owned AS (SELECT query_id, source, f.id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, f.id) AS k FROM fused f JOIN rws USING (id) WHERE source IS NOT NULL),
 rolled AS MATERIALIZED (SELECT query_id, source, sum(score * [1.0, 0.1, 0.05][k]) AS score FROM owned WHERE k <= 3 GROUP BY query_id, source)"""
    vec = """vecs AS (SELECT id, vector FROM embedding_cache UNION ALL SELECT id, vector FROM clusters),
 good AS MATERIALIZED (SELECT id, CAST(vector AS DOUBLE[]) AS v FROM vecs WHERE len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
 qv AS (SELECT id AS query_id, v AS q FROM good WHERE id % 50 = 0 AND id IN (SELECT id FROM embedding_cache)),
 sims AS (SELECT query_id, id, list_cosine_similarity(q, v) AS score FROM qv JOIN good ON len(q) = len(v))"""
    near = f"{vec}, near AS (SELECT query_id, id, score FROM sims WHERE id IN (SELECT id FROM clusters) AND score >= 0.55 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 3)"
    rel = f"""val AS (SELECT DISTINCT fragment, lower(trim(regexp_replace(normalized, '{SPACES}', ' ', 'g'))) AS v FROM vocabulary_rows),
 rel AS MATERIALIZED (SELECT 's' || source AS src, 'contains' AS kind, 'f' || id AS dst FROM fragments WHERE source IS NOT NULL UNION ALL SELECT 'f' || fragment, 'mentions', 'v' || v FROM val WHERE length(v) > 0),
 deg AS MATERIALIZED (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM rel UNION ALL SELECT dst FROM rel) GROUP BY id),
 calm AS MATERIALIZED (SELECT * FROM rel WHERE src NOT IN (SELECT id FROM deg WHERE degree > {G.HUB}) AND dst NOT IN (SELECT id FROM deg WHERE degree > {G.HUB}))"""
    seeds = f"{asked}, {rows}, {_bm25_sql('ba', 'r_all')}, seeds AS MATERIALIZED (SELECT query_id, 'f' || id AS id, 1.0 / (60 + rank) AS weight FROM ({rank('ba')}) WHERE rank <= 10)"
    around = f"""{rel}, both_ends AS (SELECT src AS id, * FROM calm UNION ALL SELECT dst, * FROM calm),
 h1 AS MATERIALIZED (SELECT DISTINCT query_id, src, kind, dst FROM seeds JOIN both_ends USING (id)),
 f2 AS (SELECT query_id, src AS id FROM h1 UNION SELECT query_id, dst FROM h1 EXCEPT SELECT query_id, id FROM seeds),
 h2 AS (SELECT DISTINCT query_id, src, kind, dst FROM f2 JOIN both_ends USING (id)),
 hood AS MATERIALIZED (SELECT query_id, src, kind, dst, min(hop) AS hop FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL)"""
    hood = f"{seeds}, {around}"
    knit = """half AS (SELECT query_id, src, dst, CASE kind WHEN 'contains' THEN 1.0 ELSE 0.5 END AS weight FROM hood WHERE src <> dst),
 graph AS MATERIALIZED (SELECT query_id, src, dst, sum(weight) AS weight FROM (SELECT * FROM half UNION ALL SELECT query_id, dst, src, weight FROM half) GROUP BY query_id, src, dst),
 outw AS MATERIALIZED (SELECT query_id, src, sum(weight) AS o FROM graph GROUP BY query_id, src), sh AS MATERIALIZED (SELECT query_id, src, dst, weight / o AS w FROM graph JOIN outw USING (query_id, src))"""
    graph = f"{hood}, {knit}"
    rounds = """tot AS (SELECT query_id, sum(weight) AS t FROM starts GROUP BY query_id), r AS MATERIALIZED (SELECT query_id, channel, id, sum(weight / t) AS r FROM starts JOIN tot USING (query_id) GROUP BY ALL),
 p0 AS (SELECT query_id, channel, id, r AS mass FROM r)"""
    for k in range(1, 13):
        rounds += f""", l{k} AS MATERIALIZED (SELECT query_id, channel, sum(mass) AS lost FROM p{k - 1} p WHERE NOT EXISTS (SELECT 1 FROM outw o WHERE o.query_id = p.query_id AND o.src = p.id) GROUP BY query_id, channel),
 p{k} AS MATERIALIZED (SELECT query_id, channel, id, sum(mass) AS mass FROM (SELECT query_id, channel, dst AS id, 0.5 * mass * w AS mass FROM p{k - 1} p JOIN sh USING (query_id) WHERE p.id = sh.src UNION ALL SELECT query_id, channel, id, 0.5 * r * coalesce(lost, 0) + 0.5 * r FROM r LEFT JOIN l{k} USING (query_id, channel)) GROUP BY query_id, channel, id)"""
    ppr = f"{graph}, starts AS (SELECT query_id, 'prose' AS channel, id, weight FROM seeds), {rounds}"
    digest = "dig AS (SELECT doc_id AS source, coalesce(sha256(text), 'source:' || doc_id) AS g FROM documents)"
    ranked = f"""{digest}, fin AS (SELECT query_id, source, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, source) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM rolled),
 ten AS (SELECT * FROM fin WHERE rank <= 10), fold AS (SELECT query_id, coalesce(g, 'source:' || source) AS g2, min(rank) AS rank, count(*) - 1 AS copies FROM ten LEFT JOIN dig USING (source) GROUP BY 1, 2)"""
    final = f"{lists}, {scored}, {ranked}"
    told = "SELECT t.query_id, t.source, round(t.score, 6) AS score, round(CASE WHEN top > 0 THEN t.score / top ELSE 1.0 END, 6) AS share, t.rank, copies FROM ten t JOIN fold f ON f.query_id = t.query_id AND f.rank = t.rank"
    ledger = f"""{lists}, starts AS MATERIALIZED (SELECT query_id, channel, 'f' || id AS id, weight FROM shares), seeds AS (SELECT DISTINCT query_id, id FROM starts), {around}, {knit}, {rounds},
 entries AS MATERIALIZED (SELECT query_id, id, channel, coalesce(s.weight, 0) AS seed, coalesce(w.mass, 0) AS walked FROM shares s FULL JOIN (SELECT query_id, channel, CAST(substring(id, 2) AS BIGINT) AS id, mass FROM p12 WHERE id LIKE 'f%') w USING (query_id, id, channel)),
 sums AS MATERIALIZED (SELECT query_id, id, sum(seed + walked) AS score FROM entries GROUP BY query_id, id)"""
    walked = scored.replace("FROM fused f", "FROM sums f")
    far = f"""{asked}, {docs}, own AS (SELECT doc_id AS id, text FROM documents WHERE source IN ('fs', 'gmail')), {_bm25_sql('bo', 'own')}, {_bm25_sql('bd', 'docs')},
 nl AS (SELECT query_id, 'local' AS node, 'a' || id AS address, rank FROM ({rank('bo')}) WHERE rank <= 20 UNION ALL SELECT query_id, 'far', 'a' || id, rank FROM ({rank('bd')}) WHERE rank <= 20),
 sc AS (SELECT query_id, address, sum(1.0 / (60 + rank)) AS score, arg_min(node, CASE node WHEN 'local' THEN 0 ELSE 1000 + rank END) AS node FROM nl GROUP BY query_id, address)"""
    return {
        "tokenize": "SELECT doc_id AS id, array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') AS tokens FROM documents",
        "postings": "SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY id, term",
        "bm25_topk": f"WITH {asked}, {docs}, {_bm25_sql('b', 'docs')} SELECT query_id, id, round(score, 6) AS score, rank FROM ({rank('b')}) WHERE rank <= 60",
        "bm25_two_roles": f"WITH {asked}, {rows}, {roles} SELECT query_id, channel, id, round(score, 6) AS score, rank FROM roles",
        "phrase_search": """WITH ph AS (SELECT id AS phrase_id, ' ' || array_to_string(list_filter(string_split_regex(lower(label), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS p FROM clusters WHERE length(label) > 0),
 t AS (SELECT doc_id AS id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL)
 SELECT phrase_id, id FROM ph, t WHERE contains(t, p) AND length(trim(p)) > 0""",
        "exact_grounding": f"WITH asked AS (SELECT fragment AS query_id, 'where is ' || min(normalized COLLATE \"C\") || ' kept?' AS text FROM vocabulary_rows WHERE fragment % 50 = 0 AND normalized IS NOT NULL GROUP BY fragment), {exact} SELECT query_id, fragment, normalized, n, document_frequency, rank FROM exact",
        "vector_topk": f"WITH {vec} SELECT query_id, id, round(score, 6) AS score FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10",
        "nearest_clusters": f"WITH {near} SELECT query_id, id, round(score, 6) AS score FROM near",
        "cluster_members": f"""WITH {near}, vdf AS (SELECT normalized, count(DISTINCT fragment) AS df FROM vocabulary_rows GROUP BY normalized),
 placed AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS c FROM near),
 h AS (SELECT cluster_id AS id, fragment, min(df) AS df FROM vocabulary_rows JOIN vdf USING (normalized) WHERE cluster_id IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY min(df), fragment) <= 128),
 m AS (SELECT query_id, fragment, min({{'c': c, 'df': df}}) AS pl FROM placed JOIN h USING (id) GROUP BY 1, 2)
 SELECT query_id, fragment, row_number() OVER (PARTITION BY query_id ORDER BY pl, fragment) AS rank FROM m""",
        "rank_gate": f"WITH {lists} SELECT query_id, channel, id, rank FROM lists",
        "rrf_fuse": f"WITH {lists} SELECT query_id, id, round(score, 6) AS score FROM fused",
        "source_score": f"WITH {lists}, {scored} SELECT query_id, source, round(score, 6) AS score FROM rolled",
        "source_hints": f"""WITH {lists}, h AS (SELECT query_id, source, f.id, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, f.id) AS rank FROM fused f JOIN rws USING (id) WHERE role = 'content' AND source IS NOT NULL)
 SELECT query_id, source, id, rank FROM h WHERE rank <= 3""",
        "digest_collapse": f"""WITH {asked}, {docs}, {_bm25_sql('b', 'docs')}, {digest}, t AS (SELECT query_id, id AS source, rank FROM ({rank('b')}) WHERE rank <= 20)
 SELECT query_id, arg_min(source, rank) AS source, min(rank) AS rank, count(*) - 1 AS copies FROM t JOIN dig USING (source) GROUP BY query_id, g""",
        "crossnode_merge": f"WITH {far} SELECT query_id, address, round(score, 6) AS score, node, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, address) AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, address) <= 10",
        "finder_lean": f"WITH {final} {told}",
        "finder_end_to_end": f"WITH {ledger}, {walked}, {ranked} {told}",
        "finder_overrides": (f"WITH {ledger}, {walked}, {ranked} {told}".replace("WHEN 'lexical' THEN 0.1 WHEN 'cluster' THEN 0.5 ELSE", "WHEN 'lexical' THEN 0.5 WHEN 'vector' THEN 0.25 WHEN 'cluster' THEN 0.5 ELSE").replace("0.5 * mass * w", "0.3 * mass * w").replace("0.5 * r * coalesce(lost, 0) + 0.5 * r", "0.3 * r * coalesce(lost, 0) + 0.7 * r")
          .replace("UNION ALL SELECT *, 2 FROM h2)", ")").replace("WHERE rank <= 10)", "WHERE rank <= 5)")),
        "finder_ledger": f"WITH {ledger}, {walked} SELECT query_id, source, channel, round(sum(seed * [1.0, 0.1, 0.05][k]), 6) AS seed, round(sum(walked * [1.0, 0.1, 0.05][k]), 6) AS walked FROM entries JOIN owned o USING (query_id, id) WHERE k <= 3 GROUP BY query_id, source, channel",
        "vertex_degree": f"WITH {rel} SELECT id, degree FROM deg",
        "hub_list": f"WITH {rel} SELECT id, degree FROM deg WHERE degree > 100",
        "hub_bound": f"WITH {rel} SELECT src, kind, dst FROM rel WHERE src NOT IN (SELECT id FROM deg WHERE degree > 100) AND dst NOT IN (SELECT id FROM deg WHERE degree > 100)",
        "edges_touching": f"WITH {seeds}, {rel} SELECT DISTINCT src, kind, dst FROM rel WHERE src IN (SELECT id FROM seeds) OR dst IN (SELECT id FROM seeds)",
        "neighborhood_2hop": f"WITH {hood} SELECT query_id, src, kind, dst, hop FROM hood",
        "graph_build": f"WITH {graph} SELECT query_id, src, dst, round(weight, 6) AS weight FROM graph",
        "ppr_12_rounds": f"WITH {ppr} SELECT query_id, id, round(mass, 6) AS mass FROM p12",
        "walk_arrivals": f"WITH {ppr} SELECT g.query_id, g.src, g.dst, round(0.5 * mass * w, 6) AS arrived FROM sh g JOIN p12 p ON p.query_id = g.query_id AND p.id = g.src",
        "expand_sources": f"""WITH {rel}, o AS (SELECT 'f' || id AS v, source FROM fragments WHERE source IS NOT NULL), n AS (SELECT src, source, kind, dst FROM calm JOIN o ON src = v)
 SELECT DISTINCT a.source, a.src AS fragment, b.src AS neighbour, a.kind, b.source AS neighbour_source FROM n a JOIN n b ON a.kind = b.kind AND a.dst = b.dst AND a.source <> b.source WHERE a.source % 50 = 0 AND a.source IN (SELECT doc_id FROM documents)""",
    }
