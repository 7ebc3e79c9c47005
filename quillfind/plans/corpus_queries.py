"""Queries over the vocabulary, the replicated log, retrieval metrics and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfind.functions import dates as D
from quillfind.functions import text as X
from quillfind.functions import vectors as V
from quillfind.operators import metrics as M
from quillfind.operators import model
from quillfind.operators import replication as R
from quillfind.operators import search as S
from quillfind.operators import vocabulary as Y
from quillfind.plans.search_queries import SPACES, _bm25_sql


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _log(s, d):
    return _t(s, d, "sync_log")


def _old_vector(s, d):
    """What a node held that was last in touch in the middle of June."""
    return R.version_vector(_log(s, d).where("arrived < '2026-06-15'"))


def _questions(s, d):
    return _t(s, d, "selected_questions").select(F.substring("question_id", 5, 20).cast("long").alias("query_id"), F.col("question").alias("text"), F.col("expected_doc_ids").alias("ids"))


def _tenth(s, d):
    """Every question whose number is divisible by 10."""
    return _questions(s, d).where("query_id % 10 = 0")


def _run(s, d, questions):
    """The ten best documents of every question; one without a number can't be told from others."""
    return S.bm25_best(_t(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), questions.where("query_id IS NOT NULL").select("query_id", "text"), 10)


def _qrels(questions):
    return questions.select("query_id", F.explode("ids").alias("id"), F.lit(1).alias("grade"))


def _rounded(df, *cols):
    return df.select(*(F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns))


def _texts(s, d):
    t = F.col("text")
    return _t(s, d, "documents").select(
        "doc_id", X.truncate_chars(t, 40).alias("short"), X.preview(t, 80).alias("preview"), X.count_lines(t).alias("n_lines"), X.slice_lines(t, 2, 3).alias("lines_2_3"),
        X.normalize_spelling(F.col("locator")).alias("spelling"), X.essence(F.col("mimetype")).alias("essence"), X.is_textual(F.col("mimetype")).alias("textual"), X.strip_links(t).alias("unlinked"),
    )


def queries() -> dict:
    return {
        "term_mining": lambda s, d: Y.mined(_t(s, d, "documents")),
        "term_mining_band": lambda s, d: Y.band_of(_t(s, d, "documents")),
        "vocabulary_counts": lambda s, d: Y.counts(_t(s, d, "vocabulary_rows")),
        "vocabulary_matches": lambda s, d: Y.matches(_t(s, d, "documents"), _t(s, d, "clusters").select(F.col("label").alias("normalized")), every=True),
        "cluster_recount": lambda s, d: Y.recounted(_t(s, d, "vocabulary_rows")),
        "cluster_text": lambda s, d: Y.cluster_text(_t(s, d, "vocabulary_rows")),
        "clustering": lambda s, d: Y.clustered(*_terms(s, d)),
        "facet_planting": lambda s, d: Y.facets(_t(s, d, "documents"), _authors(s, d)),
        "display_spelling": lambda s, d: Y.display_spellings(_t(s, d, "documents")),
        "vocabulary_retract": lambda s, d: Y.retracted(_t(s, d, "vocabulary_rows"), _relations(s, d), _rare(s, d))[1],
        "mined_anchor_drop": lambda s, d: Y.without_mined_anchors(_relations(s, d), _t(s, d, "vocabulary_rows")),
        "log_compact": lambda s, d: R.compacted(_log(s, d)),
        "log_positions": lambda s, d: R.positions(_log(s, d)),
        "log_counts": lambda s, d: R.counts(_log(s, d)),
        "version_vector": lambda s, d: R.version_vector(_log(s, d)),
        "log_delta": lambda s, d: R.delta(_log(s, d), _old_vector(s, d)),
        "log_apply": lambda s, d: R.applied(_log(s, d)),
        "ndcg_map_recall": lambda s, d: _rounded(M.scored(_run(s, d, _tenth(s, d)), _qrels(_tenth(s, d))), "ndcg", "map", "recall", "precision"),
        "mrr_hit": lambda s, d: _rounded(M.retrieval(_run(s, d, _questions(s, d)), _questions(s, d).select("query_id", "ids")), "recall", "hit", "mrr"),
        "phase_percentiles": lambda s, d: M.phases(_t(s, d, "events"), "event_type", "value"),
        "text_functions": _texts,
        "strip_html": lambda s, d: _t(s, d, "documents").where("mimetype = 'text/html'").select("doc_id", X.strip_html(F.col("text")).alias("plain")),
        "shape_of": lambda s, d: _t(s, d, "vocabulary_rows").select(F.col("normalized").alias("token")).where("token IS NOT NULL").distinct().select("token", X.shape_of(F.col("token")).alias("shape")),
        "epoch_ymd": lambda s, d: _t(s, d, "documents").select("doc_id", D.epoch_to_ymd(F.unix_seconds("modified")).alias("day"), D.parse_ymd_epoch(F.date_format("modified", "yyyy-MM-dd")).alias("midnight"), D.parse_rfc3339_epoch(F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("seconds")),
        "hashed_embedding": lambda s, d: _t(s, d, "documents").where("text IS NOT NULL").select("doc_id", V.hashed_embedding(F.col("text"), 64).alias("vector")),
        "excerpts": lambda s, d: _t(s, d, "documents").where("length(text) > 0").select("doc_id", X.excerpts(F.col("text"), F.array(F.lit("museum"), F.lit("before")), 120, 60).alias("e")).select("doc_id", F.size("e").alias("n"), F.try_element_at("e", F.lit(1)).getField("start").alias("start"), F.try_element_at("e", F.lit(1)).getField("hits").alias("hits")),
    }


def _authors(s, d):
    """Who a mail is from, by its header."""
    sender = X.sender_name(F.regexp_extract("text", r"^From: ([^\r\n]*)", 1))
    return _t(s, d, "documents").where("mimetype LIKE 'message/rfc822%' AND text LIKE 'From: %'").select("doc_id", sender.alias("author"))


def _relations(s, d):
    return model.relations_of(_t(s, d, "fragments"), _t(s, d, "vocabulary_rows"))


def _rare(s, d):
    """Values of less than three fragments: below the band."""
    rows = _t(s, d, "vocabulary_rows").select(X.normalize_spelling(F.col("normalized")).alias("normalized"), "fragment").where("normalized <> ''").distinct()
    return rows.groupBy("normalized").agg(F.count("*").alias("n")).where("n < 3")


def _terms(s, d):
    rows = _t(s, d, "vocabulary_rows").select(X.normalize_spelling(F.col("normalized")).alias("term"), F.col("fragment").alias("source")).where("term <> ''").distinct()
    terms = rows.groupBy("term").agg(F.count("*").alias("df")).where("df >= 3")
    return terms, rows.join(terms.select("term"), "term", "left_semi")


def oracle_sql() -> dict[str, str]:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS)
    shape = f"""CASE WHEN NOT regexp_matches(token, '\\p{{L}}') OR lower(token) IN ({stop}) THEN NULL WHEN regexp_matches(token, '[\\p{{N}}_/]') THEN 'identifier'
  WHEN regexp_matches(token, '[.-]') OR regexp_matches(token, '^.+\\p{{Lu}}') THEN 'term' WHEN length(token) >= 4 THEN 'term' END"""
    tokens = """list_filter(list_transform(string_split_regex(text, '[\\s,;:!?()\\[\\]{}<>"“”|=+*&^%$#@~`\\\\]+'), lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda w: w <> '' AND length(w) <= 64)"""
    mined = f"""tok AS (SELECT doc_id AS id, unnest(list_distinct({tokens})) AS token FROM documents), shp AS (SELECT id, token, {shape} AS shape FROM tok),
 once AS (SELECT lower(token) AS term, id, min(shape) AS shape FROM shp WHERE shape IS NOT NULL GROUP BY 1, 2), mined AS (SELECT term, min(shape) AS shape, count(*) AS df FROM once GROUP BY term)"""
    rel = f"""val AS (SELECT DISTINCT fragment, lower(trim(regexp_replace(normalized, '{SPACES}', ' ', 'g'))) AS v FROM vocabulary_rows),
 rel AS (SELECT 's' || source AS src, 'contains' AS kind, 'f' || id AS dst FROM fragments WHERE source IS NOT NULL UNION ALL SELECT 'f' || fragment, 'mentions', 'v' || v FROM val WHERE length(v) > 0)"""
    acc = "acc AS (SELECT * FROM sync_log WHERE regexp_matches(origin, '\\S') AND regexp_matches(key, '\\S') AND epoch > 0 AND seq > 0)"
    old = "oldv AS (SELECT origin, epoch AS e, max(seq) AS s FROM acc WHERE arrived < '2026-06-15' AND (origin, epoch) IN (SELECT (origin, max(epoch)) FROM acc WHERE arrived < '2026-06-15' GROUP BY origin) GROUP BY 1, 2)"
    vals = f"vals AS (SELECT DISTINCT cluster_id, fragment, lower(trim(regexp_replace(normalized, '{SPACES}', ' ', 'g'))) AS v FROM vocabulary_rows WHERE cluster_id IS NOT NULL AND normalized IS NOT NULL)"

    def judged(where: str) -> str:
        """run and gold of the questions that `where` chooses."""
        asked = f"""asked AS (SELECT CAST(substring(question_id, 5) AS BIGINT) AS query_id, question AS text FROM selected_questions{where}),
 asked_tok AS (SELECT query_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM asked),
 asked_kept AS (SELECT query_id, CASE WHEN len(list_filter(ws, lambda x: x NOT IN ({stop}))) > 0 THEN list_filter(ws, lambda x: x NOT IN ({stop})) ELSE ws END AS ws FROM asked_tok),
 asked_terms AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(ws) AS term FROM asked_kept) GROUP BY query_id, term), docs AS (SELECT doc_id AS id, text FROM documents)"""
        run = f"{asked}, {_bm25_sql('b', 'docs')}, run AS MATERIALIZED (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10)"
        return f"{run}, gold AS MATERIALIZED (SELECT DISTINCT CAST(substring(question_id, 5) AS BIGINT) AS query_id, unnest(expected_doc_ids) AS id FROM selected_questions{where})"

    line = "CASE WHEN string_split(text, chr(10))[-1] = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END"
    flat = f"trim(regexp_replace(text, '{SPACES}', ' ', 'g'))"
    return {
        "term_mining": f"WITH {mined} SELECT term, shape, df FROM mined",
        "term_mining_band": f"WITH {mined}, n AS (SELECT count(*) AS n FROM documents WHERE length(trim(text, ' ')) > 0) SELECT term, shape || ':' || term AS key, df FROM mined, n WHERE df >= 3 AND df <= greatest(floor(n * 0.02), 50, 3)",
        "vocabulary_matches": f"""WITH t AS (SELECT doc_id, ' ' || lower(array_to_string({tokens}, ' ')) || ' ' AS t FROM documents WHERE text IS NOT NULL), l AS (SELECT DISTINCT lower(trim(label)) AS spelling FROM clusters WHERE length(trim(label)) > 0),
 f AS (SELECT spelling, doc_id FROM l, t WHERE contains(t, ' ' || spelling || ' '))
 SELECT spelling, count(*) AS df, list(doc_id ORDER BY doc_id) AS samples FROM f GROUP BY spelling""",
        "vocabulary_counts": "SELECT kind, count(*) AS n, count(cluster_id) AS clustered, count(gloss) AS glossed FROM vocabulary_rows GROUP BY kind",
        "cluster_recount": f"WITH {vals}, e AS (SELECT cluster_id, v, count(*) AS df, min(fragment) AS low FROM vals WHERE v <> '' GROUP BY 1, 2) SELECT cluster_id, count(*) AS members, CAST(sum(df) AS BIGINT) AS document_frequency, arg_min(v, struct_pack(a := -df, b := low, c := v)) AS label FROM e GROUP BY cluster_id",
        "facet_planting": f"""WITH p AS (SELECT doc_id, k, lower(trim(regexp_replace(v, '{SPACES}', ' ', 'g'))) AS v FROM (SELECT doc_id, 'lang' AS k, lang AS v FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'host', host FROM documents
   UNION ALL SELECT doc_id, 'author', CASE WHEN length(trim(regexp_extract(f, '^([^<]*)<[^>]*>', 1), ' ')) > 0 THEN regexp_replace(trim(regexp_extract(f, '^([^<]*)<[^>]*>', 1), ' '), '^"|"$', '', 'g') ELSE trim(regexp_replace(f, '[<>]', '', 'g'), ' ') END
     FROM (SELECT doc_id, regexp_extract(text, '^From: ([^\r\n]*)', 1) AS f FROM documents WHERE mimetype LIKE 'message/rfc822%' AND text LIKE 'From: %')))
 SELECT CASE k WHEN 'author' THEN 'entity:person:' || v ELSE 'facet:' || k || ':' || v END AS key, CASE k WHEN 'author' THEN 'authored' ELSE 'faceted' END AS relation, doc_id AS source FROM p WHERE v <> ''""",
        "display_spelling": f"""WITH {mined}, e AS (SELECT lower(token) AS term, token, shape, count(*) AS n FROM shp WHERE shape IS NOT NULL GROUP BY 1, 2, 3)
 SELECT term, token AS spelling FROM e QUALIFY row_number() OVER (PARTITION BY term ORDER BY shape, n DESC, token COLLATE "C") = 1""",
        "vocabulary_retract": f"""WITH {rel}, rare AS (SELECT 'v' || v AS id FROM val WHERE v <> '' GROUP BY v HAVING count(*) < 3) SELECT src, kind, dst FROM rel WHERE src NOT IN (SELECT id FROM rare) AND dst NOT IN (SELECT id FROM rare)""",
        "mined_anchor_drop": f"""WITH {rel}, m AS (SELECT 'v' || lower(trim(regexp_replace(normalized, '{SPACES}', ' ', 'g'))) AS id FROM vocabulary_rows WHERE normalized IS NOT NULL GROUP BY 1 HAVING bool_and(coalesce(origin = 'mined', false)))
 SELECT src, kind, dst FROM rel WHERE kind <> 'mentions' OR dst NOT IN (SELECT id FROM m)""",
        "hashed_embedding": """WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM documents WHERE text IS NOT NULL),
 fnv AS MATERIALIZED (SELECT t, list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(range(octet_length(encode(t))), lambda i: ('0x' || substr(hex(encode(t)), CAST(2 * i + 1 AS INTEGER), 2))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h FROM (SELECT DISTINCT t FROM tok)),
 c AS (SELECT doc_id, CAST(h % 64 AS INTEGER) AS dim, sum(CASE WHEN (h // 4294967296) % 2 = 1 THEN -1 ELSE 1 END) AS x FROM tok JOIN fnv USING (t) GROUP BY 1, 2),
 z AS (SELECT doc_id, CASE WHEN sum(x * x) > 0 THEN sqrt(sum(x * x)) ELSE 1 END AS size FROM c GROUP BY doc_id),
 g AS (SELECT doc_id, dim FROM documents, (SELECT unnest(generate_series(0, 63)) AS dim) WHERE text IS NOT NULL)
 SELECT doc_id, list(CAST(coalesce(x / size, 0) AS FLOAT) ORDER BY dim) AS vector FROM g LEFT JOIN c USING (doc_id, dim) LEFT JOIN z USING (doc_id) GROUP BY doc_id""",
        "strip_html": r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?is)<!--.*?-->', ' ', 'g') AS t FROM documents WHERE mimetype = 'text/html'),
 b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|blockquote|section|article|header|footer|pre|hr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
 c AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b),
 d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS t FROM c)
 SELECT doc_id, trim(regexp_replace(regexp_replace(t, '\n+', chr(10), 'g'), '^\n|\n$', '', 'g'), ' ') AS plain FROM d""",
        "cluster_text": f"""WITH r AS (SELECT cluster_id, fragment, gloss, lower(trim(regexp_replace(normalized, '{SPACES}', ' ', 'g'))) AS v FROM vocabulary_rows WHERE cluster_id IS NOT NULL AND normalized IS NOT NULL),
 e AS (SELECT cluster_id, v, count(DISTINCT fragment) AS df, max(gloss COLLATE "C") AS gloss FROM r WHERE v <> '' GROUP BY 1, 2),
 t AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY df DESC, v COLLATE "C") AS k FROM e)
 SELECT cluster_id, string_agg(CASE WHEN gloss IS NULL THEN v ELSE v || ': ' || gloss END, ', ' ORDER BY k) AS text FROM t WHERE k <= 64 GROUP BY cluster_id""",
        "log_compact": f"WITH {acc} SELECT origin, epoch, key, max(seq) AS seq FROM acc GROUP BY 1, 2, 3",
        "log_positions": f"WITH {acc} SELECT origin, epoch, max(seq) AS seq FROM acc GROUP BY 1, 2",
        "log_counts": f"WITH {acc} SELECT origin, count(*) AS n FROM acc GROUP BY 1",
        "version_vector": f"WITH {acc} SELECT origin, epoch, max(seq) AS seq FROM acc WHERE (origin, epoch) IN (SELECT (origin, max(epoch)) FROM acc GROUP BY origin) GROUP BY 1, 2",
        "log_delta": f"WITH {acc}, {old}, h AS (SELECT origin, epoch, key, max(seq) AS seq FROM acc WHERE (origin, epoch) IN (SELECT (origin, max(epoch)) FROM acc GROUP BY origin) GROUP BY 1, 2, 3) SELECT h.origin, epoch, seq, key FROM h LEFT JOIN oldv USING (origin) WHERE e IS NULL OR epoch > e OR (epoch = e AND seq > s)",
        "log_apply": """WITH t AS (SELECT *, coalesce(length(trim(origin)) > 0 AND length(trim(key)) > 0 AND epoch > 0 AND seq > 0, false) AS whole FROM sync_log),
 o AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY arrived NULLS FIRST, epoch NULLS FIRST, seq NULLS FIRST, key COLLATE "C" NULLS FIRST, coalesce(tombstone, false), coalesce(record, '') COLLATE "C") AS k FROM t),
 m AS (SELECT *, max(CASE WHEN whole THEN CAST(epoch AS HUGEINT) * 1000000000000 + seq END) OVER (PARTITION BY origin ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos FROM o)
 SELECT origin, count(*) FILTER (WHERE whole AND (pos IS NULL OR CAST(epoch AS HUGEINT) * 1000000000000 + seq > pos)) AS applied, count(*) FILTER (WHERE whole AND NOT (pos IS NULL OR CAST(epoch AS HUGEINT) * 1000000000000 + seq > pos)) AS skipped, count(*) FILTER (WHERE NOT whole) AS refused FROM m GROUP BY origin""",
        "ndcg_map_recall": f"""WITH {judged(' WHERE CAST(substring(question_id, 5) AS BIGINT) % 10 = 0')}, h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS found FROM run JOIN gold USING (query_id, id)),
 g AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg, sum(found / rank) AS ap, count(*) AS hits FROM h GROUP BY query_id),
 i AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN k <= 10 THEN 1 / log2(k + 1) END) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM gold) GROUP BY query_id)
 SELECT query_id, round(coalesce(dcg, 0) / idcg, 6) AS ndcg, round(coalesce(ap, 0) / least(relevant, 10), 6) AS map, round(coalesce(hits, 0) / relevant, 6) AS recall, round(coalesce(hits, 0) / 10, 6) AS precision FROM i LEFT JOIN g USING (query_id)""",
        "mrr_hit": f"""WITH {judged('')}, e AS (SELECT g.query_id, count(rank) AS hits, count(*) AS n, min(rank) AS first FROM gold g LEFT JOIN (SELECT * FROM run WHERE rank <= 8) r USING (query_id, id) GROUP BY g.query_id)
 SELECT round(avg(100.0 * hits / n), 6) AS recall, round(avg(CASE WHEN hits > 0 THEN 100.0 ELSE 0 END), 6) AS hit, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, count(*) AS queries FROM e""",
        "phase_percentiles": "SELECT event_type AS phase, count(*) AS n, median(value) AS median, list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS INT)] AS p95, max(value) AS most FROM events WHERE value IS NOT NULL GROUP BY 1",
        "text_functions": f"""SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE rtrim(substring(text, 1, 39), ' ') || '…' END AS short, CASE WHEN length({flat}) <= 80 THEN {flat} ELSE rtrim(substring({flat}, 1, 79), ' ') || '…' END AS preview,
 CAST(len({line}) AS INT) AS n_lines, CASE WHEN len({line}) >= 2 THEN array_to_string(list_transform(({line})[2:3], lambda x: regexp_replace(x, '\\r$', '')), chr(10)) END AS lines_2_3,
 lower(trim(regexp_replace(locator, '{SPACES}', ' ', 'g'))) AS spelling, lower(trim(string_split(mimetype, ';')[1])) AS essence, mimetype LIKE 'text/%' AS textual, regexp_replace(text, '\\[([^\\[\\]]*)\\]\\([^()\\s]*\\)', '\\1', 'g') AS unlinked FROM documents""",
        "shape_of": f"WITH t AS (SELECT DISTINCT normalized AS token FROM vocabulary_rows WHERE normalized IS NOT NULL) SELECT token, {shape} AS shape FROM t",
        "epoch_ymd": "SELECT doc_id, strftime(modified AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, CAST(epoch(date_trunc('day', modified AT TIME ZONE 'UTC')) AS BIGINT) AS midnight, CAST(floor(epoch(modified)) AS BIGINT) AS seconds FROM documents",
    }
