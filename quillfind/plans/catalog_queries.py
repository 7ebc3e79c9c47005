"""Queries over the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfind.functions import text as X
from quillfind.operators import catalog as C
from quillfind.operators import model

#: The catalogue as it stood: what was observed up to this time is stored, what was observed after it is seen.
SPLIT = "2026-06-15 00:00:00"

RULES = [{"locator": "steward/**"}, {"source_type": "calendar", "content_type": "text/pl*"}, {"locator": "**/weekly-*.md"}]


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _sources(s, d):
    return model.sources_of(_t(s, d, "documents"))


def _relations(s, d):
    return model.relations_of(_t(s, d, "fragments"), _t(s, d, "vocabulary_rows"))


def _states(s, d):
    """Stored and seen: the newest source of each address on either side of the split."""
    src = _sources(s, d).where("host IS NOT NULL")
    at = F.unix_seconds(F.lit(SPLIT).cast("timestamp"))
    order = [F.desc("observed"), F.desc("id")]
    return C.latest(src.where(F.col("observed") <= at), ["host", "locator"], order), C.latest(src.where(F.col("observed") > at), ["host", "locator"], order)


def _stored_origins(s, d):
    """The stored states, where those of calendars and tasks came from other nodes."""
    stored, seen = _states(s, d)
    return stored.withColumn("origin", F.when(F.col("source_type").isin("gcalendar", "gtasks", "calendar", "tasks", "web"), F.col("source_type"))), seen


def _entries(s, d):
    """The entries of all folders, with the address each refers to."""
    kids = C.children(_sources(s, d)).where("NOT is_folder AND folder <> ''").select("host", "folder", "name").distinct()
    path = F.concat_ws("/", "host", "folder", "name")
    return kids.select(path.alias("id"), F.concat(F.lit("disc://"), path).alias("content_address"))


def _seen_all(s, d):
    src = _sources(s, d).where("host IS NOT NULL")
    return C.latest(src, ["host", "locator"], [F.desc("observed"), F.desc("id")])


def queries() -> dict:
    return {
        "catalog_listing": lambda s, d: C.listing(_sources(s, d)),
        "catalog_pending": lambda s, d: C.listing(_sources(s, d), state="pending"),
        "catalog_page": lambda s, d: C.page(_sources(s, d).select("id", "address"), ["id"], 50, 20),
        "catalog_counts": lambda s, d: C.counts(_sources(s, d)),
        "store_stats": lambda s, d: C.statistics(_sources(s, d), _t(s, d, "fragments"), _relations(s, d)),
        "type_histogram": lambda s, d: C.type_histogram(_t(s, d, "fragments")),
        "fragment_referencing": lambda s, d: C.referencing(_t(s, d, "fragments")),
        "folder_synthesis": lambda s, d: C.folders_above(_sources(s, d)),
        "folder_children": lambda s, d: C.children(_sources(s, d)).select("host", "folder", "name", "is_folder", "essence"),
        "folder_listing": lambda s, d: C.listings(_sources(s, d)).select("host", "folder", "n", F.sha2("content", 256).alias("digest")),
        "listing_parse": lambda s, d: C.parse_listing(C.listings(_sources(s, d)).select("host", "folder", "content")).groupBy("host", "folder").agg(F.count("*").alias("n")),
        "envelope_filter": lambda s, d: C.envelope_filter(_sources(s, d), source_type="fs", after=1775000000, before=1785000000).select("id", "host", "modified"),
        "facet_filter": lambda s, d: C.facet_filter(_t(s, d, "vocabulary_rows"), _t(s, d, "fragments"), ["archiveñ0"]),
        "ignore_rules": lambda s, d: _sources(s, d).where(C.ignored(RULES)).select("id", "locator"),
        "dirty_sources": lambda s, d: C.dirty(_states(s, d)[0], _seen_all(s, d), cut_off=1772000000),
        "vanished_sources": lambda s, d: C.vanished(*_states(s, d)),
        "source_upsert": lambda s, d: C.upsert(*_states(s, d)),
        "source_upsert_remote": lambda s, d: C.upsert(*_stored_origins(s, d), remote=True),
        "index_report": lambda s, d: C.report(C.dirty(_states(s, d)[0], _seen_all(s, d), cut_off=1772000000)),
        "keyset_page": lambda s, d: C.content_page(_t(s, d, "fragments"), 100, 200),
        "keyed_get_or_create": lambda s, d: C.keyed_first(_t(s, d, "vocabulary_rows")),
        "orphan_keyed_gc": lambda s, d: C.orphans(_t(s, d, "fragments"), _t(s, d, "vocabulary_rows")),
        "source_delete": lambda s, d: C.deleted(_sources(s, d).where("source_type = 'web'"), _t(s, d, "fragments"), _t(s, d, "vocabulary_rows"), _relations(s, d))[2],
        "folder_relink": lambda s, d: C.relink(_entries(s, d), _sources(s, d)),
        "cache_insert_ignore": lambda s, d: C.insert_ignore(_t(s, d, "clusters").select(F.col("text_digest").alias("digest")), _t(s, d, "embedding_cache").select("digest", "id"), ["digest"]),
        "detect_types": lambda s, d: _t(s, d, "documents").select("doc_id", X.detect_type(F.col("locator")).alias("detected")),
        "host_ids": lambda s, d: _t(s, d, "documents").select("doc_id", X.host_id(F.col("source"), F.coalesce("host", F.lit(""))).alias("derived")),
    }


def oracle_sql() -> dict[str, str]:
    src = """src AS (SELECT doc_id AS id, host, locator, 'disc://' || host || '/' || locator AS address, source AS source_type, mimetype AS content_type, lang,
  CAST(floor(epoch(modified)) AS BIGINT) AS modified, CAST(floor(epoch(observed)) AS BIGINT) AS observed, sha256(text) AS digest,
  coalesce(octet_length(encode(text)), 0) AS raw_bytes, text IS NOT NULL AS indexed,
  CASE WHEN length(trim(text)) > 0 THEN sha256(coalesce(mimetype, '')) END AS shape_stamp, text FROM documents)"""
    rel = """value AS (SELECT DISTINCT fragment, lower(trim(regexp_replace(normalized, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))) AS v, kind FROM vocabulary_rows)"""
    folders = """pre AS (SELECT DISTINCT host, array_to_string(string_split(locator, '/')[1:n], '/') AS folder FROM src, LATERAL unnest(generate_series(1, len(string_split(locator, '/')) - 1)) AS u(n) WHERE locator LIKE '%/%'),
 folders AS (SELECT host, folder FROM pre WHERE folder <> '')"""
    kids = """kids AS (SELECT host, regexp_replace(locator, '/?[^/]*$', '') AS folder, regexp_extract(locator, '([^/]*)$', 1) AS name, false AS is_folder, lower(trim(string_split(content_type, ';')[1])) AS essence,
   trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS flat FROM src
  UNION ALL SELECT host, regexp_replace(folder, '/?[^/]*$', ''), regexp_extract(folder, '([^/]*)$', 1), true, 'inode/directory', NULL FROM folders)"""
    states = f"""{src}, s AS (SELECT * FROM src WHERE host IS NOT NULL),
 stored AS (SELECT * FROM s WHERE observed <= epoch(TIMESTAMP '{SPLIT}') QUALIFY row_number() OVER (PARTITION BY host, locator ORDER BY observed DESC, id DESC) = 1),
 seen AS (SELECT * FROM s WHERE observed > epoch(TIMESTAMP '{SPLIT}') QUALIFY row_number() OVER (PARTITION BY host, locator ORDER BY observed DESC, id DESC) = 1),
 seen_all AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY host, locator ORDER BY observed DESC, id DESC) = 1)"""
    extensions = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in X.EXTENSIONS.items())
    code = ", ".join(f"'{e}'" for e in X.CODE)
    decided = """SELECT n.host, n.locator, CASE WHEN o.id IS NOT NULL AND o.indexed AND n.modified IS NOT DISTINCT FROM o.modified AND n.raw_bytes = o.raw_bytes AND o.shape_stamp IS NOT NULL AND o.shape_stamp = n.shape_stamp THEN 'skip'
  WHEN n.modified < 1772000000 THEN 'catalog' ELSE 'deep' END AS decision FROM seen_all n LEFT JOIN stored o USING (host, locator)"""
    return {
        "catalog_listing": f"WITH {src} SELECT id, host, locator, address, content_type, modified FROM src",
        "catalog_pending": f"WITH {src} SELECT id, host, locator, address, content_type, modified FROM src WHERE NOT indexed",
        "catalog_page": f"WITH {src} SELECT id, address FROM src ORDER BY id LIMIT 50 OFFSET 20",
        "catalog_counts": f"WITH {src} SELECT count(*) AS sources, count(*) FILTER (WHERE indexed) AS indexed, count(*) FILTER (WHERE NOT indexed) AS pending FROM src",
        "store_stats": f"""WITH {src}, {rel} SELECT (SELECT count(*) FROM src) AS sources, (SELECT count(*) FROM src WHERE indexed AND shape_stamp IS NOT NULL) AS deep_indexed,
 (SELECT CAST(sum(raw_bytes) AS BIGINT) FROM src) AS raw_bytes, (SELECT count(*) FROM fragments) AS fragments, (SELECT count(*) FROM fragments WHERE source IS NULL) AS keyed_fragments,
 (SELECT count(*) FROM fragments WHERE source IS NOT NULL) + (SELECT count(*) FROM (SELECT DISTINCT fragment, v FROM value WHERE length(v) > 0)) AS relations""",
        "type_histogram": "SELECT lower(trim(string_split(mimetype, ';')[1])) AS essence, count(*) AS n FROM fragments GROUP BY 1",
        "fragment_referencing": "SELECT content_address, min(id) AS id FROM fragments WHERE content_address IS NOT NULL GROUP BY 1",
        "folder_synthesis": f"WITH {src}, {folders} SELECT host, folder FROM folders",
        "folder_children": f"WITH {src}, {folders}, {kids} SELECT host, folder, name, is_folder, essence FROM kids",
        "folder_listing": f"""WITH {src}, {folders}, {kids}, e AS (SELECT host, folder, name, is_folder, name || chr(9) || coalesce(essence, '') || chr(9) || coalesce(CASE WHEN length(flat) <= 80 THEN flat ELSE rtrim(substring(flat, 1, 79)) || '…' END, '') AS line FROM kids),
 r AS (SELECT *, row_number() OVER (PARTITION BY host, folder ORDER BY NOT is_folder, name COLLATE "C", line COLLATE "C") AS k FROM e)
 SELECT host, folder, count(*) AS n, sha256('# ' || folder || chr(10) || string_agg(line, chr(10) ORDER BY k)) AS digest FROM r WHERE k <= 2000 GROUP BY host, folder""",
        "listing_parse": f"WITH {src}, {folders}, {kids} SELECT host, folder, least(count(*), 2000) AS n FROM kids WHERE name <> '' GROUP BY host, folder",
        "envelope_filter": f"WITH {src} SELECT id, host, modified FROM src WHERE source_type = 'fs' AND modified BETWEEN 1775000000 AND 1785000000",
        "facet_filter": f"WITH {rel} SELECT DISTINCT f.source FROM value v JOIN fragments f ON f.id = v.fragment WHERE v.kind IN ('facet', 'entity') AND v.v = 'archiveñ0' AND f.source IS NOT NULL",
        "ignore_rules": f"WITH {src} SELECT id, locator FROM src WHERE locator LIKE 'steward/%' OR (source_type = 'calendar' AND content_type LIKE 'text/pl%') OR regexp_full_match(locator, '(.*/)?weekly-[^/]*\\.md')",
        "dirty_sources": f"WITH {states} {decided}",
        "index_report": f"WITH {states}, dec AS ({decided}) SELECT host, count(*) AS seen, count(*) FILTER (WHERE decision = 'skip') AS skipped, count(*) FILTER (WHERE decision = 'catalog') AS catalogued, count(*) FILTER (WHERE decision = 'deep') AS deep FROM dec GROUP BY host",
        "keyset_page": "SELECT id, source, text FROM fragments WHERE id > 100 AND source IS NOT NULL AND length(trim(text, ' ')) > 0 AND coalesce(mimetype NOT LIKE 'text/x-derived-%', true) ORDER BY id LIMIT 200",
        "vanished_sources": f"WITH {states} SELECT host, locator FROM stored ANTI JOIN seen USING (host, locator)",
        "source_upsert": f"""WITH {states}, b AS (SELECT host, locator, n.id AS nid, o.id AS oid, n.content_type AS nc, o.content_type AS oc, n.modified AS nm, o.modified AS om, n.raw_bytes AS nb, o.raw_bytes AS ob, n.observed AS nv, o.observed AS ov, o.indexed AS oi FROM seen n FULL JOIN stored o USING (host, locator)),
 c AS (SELECT *, CASE WHEN nid IS NULL THEN 'kept' WHEN oid IS NULL THEN 'new' WHEN NOT (nc IS NOT DISTINCT FROM oc AND nm IS NOT DISTINCT FROM om AND nb IS NOT DISTINCT FROM ob) THEN 'updated' WHEN nv IS NOT DISTINCT FROM ov THEN 'kept' ELSE 'touched' END AS change FROM b)
 SELECT host, locator, CASE WHEN change = 'kept' THEN oc ELSE nc END AS content_type, CASE WHEN change = 'kept' THEN om ELSE nm END AS modified, CASE WHEN change = 'kept' THEN ob ELSE nb END AS raw_bytes,
  CASE WHEN change = 'kept' THEN ov ELSE nv END AS observed, CASE WHEN change IN ('new', 'updated') THEN false ELSE oi END AS indexed, change FROM c""",
        "source_upsert_remote": f"""WITH {states}, b AS (SELECT host, locator, n.id AS nid, o.id AS oid, n.content_type AS nc, o.content_type AS oc, n.modified AS nm, o.modified AS om, n.raw_bytes AS nb, o.raw_bytes AS ob, n.observed AS nv, o.observed AS ov, o.indexed AS oi, CASE WHEN o.source_type IN ('gcalendar', 'gtasks', 'calendar', 'tasks', 'web') THEN o.source_type END AS og FROM seen n FULL JOIN stored o USING (host, locator)),
 c AS (SELECT *, CASE WHEN nid IS NULL OR (oid IS NOT NULL AND og IS NULL) THEN 'kept' WHEN oid IS NULL THEN 'new' WHEN NOT (nc IS NOT DISTINCT FROM oc AND nm IS NOT DISTINCT FROM om AND nb IS NOT DISTINCT FROM ob) THEN 'updated' WHEN nv IS NOT DISTINCT FROM ov THEN 'kept' ELSE 'touched' END AS change FROM b)
 SELECT host, locator, CASE WHEN change = 'kept' THEN oc ELSE nc END AS content_type, CASE WHEN change = 'kept' THEN om ELSE nm END AS modified, CASE WHEN change = 'kept' THEN ob ELSE nb END AS raw_bytes,
  CASE WHEN change = 'kept' THEN ov ELSE nv END AS observed, CASE WHEN change IN ('new', 'updated') THEN false ELSE oi END AS indexed, change FROM c""",
        "keyed_get_or_create": f"WITH {rel} SELECT kind || ':' || v AS key, min(fragment) AS fragment, kind, v AS normalized FROM value WHERE length(v) > 0 GROUP BY kind, v",
        "orphan_keyed_gc": "SELECT id FROM fragments WHERE source IS NULL AND id NOT IN (SELECT fragment FROM vocabulary_rows WHERE fragment IS NOT NULL)",
        "source_delete": f"""WITH {rel}, edges AS (SELECT 's' || source AS src, 'contains' AS kind, 'f' || id AS dst FROM fragments WHERE source IS NOT NULL UNION ALL SELECT DISTINCT 'f' || fragment, 'mentions', 'v' || v FROM value WHERE length(v) > 0),
 gone AS (SELECT doc_id FROM documents WHERE source = 'web'), ends AS (SELECT 's' || doc_id AS v FROM gone UNION SELECT 'f' || id FROM fragments WHERE source IN (SELECT doc_id FROM gone))
 SELECT src, kind, dst FROM edges WHERE src NOT IN (SELECT v FROM ends) AND dst NOT IN (SELECT v FROM ends)""",
        "folder_relink": f"WITH {src} SELECT DISTINCT host || '/' || locator AS src, 'contains' AS kind, id AS dst FROM src WHERE locator LIKE '%/%' AND host IS NOT NULL",
        "cache_insert_ignore": "SELECT digest, min(id) AS id FROM embedding_cache WHERE digest NOT IN (SELECT text_digest FROM clusters WHERE text_digest IS NOT NULL) GROUP BY digest",
        "detect_types": f"WITH e AS (SELECT doc_id, lower(regexp_extract(locator, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM documents) SELECT doc_id, CASE e {extensions} ELSE CASE WHEN e IN ({code}) THEN 'text/plain' ELSE 'application/octet-stream' END END AS detected FROM e",
        "host_ids": "SELECT doc_id, source || '-' || substring(sha256(source || chr(10) || lower(trim(coalesce(host, '')))), 1, 16) AS derived FROM documents",
    }
