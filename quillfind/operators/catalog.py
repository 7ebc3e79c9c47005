"""The catalogue: listings, counts, filters, folders, and what changed between two states of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfind.functions import text as X
from quillfind.operators.model import deep_indexed

MAX_LISTED = 10_000

# --- listings and counts


def listing(sources: DataFrame, host: str | None = None, state: str = "all", limit: int | None = None) -> DataFrame:
    """Sources by host and locator; state is all, indexed or pending."""
    rows = sources if host is None else sources.where(F.col("host") == host)
    rows = {"all": rows, "indexed": rows.where("indexed"), "pending": rows.where("NOT indexed")}[state]
    rows = rows.select("id", "host", "locator", "address", "content_type", "modified").orderBy("host", "locator", "id")
    return rows if limit is None else rows.limit(min(limit, MAX_LISTED))


def counts(sources: DataFrame) -> DataFrame:
    """(sources, indexed, pending) in one pass."""
    return sources.agg(F.count("*").alias("sources"), F.count_if("indexed").alias("indexed"), F.count_if(~F.col("indexed")).alias("pending"))


def statistics(sources: DataFrame, fragments: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: sources, deep-indexed ones, bytes, fragments, relations. Each table is read once."""
    s = sources.agg(F.count("*").alias("sources"), F.count_if(deep_indexed()).alias("deep_indexed"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"))
    f = fragments.agg(F.count("*").alias("fragments"), F.count_if(F.col("source").isNull()).alias("keyed_fragments"))
    r = relations.agg(F.count("*").alias("relations"))
    return s.join(F.broadcast(f)).join(F.broadcast(r))  # each side is one row


def type_histogram(fragments: DataFrame) -> DataFrame:
    """(essence, n), the most frequent first."""
    return fragments.groupBy(X.essence(F.col("mimetype")).alias("essence")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "essence")


def edge_histogram(relations: DataFrame, kinds: DataFrame) -> DataFrame:
    """(from_kind, kind, to_kind, n); kinds gives the kind of each vertex (id, row_kind)."""
    a = kinds.select(F.col("id").alias("src"), F.col("row_kind").alias("from_kind"))
    b = kinds.select(F.col("id").alias("dst"), F.col("row_kind").alias("to_kind"))
    named = relations.join(a, "src", "left").join(b, "dst", "left")
    return named.groupBy("from_kind", "kind", "to_kind").agg(F.count("*").alias("n"))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page in a stated order; at most 10,000 rows."""
    return rows.orderBy(*order).offset(offset).limit(min(limit, MAX_LISTED))


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the given ids, each once: a semi-join in place of an IN list."""
    return rows.join(ids.select(key), key, "left_semi")


def referencing(fragments: DataFrame) -> DataFrame:
    """(content_address, id): the lowest fragment that refers to each address."""
    return fragments.where("content_address IS NOT NULL").groupBy("content_address").agg(F.min("id").alias("id"))


# --- folders


def folders_above(sources: DataFrame) -> DataFrame:
    """(host, folder): every folder between a source and its host, each once."""
    parts = F.split("locator", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    deep = sources.where("locator LIKE '%/%'")
    return deep.select("host", F.explode(prefixes).alias("folder")).where("folder <> ''").distinct()


def _parent(c: Column) -> Column:
    return F.regexp_replace(c, "/?[^/]*$", "")


def children(sources: DataFrame) -> DataFrame:
    """(host, folder, name, is_folder, essence, summary): what each folder directly holds, '' being the host itself."""
    files = sources.select(
        "host", _parent(F.col("locator")).alias("folder"), F.regexp_extract("locator", "([^/]*)$", 1).alias("name"), F.lit(False).alias("is_folder"), X.essence(F.col("content_type")).alias("essence"), X.preview(F.col("text"), 80).alias("summary")
    )
    inner = folders_above(sources).select(
        "host", _parent(F.col("folder")).alias("_up"), F.regexp_extract("folder", "([^/]*)$", 1).alias("name"), F.lit(True).alias("is_folder"), F.lit("inode/directory").alias("essence"), F.lit(None).cast("string").alias("summary")
    )
    return files.union(inner.withColumnRenamed("_up", "folder"))


def listings(sources: DataFrame, most: int = 2000) -> DataFrame:
    """(host, folder, n, content): each folder as text: a head, folders before files, name, type and summary parted by tabs."""
    entry = F.struct((~F.col("is_folder")).alias("file"), "name", F.concat_ws("\t", "name", F.coalesce("essence", F.lit("")), F.coalesce("summary", F.lit(""))).alias("line"))
    ranked = children(sources).withColumn("e", entry)
    order = Window.partitionBy("host", "folder").orderBy("e")
    bounded = ranked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    body = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "\n")
    return bounded.groupBy("host", "folder").agg(F.count("*").alias("n"), F.concat(F.lit("# "), F.first("folder"), F.lit("\n"), body).alias("content"))


def parse_listing(rows: DataFrame, content: str = "content") -> DataFrame:
    """The inverse of `listings`: (…, name, essence, summary) of lines with three fields."""
    line = rows.withColumn("_line", F.explode(X.lines(F.col(content)))).withColumn("_f", F.split("_line", "\t"))
    return line.where(F.size("_f") == 3).select(*rows.drop(content).columns, *(F.col("_f")[i].alias(n) for i, n in enumerate(("name", "essence", "summary"))))


# --- filters


def envelope_filter(sources: DataFrame, host: str | None = None, source_type: str | None = None, after: int | None = None, before: int | None = None) -> DataFrame:
    """Bounds are inclusive; a source without a time passes no bound."""
    tests = [(host, F.col("host") == host), (source_type, F.col("source_type") == source_type), (after, F.col("modified") >= F.lit(after)), (before, F.col("modified") <= F.lit(before))]
    return reduce(lambda df, t: df if t[0] is None else df.where(t[1]), tests, sources)


def facet_filter(vocabulary: DataFrame, fragments: DataFrame, facets: list[str]) -> DataFrame:
    """(source) anchored to every one of the facets, spelled as facet or entity rows."""
    wanted = sorted({" ".join(f.lower().split()) for f in facets})
    rows = vocabulary.where(F.col("kind").isin("facet", "entity")).select(F.col("fragment").alias("id"), X.normalize_spelling(F.col("normalized")).alias("spelled")).where(F.col("spelled").isin(*wanted))
    anchored = rows.join(fragments.where("source IS NOT NULL").select("id", "source"), "id")
    return anchored.groupBy("source").agg(F.countDistinct("spelled").alias("n")).where(F.col("n") == len(wanted)).select("source")


def ignored(rules: list[dict]) -> Column:
    """Whether any rule matches: fields of a rule all must; address and locator are path globs, other fields plain ones.

    A rule on a field that is null never matches.
    """
    if len(rules) > 1024:
        raise ValueError("at most 1024 rules")

    def one(rule: dict) -> Column:
        tests = [F.coalesce(F.col(f).rlike(X.glob_regex(g, f in ("address", "locator"))), F.lit(False)) for f, g in sorted(rule.items())]
        return reduce(lambda a, b: a & b, tests)

    return reduce(lambda a, b: a | b, map(one, rules), F.lit(False))


# --- what changed


def dirty(stored: DataFrame, seen: DataFrame, cut_off: int | None = None, budget: int | None = None) -> DataFrame:
    """(host, locator, decision) of seen sources: skip, catalog or deep.

    Dirty is what is new, not indexed, of another time or size, or stamped otherwise or not
    at all. Older than the cut-off is catalogued only; so is what lies beyond the budget, in
    the order of host and locator.
    """
    old = stored.select("host", "locator", F.col("modified").alias("_m"), F.col("raw_bytes").alias("_b"), F.col("indexed").alias("_i"), F.col("shape_stamp").alias("_s"), F.lit(True).alias("_known"))
    both = seen.select("host", "locator", "modified", "raw_bytes", "shape_stamp").join(old, ["host", "locator"], "left")
    changed = (
        F.col("_known").isNull() | ~F.col("_i") | ~F.col("modified").eqNullSafe(F.col("_m")) | (F.col("raw_bytes") != F.col("_b")) | F.col("_s").isNull() | ~F.col("_s").eqNullSafe(F.col("shape_stamp"))
    )
    late = F.lit(False) if cut_off is None else F.coalesce(F.col("modified") < cut_off, F.lit(False))
    judged = both.select("host", "locator", F.when(~changed, "skip").when(late, "catalog").otherwise("deep").alias("decision"))
    if budget is None:
        return judged
    # a budget is a top-k: the threshold row decides, so no global numbering of all rows is needed
    kept = judged.where("decision = 'deep'").orderBy("host", "locator").limit(budget).select("host", "locator", F.lit(True).alias("_in"))
    return judged.join(kept, ["host", "locator"], "left").select("host", "locator", F.when((F.col("decision") == "deep") & F.col("_in").isNull(), "catalog").otherwise(F.col("decision")).alias("decision"))


def dirty_folders(stored: DataFrame, sources: DataFrame) -> DataFrame:
    """(host, folder) whose listing differs from the stored digest and that holds an indexed child."""
    now = listings(sources).select("host", "folder", F.sha2("content", 256).alias("digest"))
    holding = sources.where("indexed").select("host", _parent(F.col("locator")).alias("folder")).distinct()
    old = stored.select("host", "folder", F.col("digest").alias("_old"))
    return now.join(holding, ["host", "folder"], "left_semi").join(old, ["host", "folder"], "left").where(~F.col("digest").eqNullSafe(F.col("_old"))).select("host", "folder")


def vanished(stored: DataFrame, seen: DataFrame, scope: str = "") -> DataFrame:
    """Stored sources in scope that were not seen."""
    return stored.where(X.in_scope(F.col("locator"), scope)).join(seen.select("host", "locator"), ["host", "locator"], "left_anti").select("host", "locator")


def holding_folders(folders: DataFrame, sources: DataFrame) -> DataFrame:
    """Folders that still hold a source, however deep."""
    return folders.join(folders_above(sources), ["host", "folder"], "left_semi")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert(stored: DataFrame, seen: DataFrame, remote: bool = False) -> DataFrame:
    """(host, locator, content_type, modified, observed, raw_bytes, indexed, change): the catalogue after an upsert.

    change is new, updated, touched (only `observed` differs) or kept; new, updated and
    touched rows take the seen values, and the first two are to be indexed anew. A remote
    upsert updates rows that are themselves remote, and never a row of our own: one whose
    `origin` in the stored table is null, or all of them where it has no such column.
    """
    fields = ("content_type", "modified", "raw_bytes")
    cols = ["host", "locator", *fields, "observed", "indexed"]
    owner = F.col("origin") if "origin" in stored.columns else F.lit(None).cast("string")
    old = stored.select("host", "locator", *(F.col(c).alias(f"_{c}") for c in (*fields, "observed", "indexed")), owner.alias("_origin"), F.lit(True).alias("_old"))
    both = seen.select(*cols).withColumn("_new", F.lit(True)).join(old, ["host", "locator"], "full_outer")
    same = reduce(lambda a, b: a & b, (F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields))
    guarded = F.col("_origin").isNull() if remote else F.lit(False)
    change = F.when(F.col("_new").isNull() | (guarded & F.col("_old").isNotNull()), "kept").when(F.col("_old").isNull(), "new").when(~same, "updated").when(F.col("observed").eqNullSafe(F.col("_observed")), "kept").otherwise("touched")
    taken = F.col("change").isin("new", "updated", "touched")
    values = [F.when(taken, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in (*fields, "observed")]
    indexed = F.when(F.col("change").isin("new", "updated"), F.lit(False)).otherwise(F.col("_indexed")).alias("indexed")
    return both.withColumn("change", change).select("host", "locator", *values, indexed, "change")


# --- keyed fragments and subtrees


def keyed_first(vocabulary: DataFrame) -> DataFrame:
    """(key, fragment, kind, normalized): the first emitter of each key stands."""
    spelled = X.normalize_spelling(F.col("normalized"))
    rows = vocabulary.where(F.length(spelled) > 0).select(F.concat_ws(":", "kind", spelled).alias("key"), "fragment", "kind", spelled.alias("normalized"))
    return rows.groupBy("key").agg(F.min(F.struct("fragment", "kind", "normalized")).alias("s")).select("key", "s.fragment", "s.kind", "s.normalized")


def get_or_create(existing: DataFrame, emitted: DataFrame) -> DataFrame:
    """(key, fragment, created): emitted keys with the fragment they resolve to."""
    first = keyed_first(emitted).select("key", "fragment")
    old = existing.select("key", F.col("fragment").alias("_old"))
    return first.join(old, "key", "left").select("key", F.coalesce("_old", "fragment").alias("fragment"), F.col("_old").isNull().alias("created"))


def orphans(fragments: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Keyed fragments (without a source) that no vocabulary row of any origin refers to, save what was mined."""
    keyed = fragments.where("source IS NULL").select("id")
    held = vocabulary.select(F.col("fragment").alias("id"))
    return keyed.join(held, "id", "left_anti")


def replace_subtrees(fragments: DataFrame, planned: DataFrame) -> DataFrame:
    """Fragments with those of the planned sources replaced by the plan."""
    kept = fragments.join(planned.select("source").distinct(), "source", "left_anti")
    return kept.unionByName(planned.select(*kept.columns))


def deleted(gone: DataFrame, fragments: DataFrame, vocabulary: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fragments, vocabulary, relations) once the sources of `gone` (id) are deleted.

    Their fragments go, with the vocabulary rows of those, and every edge at one of them;
    values that nothing mentions any more are left to `orphans`.
    """
    away = fragments.join(gone.select(F.col("id").alias("source")), "source", "left_semi").select("id")
    kept = fragments.join(away, "id", "left_anti")
    rows = vocabulary.join(away.select(F.col("id").alias("fragment")), "fragment", "left_anti")
    ends = away.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("v")).union(gone.select(F.concat(F.lit("s"), F.col("id").cast("string")))).distinct()
    edges = relations.join(ends.withColumnRenamed("v", "src"), "src", "left_anti").join(ends.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "kind", "dst")
    return kept, rows, edges


def relink(fragments: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, kind, dst): entries that refer to the address of a source contain its root."""
    entries = fragments.where("content_address IS NOT NULL").select(F.col("id").alias("src"), F.col("content_address").alias("address"))
    roots = sources.select("address", F.col("id").alias("dst"))
    return entries.join(roots, "address").select("src", F.lit("contains").alias("kind"), "dst")


def report(decisions: DataFrame) -> DataFrame:
    """(host, seen, skipped, catalogued, deep): what an index run does with the sources of each host; decisions as `dirty` gives them."""
    of = lambda d: F.count_if(F.col("decision") == d)
    return decisions.groupBy("host").agg(F.count("*").alias("seen"), of("skip").alias("skipped"), of("catalog").alias("catalogued"), of("deep").alias("deep"))


def content_page(fragments: DataFrame, after: int, limit: int) -> DataFrame:
    """(id, source, text) of content fragments past `after`, in the order of ids, `limit` of them: one page, by its key.

    Derived and keyed fragments are no content. Only the rows past the key are read on, and
    each task keeps its own first `limit`.
    """
    content = fragments.where(F.col("source").isNotNull() & (F.length(F.trim("text")) > 0) & ~F.coalesce(F.col("mimetype").startswith(X.DERIVED), F.lit(False)))
    return content.where(F.col("id") > after).select("id", "source", "text").orderBy("id").limit(limit)


def insert_ignore(cache: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that a cache doesn't hold yet, one per key (the least): what is to be appended."""
    values = [c for c in rows.columns if c not in keys]
    once = rows.groupBy(*keys).agg(F.min(F.struct(*values)).alias("_v")).select(*keys, "_v.*")
    return once.join(cache.select(*keys), keys, "left_anti")
