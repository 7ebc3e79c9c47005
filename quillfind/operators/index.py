"""Upkeep of the index: caches, the embedding stage, adopted rows, cluster merges, and who may say what in the log."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfind.functions import text as X
from quillfind.functions import vectors as V

#: Characters of a text that are embedded, and the cosine from which clusters are one.
EMBEDDED, MERGED = 6000, 0.92

# --- caches and vectors


def cache_key(digest: Column, mimetype: Column, root: Column, transform: str, fingerprint: str) -> Column:
    """What an output of a transform is kept under."""
    return F.sha2(F.concat_ws("|", F.lit("v1"), digest, X.essence(mimetype), root.cast("string"), F.lit(transform), F.lit(fingerprint)), 256)


def cached(rows: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses)."""
    return rows.join(cache, keys), rows.join(cache.select(*keys), keys, "left_anti")


def covered(rows: DataFrame, scope: str = "all") -> DataFrame:
    """The search rows that get a vector: all, or summaries only."""
    if scope not in ("all", "summaries"):
        raise ValueError(f"unknown scope {scope!r}")
    return rows if scope == "all" else rows.where(F.col("role") == "summary")


def embedded(rows: DataFrame, cache: DataFrame, model: str, dims: int, scope: str = "all") -> DataFrame:
    """(id, digest, vector, fresh): vectors of covered rows, from the cache by digest, model and width, else embedded anew.

    Equal texts are embedded once. A row without text has no vector.
    """
    wanted = covered(rows, scope).where(F.length("text") > 0).select("id", F.sha2("text", 256).alias("digest"), F.substring("text", 1, EMBEDDED).alias("_t"))
    known = cache.where((F.col("model") == model) & (F.col("dimensions") == dims) & (F.size("vector") == dims)).groupBy("digest").agg(F.min_by("vector", "id").alias("vector"))
    missing = wanted.join(known.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.min("_t").alias("_t"))
    fresh = missing.select("digest", V.hashed_embedding(F.col("_t"), dims).alias("vector"), F.lit(True).alias("fresh"))
    every = known.select("digest", F.col("vector").cast("array<float>").alias("vector"), F.lit(False).alias("fresh")).union(fresh)
    return wanted.select("id", "digest").join(every, "digest").select("id", "digest", "vector", "fresh")


def stale_vectors(cache: DataFrame, model: str, dims: int) -> DataFrame:
    """(id) of vectors of another identity than the declared one, or not as long as they say."""
    fits = (F.col("model") == model) & (F.col("dimensions") == dims) & (F.size("vector") == dims)
    return cache.where(~F.coalesce(fits, F.lit(False))).select("id")


# --- vocabulary rows and clusters


def adopted(fragments: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(fragment, kind, normalized): keyed fragments that no vocabulary row files yet; the kind by their type."""
    keyed = fragments.where("source IS NULL AND length(trim(text)) > 0").select(F.col("id").alias("fragment"), "mimetype", X.normalize_spelling(F.col("text")).alias("normalized"))
    kind = F.regexp_extract("mimetype", rf"^{X.DERIVED}([a-z]+)", 1)
    known = vocabulary.select("fragment")
    return keyed.join(known, "fragment", "left_anti").select("fragment", F.when(kind.isin("term", "identifier", "entity", "alias", "facet"), kind).otherwise("term").alias("kind"), "normalized")


def document_frequencies(vocabulary: DataFrame, fragments: DataFrame) -> DataFrame:
    """(normalized, document_frequency): sources of the envelope rows, counted anew."""
    rows = vocabulary.where("origin = 'envelope'").select(F.col("fragment").alias("id"), X.normalize_spelling(F.col("normalized")).alias("normalized")).where("normalized <> ''")
    return rows.join(fragments.where("source IS NOT NULL").select("id", "source"), "id").groupBy("normalized").agg(F.countDistinct("source").alias("document_frequency"))


def merges(clusters: DataFrame, changed_since: int, floor: float = MERGED, block: int = 4096) -> DataFrame:
    """(loser, survivor): each changed cluster is merged at most once, with its nearest one that isn't taken.

    The smaller goes into the larger, of equally large ones the changed one into the other.
    All clusters are compared, by pairs of blocks of about `block` clusters; only the pairs
    near enough meet in the one task that decides in the order of the ids.
    """
    usable = clusters.where("vector IS NOT NULL").select("id", "vector", F.coalesce("member_count", F.lit(0)).cast("long").alias("size"), (F.coalesce("changed_sweep", F.lit(0)) >= changed_since).alias("changed"))
    blocks = max(1, -(-usable.count() // block))
    every, own = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked = usable.where("changed").select(own.alias("a"), every.alias("b"), F.lit(True).alias("asks"), "id", "vector", "size")
    met = usable.select(every.alias("a"), own.alias("b"), F.lit(False).alias("asks"), "id", "vector", "size")

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = []
        sizes = pdf["vector"].map(len)
        for dim in sorted(set(sizes)):
            g = pdf[sizes == dim]
            m = np.array(g["vector"].tolist(), float)
            with np.errstate(all="ignore"):
                m = m / np.linalg.norm(m, axis=1)[:, None]
            fine = np.isfinite(m).all(1)
            g, m = g[fine], m[fine]
            asks, ids, n = g["asks"].to_numpy(bool), g["id"].to_numpy(), g["size"].to_numpy()
            q, others = np.flatnonzero(asks), np.flatnonzero(~asks)
            for at in range(0, len(q), 512):
                s = m[q[at : at + 512]] @ m[others].T
                r, c = np.nonzero((s >= floor) & (ids[q[at : at + 512]][:, None] != ids[others][None]))
                i, j = q[at + r], others[c]
                out.append(pd.DataFrame({"id": ids[i], "other": ids[j], "score": s[r, c], "size": n[i], "other_size": n[j]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["id", "other", "score", "size", "other_size"])

    pairs = asked.union(met).groupBy("a", "b").applyInPandas(near, "id long, other long, score double, size long, other_size long")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        out, taken = [], set()
        for i, j, size, other in pdf.sort_values(["id", "score", "other"], ascending=[True, False, True])[["id", "other", "size", "other_size"]].itertuples(index=False):
            if i not in taken and j not in taken:
                taken |= {i, j}
                out.append((j, i) if other < size else (i, j))
        return pd.DataFrame(out, columns=["loser", "survivor"])

    return pairs.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(decide, "loser long, survivor long")


# --- the log's authority


def authorised(entries: DataFrame) -> DataFrame:
    """Entries with `allowed`: node and stewardship records count only from the node they describe.

    entries: (origin, key, kind); the key of such a record names the node behind its kind.
    """
    own = F.regexp_extract("key", r"^(?:node|stewardship):([^/]+)", 1)
    bound = F.col("kind").isin("node", "stewardship", "stewardship_withdrawn")
    return entries.withColumn("allowed", ~F.coalesce(bound, F.lit(False)) | (own == "") | (own == F.col("origin")))


def purged(entries: DataFrame, expelled: DataFrame, own: str) -> DataFrame:
    """Entries without those of expelled nodes; a node never purges itself."""
    gone = expelled.where(F.col("node") != own).select(F.col("node").alias("origin"))
    return entries.join(gone, "origin", "left_anti")


def generation(*parts: Column) -> Column:
    """A digest of what a derived table was made from; when it is the same, the pass is skipped."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)
