"""The vocabulary pass: mining terms, the document-frequency band, clusters and their upkeep."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfind.functions import text as X
from quillfind.functions.session import spread
from quillfind.operators.search import phrase_blocks, standing

#: Least documents of a term, its largest share of them with the floor of that bound, and the bounds of clustering.
DF_MIN, DF_SHARE, DF_FLOOR = 3, 0.02, 50
JOIN_SHARE, ROOM, CLUSTERS, SAMPLES = 0.5, 64, 10_000, 256

#: Ids of documents that a task holds while it counts matches.
KEPT = 1 << 20


def mined(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, shape, df): exact document frequencies of shaped tokens; the spelling is in lower case."""
    token = documents.select(F.col(key).alias("id"), F.explode(F.array_distinct(X.vocabulary_tokens(F.col(text)))).alias("token"))
    shaped = token.withColumn("shape", X.shape_of(F.col("token"))).where("shape IS NOT NULL")
    # a document counts once for a term, whatever its spellings; identifier is the stronger shape
    once = shaped.groupBy(F.lower("token").alias("term"), "id").agg(F.min("shape").alias("shape"))
    return once.groupBy("term").agg(F.min("shape").alias("shape"), F.count("*").alias("df"))


def in_band(terms: DataFrame, documents: int | Column, least: int = DF_MIN, share: float = DF_SHARE, floor: int = DF_FLOOR) -> DataFrame:
    """Terms in the band: at least `least` documents, at most the share of all, or the floor if that is more."""
    n = documents if isinstance(documents, Column) else F.lit(documents)
    return terms.where((F.col("df") >= least) & (F.col("df") <= F.greatest(F.floor(n * share), F.lit(floor), F.lit(least))))


def band_of(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, df) in the band: identifiers are keyed identifier:, others term:."""
    total = documents.where(F.length(F.trim(text)) > 0).agg(F.count("*").alias("_n"))
    terms = mined(documents, key, text).join(F.broadcast(total))  # one row
    return in_band(terms, F.col("_n")).select("term", F.concat_ws(":", "shape", "term").alias("key"), "df")


def phrases(rows: DataFrame, key: str, text: str, most: int = 4) -> DataFrame:
    """(phrase, df): keyword phrases of two to four words with a shaped one among them."""
    said = rows.select(F.col(key).alias("id"), F.explode(X.keyword_phrases(F.col(text))).alias("p"))
    ws = F.split(X.normalize_spelling(F.col("p")), " ")
    fit = said.where(F.size(ws).between(2, most) & F.exists(ws, lambda w: X.shape_of(w).isNotNull()))
    return fit.groupBy(X.normalize_spelling(F.col("p")).alias("phrase")).agg(F.countDistinct("id").alias("df"))


def matches(documents: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text", every: bool = False) -> DataFrame:
    """(spelling, df, samples): in how many documents each spelling stands, and the first of them, or `every` one in order.

    The spellings, of any number of words, travel to the documents as a trie. Each task
    counts its own documents and lists those of a spelling, so sightings are not shuffled
    one by one.
    """
    known = vocabulary.select(X.normalize_spelling(F.col("normalized")).alias("spelling")).where("spelling <> ''").distinct()
    wanted = known.select("spelling", F.split("spelling", " ").alias("tokens"))
    told = spread(documents.select(F.col(key).alias("id"), F.col(text).alias("text"))).select("id", F.transform(X.vocabulary_tokens(F.col("text")), lambda w: F.lower(w)).alias("ws"))
    kind = told.schema["id"].dataType.simpleString()
    schema = f"spelling string, df long, samples array<{kind}>"
    context, most = documents.sparkSession.sparkContext, None if every else SAMPLES

    def met(table, trie):
        names = context.broadcast(table.column("spelling").combine_chunks())

        def run(batches):
            held = _Firsts(len(names.value), most)
            for batch in batches:
                row, phrase = standing(batch.column(1), trie.value, len(names.value))
                yield from held.added(phrase, batch.column(0).take(pa.array(row)), names.value)
            yield from held.flushed(names.value)

        return told.mapInArrow(run, schema)

    parts = [met(*b) for b in phrase_blocks(wanted)]
    if not parts:
        return documents.sparkSession.createDataFrame([], schema)
    held = F.array_sort(F.flatten(F.collect_list("samples")))
    first = held if every else F.slice(held, 1, SAMPLES)
    return reduce(DataFrame.union, parts).groupBy("spelling").agg(F.sum("df").alias("df"), first.alias("samples")).select("spelling", "df", "samples")


class _Firsts:
    """How many ids each spelling was seen with, and the `most` least of them, or all; put out whenever more than KEPT are held."""

    def __init__(self, spellings: int, most: int | None):
        self.df, self.held, self.rows, self.most = np.zeros(spellings, np.int64), [], 0, most

    def added(self, phrase: np.ndarray, ids: pa.Array, names: pa.Array):
        self.df += np.bincount(phrase, minlength=len(self.df))
        self.held.append(pa.table({"phrase": phrase, "id": ids}))
        self.rows += len(phrase)
        if self.rows > 2 * KEPT:
            self._cut()
            if self.rows > KEPT:
                yield from self.flushed(names)

    def _cut(self) -> None:
        table = pa.concat_tables(self.held).sort_by([("phrase", "ascending"), ("id", "ascending")])
        if self.most is not None:
            phrase = table.column("phrase").to_numpy()
            table = table.filter(pa.array(np.arange(len(phrase)) - np.searchsorted(phrase, phrase) < self.most))
        self.held, self.rows = [table], table.num_rows

    def flushed(self, names: pa.Array):
        if not self.held:
            return
        self._cut()
        seen, begins = np.unique(self.held[0].column("phrase").to_numpy(), return_index=True)
        ids = self.held[0].column("id").combine_chunks()
        ends = np.r_[begins[1:], len(ids)]
        for at in range(0, len(seen), 1024):
            a, b = begins[at : at + 1024], ends[at : at + 1024]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[a, b[-1]] - a[0], pa.int32()), ids.slice(a[0], b[-1] - a[0]))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(seen[at : at + 1024])), pa.array(self.df[seen[at : at + 1024]]), lists], names=["spelling", "df", "samples"])
        self.df[:], self.held, self.rows = 0, [], 0


def recounted(vocabulary: DataFrame) -> DataFrame:
    """(cluster_id, members, document_frequency, label): clusters counted anew; the label is the member of most documents.

    Ties go to the lowest fragment. Clusters without members are gone.
    """
    rows = vocabulary.where("cluster_id IS NOT NULL").select("cluster_id", "fragment", X.normalize_spelling(F.col("normalized")).alias("v")).where("v <> ''").distinct()
    each = rows.groupBy("cluster_id", "v").agg(F.count("*").alias("df"), F.min("fragment").alias("low"))
    return each.groupBy("cluster_id").agg(F.count("*").alias("members"), F.sum("df").alias("document_frequency"), F.min(F.struct((-F.col("df")).alias("d"), "low", "v")).getField("v").alias("label"))


def counts(vocabulary: DataFrame) -> DataFrame:
    """(kind, n, clustered, glossed)."""
    return vocabulary.groupBy("kind").agg(F.count("*").alias("n"), F.count("cluster_id").alias("clustered"), F.count("gloss").alias("glossed"))


def cluster_text(vocabulary: DataFrame, most: int = 64) -> DataFrame:
    """(cluster_id, text): up to 64 members, the most frequent first, `spelling: gloss` joined by commas."""
    rows = vocabulary.where("cluster_id IS NOT NULL").select("cluster_id", "fragment", "gloss", X.normalize_spelling(F.col("normalized")).alias("v")).where("v <> ''")
    each = rows.groupBy("cluster_id", "v").agg(F.countDistinct("fragment").alias("df"), F.max("gloss").alias("gloss"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("df"), "v")
    top = each.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return top.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(": ", "v", "gloss").alias("t")))), lambda x: x["t"]), ", ").alias("text"))


def clustered(terms: DataFrame, sightings: DataFrame) -> DataFrame:
    """(term, cluster): greedy clusters of co-occurring terms; a term that finds no room has none.

    terms: (term, df); sightings: (term, source), at most 256 sources a term. In the order of
    df and spelling a term joins the cluster seen in the largest share, of half at least, of
    its sources that has room; else it founds one, up to 10,000; a source remembers 32 of
    its clusters. Each choice depends on all before it, so this is one task; its rows are the
    terms of the band, which grow with the corpus, with a sample of each.
    """
    w = Window.partitionBy("term").orderBy("source")
    sampled = sightings.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= SAMPLES)
    rows = terms.join(sampled.groupBy("term").agg(F.array_sort(F.collect_list("source")).alias("sources")), "term").withColumn("_one", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["df", "term"], ascending=[False, True])
        seen: dict = {}
        sizes: list[int] = []
        out = []
        for term, sources in zip(pdf["term"], pdf["sources"]):
            votes: dict[int, int] = {}
            for s in sources:
                for c in seen.get(s, ()):
                    votes[c] = votes.get(c, 0) + 1
            fit = [(-n, c) for c, n in votes.items() if n >= JOIN_SHARE * len(sources) and sizes[c] < ROOM]
            if fit:
                cluster = min(fit)[1]
            elif len(sizes) < CLUSTERS:
                cluster = len(sizes)
                sizes.append(0)
            else:
                out.append((term, None))
                continue
            sizes[cluster] += 1
            out.append((term, cluster))
            for s in sources:
                held = seen.setdefault(s, [])
                if cluster not in held and len(held) < 32:
                    held.append(cluster)
        return pd.DataFrame({"term": [t for t, _ in out], "cluster": pd.array([c for _, c in out], "Int32")})

    return rows.groupBy("_one").applyInPandas(run, "term string, cluster int")


def facets(documents: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """(key, relation, source): authors as people, everything else of the envelope as facets.

    authors: (doc_id, author), as the envelope names them.
    """
    pair = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), X.normalize_spelling(F.col(k)).alias("v")) for k in ("lang", "source", "host"))))
    rows = documents.select(F.col("doc_id").alias("source_id"), pair.alias("p")).select("source_id", "p.k", "p.v")
    if authors is not None:
        rows = rows.union(authors.select(F.col("doc_id").alias("source_id"), F.lit("author").alias("k"), X.normalize_spelling(F.col("author")).alias("v")))
    person = F.col("k") == "author"
    return rows.where("v IS NOT NULL AND v <> ''").select(F.when(person, F.concat(F.lit("entity:person:"), F.col("v"))).otherwise(F.concat(F.lit("facet:"), "k", F.lit(":"), "v")).alias("key"), F.when(person, "authored").otherwise("faceted").alias("relation"), F.col("source_id").alias("source"))


def display_spellings(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, spelling): how a mined term is shown: the spelling of the strongest shape, of these the one of most documents, of these the least."""
    token = documents.select(F.col(key).alias("id"), F.explode(F.array_distinct(X.vocabulary_tokens(F.col(text)))).alias("token"))
    shaped = token.withColumn("shape", X.shape_of(F.col("token"))).where("shape IS NOT NULL")
    each = shaped.groupBy("token", "shape").agg(F.count("*").alias("n"))
    return each.groupBy(F.lower("token").alias("term")).agg(F.min(F.struct("shape", (-F.col("n")).alias("n"), "token")).getField("token").alias("spelling"))


def retracted(vocabulary: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, relations) without the rows of `gone` (normalized): values that the band no longer names; relations lose every edge at them."""
    values = gone.select(X.normalize_spelling(F.col("normalized")).alias("_v")).distinct()
    kept = vocabulary.withColumn("_v", X.normalize_spelling(F.col("normalized"))).join(values, "_v", "left_anti").drop("_v")
    ids = values.select(F.concat(F.lit("v"), "_v").alias("id"))
    edges = relations.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "kind", "dst")
    return kept, edges


def without_mined_anchors(relations: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Relations without the mentions of values that were mined only: the full-text index is their anchor."""
    value = X.normalize_spelling(F.col("normalized"))
    by = vocabulary.where(F.length(value) > 0).groupBy(F.concat(F.lit("v"), value).alias("dst")).agg(F.bool_and(F.coalesce(F.col("origin") == "mined", F.lit(False))).alias("_mined"))
    mined = by.where("_mined").select("dst", F.lit("mentions").alias("kind"))
    return relations.join(mined, ["kind", "dst"], "left_anti").select("src", "kind", "dst")


def merged_rows(relations: DataFrame, merges: DataFrame) -> DataFrame:
    """Relations with every loser's edges re-pointed to its survivor, each edge once; merges: (loser, survivor)."""
    m = merges.select(F.col("loser").alias("dst"), F.col("survivor"))
    out = merges.select(F.col("loser").alias("src"))
    return relations.join(out, "src", "left_anti").join(m, "dst", "left").select("src", "kind", F.coalesce("survivor", "dst").alias("dst")).distinct()
