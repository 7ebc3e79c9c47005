"""The Finder: seed lists, fusion, walk, rollup to sources, and the ledger that explains each score."""

from __future__ import annotations

from dataclasses import dataclass
from dataclasses import fields as declared

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfind.functions.session import cut
from quillfind.operators import graph as G
from quillfind.operators import search as S

@dataclass(frozen=True)
class FinderConfig:
    """Settings of the Finder that a query may override."""

    seeds: int = S.SEEDS
    k: float = 60.0
    damping: float = G.DAMPING
    rounds: int = G.ROUNDS
    hops: int = 2
    hub: int = G.HUB
    limit: int = 10
    vector_cosine: float = 0.25
    cluster_cosine: float = 0.55
    clusters: int = 3
    weights_prose: float = S.CHANNEL_WEIGHTS["prose"]
    weights_lexical: float = S.CHANNEL_WEIGHTS["lexical"]
    weights_vector: float = S.CHANNEL_WEIGHTS["vector"]
    weights_exact: float = S.CHANNEL_WEIGHTS["exact"]
    weights_cluster: float = S.CHANNEL_WEIGHTS["cluster"]

    @property
    def weights(self) -> dict[str, float]:
        return {channel: getattr(self, f"weights_{channel}") for channel in S.CHANNEL_WEIGHTS}

    def overridden(self, settings: list[str]) -> FinderConfig:
        """With `a.b=value` settings, at most 32; an unknown name or a value out of bounds is an error."""
        if len(settings) > 32:
            raise ValueError("at most 32 overrides")
        kinds = {f.name: type(getattr(self, f.name)) for f in declared(self)}
        values = {}
        for s in settings:
            name, sep, value = s.partition("=")
            name = name.strip().replace(".", "_")
            if not sep or name not in kinds:
                raise ValueError(f"unknown setting {s!r}")
            values[name] = kinds[name](value.strip())
        made = FinderConfig(**{**{n: getattr(self, n) for n in kinds}, **values})
        if not 0 < made.damping < 1 or made.hops not in range(1, 5) or min(made.seeds, made.rounds, made.limit, made.hub, made.clusters) < 1 or made.k <= 0 or min(made.weights.values()) < 0 or not all(-1 <= c <= 1 for c in (made.vector_cosine, made.cluster_cosine)):
            raise ValueError("a setting is out of bounds")
        return made


DEFAULTS = FinderConfig()


def seed_lists(
    rows: DataFrame, queries: DataFrame, vocabulary: DataFrame | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, clusters: DataFrame | None = None, config: FinderConfig = DEFAULTS
) -> DataFrame:
    """(query_id, channel, id, rank): the ranked lists of every channel that has its tables.

    prose and lexical from the rows, exact from the vocabulary, vector from (id, vector) of
    the rows, cluster from (id, vector) of the clusters and the vocabulary's members.
    """
    lists = S.by_role(rows, queries, config.seeds).select("query_id", "channel", "id", "rank")
    if vocabulary is not None:
        exact = S.exact_grounding(queries, vocabulary).select("query_id", F.lit("exact").alias("channel"), F.col("fragment").alias("id"), "rank")
        lists = lists.union(exact)
    if vectors is not None and query_vectors is not None:
        near = S.nearest_rows(query_vectors, vectors, config.seeds, config.vector_cosine).select("query_id", F.lit("vector").alias("channel"), "id", "rank")
        lists = lists.union(near)
    if clusters is not None and query_vectors is not None and vocabulary is not None:
        matched = S.nearest_rows(query_vectors, clusters, config.clusters, config.cluster_cosine)
        members = S.cluster_members(matched, vocabulary).select("query_id", F.lit("cluster").alias("channel"), F.col("fragment").alias("id"), "rank")
        lists = lists.union(members)
    return S.gate(lists)


def fused_by_channel(lists: DataFrame, config: FinderConfig = DEFAULTS) -> DataFrame:
    """(query_id, id, channel, weight): what each list gives to each id; over the channels it is the fused score."""
    weight = F.create_map(*[F.lit(x) for pair in config.weights.items() for x in pair])
    best = lists.groupBy("query_id", "channel", "id").agg(F.min("rank").alias("rank"))
    return best.select("query_id", "id", "channel", (F.coalesce(F.try_element_at(weight, "channel"), F.lit(1.0)) / (config.k + F.col("rank"))).alias("weight"))


def ledger(lists: DataFrame, relations: DataFrame, config: FinderConfig = DEFAULTS) -> DataFrame:
    """(query_id, id, channel, seed, walked): per fragment and channel the fused seed and the mass the walk brings.

    final score of a fragment = seed + walked over all channels. Vertices of the relation
    graph are 'f' + fragment id; values and sources conduct, but aren't scored.
    """
    seeds = fused_by_channel(lists, config)
    starts = seeds.select("query_id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("id"), "channel", "weight")
    edges = G.neighbourhood(relations, starts.select("query_id", "id"), config.hops, config.hub)
    starts = cut(starts)
    mass = G.walked(cut(G.build(edges)), starts, damping=config.damping, rounds=config.rounds).where(F.col("id").startswith("f"))
    walked = mass.select("query_id", F.substring("id", 2, 20).cast("long").alias("id"), "channel", F.col("mass").alias("walked"))
    return seeds.withColumnRenamed("weight", "seed").join(walked, ["query_id", "id", "channel"], "full_outer").select("query_id", "id", "channel", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.coalesce("walked", F.lit(0.0)).alias("walked"))


def discover(lists: DataFrame, rows: DataFrame, sources: DataFrame, relations: DataFrame | None = None, config: FinderConfig = DEFAULTS, passing: DataFrame | None = None) -> DataFrame:
    """(query_id, source, score, share, rank, copies): ranked sources.

    Filters (`passing`: ids of sources) are applied after the walk, so they never widen what
    is found; the cut to `limit` comes before equal digests are collapsed, so fewer may be
    left. A query without seeds has no results.
    """
    if relations is None:
        scores = fused_by_channel(lists, config).groupBy("query_id", "id").agg(F.sum("weight").alias("score"))
    else:
        scores = ledger(lists, relations, config).groupBy("query_id", "id").agg(F.sum(F.col("seed") + F.col("walked")).alias("score"))
    rolled = S.source_scores(scores, rows)
    if passing is not None:
        rolled = rolled.join(passing.select(F.col("id").alias("source")), "source", "left_semi")
    final = S.final_ranking(rolled, config.limit)
    kept = S.collapse(final.select("query_id", "source", "rank"), sources)
    return final.join(kept.select("query_id", "source", "copies"), ["query_id", "source"]).select("query_id", "source", "score", "share", "rank", "copies")


def source_ledger(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, source, channel, seed, walked): each source's score split by channel, with the rollup's weights.

    The sum over the channels of seed + walked is the score of the source.
    """
    total = entries.groupBy("query_id", "id").agg(F.sum(F.col("seed") + F.col("walked")).alias("score"))
    owned = total.join(rows.where("source IS NOT NULL").select("id", "source"), "id")
    w = Window.partitionBy("query_id", "source").orderBy(S.best_first(), "id")
    weight = F.array(*map(F.lit, S.ROLLUP_WEIGHTS))
    top = owned.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= len(S.ROLLUP_WEIGHTS)).select("query_id", "source", "id", weight[F.col("_k") - 1].alias("_w"))
    return entries.join(top, ["query_id", "id"]).groupBy("query_id", "source", "channel").agg(F.sum(F.col("seed") * F.col("_w")).alias("seed"), F.sum(F.col("walked") * F.col("_w")).alias("walked"))
