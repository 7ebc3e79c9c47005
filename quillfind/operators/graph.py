"""The relation graph: degrees, hub-bounded neighbourhoods and personalized PageRank, batched by query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfind.functions.session import cut

#: Hops at most, degree from which a vertex is a hub, damping, and rounds of the walk.
MAX_HOPS, HUB, DAMPING, ROUNDS = 4, 500, 0.5, 12
#: How well a kind of relation conducts, and one that isn't named.
KIND_WEIGHTS = {"contains": 1.0, "derives": 1.0, "mentions": 0.5, "links-to": 0.7, "resolves-to": 0.7, "authored": 0.5, "faceted": 0.3, "aliases": 0.8, "transcribes": 1.0}
OTHER_KIND = 0.5
#: Edges of one query up to which its walk is one task; larger ones are walked by joins, with the same result.
SLICE = 200_000


def touching(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among the ids, each once: two equi-joins, as an OR would be a nested loop."""
    known = ids.select("id").distinct()
    a = relations.join(known.withColumnRenamed("id", "src"), "src", "left_semi")
    b = relations.join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return a.select("src", "kind", "dst").union(b.select("src", "kind", "dst")).distinct()


def degrees(relations: DataFrame) -> DataFrame:
    """(id, degree): edges in and out; a loop counts twice."""
    ends = relations.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def hubs(relations: DataFrame, most: int = HUB) -> DataFrame:
    """(id, degree) beyond the bound, the largest first."""
    return degrees(relations).where(F.col("degree") > most).orderBy(F.desc("degree"), "id")


def without_hubs(relations: DataFrame, most: int = HUB) -> DataFrame:
    """Edges of which neither end is a hub."""
    beyond = degrees(relations).where(F.col("degree") > most).select("id")
    return relations.join(beyond.withColumnRenamed("id", "src"), "src", "left_anti").join(beyond.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "kind", "dst")


def neighbourhood(relations: DataFrame, seeds: DataFrame, hops: int = 2, most: int = HUB, limit: int | None = None) -> DataFrame:
    """(query_id, src, kind, dst, hop): edges within `hops` of the seeds of each query, hubs and their edges left out.

    One pair of joins a hop; an edge keeps the hop it was first reached at. `limit` keeps so
    many edges of a query, in the order of hop, src, kind and dst.
    """
    edges = without_hubs(relations, most)
    both = edges.select(F.col("src").alias("id"), "src", "kind", "dst").union(edges.select(F.col("dst").alias("id"), "src", "kind", "dst"))
    reached = seeds.select("query_id", "id").distinct()
    frontier, found = reached, None
    for hop in range(1, min(hops, MAX_HOPS) + 1):
        step = frontier.join(both, "id").select("query_id", "src", "kind", "dst").distinct().withColumn("hop", F.lit(hop))
        found = step if found is None else found.union(step)
        if hop < hops:
            ends = step.select("query_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
            frontier = ends.join(reached, ["query_id", "id"], "left_anti")
            reached = reached.union(frontier)
    found = found.groupBy("query_id", "src", "kind", "dst").agg(F.min("hop").alias("hop"))
    if limit is None:
        return found
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("hop", "src", "kind", "dst")
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).drop("_k")


def build(edges: DataFrame, weights: dict[str, float] = KIND_WEIGHTS, vertex: DataFrame | None = None) -> DataFrame:
    """(query_id, src, dst, weight): both directions, loops and weights of 0 dropped, parallel edges summed.

    vertex: (id, weight) of the kind of the vertex that an edge leads into; 1 where none is given.
    """
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    w = F.coalesce(F.try_element_at(table, "kind"), F.lit(OTHER_KIND))
    one = edges.where("src <> dst").select("query_id", "src", "dst", w.alias("weight"))
    both = one.union(one.select("query_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    if vertex is not None:
        both = both.join(vertex.select(F.col("id").alias("dst"), F.col("weight").alias("_v")), "dst", "left").select("query_id", "src", "dst", (F.col("weight") * F.coalesce("_v", F.lit(1.0))).alias("weight"))
    return both.where("weight > 0").groupBy("query_id", "src", "dst").agg(F.sum("weight").alias("weight"))


def walk_kernel(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, restart: np.ndarray, damping: float, rounds: int) -> np.ndarray:
    """Mass of each vertex (row) and channel (column). What a channel loses at vertices without a way out returns by its own restart."""
    n = len(restart)
    out = np.bincount(src, weight, n)
    share = weight / out[src] if len(src) else weight
    p = restart.copy()
    for _ in range(rounds):
        spread = np.zeros_like(p)
        for c in range(p.shape[1]):
            spread[:, c] = np.bincount(dst, p[src, c] * share, n)
        p = (1 - damping) * restart + damping * (spread + p[out == 0].sum(0)[None] * restart)
    return p


def walk(graph: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(query_id, id, channel, mass) of the queries, each walked in one task.

    seeds: (query_id, id, channel, weight). The weights of a query are scaled to one over
    all its channels. All rounds are run, whatever the size. Queries without seeds have no mass.
    """
    seeds = seeds.select(*(F.col(c).alias(c) for c in ("query_id", "id", "channel", "weight")))  # fresh columns: both sides may share a plan
    q = seeds.schema["query_id"].dataType.simpleString()
    i = seeds.schema["id"].dataType.simpleString()

    def run(edges: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        starts = starts[starts["weight"] > 0]
        if not len(starts):
            return pd.DataFrame({"query_id": [], "id": [], "channel": [], "mass": []})
        m = len(edges)
        at, names = pd.factorize(np.concatenate([edges["src"], edges["dst"], starts["id"]]))
        channels = sorted(starts["channel"].unique())
        restart = np.zeros((len(names), len(channels)))
        np.add.at(restart, (at[2 * m :], [channels.index(c) for c in starts["channel"]]), starts["weight"].to_numpy(float))
        restart /= restart.sum()
        p = walk_kernel(at[:m], at[m : 2 * m], edges["weight"].to_numpy(float), restart, damping, rounds)
        v, c = np.nonzero(p)
        return pd.DataFrame({"query_id": starts["query_id"].iloc[0], "id": names[v], "channel": [channels[k] for k in c], "mass": p[v, c]})

    return graph.groupBy("query_id").cogroup(seeds.groupBy("query_id")).applyInPandas(run, f"query_id {q}, id {i}, channel string, mass double")


def walk_large(graph: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, every: int = 2) -> DataFrame:
    """The same by joins: for graphs that fit no task. Lineage is cut every few rounds."""
    scale = seeds.where("weight > 0").groupBy("query_id").agg(F.sum("weight").alias("_t"))
    # what every round reads again is written once
    restart = cut(seeds.where("weight > 0").join(scale, "query_id").groupBy("query_id", "id", "channel").agg(F.sum(F.col("weight") / F.col("_t")).alias("r")))
    graph = cut(graph.select("query_id", "src", "dst", "weight"))
    out = graph.groupBy("query_id", "src").agg(F.sum("weight").alias("_out"))
    share = cut(graph.join(out, ["query_id", "src"]).select("query_id", F.col("src").alias("id"), "dst", (F.col("weight") / F.col("_out")).alias("share")))
    leaving = cut(out.select("query_id", F.col("src").alias("id"), F.lit(True).alias("_leaves")))
    p = restart.select("query_id", "id", "channel", F.col("r").alias("mass"))
    for k in range(1, rounds + 1):
        spread = p.join(share, ["query_id", "id"]).select("query_id", F.col("dst").alias("id"), "channel", (F.col("mass") * F.col("share") * damping).alias("mass"))
        lost = p.join(leaving, ["query_id", "id"], "left").where("_leaves IS NULL").groupBy("query_id", "channel").agg(F.sum("mass").alias("_lost"))
        back = restart.join(lost, ["query_id", "channel"]).select("query_id", "id", "channel", (F.col("r") * F.col("_lost") * damping).alias("mass"))
        again = restart.select("query_id", "id", "channel", (F.col("r") * (1 - damping)).alias("mass"))
        p = spread.union(back).union(again).groupBy("query_id", "id", "channel").agg(F.sum("mass").alias("mass"))
        if k % every == 0:
            p = cut(p)
    return p


def walked(graph: DataFrame, seeds: DataFrame, slice_edges: int = SLICE, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(query_id, id, channel, mass): small graphs in one task each, those beyond `slice_edges` edges by joins; the same either way."""
    large = graph.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > slice_edges).select("query_id")
    if large.isEmpty():
        return walk(graph, seeds, damping, rounds)
    large = cut(large)
    out = walk(graph.join(large, "query_id", "left_anti"), seeds.join(large, "query_id", "left_anti"), damping, rounds)
    return out.union(walk_large(graph.join(large, "query_id", "left_semi"), seeds.join(large, "query_id", "left_semi"), damping, rounds).select("query_id", "id", "channel", "mass"))


def pagerank(graph: DataFrame, seeds: DataFrame, slice_edges: int = SLICE, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(query_id, id, mass) of all channels together."""
    return walked(graph, seeds, slice_edges, damping, rounds).groupBy("query_id", "id").agg(F.sum("mass").alias("mass"))


def arrivals(graph: DataFrame, mass: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(query_id, src, dst, arrived): what flows over each edge in the resting state."""
    out = graph.groupBy("query_id", "src").agg(F.sum("weight").alias("_out"))
    flows = graph.join(out, ["query_id", "src"]).join(mass.select("query_id", F.col("id").alias("src"), "mass"), ["query_id", "src"])
    return flows.select("query_id", "src", "dst", (damping * F.col("mass") * F.col("weight") / F.col("_out")).alias("arrived"))


def expand(relations: DataFrame, fragments: DataFrame, sources: DataFrame, hub: int = HUB) -> DataFrame:
    """(source, fragment, neighbour, kind, neighbour_source): edges of each source's fragments that lead to fragments of other sources.

    The vertices are fragment ids here: two fragments are neighbours if they mention one
    value. Values of more than `hub` edges conduct nothing, so no value joins more than that
    many fragments with each other.
    """
    calm = without_hubs(relations, hub)
    owned = fragments.where("source IS NOT NULL").select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("v"), "source")
    named = calm.join(owned.withColumnRenamed("v", "src"), "src").select("src", "source", "kind", "dst")
    asked = named.join(sources.select(F.col("id").alias("source")), "source", "left_semi")
    other = named.select(F.col("src").alias("neighbour"), F.col("source").alias("neighbour_source"), "kind", "dst")
    met = asked.join(other, ["kind", "dst"]).where("source <> neighbour_source")
    return met.select("source", F.col("src").alias("fragment"), "neighbour", "kind", "neighbour_source").distinct()
