"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Every distinct vector is dealt to a shard. Inside a shard, greedy searches over the graph so far propose neighbours for
each new vector; pruning keeps a near one and drops those that it covers within a relaxed distance, so that edges point
in diverse directions. A query runs a beam search in every shard; the exact distances of what it found are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopylens.llm.common import cut

SHARD_VECTORS = 4096
QUERY_BLOCK = 20_000
DEGREE = 32
BEAM = 64
ALPHA = 1.2
K = 10


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the beam nearest vectors that greedy search meets, for all queries at once.

    graph: a row of neighbours for each vector, filled up with -1. Missing places are -1 at infinite distance.
    """
    b, far = len(queries), x.dtype.type(np.inf)
    ids = np.full((b, beam), -1, np.int32)
    dist = np.full((b, beam), far, x.dtype)
    ids[:, 0], dist[:, 0] = entry, ((queries - x[entry]) ** 2).sum(1)
    seen = np.zeros((b, beam), bool)
    live = np.arange(b)
    while len(live):
        open_dist = np.where(seen[live] | (ids[live] < 0), far, dist[live])
        at = open_dist.argmin(1)
        live = live[np.isfinite(open_dist[np.arange(len(live)), at])]
        if not len(live):
            break
        open_dist = np.where(seen[live] | (ids[live] < 0), far, dist[live])
        at = open_dist.argmin(1)
        seen[live, at] = True
        near = graph[ids[live, at]]
        gap = x[near] - queries[live, None, :]
        d = np.einsum("bri,bri->br", gap, gap)
        known = (near[:, :, None] == ids[live][:, None, :]).any(2)
        d[known | (near < 0)] = far
        all_ids, all_d = np.hstack([ids[live], near]), np.hstack([dist[live], d])
        all_seen = np.hstack([seen[live], np.zeros(near.shape, bool)])
        best = np.argsort(all_d, 1, kind="stable")[:, :beam]
        ids[live], dist[live], seen[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_d, all_seen))
        ids[live] = np.where(np.isfinite(dist[live]), ids[live], -1)
    return ids, dist


def robust_prune(x: np.ndarray, p: int, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The neighbours of p among candidates: nearest first, without what a chosen one covers within distance / alpha."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != p)])
    d = ((x[candidates] - x[p]) ** 2).sum(1)
    order = np.argsort(d, kind="stable")
    candidates, d = candidates[order], d[order]
    own = x[candidates]
    norm = (own * own).sum(1)
    between = (norm[:, None] + norm[None, :] - 2 * own @ own.T) * (alpha * alpha)
    alive, out = np.ones(len(candidates), bool), []
    for k in range(len(candidates)):
        if alive[k]:
            out.append(candidates[k])
            if len(out) == degree:
                break
            alive &= between[k] > d
    return np.array(out, np.int32)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 256) -> tuple[np.ndarray, int]:
    """Neighbours of each vector, and the vector to enter at: the one nearest to the mean."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(1).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])

    def link(p: int, found: np.ndarray) -> None:
        keep = robust_prune(x, p, found, degree, alpha)
        graph[p], graph[p, : len(keep)] = -1, keep

    done, size = 1, 1
    while done < n:
        new = order[done : done + size]
        found, _ = beam_search(x, graph, entry, x[new], beam)
        for p, f in zip(new, found, strict=True):
            link(p, np.concatenate([f, graph[p]]))
        back: dict[int, list[int]] = {}
        for p in new:
            for q in graph[p][graph[p] >= 0]:
                back.setdefault(int(q), []).append(p)
        for q, ps in back.items():
            had = graph[q][graph[q] >= 0]
            both = np.unique(np.concatenate([had, np.array(ps, np.int32)]))
            if len(both) <= degree:
                graph[q], graph[q, : len(both)] = -1, both
            else:
                link(q, both)
        done, size = done + len(new), min(batch, max(1, done))
    return graph, entry


def scaled(*parts: np.ndarray) -> list[np.ndarray]:
    """parts, vectors in double precision, divided by the largest component of all; nearness stays the same.

    In single precision, but where a vector is so much smaller that the squares of its components would be lost.
    """
    sizes = np.concatenate([np.abs(p).max(1, initial=0) for p in parts])
    top = sizes.max(initial=0) or 1.0
    kind = np.float32 if sizes.min(initial=top) > 1e-12 * top else np.float64
    return [(p / top).astype(kind) for p in parts]


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector of finite components of any size that are not all zero.

    Distances whose squares exceed double precision are infinite, and settled by the smaller id.
    """
    v = F.col(embedding)
    whole = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    return rows.where(whole & F.exists("v", lambda c: c != 0))


def partitions(groups: int | None) -> int:
    """How many partitions so many groups are dealt to by hash: few groups to four times as many, so that few meet."""
    groups = max(1, groups or 0)
    return max(groups, min(4 * groups, 1000))


def build_index(rows: DataFrame, k: int = K, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """(dim, shard, parts, place, v, ids, near): the graph's rows, as Parquet in the shared folder.

    Equal vectors are one: of their ids the k + 1 smallest can be among the k nearest of any query. Vectors of different
    lengths are never compared; each length has its own shards.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = rows.distinct().withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = cut(distinct.withColumn("dim", F.size("v")), "vectors")
    parts = distinct.groupBy("dim").agg(F.ceil(F.count("*") / shard_vectors).cast("int").alias("parts"))
    dealt = distinct.join(parts, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda i: i[0]), ignore_index=True)
        graph, entry = build_graph(*scaled(np.stack(pdf["v"].to_list()).astype(np.float64)))
        return pdf.assign(place=np.arange(len(pdf)), near=[g[g >= 0].tolist() for g in graph], entry=entry)[["dim", "parts", "shard", "place", "entry", "v", "ids", "near"]]

    # shards are small in bytes and large in work: each gets a partition, which Spark doesn't put together again
    n = partitions(parts.agg(F.sum("parts")).first()[0])
    kind = rows.schema["v"].dataType.simpleString()
    schema = f"dim int, parts int, shard int, place int, entry int, v {kind}, ids array<long>, near array<int>"
    return cut(dealt.select("dim", "parts", "shard", "v", "ids").repartition(n, "dim", "shard").groupBy("dim", "shard").applyInPandas(build, schema), "graph")


def search(index: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (vec_id, v), itself left out.

    Nearest first, ties to the smaller id. An id with several vectors is a neighbour by the nearest of them, and a query
    of its own for each, of which the nearest found together count. score: the Euclidean distance in double precision. Fewer rows where the index
    has fewer. Queries go to the shards of their length in blocks; no task holds more than one block and one shard.
    """
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    shards = index.groupBy("dim").agg(F.max("parts").alias("parts"))
    asked = queries.withColumn("dim", F.size("v")).join(shards, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("shard"), "block", "vec_id", "v")
    graph = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def answer(key: tuple, nodes: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(nodes) and len(wanted):
            nodes = nodes.sort_values("place", ignore_index=True)
            exact = np.stack(nodes["v"].to_list()).astype(np.float64)
            near = nodes["near"].to_list()
            graph = np.full((len(exact), max(1, max(map(len, near)))), -1, np.int32)
            for i, g in enumerate(near):
                graph[i, : len(g)] = g
            ids, q = nodes["ids"].to_list(), np.stack(wanted["v"].to_list()).astype(np.float64)
            x, asked_for = scaled(exact, q)
            for first in range(0, len(q), 256):
                found, _ = beam_search(x, graph, int(nodes["entry"][0]), asked_for[first : first + 256], beam)
                for qid, qv, f in zip(wanted["vec_id"][first : first + 256], q[first : first + 256], found, strict=True):
                    f = f[f >= 0]
                    scores = np.sqrt(((exact[f] - qv) ** 2).sum(1))
                    best = sorted((s, i) for s, p in zip(scores, f, strict=True) for i in ids[p] if i != qid)[:k]
                    out["query_id"] += [qid] * len(best)
                    out["vec_id"] += [i for _, i in best]
                    out["score"] += [s for s, _ in best]
        return pd.DataFrame(out)

    keys = ["dim", "shard", "block"]
    n = partitions((shards.agg(F.sum("parts")).first()[0] or 0) * blocks)
    found = graph.repartition(n, *keys).groupBy(*keys).cogroup(asked.repartition(n, *keys).groupBy(*keys)).applyInPandas(answer, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """The k nearest of each vector whose id is divisible by every."""
    rows = usable(vectors)
    return search(build_index(rows, k), rows.where(F.col("vec_id") % every == 0), k)
