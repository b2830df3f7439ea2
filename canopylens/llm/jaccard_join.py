"""N-gram Jaccard join by a token-group matrix, exact.

Documents are sets of shingles. Equal sets are one node. Similar nodes are put into groups: nodes with an equal minimum
hash are compared with one of them, and those found similar form clusters, dealt into groups of bounded size. The matrix
says which tokens a group holds; it keeps those tokens that decide: of each node the first ones in hash order, so many
that similar nodes share a known number of them. A group is opened for another one only where enough of these tokens
are shared by their clusters, the smaller asking the groups of the larger, and where a query's overlap with the union of all tokens of the group reaches what similarity asks for.

Why no link is lost. Let p(n) = n - ceil(t n) + 1 and L(n) >= p(n) the tokens kept of a node of n tokens. Nodes a and b
of similarity t or more overlap in at least t max(|a|, |b|) tokens, so that they share at least
min(L(a) - p(a), L(b) - p(b)) + 1 of the kept ones. Tokens in more than COMMON clusters are not followed; a node with h
such tokens shares at least extra(a) - h others with each partner, where extra is the least shared number over all
partner sizes. Nodes for which that is not positive ("deep") can only be missed by other deep nodes of another component.
Of those all tokens are counted: a deep node stays in question if t of its tokens or more occur in another component of
deep nodes, and of two linked ones each has a shared token among its first p(n), when tokens are ordered by how many
deep nodes hold them, rarest first. Deep nodes form groups by their most common token, and only groups that have such a
token in common are opened for one another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopylens.llm.common import cut, forget, n_words, sent_if_small, shielded
from canopylens.llm.components import components

WORDS = 5
#: Similarity in hundredths.
SIMILAR = 80
MIN_HASHES = 3
#: Clusters up to which a token is followed; nodes of a group; queries that one task compares with a group.
COMMON = 16
GROUP = 48
QUERIES = 256
#: Kept tokens of all nodes that one task counts.
RANGE_TOKENS = 500_000
#: Nodes whose tokens a task holds at once.
NODES = 2_000
#: Texts that a task remembers, so as not to write the tokens of each of many copies.
MET = 200_000
#: Nodes of a group of deep nodes.
DEEP_GROUP = 256
_M = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * _M[1]
    h = (h ^ (h >> np.uint64(27))) * _M[2]
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Ordered distinct 64-bit hashes of each text's shingles; of all its words as one if there are fewer."""
    ids: dict[bytes, int] = {}
    local: list[np.ndarray] = []
    for t in texts:
        own = (t or "").encode().lower().split()
        local.append(np.fromiter((ids.setdefault(w, len(ids)) for w in own), np.int32, len(own)))
    lengths = [len(x) for x in local]
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in ids] or [0], np.uint64)
    h = hashes[np.concatenate(local)] if local else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = mix(rolled * _M[0] + h[k : k + len(rolled)])
    out, at = [], 0
    for n in lengths:
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(h[at : at + n].tobytes(), n)], np.uint64) if n else np.zeros(0, np.uint64))
        at += n
    return out


def least_overlap(n: int) -> int:
    return -(-SIMILAR * n // 100)


def kept(n: int) -> int:
    """How many tokens of a node of n are kept: half again its prefix, 8 more at least."""
    prefix = n - least_overlap(n) + 1
    return min(n, max(prefix + 8, prefix + prefix // 2))


def extra(n: int) -> int:
    """Kept tokens that a node of n shares at least with any partner. Partners have ceil(t n) tokens or more."""
    spare = lambda m: kept(m) - (m - least_overlap(m) + 1)
    low, high = least_overlap(n), 100 * n // SIMILAR
    return 1 + min(spare(m) for m in {*range(low, min(low + 60, high) + 1), n})


def _extra(n: Column) -> Column:
    """extra() of a column: for up to 400 tokens from a table, beyond that a lower bound of it."""
    table = F.array(*[F.lit(extra(k)) for k in range(1, 401)])
    return F.when(n <= 400, F.get(table, n.cast("int") - 1)).otherwise(F.floor(n * (0.08 - 0.002)) - 2).cast("int")


def keys(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)})


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, k1, k2, n, set, mins, low): of each row the hashes of its text, its set's size, digest, minimum hashes and
    kept tokens. A row of a text that the task has met before has no tokens."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seeds = [mix(np.array([k + 1], np.uint64))[0] for k in range(MIN_HASHES)]
        met: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = shingle_sets(b.column(3).to_pylist())
                mins = [[int(mix(s ^ k).min().astype(np.int64)) for k in seeds] if len(s) else [] for s in sets]
                low = []
                for key, s in zip(b.column(1).to_pylist(), sets, strict=True):
                    low.append(None if key in met or not len(s) else s[: kept(len(s))].tobytes())
                    if len(met) < MET:
                        met.add(key)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(mins, pa.list_(pa.int64())), pa.array(low, pa.binary())],
                    names=["doc_id", "k1", "k2", "n", "set", "mins", "low"])

    rows = keys(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")), "_text")
    return rows.select("doc_id", "k1", "k2", "_text").mapInArrow(sign, "doc_id long, k1 long, k2 long, n long, set binary, mins array<long>, low binary")


def texts_of(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(k1, k2, _text): the text of each of the keys of rows, once."""
    needed = rows.select("k1", "k2").distinct()
    return keys(docs.select(F.col(text).alias("_text")), "_text").join(sent_if_small(needed), ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("_text").alias("_text"))


def open_groups(members: DataFrame, asks: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Links (a, b) between queries and members of the groups that they open.

    Of the links of a task only those come out that connect what others have not: they reach the same nodes.

    members, asks: (gid, node). Queries of a group are dealt to tasks of QUERIES each, which all get the group's texts.
    """
    parts = asks.groupBy("gid").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    asked = asks.join(parts, "gid").select("gid", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", F.lit(True).alias("query"))
    held = members.join(parts, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", F.lit(False).alias("query"))
    rows = cut(asked.unionByName(held).join(nodes.select("node", "k1", "k2"), "node"), "asked")

    def compare(t: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        query, names, a, b = t.column("query").to_pylist(), t.column("node").to_pylist(), [], []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        sets = shingle_sets(t.column("_text").to_pylist())
        held = [i for i, q in enumerate(query) if not q]
        sizes = np.array([len(sets[i]) for i in held], np.int64)
        token = np.concatenate([sets[i] for i in held]) if held else np.zeros(0, np.uint64)
        order = np.argsort(token, kind="stable")
        token, of = token[order], np.repeat(np.arange(len(held)), sizes)[order]
        for i, q in enumerate(query):
            if not q or not len(token):
                continue
            s = sets[i]
            first = np.searchsorted(token, s)
            times = np.searchsorted(token, s, "right") - first
            if 100 * int((times > 0).sum()) < SIMILAR * len(s):  # the overlap with the union of all tokens of the group
                continue
            at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
            both = np.bincount(of[at], minlength=len(held))
            for j in np.flatnonzero(100 * both >= SIMILAR * (len(s) + sizes - both)):
                if (x := root(names[i])) != (y := root(names[held[j]])):
                    a.append(names[i])
                    b.append(names[held[j]])
                    parent[x] = y
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    texts = rows.join(texts_of(rows, docs, text), ["k1", "k2"]).select("gid", "part", "node", "query", "_text")
    return cut(texts.groupBy("gid", "part").applyInArrow(compare, "a long, b long"), "links")


def stars(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(gid, node): each node (node, n, keys) with the first one of the same keys, if their sizes allow a link."""
    heads = keyed.groupBy(*keys).agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("node", *keys).alias("h"), "node", "n")).alias("head")).where("c > 1")
    heads = heads.select(*keys, F.col("head.node").alias("gid"), F.col("head.n").alias("head_n"))
    return cut(keyed.join(heads, keys).where(f"node <> gid and 100 * least(n, head_n) >= {SIMILAR} * greatest(n, head_n)").select("gid", "node").distinct(), "stars")


def deep_tokens(deep: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, n, cluster, tokens) of the deep nodes (node, n, cluster, k1, k2): all their tokens."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                tokens = [s.astype(np.int64) for s in shingle_sets(b.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(tokens, pa.list_(pa.int64()))], names=["node", "n", "cluster", "tokens"])

    rows = deep.join(texts_of(deep, docs, text), ["k1", "k2"]).select("node", "n", "cluster", "_text")
    return cut(rows.mapInArrow(sets, "node long, n long, cluster long, tokens array<long>"), "deep-tokens")


def deep_links(deep: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Links between deep nodes (node, n, cluster, k1, k2) of different clusters.

    A node stays in question if enough of its tokens occur in another cluster; its probes are those of them that come
    first, by how many nodes hold them. Groups hold nodes with the same most common token; those of one large cluster
    have groups of their own. The nodes of a group ask each group that has a probe in common with it, unless both are
    one cluster. So the rows that joins make grow with the number of groups that share a token, not of nodes.
    """
    own = deep_tokens(deep, docs, text)
    each = own.select("node", "cluster", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("df"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo <> hi").select("token", "df")
    ranked = each.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    known = own.select("node", "n", "cluster").join(ranked, "node").where(f"100 * size(t) >= {SIMILAR} * n")
    prefix = F.col("n") - F.ceil(F.col("n") * SIMILAR / 100) + 1
    probes = F.transform(F.slice("t", F.lit(1), (prefix - F.col("n") + F.size("t")).cast("int")), lambda x: x["token"])
    of = cut(known.select("node", "cluster", probes.alias("probes"), F.element_at("t", -1)["token"].alias("h")), "deep-probes")

    many = of.groupBy("h", "cluster").agg(F.count("*").alias("c")).withColumn("own", F.when(F.col("c") >= DEEP_GROUP, F.col("cluster")))
    parts = many.groupBy("h", "own").agg(F.ceil(F.sum("c") / DEEP_GROUP).alias("parts")).withColumnsRenamed({"h": "ph", "own": "po"})
    dealt = of.join(many.select("h", "cluster", "own"), ["h", "cluster"]).join(parts, F.col("h").eqNullSafe(F.col("ph")) & F.col("own").eqNullSafe(F.col("po")))
    dealt = cut(dealt.select("node", "cluster", "probes", F.xxhash64("h", "own", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("gid")), "deep-groups")
    groups = dealt.groupBy("gid").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
    holds = dealt.select("gid", F.explode("probes").alias("token")).distinct()
    pairs = cut(holds.withColumnRenamed("gid", "by").join(holds, "token").where("by <= gid").select("by", "gid").distinct(), "deep-pairs")
    asks = pairs.join(groups, "gid").join(dealt.select(F.col("gid").alias("by"), "node", "cluster"), "by").where("lo <> cluster or hi <> cluster").select("gid", "node")
    held = dealt.select("gid", "node").join(pairs.select("gid").distinct(), "gid")
    return open_groups(held, asks, nodes, docs, text)


def first_links(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Links to one node of each set of nodes with an equal minimum hash."""
    asks = stars(nodes.select("node", "n", F.posexplode("mins").alias("k", "m")), ["k", "m"])
    return open_groups(asks.select("gid").distinct().withColumn("node", F.col("gid")), asks, nodes, docs, text)


def matrix(grouped: DataFrame, signed: DataFrame, tokens: int) -> DataFrame:
    """(kind, a, b, shared): cluster pairs with the kept tokens that they share (kind 0), and nodes a with the number of
    their common tokens, or more (1).

    grouped: (k1, k2, node, n, cluster), one row for each node. A token goes to the task of its range of hashes;
    of a token that is common within one batch of nodes, only as many entries as show that go there.
    """
    ranges = max(1, math.ceil(tokens / RANGE_TOKENS))
    node_type = [("node", "<i8"), ("cluster", "<i8"), ("n", "<i8")]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        done: set[int] = set()
        for number, whole in enumerate(b.slice(at, NODES) for b in batches for at in range(0, b.num_rows, NODES)):
            low, of = [], []
            about = np.rec.fromarrays([whole.column(c).to_numpy() for c in ("node", "cluster", "n")], dtype=node_type)
            for k, (node, s) in enumerate(zip(about["node"].tolist(), whole.column("low").to_pylist(), strict=True)):
                if node not in done:  # copies of a text
                    done.add(node)
                    low.append(np.frombuffer(s, np.uint64))
                    of.append(np.full(len(low[-1]), k))
            if not low:
                continue
            token, of = np.concatenate(low), np.concatenate(of)
            order = np.lexsort((about["cluster"][of], token))
            token, of = token[order], of[order]
            new_token = np.concatenate([[True], token[1:] != token[:-1]])
            new_cluster = new_token | np.concatenate([[True], about["cluster"][of[1:]] != about["cluster"][of[:-1]]])
            starts = np.flatnonzero(new_token)
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(token))))
            rank = np.cumsum(new_cluster) - np.repeat(np.cumsum(new_cluster)[starts], np.diff(np.append(starts, len(token))))
            common = np.bincount(run, new_cluster)[run] > COMMON
            send = ~common | new_cluster & (rank <= COMMON)
            to = ((token >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            out = []
            for r in np.unique(to):
                here = send & (to == r)
                out.append((int(r), token[here].tobytes(), about[of[here]].tobytes()))
            rest = common & ~send
            if rest.any():
                out.append((-1 - number % ranges, token[rest].tobytes(), about[of[rest]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["range", "tokens", "nodes"])

    def count(t: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()])
        about = np.concatenate([np.frombuffer(x, node_type) for x in t.column("nodes").to_pylist()])
        if t.column("range")[0].as_py() < 0:
            return _found([], about["node"])
        order = np.lexsort((about["cluster"], token))
        token, about = token[order], about[order]
        new_token = np.concatenate([[True], token[1:] != token[:-1]])
        new_cluster = new_token | np.concatenate([[True], about["cluster"][1:] != about["cluster"][:-1]])
        starts = np.flatnonzero(new_token)
        sizes = np.diff(np.append(starts, len(token)))
        clusters = np.add.reduceat(new_cluster.astype(np.int64), starts)
        common = np.repeat(clusters > COMMON, sizes)
        pairs: dict[tuple[int, int], int] = {}
        for i in np.flatnonzero((clusters > 1) & (clusters <= COMMON)):
            part = about[starts[i] : starts[i] + sizes[i]]
            first = np.flatnonzero(np.concatenate([[True], part["cluster"][1:] != part["cluster"][:-1]]))
            least, most = np.minimum.reduceat(part["n"], first).tolist(), np.maximum.reduceat(part["n"], first).tolist()
            cluster = part["cluster"][first].tolist()
            for x in range(len(cluster)):
                for y in range(x + 1, len(cluster)):
                    if 100 * most[x] >= SIMILAR * least[y] and 100 * most[y] >= SIMILAR * least[x]:
                        pairs[cluster[x], cluster[y]] = pairs.get((cluster[x], cluster[y]), 0) + 1
        return _found([(a, b, n) for (a, b), n in pairs.items()], about["node"][common])

    rows = signed.where("low is not null").select("k1", "k2", "low").join(sent_if_small(grouped.select("k1", "k2", "node", "cluster", "n")), ["k1", "k2"]).select("node", "cluster", "n", "low")
    return cut(rows.mapInArrow(spread, "range long, tokens binary, nodes binary").repartition(max(2, ranges), "range").groupBy("range").applyInArrow(count, "kind int, a long, b long, shared long"), "matrix")


def _found(pairs: list[tuple[int, int, int]], common: np.ndarray) -> pa.Table:
    node, times = np.unique(common, return_counts=True)
    a = np.concatenate([np.array([p[0] for p in pairs], np.int64), node.astype(np.int64)])
    b = np.concatenate([np.array([p[1] for p in pairs], np.int64), np.zeros(len(node), np.int64)])
    shared = np.concatenate([np.array([p[2] for p in pairs], np.int64), times.astype(np.int64)])
    kind = np.concatenate([np.zeros(len(pairs), np.int32), np.ones(len(node), np.int32)])
    return pa.table([kind, a, b, shared], names=["kind", "a", "b", "shared"])


def join_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component_id, component) of every row.

    component tells components apart whose ids are equal or null; it is null for a text without words. component_id is
    the smallest doc_id that links reach; null ids are left out of this choice, and it is null where all are. A text
    without words and a null one are linked with nothing and keep their own doc_id. Repeated rows are copies; any number
    of copies is one node. A text of any length is one set, held by one task. Ties don't occur: ids are compared, not
    rows. Other columns are left out, whatever their names. An empty table gives an empty table. Sets are compared by
    64-bit hashes of their shingles.
    """
    signed = cut(signatures(docs, doc_id, text), "signed")
    nodes = signed.where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.min("doc_id").alias("least_id"), F.min(F.struct("k1", "k2")).alias("k"), F.first("mins").alias("mins"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "set", "n", "least_id", "k.k1", "k.k2", "mins"), "nodes")
    links = first_links(nodes, docs, text)

    clusters = components(links).withColumnRenamed("component", "cluster")
    grouped = cut(nodes.join(clusters, "node", "left").select("node", "n", "k1", "k2", F.coalesce("cluster", "node").alias("cluster")), "clustered")
    sizes = grouped.groupBy("cluster").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    grouped = cut(grouped.join(sizes, "cluster").select("*", F.when(F.col("parts") > 1, F.xxhash64("cluster", F.pmod(F.xxhash64("node"), F.col("parts")))).otherwise(F.col("cluster")).alias("gid")).drop("parts"), "groups")
    total = grouped.agg(F.sum(F.col("n") * 0.3 + 8)).first()[0] or 0
    found = matrix(grouped, signed, int(total))

    common = found.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("shared").alias("common"))
    weighed = cut(grouped.join(common, "node", "left").withColumn("spare", _extra(F.col("n")) - F.coalesce("common", F.lit(0))), "weighed")
    asked = weighed.groupBy("cluster").agg(F.min("spare").alias("spare"), F.count("*").alias("c"))
    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    for side in ("a", "b"):
        pairs = pairs.join(asked.select(F.col("cluster").alias(side), F.col("spare").alias(f"spare_{side}"), F.col("c").alias(f"c_{side}")), side)
    first = (F.col("c_a") < F.col("c_b")) | (F.col("c_a") == F.col("c_b")) & (F.col("a") < F.col("b"))
    pairs = cut(pairs.where("shared >= greatest(spare_a, spare_b)").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("small"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("large")), "cluster-pairs")
    queries = pairs.join(grouped.select(F.col("cluster").alias("small"), "node"), "small")
    asks = queries.join(grouped.select(F.col("cluster").alias("large"), "gid").distinct(), "large").select("gid", "node").distinct()
    members = grouped.join(pairs.select(F.col("large").alias("cluster")).distinct(), "cluster").select("gid", "node")
    opened = open_groups(members, asks, nodes, docs, text)

    near = links.union(opened)
    deep = weighed.where("spare <= 0").select("node", "n", "k1", "k2").join(components(near), "node", "left")
    deep = cut(deep.select("node", "n", "k1", "k2", F.coalesce("component", "node").alias("cluster")), "deep")
    final = components(near.union(deep_links(deep, nodes, docs, text)))
    of = cut(nodes.join(final, "node", "left").select("set", "least_id", F.coalesce("component", "node").alias("component")), "placed")
    least = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = of.join(least, "component").select("set", "component_id", "component")
    out = signed.join(named, "set", "left")
    return out.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")


def report(docs: DataFrame) -> DataFrame:
    return join_similar(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    found = cut(join_similar(docs), "similar")
    rows = found.where("n_shingles > 0").groupBy("component", "doc_id", "k1", "k2").agg(F.count("*").alias("c"))
    stay = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2", "c")).alias("k"))
    keyed = keys(docs, "text")
    few = stay.select(F.col("k.doc_id").alias("s_id"), F.col("k.k1").alias("s1"), F.col("k.k2").alias("s2"), F.col("k.c").alias("c"))
    out = keyed.join(sent_if_small(few), keyed["doc_id"].eqNullSafe(F.col("s_id")) & (keyed["k1"] == F.col("s1")) & (keyed["k2"] == F.col("s2")))
    once = out.where("c = 1").select(*docs.columns)
    again = out.where("c > 1").dropDuplicates(["doc_id", "k1", "k2"]).select(*docs.columns)
    return once.union(again).union(docs.where(n_words(F.col("text")) == 0))


def stage(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, the one of the smallest (doc_id, k1, k2), null ids last.

    All rows with a null text, an empty one or one without words stay. Of repeated rows one stays. Columns of any name
    come through as they are. An empty table gives an empty table.
    """
    return shielded(docs, ("doc_id", "text"), one_of_each)


def oracle() -> str:
    """DuckDB SQL for report(): all pairs with a common shingle, then the smallest id that links reach."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with recursive w as (select doc_id, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, array_to_string(words[i : i + {WORDS - 1}], ' ') as g
    from (select doc_id, words, unnest(range(1, greatest(2, len(words) - {WORDS - 2}))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from shared join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= {SIMILAR} * (x.n + y.n - c)),
reach(doc_id, r) as (select doc_id, doc_id from documents union select doc_id, b from reach join link on r = a)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id
from documents d left join n using (doc_id) join (select doc_id, min(r) as component_id from reach group by doc_id) using (doc_id)"""
