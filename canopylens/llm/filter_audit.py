"""Filter interaction audit: what each filter removes in every order of the filters, by decision diagrams.

Every document has a mask of the filters that it fails. The masks of a part, with their counts, make a decision diagram:
one level for each filter, a pass and a fail branch at each node, counts at the leaves, equal nodes kept once. Two
neighbouring levels are swapped in place, and swaps lead through all orders. In each order the path of all passes meets
the filters step by step: what its fail branches weigh is what the steps remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopylens.llm.common import UPPER, cut, forget

FILTERS = "ABCDE"
MIN_WORDS = 200
SYMBOLS = "#$%&*|"
#: What is counted of each mask: documents, and those labelled as good and as toxic.
COUNTS = ("n", "good", "toxic")
REPORT = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Diagram:
    """A decision diagram of counted masks. Every path has all levels, so that a swap touches two levels only.

    counts: {mask: counts}; bit k of a mask is the k-th letter of filters, set where that filter fails.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: str = FILTERS):
        self.order, n = list(filters), len(filters)
        self.kids: dict[int, tuple[int, int]] = {}
        self.weights: dict[int, tuple[int, ...]] = {}
        nothing = (0,) * len(next(iter(counts.values())))
        leaves: dict[tuple, int] = {}
        nodes = []
        for path in range(2**n):  # the first filter decides at the highest bit of a path
            mask = sum(1 << k for k in range(n) if path >> (n - 1 - k) & 1)
            weight = counts.get(mask, nothing)
            nodes.append(leaves.setdefault(weight, len(self.weights)))
            self.weights[nodes[-1]] = weight
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(n)]
        for level in reversed(range(n)):
            nodes = [self._node(level, lo, hi) for lo, hi in zip(nodes[::2], nodes[1::2], strict=True)]
        self.root = nodes[0]

    def _node(self, level: int, lo: int, hi: int) -> int:
        """The node of a level with these branches (pass, fail), made if there is none."""
        if (lo, hi) not in self.levels[level]:
            new = self.levels[level][lo, hi] = max(self.weights) + 1
            self.kids[new] = (lo, hi)
            self.weights[new] = tuple(a + b for a, b in zip(self.weights[lo], self.weights[hi], strict=True))
        return self.levels[level][lo, hi]

    def swap(self, k: int) -> None:
        """Exchange levels k and k + 1. Nodes of level k keep their place and weight, those below are made anew."""
        upper, lower = self.levels[k], self.levels[k + 1]
        grandkids = {node: (*self.kids[lo], *self.kids[hi]) for (lo, hi), node in upper.items()}
        self.levels[k], self.levels[k + 1] = {}, {}
        for node in lower.values():
            del self.kids[node], self.weights[node]
        for node, (pass_pass, pass_fail, fail_pass, fail_fail) in grandkids.items():
            self.kids[node] = (self._node(k + 1, pass_pass, fail_pass), self._node(k + 1, pass_fail, fail_fail))
            self.levels[k][self.kids[node]] = node
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> list[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept after it, counts it removes) along the path of all passes."""
        out, node = [], self.root
        for letter in self.order:
            lo, hi = self.kids[node]
            out.append((letter, self.weights[lo], self.weights[hi]))
            node = lo
        return out


def adjacent_swaps(n: int) -> list[int]:
    """Swaps of places (k, k + 1) that lead through all orders of n things, each once: one thing wanders to and fro."""
    if n < 2:
        return []
    down = list(range(n - 2, -1, -1))
    out = list(down)
    for i, k in enumerate(adjacent_swaps(n - 1)):
        out += [k, *down] if i % 2 else [k + 1, *down[::-1]]
    return out


def all_orders(counts: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of a part."""
    fails = {f: sum(c[0] for mask, c in counts.items() if mask >> k & 1) for k, f in enumerate(filters)}
    alone = {f: counts.get(1 << k, (0,))[0] for k, f in enumerate(filters)}
    diagram = Diagram(counts, filters)
    steps = [("".join(diagram.order), diagram.steps())]
    for k in adjacent_swaps(len(filters)):
        diagram.swap(k)
        steps.append(("".join(diagram.order), diagram.steps()))
    shapley = dict.fromkeys(filters, 0)
    for _, path in steps:
        for f, _, removed in path:
            shapley[f] += removed[0]
    return [
        (order, step, f, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], shapley[f])
        for order, path in steps for step, (f, kept, removed) in enumerate(path, 1)
    ]


def failures(text: str | None) -> tuple[bytes, int]:
    """The SHA-256 of a text, and the mask of the filters A to D that it fails. A null text is empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, UPPER.encode()))
    symbols = len(raw) != len(raw.translate(None, SYMBOLS.encode()))
    fails = (len(words) < MIN_WORDS, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), symbols)
    return hashlib.sha256(raw).digest(), sum(1 << k for k, f in enumerate(fails) if f)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with digest and mask instead of the text. Every row is judged alone and whole."""
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("digest", T.BinaryType()), T.StructField("mask", T.IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = [failures(t) for t in batch.column(text).to_pylist()]
                new = [pa.array([d for d, _ in rows], pa.binary()), pa.array([m for _, m in rows], pa.int32())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *new], names=[*others, "digest", "mask"])

    return docs.mapInArrow(judge, schema)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of each part fail which filters. At most 32 rows a part.

    docs: (doc_id, text, lang). A null lang is the part of the empty string. A document is good or toxic if any label of
    its id says so; null ids have none. Filter E fails where a smaller doc_id has an equal text: equal rows are counted
    first, then texts by SHA-256, part and labels, so that no task meets all copies of a text. Null ids are neither
    smaller nor larger than others and pass it, as do rows that repeat the smallest id itself.
    """
    rows = judged(docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part")))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("c"))
    # null ids meet no label, and are dealt by their text
    rows = rows.withColumns({"unknown": F.col("doc_id").isNull(), "key": F.coalesce("doc_id", F.xxhash64("digest"))})
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marked.withColumn("unknown", F.lit(False)), ["key", "unknown"], "left").fillna(0, ["good", "toxic"])
    same = rows.groupBy("digest", "mask", "part", "unknown", "good", "toxic").agg(F.sum("c").alias("n"), F.min(F.struct("doc_id", "c")).alias("least"))
    first = F.min(F.when(~F.col("unknown"), F.col("least.doc_id"))).over(Window.partitionBy("digest"))
    firsts = F.when(F.col("unknown"), F.col("n")).when(F.col("least.doc_id") == first, F.col("least.c")).otherwise(0)
    same = cut(same.withColumn("firsts", firsts).select("part", "mask", "good", "toxic", "n", "firsts"), "audit-masks")
    copies = F.array(F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    each = same.select("part", "good", "toxic", F.inline(copies)).where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """REPORT: every part, order of the filters and step. counted: (part, mask, n, good, toxic), a row for each mask."""

    def orders(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): tuple(map(int, c)) for m, *c in pdf[["mask", *COUNTS]].itertuples(index=False)}
        rows = pd.DataFrame(all_orders(counts, filters), columns=[c.split(" ")[0] for c in REPORT.split(", ")[1:]])
        rows.insert(0, "part", pdf["part"].iloc[0])
        return rows

    return counted.groupBy("part").applyInPandas(orders, REPORT)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all documents. An empty table has no parts and gives no rows."""
    return audit(masks(docs, labels))


def oracle() -> str:
    """DuckDB SQL with the same filters, every order by itself."""
    word = r"[^\x20\x09-\x0D]+"
    fails = lambda f: f"(mask >> {FILTERS.index(f)}) & 1 = 1"
    passed = " and ".join(f"(not ({fails(f)}) or position('{f}' in filter_order) >= step)" for f in FILTERS)
    own = " or ".join(f"(filter = '{f}' and {fails(f)})" for f in FILTERS)
    only = " or ".join(f"(filter = '{f}' and mask = {1 << k})" for k, f in enumerate(FILTERS))
    return f"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{word}') as words from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(words) < {MIN_WORDS} then 1 else 0 end + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
    + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 4 else 0 end
    + case when regexp_matches(text, '[{SYMBOLS}]') then 8 else 0 end
    + case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end as mask from d left join l using (doc_id)),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by 1, 2),
f as (select unnest(string_split('{",".join(FILTERS)}', ',')) as f),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from f a, f b, f c, f d, f e
    where a.f not in (b.f, c.f, d.f, e.f) and b.f not in (c.f, d.f, e.f) and c.f not in (d.f, e.f) and d.f <> e.f),
s as (select filter_order, cast(step as integer) as step, filter_order[step] as filter from (select filter_order, unnest(range(1, 6)) as step from o)),
r as (select part, filter_order, step, filter, n, good, toxic, {passed} as here, {own} as own, {only} as alone from c, s),
t as (select part, filter_order, step, filter, coalesce(sum(n) filter (here and not own), 0) as kept, coalesce(sum(n) filter (here and own), 0) as removed,
    coalesce(sum(n) filter (own and not here), 0) as redundant, coalesce(sum(n) filter (alone), 0) as unique_fails,
    coalesce(sum(good) filter (here and own), 0) as good_lost, coalesce(sum(toxic) filter (here and own), 0) as toxic_lost from r group by 1, 2, 3, 4)
select part, filter_order, step, filter, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
    cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, filter) as bigint) as shapley from t"""
