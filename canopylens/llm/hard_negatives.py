"""Hard-negative mining by slots of scores.

An anchor's positives set upper limits on the scores of its negatives. The distinct limits of an anchor, from the highest
down, cut all scores below the highest one into disjoint slots. Tasks keep the best few candidates of each slot; they are
added up slot by slot. A positive's window is its own slot and all below, so merging the slots from the lowest up gives
the best of every window, and its lower limit then cuts off the end. No window is searched by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopylens.llm.common import cut
from canopylens.llm.neighbours import partitions

ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: The window of a positive of score p: 50 p <= 100 n <= 95 p.
LOW, HIGH = 50, 95
#: Rows and anchors that a task meets at once; anchors are compared so many at a time.
ROW_BLOCK, ANCHOR_BLOCK, AT_ONCE = 8_192, 16_384, 64
LEAST, MOST = -(2**63), 2**63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, one for each id: of rows that repeat an id the smallest one.

    They have an id, a label and a vector without null or non-finite components; the labels of every seventh id move on.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    rows = rows.dropna().where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.withColumn("label", moved).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def whole_numbers(vectors: pd.Series) -> np.ndarray:
    """floor(256 x) of every component, in double precision: a row for each vector."""
    return np.floor(256 * np.stack(vectors.to_list()).astype(np.float64)) if len(vectors) else np.zeros((0, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a and b, exact.

    In double precision where no sum can leave its whole numbers, else in numbers of any length; what no long can hold
    is set to the nearest one.
    """
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, LEAST, MOST).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k highest allowed scores of each row; ties go to the smaller id. ids ascend."""
    if scores.shape[1] > k:
        masked = np.where(allowed, scores, LEAST)
        edge = scores.shape[1] - k
        allowed = allowed & (masked >= np.partition(masked, edge, axis=1)[:, edge, None])
    row, at = np.nonzero(allowed)
    order = np.lexsort((ids[at], ~scores[row, at], row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], ids[at[keep]], scores[row[keep], at[keep]]


def meet(anchors: DataFrame, rows: DataFrame, kept, schema: str) -> DataFrame:
    """kept(anchors, rows, scores) of every block of anchors with every block of rows of vectors of the same length.

    anchors and rows: (dim, vec_id, label, v), anchors with further columns. No task holds more than a block of each.
    """
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / ROW_BLOCK).alias("row_blocks"))
    sizes = cut(sizes.join(anchors.groupBy("dim").agg(F.ceil(F.count("*") / ANCHOR_BLOCK).alias("anchor_blocks")), "dim"), "hard-blocks")
    tasks = sizes.agg(F.sum(F.col("row_blocks") * F.col("anchor_blocks"))).first()[0] or 1
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    drop = ("row_blocks", "anchor_blocks")
    left = anchors.join(sizes, "dim").withColumns({"a": block("anchor_blocks"), "b": every("row_blocks")}).drop(*drop)
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # the anchors come from the same table
    right = rows.join(sizes, "dim").withColumns({"b": block("row_blocks"), "a": every("anchor_blocks")}).drop(*drop)

    def scored(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some) and len(others):
            some, others = some.sort_values("vec_id", ignore_index=True), others.sort_values("vec_id", ignore_index=True)
            a, b = whole_numbers(some["v"]), whole_numbers(others["v"])
            for at in range(0, len(some), AT_ONCE):
                out.append(kept(some.iloc[at : at + AT_ONCE], others, products(a[at : at + AT_ONCE], b)))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split(" ")[0]: [] for c in schema.split(", ")})

    keys, n = ["dim", "a", "b"], partitions(int(tasks))
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInPandas(scored, schema)


def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """found with rank: the k first of each key, by score from above, then by other_id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives(anchors: DataFrame, rows: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, other_id, score, rank): the first k other rows of each anchor's label."""

    def kept(some: pd.DataFrame, others: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        ids, own = others["vec_id"].to_numpy(), some["vec_id"].to_numpy()
        allowed = (some["label"].to_numpy()[:, None] == others["label"].to_numpy()) & (own[:, None] != ids)
        row, other, score = best(scores, ids, allowed, k)
        return pd.DataFrame({"anchor_id": own[row], "other_id": other, "score": score})

    return first(meet(anchors, rows, kept, "anchor_id long, other_id long, score long"), ["anchor_id"], k)


def high(score: Column) -> Column:
    """The highest score that a negative may have beside a positive of this score: floor(HIGH * score / 100)."""
    return F.call_function("div", score, F.lit(100)) * HIGH + F.floor(score % 100 * HIGH / 100)


def in_slots(anchors: DataFrame, rows: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """(anchor_id, slot, other_id, score): the first k rows of another label in each slot of each anchor.

    anchors have limits, from the highest down; slot s holds scores from limits[s] down to above limits[s + 1].
    """

    def kept(some: pd.DataFrame, others: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        ids, own, limits = others["vec_id"].to_numpy(), some["vec_id"].to_numpy(), some["limits"].to_list()
        differs = some["label"].to_numpy()[:, None] != others["label"].to_numpy()
        out = []
        for slot in range(max(map(len, limits))):
            has = np.array([slot < len(x) for x in limits])
            top = np.array([x[slot] if slot < len(x) else 0 for x in limits], np.int64)
            lasts = np.array([slot + 1 >= len(x) for x in limits])
            under = np.array([x[slot + 1] if slot + 1 < len(x) else 0 for x in limits], np.int64)
            allowed = differs & has[:, None] & (scores <= top[:, None]) & (lasts[:, None] | (scores > under[:, None]))
            row, other, score = best(scores, ids, allowed, k)
            out.append(pd.DataFrame({"anchor_id": own[row], "slot": np.int32(slot), "other_id": other, "score": score}))
        return pd.concat(out, ignore_index=True)

    return first(meet(anchors, rows, kept, "anchor_id long, slot int, other_id long, score long"), ["anchor_id", "slot"], k)


def windows(slots: Column, n_slots: Column, k: int = NEGATIVES) -> Column:
    """The first k of every suffix of slots: element s has those of slot s and all below.

    slots: array of (slot, back, other_id); back is the score with all bits turned, which ascends where scores descend.
    From the lowest slot up, what the suffix below it has is merged with the slot's own.
    """
    own = lambda s: F.transform(F.filter(slots, lambda x: x["slot"] == s), lambda x: F.struct(x["back"].alias("back"), x["other_id"].alias("other_id")))
    nothing = F.expr("cast(array(array()) as array<array<struct<back:bigint,other_id:bigint>>>)")
    step = lambda done, s: F.concat(F.array(F.slice(F.sort_array(F.concat(own(s), done[0])), 1, k)), done)
    return F.aggregate(F.sequence(n_slots - 1, F.lit(0), F.lit(-1)), nothing, step)


def mine(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), at most NEGATIVES rows a positive.

    Rows with null ids, labels, vectors or components, or with non-finite components take no part; rows of one id are
    one row; vectors of different lengths never meet. Vectors of any finite size are taken exactly. An anchor without
    positives, and a positive without negatives in its window, give no row, as does an empty table.
    """
    rows = cut(usable(vectors).withColumn("dim", F.size("v")), "hard-rows")
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    found = cut(positives(anchors, rows).withColumn("high", high(F.col("score"))), "hard-positives")
    limits = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("high"), False).alias("limits"))  # at most POSITIVES
    slots = cut(in_slots(anchors.join(limits, "vec_id"), rows), "hard-slots")

    back = F.bitwise_not("score").alias("back")
    kept = slots.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", back, "other_id")).alias("kept"))  # at most POSITIVES x NEGATIVES
    best_of = kept.join(limits.withColumnRenamed("vec_id", "anchor_id"), "anchor_id").withColumn("windows", windows(F.col("kept"), F.size("limits"))).drop("kept")
    pairs = found.join(best_of, "anchor_id").withColumn("window", F.get("windows", F.array_position("limits", F.col("high")).cast("int") - 1))
    wide = lambda score: score.cast("decimal(20,0)")
    inside = F.filter("window", lambda x: wide(F.col("score")) * LOW <= wide(F.bitwise_not(x["back"])) * 100)
    out = pairs.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(inside).alias("at", "n"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.other_id").alias("negative_id"), "positive_score", F.bitwise_not("n.back").alias("negative_score"))


def oracle() -> str:
    """DuckDB SQL: all anchors with all rows, every window by itself."""
    return f"""
with r as (select vec_id, case when vec_id % {RELABEL_EVERY} = 0 then (label + 1) % {LABELS} else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0) as bigint) as s
    from r a, r b where a.vec_id % {ANCHOR_EVERY} = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= {POSITIVES}),
n as (select p.a, p.b as p, s.b as n, p.s as ps, s.s as ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) as rank
    from p join s on p.a = s.a and not s.same and {LOW} * p.s <= 100 * s.s and 100 * s.s <= {HIGH} * p.s)
select a as anchor_id, p as positive_id, cast(rank as integer) as rank, n as negative_id, ps as positive_score, ns as negative_score from n where rank <= {NEGATIVES}"""
