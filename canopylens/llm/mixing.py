"""Mixing sources to target weights by entropy balancing.

Each source is given a token target. Among all document rates w with 0 <= w <= cap and sum(w * size) = target, entropy
balancing takes the one that is nearest to 1 in relative entropy, each document counting once. The dual of this problem
is convex in one multiplier for each source, and the rate of a document is min(cap, exp(multiplier * size / mean)): an
exponential tilt by its tokens, against the mean size in its source. Newton's method solves the dual; each step is one
aggregation over the numbers of documents of each source and size. Rates are then rounded into whole copies, so that
each source's tokens meet the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopylens.llm.common import cut, n_words, numbered, shielded

CAP = 3.0
WEIGHTS = (1, 2, 3)
#: Newton steps at most, and the share of a target by which a source may miss it before rounding.
NEWTON_STEPS = 60
NEAR = 1e-9
BUCKET_ROWS = 2_000


def weighed(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """sizes with weight: sources by code point, null last, weigh weights[0], weights[1], ..., repeating.

    Sources are dealt to partitions by ranges of names, numbered in each, and each number is raised by the number of
    sources in the partitions before: no task holds all sources.
    """
    name = F.col("source").asc_nulls_last()
    dealt = sizes.repartitionByRange(name).sortWithinPartitions(name)
    placed = cut(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "mix-order")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.col("at") + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    return placed.join(F.broadcast(counts.select("part", before.alias("before"))), "part").withColumn("weight", weight).drop("part", "at", "before")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, n_docs, source_size, target): shares of all tokens by weight, no target above cap times its source.

    sizes: (source, n_docs, source_size). What a full source leaves is shared by weight among the rest, until none is
    above its room; each round is one sum over the sources.
    """
    rows = cut(weighed(sizes, weights).withColumn("room", F.col("source_size") * cap), "mix-sources")
    level = 0.0
    while True:
        full = F.col("room") <= F.col("weight") * level
        total = rows.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("room")).otherwise(0.0)).alias("filled"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not total.open:
            break
        higher = (total.all - total.filled) / total.open
        if higher <= level:
            break
        level = higher
    return rows.select("source", "n_docs", "source_size", F.least("room", F.col("weight") * level).alias("target"))


def rate_of(multiplier: Column, tilt: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(multiplier * tilt))


def solve(cells: DataFrame, wanted: DataFrame, cap: float = CAP, steps: int = NEWTON_STEPS) -> DataFrame:
    """wanted (source, n_docs, source_size, target) with its multiplier: safeguarded Newton steps, all sources at once.

    cells: (source, size, n), the number of documents of each size. Each step sums tokens and slope over them, grouped
    by source. The multiplier stays between one that takes too little and one that takes enough; where a Newton step
    would leave this interval or did not halve what is lacking, the interval is halved instead. Steps end when every
    source is near its target. A source without tokens, or whose target is all of its room, needs no step.
    """
    mean = F.col("source_size") / F.col("n_docs")
    cells = cut(cells.where("size > 0"), "mix-sizes")
    smallest = cells.groupBy("source").agg(F.min("size").alias("_least")).withColumnRenamed("source", "_s")
    at_most = F.log(F.lit(cap)) * F.col("mean") / F.col("_least")
    share = F.log(F.col("target") / F.col("source_size"))
    state = wanted.withColumn("mean", mean).join(smallest, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    state = state.withColumn("multiplier", F.when(F.col("target") >= F.col("source_size") * cap, at_most).when(F.col("target") > 0, F.lit(0.0)))
    # at low every document's rate is the share that is wanted or less, at high every one's is the cap
    state = state.withColumns({"low": F.least(F.lit(0.0), share * F.col("mean") / F.col("_least")), "high": at_most, "before": F.lit(float("inf")), "lacks": F.lit(float("inf"))})
    state = cut(state.drop("_least"), "mix-state")
    for _ in range(steps):
        tilt = F.col("size") / F.col("mean")
        rate = rate_of(F.col("multiplier"), tilt, cap)
        inside = F.when(F.col("multiplier") * tilt < F.log(F.lit(cap)), rate * tilt).otherwise(0.0)
        each = cells.withColumnRenamed("source", "_s").join(state.select("source", "mean", "multiplier"), F.col("_s").eqNullSafe(F.col("source")))
        sums = each.groupBy("_s").agg(F.sum(rate * F.col("size") * F.col("n")).alias("taken"), F.sum(inside * F.col("size") * F.col("n")).alias("slope"))
        now = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("lacks", F.coalesce(F.col("target") - F.col("taken"), F.lit(0.0)))
        there = F.abs("lacks") <= F.col("target") * NEAR
        low, high = F.when(F.col("lacks") >= 0, F.col("multiplier")).otherwise(F.col("low")), F.when(F.col("lacks") >= 0, F.col("high")).otherwise(F.col("multiplier"))
        newton = F.col("multiplier") + F.try_divide(F.col("lacks"), F.col("slope"))
        good = newton.between(low, high) & (F.abs("lacks") <= F.col("before") / 2)
        state = cut(now.select(
            "source", "n_docs", "source_size", "target", "mean", F.when(there | F.col("multiplier").isNull(), F.col("multiplier")).when(good, newton).otherwise((low + high) / 2).alias("multiplier"),
            low.alias("low"), high.alias("high"), F.abs("lacks").alias("before"), "lacks",
        ), "mix-state")
        if state.where(~there & F.col("multiplier").isNotNull()).isEmpty():
            break
    return state.select("source", "n_docs", "source_size", "target", "mean", "multiplier")


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, text: str = "text", source: str = "source") -> DataFrame:
    """docs with size, source_size, target, rate and copies (how often the mix takes the document, 0 to cap).

    Null texts have size 0, and like empty ones rate 1; null sources are one source, last in order. Repeated rows are
    separate documents, which may swap copies. A text of any length is one document, taken whole. Columns of docs with
    these names are replaced; others may have any name but _user_0 and so on. An empty table gives an empty table.

    Rounding: inside buckets of some 2,000 documents, ordered by size, every document's copies are the step of
    the running sum of rates; copies of a row are numbered, and so in buckets of their own. What a source then lacks or has too much is made good on its smallest documents, found
    from the counts of each size. All choices come from hashes of the rows, so that reruns agree.
    """
    new = ["size", "source_size", "target", "rate", "copies"]
    kept = docs.drop(*new)
    return shielded(kept, (text, source), lambda d: _mixed(d, weights, cap, text, source), new)


def _mixed(docs: DataFrame, weights, cap: float, text: str, source: str) -> DataFrame:
    sized = docs.withColumn("size", n_words(F.col(text))).withColumn("_src", F.col(source))
    cells = cut(sized.groupBy(F.col("_src").alias("source"), "size").agg(F.count("*").alias("n")), "mix-cells")
    sums = cells.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = solve(cells, targets(sums, weights, cap), cap).withColumnsRenamed({"source": "_p_src", "n_docs": "_n_docs", "multiplier": "_mult", "mean": "_mean"})

    sized = numbered(docs).withColumn("size", n_words(F.col(text))).withColumn("_src", F.col(source))
    rated = sized.join(plan, sized["_src"].eqNullSafe(plan["_p_src"])).drop("_p_src")
    tilted = F.when(F.col("size") > 0, rate_of(F.col("_mult"), F.col("size") / F.col("_mean"), cap)).otherwise(1.0)
    rated = rated.withColumn("rate", F.when(F.col("target") > 0, tilted).otherwise(0.0)).drop("_mult", "_mean")
    rated = rated.withColumn("_bucket", F.pmod(F.xxhash64("_row", F.lit(7)), F.ceil(F.col("_n_docs") / BUCKET_ROWS)))
    part = F.col("rate") - F.floor("rate")
    order = Window.partitionBy("_src", "_bucket").orderBy(F.desc("size"), "_row").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(part).over(order) + F.pmod(F.xxhash64("_src", "_bucket"), F.lit(1000)) / 1000
    step = F.floor("rate") + F.floor(F.col("_run") + 1e-9) - F.floor(F.col("_run") - part + 1e-9)
    first = rated.withColumn("_run", run).withColumn("copies", step.cast("int"))

    rounded = cut(first.groupBy("_src", "size", "copies").agg(F.count("*").alias("n"), F.first("target").alias("target")), "mix-rounded")
    off = rounded.groupBy(F.col("_src").alias("_o")).agg((F.first("target") - F.sum(F.col("n") * F.col("copies") * F.col("size"))).alias("off"))
    able = F.when(F.col("off") > 0, F.col("copies") < int(cap)).otherwise(F.col("copies") > 0)
    movable = rounded.where("size > 0").join(off, F.col("_src").eqNullSafe(F.col("_o"))).where(able).groupBy("_src", "size", "off").agg(F.sum("n").alias("n"))
    smaller = Window.partitionBy("_src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum(F.col("n") * F.col("size")).over(smaller), F.lit(0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.abs("off") - F.col("below")) / (F.col("n") * F.col("size"))))
    fix = movable.withColumn("below", below).withColumn("share", share).where("share > 0")
    fix = fix.select(F.col("_src").alias("_f_src"), F.col("size").alias("_f_size"), F.signum("off").cast("int").alias("_sign"), F.col("share").alias("_share"))
    picked = F.pmod(F.xxhash64("_row", F.lit(11)), F.lit(1_000_000)) < F.col("_share") * 1_000_000
    room = F.when(F.col("_sign") > 0, F.col("copies") < int(cap)).otherwise(F.col("copies") > 0)
    done = first.join(fix, F.col("_src").eqNullSafe(F.col("_f_src")) & (F.col("size") == F.col("_f_size")), "left")
    return done.withColumn("copies", F.when(F.col("_sign").isNotNull() & picked & room, F.col("copies") + F.col("_sign")).otherwise(F.col("copies")))


def mixture(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "rate")


def stage(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as the mix takes it, with the columns of docs.

    Null and empty texts have rate 1 and stay. Columns of any name come through as they are; repeated rows are separate
    documents. An empty table gives an empty table.
    """

    def taken(rows: DataFrame) -> DataFrame:
        mixed = mix(rows)
        return mixed.where("copies > 0").withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))

    return shielded(docs, ("text", "source"), taken)
