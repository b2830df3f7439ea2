"""Line dedup: passages of lines that occur again anywhere are removed, the first one stays.

Two kinds of passages are counted over all documents by hash. Chunks are content-defined: a boundary falls before a line
where the rolling hash over it and the line before says so, and around every line of LONG_WORDS words or more; chunks of
several lines, and long lines, count. Windows are the shortest runs of lines of LONG_WORDS words or more that begin or
end at a line, so that every line of a longer repeated run is in a window that lies in the run. Passages that occur
again by hash are compared by the SHA-256 of their bytes before any is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopylens.llm.common import cut, fenced, hot_keys_split, shielded

#: One boundary in so many places; words of a line that is a chunk of its own, and of a window.
DIVISOR = 2
LONG_WORDS = 50


def cut_lines(docs: DataFrame, text: str = "text", divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with _lines, _marks (hash, and whether long, of each line) and _starts, the first lines of the chunks."""
    docs = docs.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    docs = docs.withColumn("_marks", F.transform("_lines", lambda s: F.struct(F.xxhash64(s).alias("h"), (F.size(F.split(s, " ")) >= long_words).alias("long"))))
    m = F.col("_marks")
    begins = lambda x, i: (i == 0) | x["long"] | F.get(m, i - 1)["long"] | (F.pmod(F.xxhash64(F.get(m, i - 1)["h"], x["h"]), F.lit(divisor)) == 0)
    return docs.withColumn("_starts", F.filter(F.transform(m, lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull()))


def chunk_lines(docs: DataFrame, text: str = "text", divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with _lines and _chunks: (from, n, hash, whole) of each chunk; whole: it may be removed if it occurs again."""
    m = F.col("_marks")
    size = lambda s, k: F.coalesce(F.get(F.col("_starts"), k + 1), F.size("_lines")) - s
    body = lambda s, k: F.array_join(F.slice("_lines", s + 1, size(s, k)), "\n")
    chunk = lambda s, k: F.struct(s.alias("from"), size(s, k).alias("n"), F.xxhash64(body(s, k)).alias("hash"), (((size(s, k) > 1) | F.get(m, s)["long"]) & body(s, k).rlike(r"[^\x00-\x20]")).alias("whole"))
    return cut_lines(docs, text, divisor, long_words).withColumn("_chunks", F.transform("_starts", chunk)).drop("_marks", "_starts")


def line_windows(docs: DataFrame, words: int = LONG_WORDS) -> DataFrame:
    """docs, which have _lines, with _windows: (from, n, hash) of the shortest runs of lines of so many words that begin
    at a line, and of those that end at one. Lines without words begin and end none, so that a run has few others.
    """
    docs = docs.withColumn("_hashes", F.transform("_lines", lambda s: F.xxhash64(s)))
    full = F.transform("_lines", lambda s, i: F.struct(i.alias("i"), F.regexp_count(s, F.lit(r"[^\x20\x09-\x0D]+")).alias("w")))
    docs = docs.withColumn("_full", F.filter(full, lambda x: x["w"] > 0)).withColumn("_back", F.reverse("_full"))

    def reach(lines: str, k: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("last"))
        walk = F.aggregate(F.slice(lines, k + 1, F.lit(words)), start, lambda a, y: F.when(a["sum"] >= words, a).otherwise(F.struct((a["sum"] + y["w"]).alias("sum"), y["i"].alias("last"))))
        return F.transform(F.array(walk), lambda a: F.when(a["sum"] >= words, a["last"]))[0]

    place = lambda a, b: F.shiftleft(a.cast("long"), 32) + (b - a + 1)
    ahead, behind = F.transform("_full", lambda x, k: place(x["i"], reach("_full", k))), F.transform("_back", lambda x, k: place(reach("_back", k), x["i"]))
    docs = docs.withColumn("_places", F.array_distinct(F.filter(F.concat(ahead, behind), lambda p: p.isNotNull())))
    at, n = lambda p: F.shiftright(p, 32).cast("int"), lambda p: p.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    return docs.withColumn("_windows", F.transform("_places", lambda p: F.struct(at(p).alias("from"), n(p).alias("n"), F.xxhash64(F.slice("_hashes", at(p) + 1, n(p))).alias("hash")))).drop("_hashes", "_full", "_back", "_places")


def gone_runs(gone: DataFrame) -> DataFrame:
    """(_row, _runs, _n_gone) from the lines [from, to) of the passages that go, some of which are chunks.

    A run is a longest stretch of lines that go; its starts are where its pieces begin, each chunk but the first with
    one of its own. _n_gone is the number of chunks.
    """
    order = Window.partitionBy("_row").orderBy("from", F.desc("chunk"), "to")
    so_far = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = gone.withColumn("opens", so_far.isNull() | (F.col("from") > so_far))
    runs = runs.withColumn("run", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.sum(F.col("chunk").cast("int")).over(Window.partitionBy("_row", "run").orderBy("from", F.desc("chunk"), "to").rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("start", F.when(F.col("opens") | F.col("chunk") & (nth > 1), F.col("from")))
    runs = runs.groupBy("_row", "run").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.sort_array(F.collect_set("start")).alias("starts"), F.sum(F.col("chunk").cast("int")).alias("n"))
    return runs.groupBy(F.col("_row").alias("_g")).agg(F.sort_array(F.collect_list(F.struct("from", "to", "starts"))).alias("_runs"), F.sum("n").cast("int").alias("_n_gone"))


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs with _row, a key of its own for each row: its id, the hash of its text, and a number where rows repeat.

    Nothing in it depends on how docs are partitioned: rows that repeat are written once with their number, and any
    other is known by what it holds, so that plans that compute it again find the same rows.
    """
    rows = docs.withColumn("_row", F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.lit(-1).cast("long").alias("nth")))
    again = cut(rows.groupBy("_row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_row").alias("_again")), "dedup-again")
    if again.isEmpty():
        return rows
    same = F.col("_row") == F.col("_again")
    number = F.struct(F.col("_row.id").alias("id"), F.col("_row.hash").alias("hash"), F.monotonically_increasing_id().alias("nth"))
    return rows.join(again, same, "left_anti").unionByName(cut(rows.join(again, same, "left_semi").withColumn("_row", number), "dedup-repeated"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with text without its repeated passages, and n_chunks, n_removed, removed (the texts taken out, in order).

    Of equal passages the one of the smallest (doc_id, hash of the text, place) stays; a window that overlaps the first one goes but
    for that. So each line that goes has an equal one that stays. n_removed counts chunks; a run of windows around them
    is taken out with them, and one without a chunk is a text in removed too. Null texts stay null and empty ones empty;
    a document may come out empty. Blank chunks always stay. Repeated rows count as separate documents: all but the first lose their passages.
    Ties and copies of any number are settled by the same order. Columns of docs with these names are replaced.
    """
    new = ["n_chunks", "n_removed", "removed"]
    rows = keyed(docs.drop(*new), text, doc_id)
    chunks = F.transform(F.filter("_chunks", lambda c: c["whole"]), lambda c: F.struct(c["from"].alias("from"), c["n"].alias("n"), c["hash"].alias("hash"), F.lit(True).alias("chunk")))
    wide = F.transform("_windows", lambda c: F.struct(c["from"].alias("from"), c["n"].alias("n"), c["hash"].alias("hash"), F.lit(False).alias("chunk")))
    seen = line_windows(chunk_lines(rows.select("_row", text), text)).select("_row", F.explode(F.concat(chunks, wide)).alias("c")).select("_row", "c.*")
    again = cut(seen.groupBy("hash", "chunk").agg(F.count("*").alias("n_seen")).where("n_seen > 1"), "dedup-seen")
    doubted = hot_keys_split(seen, again, ["hash", "chunk"], "n_seen").groupBy(F.col("_row").alias("_r")).agg(F.collect_list(F.struct("from", "n", "chunk")).alias("_doubted"))

    doubts = rows.select("_row", F.split(F.col(text), "\n", -1).alias("_lines")).join(doubted, F.col("_row") == F.col("_r"))
    digest = lambda c: F.unhex(F.sha2(F.array_join(F.slice("_lines", c["from"] + 1, c["n"]), "\n"), 256))
    doubts = doubts.select("_row", F.explode(F.transform("_doubted", lambda c: F.struct(c["from"].alias("from"), c["n"].alias("n"), c["chunk"].alias("chunk"), digest(c).alias("digest")))).alias("c")).select("_row", "c.*")
    doubts = cut(doubts.select("_row", "from", "n", "chunk", "digest"), "dedup-doubts").withColumn("at", F.struct(F.col("_row").alias("row"), F.col("from").alias("from")))
    first = cut(doubts.groupBy("digest", "chunk").agg(F.count("*").alias("n_same"), F.min("at").alias("first")).where("n_same > 1"), "dedup-first")
    gone = hot_keys_split(doubts, first, ["digest", "chunk"], "n_same").where(F.col("at") != F.col("first"))
    begin = F.when(F.col("first.row") == F.col("_row"), F.greatest("from", F.col("first.from") + F.col("n"))).otherwise(F.col("from"))
    gone = gone_runs(gone.select("_row", begin.alias("from"), (F.col("from") + F.col("n")).alias("to"), "chunk"))

    out = cut_lines(rows.join(gone, F.col("_row") == F.col("_g"), "left"), text)
    lines = lambda a, b: F.slice("_lines", a + 1, b - a)
    pieces = F.flatten(F.transform("_runs", lambda r: F.transform(r["starts"], lambda a, k: F.array_join(lines(a, F.coalesce(F.get(r["starts"], k + 1), r["to"])), "\n"))))
    between = F.transform(F.sequence(F.lit(0), F.size("_runs")), lambda k: lines(F.coalesce(F.get("_runs", k - 1)["to"], F.lit(0)), F.coalesce(F.get("_runs", k)["from"], F.size("_lines"))))
    return fenced(out.select(
        *[F.when(F.col("_runs").isNotNull(), F.array_join(F.flatten(between), "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns if c not in new],
        F.size("_starts").alias("n_chunks"), F.coalesce("_n_gone", F.lit(0)).alias("n_removed"), F.coalesce(pieces, F.expr("cast(array() as array<string>)")).alias("removed"),
    ))


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row for each document: its clean text's digest and what was taken out."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_chunks", "n_removed", F.length(F.array_join("removed", "")).cast("long").alias("chars_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.array_join("removed", "\n").alias("removed_text"))


def stage(docs: DataFrame) -> DataFrame:
    """Documents with their clean text, in the columns of docs; those of which nothing is left go.

    Null and empty texts, in which nothing is removed, stay. Of repeated rows and equal passages the first keeps its
    text, in the order of dedup_lines(). Columns of any name come through as they are. An empty table gives an empty one.
    """

    def left(rows: DataFrame) -> DataFrame:
        out = dedup_lines(rows)
        return out.where((F.size("removed") == 0) | F.col("text").rlike(r"[^\x00-\x20]"))

    return shielded(docs, ("doc_id", "text"), left)
