"""Inputs that other forms of the code got wrong: tables behind shuffles, odd letters, patterns, magnitudes and columns."""

import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from canopylens.llm import common, line_dedup, mixing, neighbours, packing, url_filter
from canopylens.llm.common import cut, hot_keys_split
from test_text_operators import VOCABULARY

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_line_dedup_of_a_table_from_a_shuffle(spark, many_partitions):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    wide = docs.groupBy("doc_id").agg(F.min("text").alias("text"), F.max(F.repeat("lang", 3000)).alias("wide"))
    got = line_dedup.stage(wide).collect()
    want = line_dedup.stage(cut(wide, "test")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in want)
    assert {r.doc_id: r.wide for r in got} == {r.doc_id: r.lang * 3000 for r in docs.collect() if r.doc_id in {g.doc_id for g in got}}


def test_line_dedup_of_repeated_rows(spark):
    text = "\n".join(prose(5000 + k, 20) for k in range(6))
    rows = [(1, text), (1, text), (1, text), (None, text), (2, "only here"), (2, "only here"), (1, "another text"), (None, None), (None, None)]
    got = Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(None, text): 1, (1, ""): 3, (2, "only here"): 2, (1, "another text"): 1, (None, None): 2})


def brute_line_dedup(docs):
    """{doc_id: text} without passages that were there before, chunks by the rule of their hashes and windows by words."""
    hashes = lambda frame: frame.select("doc_id", F.split("text", "\n", -1).alias("l")).select("doc_id", "l", F.transform("l", lambda x: F.xxhash64(x)).alias("h"))
    rows = hashes(docs).select("doc_id", "l", "h", F.transform("h", lambda x, i: F.pmod(F.xxhash64(F.get("h", i - 1), x), F.lit(line_dedup.DIVISOR)) == 0).alias("rolled")).orderBy("doc_id").collect()
    seen, gone = {}, defaultdict(set)
    for kind in ("chunk", "window"):
        for r in rows:
            words = [len(x.encode().split()) for x in r.l]
            long = [len(x.split(" ")) >= line_dedup.LONG_WORDS for x in r.l]
            if kind == "chunk":
                starts = [i for i in range(len(r.l)) if i == 0 or long[i] or long[i - 1] or r.rolled[i]]
                spans = [(a, b) for a, b in zip(starts, [*starts[1:], len(r.l)], strict=True) if (b - a > 1 or long[a]) and re.search(r"[^\x00-\x20]", "\n".join(r.l[a:b]))]
            else:
                spans = set()
                for a in range(len(r.l)):
                    if words[a]:
                        b = next((b for b in range(a, len(r.l)) if sum(words[a : b + 1]) >= line_dedup.LONG_WORDS), None)
                        c = next((c for c in range(a, -1, -1) if sum(words[c : a + 1]) >= line_dedup.LONG_WORDS), None)
                        spans |= {(a, b + 1)} if b is not None else set()
                        spans |= {(c, a + 1)} if c is not None else set()
            for a, b in sorted(spans):
                first = seen.setdefault((kind, "\n".join(r.l[a:b])), (r.doc_id, a))
                if first != (r.doc_id, a):
                    gone[r.doc_id] |= set(range(max(a, first[1] + b - a) if first[0] == r.doc_id else a, b))
    return {r.doc_id: "\n".join(x for i, x in enumerate(r.l) if i not in gone[r.doc_id]) for r in rows}


def test_line_dedup_against_an_independent_version(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    passage = "\n".join(prose(6000 + k, 11) for k in range(8))
    docs = docs.union(spark.createDataFrame([(100_000 + k, f"{prose(7000 + k, 9)}\n{passage}\n{prose(8000 + k, 12, 3)}") for k in range(9)], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == brute_line_dedup(docs)


def test_hot_keys_are_split(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("v"))
    found = cut(rows.groupBy("key").agg(F.count("*").alias("n")), "test").withColumn("first", -F.col("key"))
    got = hot_keys_split(rows, found, ["key"], "n")
    assert sorted(map(tuple, got.select("key", "v", "first").collect())) == sorted((0 if i % 3 == 0 else i, i, 0 if i % 3 == 0 else -i) for i in range(5000))


def test_ids_of_letters_whose_lower_case_is_longer():
    ids = packing.WordIds(VOCABULARY)
    odd = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (len(chr(c).lower()) > 1 or len(chr(c).upper()) > 1 or chr(c).lower() != chr(c).lower().casefold())]
    words = [w for c in odd for p in packing.WordIds.TAIL for w in (f"{c}{p}", f"T{c}r{c}{p}", f"{p}{c}", f"ab{c}")] + ["TARİHİ.", "İ!", "İ#"]
    for at in range(0, len(words), 500):
        for word, stream in zip(words[at : at + 500], ids.streams(words[at : at + 500]), strict=True):
            assert stream == np.array(ids.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes(), word


def test_tokens_of_generated_patterns(spark):
    r = random.Random(3)
    atoms = [("/", "/"), ("-", "-"), (r"\.", "."), ("[?&]", "&"), ("[a-z]", "q"), ("[0-9x]", "7"), (".", "z"), ("[^/]", "y"), ("(ab|cd)", "cd"), (r"(/|\?|$)", "?"), ("=", "="), (r"\d", "5"), (r"\w", "k"), *[("/", "/"), ("-", "-"), (r"\.", "."), ("=", "=")] * 4, ("[]a]", "a")]
    signs = [("", 1)] * 30 + [("?", 0), ("*", 0), ("+", 2), ("*?", 1), ("+?", 2), ("??", 0), ("++", 1), ("{2}", 2), ("{1,3}?", 3), ("{0,2}", 0)]
    rules, urls = [("lazy", "/x.*?login/")], ["http://a.b/x-mylogin/", "http://a.b/xlogin/"]
    for k in range(400):
        pattern, url = "", "http://a.b/"
        for _ in range(r.randint(3, 7)):
            source, text = r.choice(atoms) if r.random() < 0.5 else (w := r.choice(["foo", "bar9", "x", "login"]), w)
            sign, times = r.choice(signs)
            if len(source) > 1 and source.isalnum():
                pattern, url = pattern + source + sign, url + source[:-1] + source[-1] * times
            else:
                pattern, url = pattern + source + sign, url + text * times
        rules.append((f"r{k:03}", pattern))
        urls += [url, url + "zz", url.replace("://a.b/", "://a.b/m"), url[:-1]]
    java = lambda p: p.replace("++", "+").replace("[]a]", r"[\]a]")
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    table = url_filter.pattern_table(spark, rules)
    got = {x.page_id: x.pattern_id for x in url_filter.judge_urls(pages, pattern_rules=table).collect()}
    plain = pages.join(table, F.expr("rlike(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), pattern)")).groupBy("page_id").agg(F.min("pattern_id").alias("p"))
    want = {x.page_id: x.p for x in plain.collect()}
    assert got == {i: want.get(i) for i in range(len(urls))} and len(want) > 300 and got[0] == "lazy"
    assert all(re.compile(java(p)) for _, p in rules) and 20 < sum(bool(url_filter.literal_tokens(p)) for _, p in rules) < 400


@pytest.mark.parametrize(("size", "kind"), [(1e20, "float"), (1e-25, "float"), (1e300, "double"), (1.0, "float")])
@pytest.mark.parametrize("n", [5, 300])
def test_neighbours_of_very_large_and_small_vectors(spark, size, kind, n):
    r = np.random.default_rng(8)
    x = r.normal(size=(n, 12)) * (size if size < 1e299 else 1e150)
    x = x.astype(np.float32 if kind == "float" else np.float64)
    x[n // 2 :] *= x.dtype.type(1e-3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = defaultdict(list)
    for row in neighbours.report(table, every=20).orderBy("query_id", "rank").collect():
        got[row.query_id].append(row.vec_id)
    x, hits = x.astype(np.float64), 0
    for q in range(0, n, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((s, i) for i, s in enumerate(d) if i != q)[:10]
        assert len(got[q]) == len(want)
        hits += len(set(got[q]) & {i for _, i in want})
    assert hits >= 0.95 * 10 * len(range(0, n, 20)) if n > 10 else hits == n - 1


def test_mixing_of_nested_maps(spark, docs):
    odd = docs.withColumns({"m": F.array(F.create_map(F.lit("k"), "doc_id")), "s": F.struct(F.create_map(F.lit("k"), F.col("lang"))), "t": F.create_map(F.lit(1), F.lit(2))})
    first, second = (Counter((r.doc_id, r.copies) for r in mixing.mix(odd).select("doc_id", "copies").collect()) for _ in range(2))
    assert first == second and sum(first.values()) == docs.count() and mixing.stage(odd).columns == odd.columns


def test_rows_that_repeat_are_numbered(spark, docs, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 7)
    many = docs.where("doc_id < 4").withColumn("m", F.create_map("lang", "doc_id"))
    table = many.unionByName(many.where("doc_id = 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("k")).repartition(5)
    got = common.numbered(table).collect()
    assert Counter(r.doc_id for r in got) == {0: 1, 1: 41, 2: 1, 3: 2} and len({r["_row"] for r in got}) == len(got)
    assert sorted((r.doc_id, r["_row"]) for r in got) == sorted((r.doc_id, r["_row"]) for r in common.numbered(table.repartition(3)).collect())
    assert all(r.m == {r.lang: r.doc_id} for r in got) and common.numbered(table.where("false")).count() == 0


def test_mixing_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    rows = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("a").alias("source"))
    rows = rows.unionByName(spark.range(500).select("id", F.concat(F.lit("w "), F.repeat(F.lit("x "), (F.col("id") % 50).cast("int"))), F.lit("b")).toDF("doc_id", "text", "source"))
    first, second = (mixing.mix(rows).groupBy("source", "size", "copies").count().orderBy("source", "size", "copies").collect() for _ in range(2))
    assert first == second
    for s in "ab":
        taken = sum(r["size"] * r.copies * r["count"] for r in first if r.source == s)
        target = mixing.mix(rows).where(F.col("source") == s).first().target
        assert taken == pytest.approx(target, rel=0.01)
