"""Similarity join, neighbours, language model, toxicity and the pipeline against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

import corpus_pipeline
from canopylens.llm import components, jaccard_join, language_model, neighbours, queries, toxicity
from canopylens.llm.common import numbered, table
from canopylens.llm.elias_fano import EliasFano, Trie, mapped

DIR = "/root/testdata/sf0.001"


def brute_components(rows):
    sets, parent = [], {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.append((i, s))
    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x
    for k, (i, s) in enumerate(sets):
        for j, r in sets[:k]:
            both = len(s & r)
            if s and r and 100 * both >= 80 * (len(s) + len(r) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize(("common", "group", "tokens"), [(16, 48, 500_000), (1, 2, 300)])
def test_jaccard_join(docs, monkeypatch, common, group, tokens):
    for name, value in (("COMMON", common), ("GROUP", group), ("RANGE_TOKENS", tokens)):
        monkeypatch.setattr(jaccard_join, name, value)
    some = docs.where("doc_id is not null")
    got = jaccard_join.report(some).collect()
    want = brute_components([(r.doc_id, r.text) for r in some.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()])
    assert len(got) == some.count() and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_join_of_drifting_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON", 3)
    words = prose(1, 150).split()
    rows = []
    for i in range(60):
        w = list(words)
        for k in range(i % 12):
            w[(i * 7 + k * 13) % 150] = f"z{i}{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard_join.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}


@pytest.mark.parametrize("group", [256, 16])
def test_jaccard_join_of_a_common_passage_and_many_near_copies(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard_join, "DEEP_GROUP", group)
    passage, base, rows = prose(70, 60), prose(71, 140).split(), []
    for i in range(250):  # two fifths to all of the text are the passage
        rows.append((i, f"{prose(2000 + i, 1 + 90 * (i % 7) // 6, vocabulary=5000)} {passage}"))
    for i in range(250, 450):  # copies of one text that drift, so that some are linked by others only
        w = list(base)
        for k in range(i % 9):
            w[(i * 7 + k * 31) % 140] = f"z{i % 40}{k}"
        rows.append((i, " ".join(w[: 140 - i % 5])))
    got = {r.doc_id: r.component_id for r in jaccard_join.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}


CLASHING = ("c", "k1", "k2", "s1", "kept", "n_words", "clean_text", "n_chunks", "removed", "_row", "size", "target", "rate", "copies", "component", "_n")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_pass_odd_tables_and_clashing_columns_through(spark, docs, nothing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, nothing, DIR).collect() == []
    odd = docs.where("doc_id is null or doc_id not in (5, 6)").withColumns({c: F.concat(F.lit(f"{c}="), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})
    out = stage(spark, odd, DIR)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    found = out.collect()
    assert found
    for r in found:
        assert all(r[c] == f"{c}={'none' if r.doc_id is None else r.doc_id}" for c in CLASHING)


def test_jaccard_stage_keeps_one(docs, nothing):
    kept = jaccard_join.stage(docs).collect()
    report = jaccard_join.report(docs).collect()
    assert Counter(r.doc_id for r in kept) == Counter({r.component_id for r in report})
    assert jaccard_join.report(nothing).count() == 0 and jaccard_join.stage(nothing).columns == nothing.columns


def test_jaccard_stage_keeps_one_row_of_each_component(spark):
    a, b, c, d = (prose(900 + i, 80) for i in range(4))
    near = a.replace("w7 ", "changed ", 1)
    rows = [(None, a), (None, b), (None, None), (None, ""), (None, ""), (1, c), (1, d), (1, " "), (2, near), (3, c), (3, c)]
    kept = jaccard_join.stage(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, b), (None, None), (None, ""), (None, ""), (1, c), (1, d), (1, " "), (2, near)]
    assert Counter(map(tuple, kept)) == Counter(want)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 9), (20, 20)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **dict.fromkeys((5, 6, 7, 8, 9), 5), **{100 + i: 100 for i in range(31)}}


def test_extra_holds_for_all_sizes():
    """Every pair of sizes that can be similar shares as many kept tokens as extra() says, at least."""
    spare = lambda n: jaccard_join.kept(n) - (n - jaccard_join.least_overlap(n) + 1)
    for n in range(1, 900):
        for m in range(jaccard_join.least_overlap(n), 100 * n // 80 + 1):
            assert jaccard_join.extra(n) <= 1 + min(spare(n), spare(m))
        if n > 400:
            assert math.floor(n * 0.078) - 2 <= jaccard_join.extra(n)


def vectors(spark, n=600, dim=8, extra=()):
    x = np.random.default_rng(3).normal(size=(n, dim)).astype(np.float32)
    x[200:260] = x[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_VECTORS", 200)
    odd = [(700, None, 1), (800, [0.0] * 8, 1), (900, [float("nan")] * 8, 1), (901, [float("inf")] + [1.0] * 7, 1), (1000, [1.0, None] * 4, 1), (None, [1.0] * 8, 1)]
    v = vectors(spark, extra=odd)
    got = defaultdict(list)
    for r in neighbours.report(v).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = {r.vec_id: np.array(r.embedding, float) for r in v.where("vec_id < 600").collect()}
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    hits = 0
    for q, found in got.items():
        want = sorted((math.sqrt(((x[i] - x[q]) ** 2).sum()), i) for i in x if i != q)[:10]
        assert found == sorted(found, key=lambda t: (t[1], t[0])) and len(found) == 10
        assert all(s == pytest.approx(math.sqrt(((x[i] - x[q]) ** 2).sum()), abs=1e-12) for i, s in found)
        hits += len({i for _, i in want} & {i for i, _ in found})
    assert hits >= 0.9 * 10 * len(got)
    assert [i for i, _ in got[200]] == [7, 201, 202, 203, 204, 205, 206, 207, 208, 209]


def test_neighbours_of_an_id_with_several_vectors_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_VECTORS", 40)
    v = vectors(spark, extra=[(7, [9.0] * 8, 0), (100, [9.5] * 8, 0)])
    got = neighbours.report(v).collect()
    assert Counter(r.query_id for r in got) == dict.fromkeys((0, 100, 200, 300, 400, 500), 10)
    assert len({(r.query_id, r.vec_id) for r in got}) == 60
    assert {r.vec_id: r.score for r in got if r.query_id == 100}[7] == pytest.approx(2**0.5)


def test_neighbours_of_few_and_none(spark):
    assert neighbours.report(vectors(spark).where("false")).count() == 0
    few = neighbours.report(vectors(spark).where("vec_id in (0, 5, 100)")).collect()
    assert Counter(r.query_id for r in few) == {0: 2, 100: 2}


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((1, 5), (10, 1000), (5000, 2**63), (5000, 6000), (70_000, 2**40), (0, 1)):
        v = np.sort(r.integers(0, top, n, dtype=np.uint64))
        e = EliasFano.of(v)
        x = np.concatenate([v, r.integers(0, top, 500, dtype=np.uint64)])
        assert (e.access(np.arange(n)) == v).all() and (e.successor(x) == np.searchsorted(v, x)).all()


def test_trie_is_mapped_from_a_file(tmp_path):
    context, word, n = np.array([3, 3, 9], np.uint64), np.array([1, 5, 5], np.uint32), np.array([4, 1, 2])
    trie = Trie.of(context, word, n, 0.75)
    with open(tmp_path / "trie", "wb") as file:
        trie.save(file)
    asked = np.array([3, 3, 4, 9], np.uint64), np.array([1, 9, 1, 5], np.uint32)
    shares, rests = Trie.load(np.memmap(tmp_path / "trie", np.uint8, "r")).query(*asked)
    with mapped(trie) as other:
        assert all((x == y).all() for x, y in zip(other.query(*asked), (shares, rests), strict=True))
        assert not other.shares.flags.owndata and not other.levels["contexts"].low.flags.writeable
    with mapped(Trie.of(context[:0], word[:0], n[:0], 0.75)) as none:
        assert (none.query(*asked)[0] == 255).all()
    assert (shares[[0, 3]] == trie.shares[[0, 2]]).all() and (shares[[1, 2]] == 255).all() and rests[2] == 0


def test_shards_are_ranges_of_hashes_and_numbers_come_back():
    r = np.random.default_rng(1)
    hashes = np.sort(np.append(r.integers(0, 2**64, 5000, dtype=np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]))
    for shards in (1, 2, 21, 3750, 2**24):
        shard, key = language_model.shard_and_key(hashes, shards)
        want = [divmod(int(h) * shards, 2**64) for h in hashes]
        assert shard.tolist() == [w for w, _ in want]
        assert key.tolist() == [f >> (64 - language_model.KEY_BITS) for _, f in want]
    for kind in (np.uint8, np.uint32, np.uint64):
        for n in (0, 1, 1000):
            numbers = r.integers(0, np.iinfo(kind).max, n, dtype=kind, endpoint=True)
            assert (language_model.opened(language_model.shut(numbers), kind) == numbers).all()
    assert language_model.starts(np.array([1, 1, 2, 2]), np.array([5, 6, 6, 6])).tolist() == [0, 1, 2, 4]


def test_language_model(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_CHARS", 9000)
    monkeypatch.setattr(language_model, "SHARD_CHARS", 7000)
    rows = docs.collect()
    tokens = [(r.doc_id, [*(r.text or "").encode().lower().split(), b"</s>"]) for r in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count, pairs = Counter(), defaultdict(Counter)
    for i, t in tokens:
        if not held(i):
            count.update(t)
            for a, b in zip([b"<s>", *t], t, strict=False):
                pairs[a][b] += 1
    n, z = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    want = Counter()
    for i, t in tokens:
        base = sum(math.log10((count[w] + 0.5) / z) for w in t)
        want[(i, held(i), len(t), sum(count[w] > 0 for w in t), n, round(base, 6))] += 1
    got = language_model.score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    by = {i: t for i, t in tokens}
    for r in got:
        exact = 0.0
        for v, w in zip([b"<s>", *by[r.doc_id]], by[r.doc_id], strict=False):
            p, total = (count[w] + 0.5) / z, sum(pairs[v].values())
            if total:
                p = max(pairs[v][w] - 0.75, 0) / total + 0.75 * len(pairs[v]) / total * p
            exact += math.log10(p)
        assert r.score == pytest.approx(exact, abs=0.02 * r.n_tokens)
    assert language_model.score(nothing).count() == 0


def test_split_contexts_are_dealt_by_the_whole_n_gram(docs):
    context, word = np.array([3, 3, 5, 7, 7, 7], np.uint64), np.array([1, 2, 1, 1, 2, 3], np.uint64)
    plain, mine, part, of = language_model.dealt(context, word, np.array([3, 7], np.uint64), 4)
    assert plain.tolist() == [2] and sorted(mine) == [0, 1, 3, 4, 5] and (np.diff(part) >= 0).all() and part.max() < 4
    assert (np.array([3, 7])[of] == context[mine]).all()
    again = language_model.dealt(context[3:], word[3:], np.array([3, 7], np.uint64), 4)
    assert {(int(w), int(p)) for w, p in zip(word[mine], part, strict=True)} >= {(int(word[3:][k]), int(p)) for k, p in zip(again[1], again[2], strict=True)}
    none = language_model.dealt(context, word, np.zeros(0, np.uint64), 1)
    assert none[0].tolist() == [0, 1, 2, 3, 4, 5] and not len(none[1])
    found = language_model.split_contexts(language_model.in_blocks(numbered(docs.select("doc_id", "text")), 1, only=0), 1000, 3)
    assert language_model.START in found[2][0] and (np.diff(found[2][0].astype(float)) > 0).all() and found[2][1] >= 1


@pytest.mark.parametrize("share, least", [(1 / 8, 16), (0, 1), (1e9, 1)])
def test_language_model_of_order_three(docs, nothing, monkeypatch, share, least):
    monkeypatch.setattr(language_model, "BLOCK_CHARS", 9000)
    monkeypatch.setattr(language_model, "SHARD_CHARS", 7000)
    monkeypatch.setattr(language_model, "SPLIT_SHARE", share)
    monkeypatch.setattr(language_model, "SPLIT_LEAST", least)
    monkeypatch.setattr(queries, "table", lambda spark, d, name: spark)
    docs = docs.where("text is null or length(text) < 50000")
    by = {r.doc_id: [*(r.text or "").encode().lower().split(), b"</s>"] for r in docs.collect()}
    count, after = Counter(), defaultdict(Counter)
    for r in docs.collect():
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            t = by[r.doc_id]
            count.update(t)
            for u, v, w in zip([b"<s>", b"<s>", *t], [b"<s>", *t], t, strict=False):
                after[v][w] += 1
                after[u, v][w] += 1
    z = sum(count.values()) + 0.5 * (len(count) + 1)
    got = queries.queries()["op6_language_model"](docs, "").collect()
    assert len(got) == docs.count() and queries.queries()["op6_language_model"](nothing, "").count() == 0
    for r in got:
        t, exact = by[r.doc_id], 0.0
        for u, v, w in zip([b"<s>", b"<s>", *t], [b"<s>", *t], t, strict=False):
            p = (count[w] + 0.5) / z
            for c in (v, (u, v)):
                if c in after:
                    total = sum(after[c].values())
                    p = max(after[c][w] - 0.75, 0) / total + 0.75 * len(after[c]) / total * p
            exact += math.log10(p)
        assert r.score == pytest.approx(exact, abs=0.02 * r.n_tokens)


def test_held_out_texts_score_better_than_unigrams(spark):
    rows = language_model.score(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


def toxic_docs(spark):
    texts = [prose(i, 60) + (f" vile{i % 4}, you" if i % 5 == 0 else "") + (" ### junk junk" if i % 7 == 0 else "") for i in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, ""), (0, texts[0])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_docs(spark)
    got = toxicity.report(docs, labels).collect()
    assert len(got) == 303
    unseen = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 300]
    assert np.mean([r.toxic == (r.doc_id % 5 == 0) for r in unseen]) >= 0.95
    assert not [r for r in got if r.doc_id >= 1000 and r.toxic]


def test_toxicity_without_labels(spark, nothing):
    docs, labels = toxic_docs(spark)
    for few in (labels.where("false"), labels.where("toxic = 0 and quality = 1")):
        got = toxicity.report(docs, few).collect()
        assert len(got) == 303 and not any(r.toxic for r in got)
    assert toxicity.report(nothing, labels).count() == 0


def test_toxicity_chain_uses_the_earlier_category(spark):
    docs, labels = toxic_docs(spark)
    known = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    model = toxicity.train(docs, known, ["low_quality", "toxic"])
    assert [len(m["weights"]) - len(model["words"]) for m in model["chain"]] == [1, 2]


def test_toxicity_of_repeated_ids_and_folds(spark):
    docs, labels = toxic_docs(spark)
    few = labels.where("doc_id % 5 = 0 and doc_id < 40")  # one fold by id would hold all
    assert toxicity.report(docs, few).count() == 303
    twice = docs.union(docs.where("doc_id < 50")).union(spark.createDataFrame([(7, prose(7, 30_000) + " vile1, you")], docs.schema))
    assert toxicity.report(twice, labels.union(labels)).count() == 355
    known = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    sample = toxicity.labelled_words(twice, known, ["low_quality", "toxic"])
    assert sample.count() == sample.select("doc_id").distinct().count() == 200


def test_toxicity_against_plain_evaluation(spark):
    docs, labels = toxic_docs(spark)
    model = toxicity.train(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ["low_quality", "toxic"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.predict(docs, model).collect():
        words, earlier = {w.strip(toxicity.PUNCTUATION) for w in (texts[r.doc_id] or "").lower().split()}, []
        for m in model["chain"]:
            n = len(model["words"])
            z = m["weights"][-1] + sum(w for w, v in zip(m["weights"], model["words"], strict=False) if v in words) + sum(w * p for w, p in zip(m["weights"][n:-1], earlier, strict=True))
            earlier.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        assert [r.p_low_quality, r.p_toxic] == pytest.approx(earlier, abs=1e-4) and r.toxic == (r.p_toxic >= model["chain"][1]["threshold"])


def plain_chain(rows, n_words, folds, categories):
    """(words, weights of each category) by counting and by gradient descent, in plain steps and double precision."""
    chosen, total = [], len(rows)
    for c in range(categories):
        hits, rate = sum(y[c] for _, _, y in rows), sum(y[c] for _, _, y in rows) / total
        if not 0 < hits < total:
            continue
        n, own = Counter(w for _, words, _ in rows for w in words), Counter(w for _, words, y in rows for w in words if y[c])
        best = sorted((-((own[w] - n[w] * rate) ** 2) / (n[w] * rate * (1 - rate)), w) for w in n if n[w] >= 4)[:n_words]
        chosen += [w for _, w in best if w not in chosen]

    def descend(x, y):
        x = np.hstack([x, np.ones((len(x), 1))])
        share = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) / len(x)
        w, last = np.zeros(x.shape[1]), np.zeros(x.shape[1])
        rate, keep = 2 / (0.25 * (x**2).sum(1).mean() + 1e-3), np.append(np.full(x.shape[1] - 1, 1e-3), 0)
        for k in range(200):
            v = w + (k - 1) / (k + 2) * (w - last) if k else w
            last, w = w, v - rate * (((1 / (1 + np.exp(-np.clip(x @ v, -30, 30))) - y) * share) @ x + keep * v)
        return w

    x, weights = np.array([[float(w in words) for w in chosen] for _, words, _ in rows]), []
    fold = np.array([zlib.crc32(str(i).encode()) % folds for i, _, _ in rows])
    for c in range(categories):
        y, p = np.array([float(y[c]) for _, _, y in rows]), np.zeros(total)
        for f in range(folds):
            w = descend(x[fold != f], y[fold != f])
            p[fold == f] = 1 / (1 + np.exp(-(np.hstack([x[fold == f], np.ones(((fold == f).sum(), 1))]) @ w)))
        weights.append(descend(x, y))
        x = np.hstack([x, p[:, None]])
    return chosen, weights


def test_toxicity_training_against_a_plain_chain(spark):
    docs, labels = toxic_docs(spark)
    model = toxicity.train(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ["low_quality", "toxic"])
    texts, rows = {r.doc_id: r.text or "" for r in docs.collect()}, []
    for r in labels.orderBy("doc_id").collect():
        if r.doc_id in texts and r.quality is not None and r.toxic is not None:
            rows.append((r.doc_id, {w.strip(toxicity.PUNCTUATION) for w in texts[r.doc_id].lower().split()} - {""}, (1 - r.quality, r.toxic)))
    words, weights = plain_chain(rows, toxicity.WORDS, toxicity.FOLDS, 2)
    assert sorted(words) == sorted(model["words"])
    for m, w in zip(model["chain"], weights, strict=True):
        ours = dict(zip([*model["words"], *range(len(m["weights"]) - len(words))], m["weights"], strict=True))
        theirs = dict(zip([*words, *range(len(w) - len(words))], w, strict=True))
        assert max(abs(ours[k] - theirs[k]) for k in ours) < 0.02


def test_pipeline_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DIR)
        assert after.columns == columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and ids, name
        before = after
    packed = corpus_pipeline.run(spark, DIR)
    assert packed.select("doc_id").distinct().count() == len(ids)


def test_all_are_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert names == list(range(1, 14))
