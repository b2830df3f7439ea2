"""The pipeline, stage by stage, against plain versions that share no code with the operators."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from conftest import prose
from test_corpus_operators import brute_components
from test_odd_inputs import brute_line_dedup
from test_text_operators import VOCABULARY, exact_rates

import corpus_pipeline
from canopylens.llm import packing, quality
from canopylens.llm.common import cut, table

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The input and output of every stage, on given documents and some with planted passages, copies and bad lines."""
    docs = table(spark, DIR, "documents")
    passage = "\n".join(prose(7100 + k, 12) for k in range(7))
    base = prose(7200, 150, 3)
    more = [(10_000 + k, f"{prose(7300 + k, 60)}\n{passage}\n{prose(7400 + k, 40)}", "en", f"s{k % 2}", 1) for k in range(12)]
    more += [(11_000 + k, base.replace(f"w{k} ", "other "), "en", None, 1) for k in range(20)]
    more += [(12_000 + k, f"{prose(7500 + k, 90, 2)}\nHome | News | Sport | Weather\nClick here to read on, all rights reserved.", "en", "s0", 1) for k in range(5)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    out, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, before, DIR), "test")
        out[name] = before.collect(), after.collect()
        before = after
    return out


def test_quality_stage(steps):
    def bad(line):
        n = len(line.encode().split())
        tail = line.rstrip(" \t\n\x0b\x0c\r")
        return n > 0 and (
            5 * sum(line.count(c) for c in "#*$%&|<>") > n or 2 * line.count("!!") > n or (n >= 4 and regex.search(r"\p{Lu}", line) is not None and not regex.search(r"\p{Ll}", line))
            or (n < 4 and not tail.endswith(quality.ENDINGS)) or sum(line.count(s) for s in ("|", "»", " > ", " · ")) >= 3 or regex.search(quality.BOILERPLATE.pattern, line.lower()) is not None
            or (n <= 6 and regex.search(quality.NAVIGATION.pattern, line.lower()) is not None)
        )

    want = Counter()
    for r in steps["quality_rules"][0]:
        lines = (r.text or "").split("\n")
        words = (r.text or "").encode().split()
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[w] > 1 for j in range(3)}
        lost = sum(len(x.encode().split()) for x in lines if bad(x))
        if len(words) >= 50 and 2 * len(hit) <= len(words) and 2 * lost <= len(words):
            want[r.doc_id, "\n".join(x for x in lines if not bad(x)), r.source] += 1
    assert Counter((r.doc_id, r.text, r.source) for r in steps["quality_rules"][1]) == want and len(want) > 50


def test_line_dedup_stage(spark, steps):
    before, after = steps["line_dedup"]
    clean = brute_line_dedup(spark.createDataFrame([(r.doc_id, r.text) for r in before], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in after} == {i: t for i, t in clean.items() if t.strip("".join(map(chr, range(33))))}
    assert sum("\n" in r.text for r in after) and len(after) < sum(len(r.text) > 0 for r in before) + 1
    assert sum(len(r.text) for r in after) < sum(len(r.text) for r in before)


def test_near_copies_stage(steps):
    before, after = steps["ngram_jaccard_join"]
    group = brute_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in group.values()}) and len(after) < len(before)
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}


def test_mixing_stage(steps):
    before, after = steps["mix_sources"]
    taken = Counter(r.doc_id for r in after)
    size = {r.doc_id: len(r.text.encode().split()) for r in before}
    by_source = defaultdict(list)
    for r in before:
        by_source[r.source].append(r.doc_id)
    assert set(taken) <= set(size) and max(taken.values()) <= 3
    names = sorted((s for s in by_source if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in by_source if s is None]
    weight, total = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}, {s: sum(size[i] for i in ids) for s, ids in by_source.items()}
    full = set()
    while True:
        target = {s: 3 * total[s] if s in full else (sum(total.values()) - sum(3 * total[x] for x in full)) * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if target[s] > 3 * total[s] + 1e-6}
        if not over:
            break
        full |= over
    for s, ids in by_source.items():
        assert abs(sum(taken[i] * size[i] for i in ids) - target[s]) <= max(0.05 * target[s], max(size[i] for i in ids))
        if target[s] < 2.99 * total[s] and len(ids) > 20:  # copies follow the rates of the tilt
            rates = exact_rates([size[i] for i in ids], target[s])
            assert abs(sum(taken[i] for i in ids) - rates.sum()) <= 0.1 * rates.sum() + 3


def test_packing_stage(steps):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    before, after = steps["best_fit_packing"]
    want = Counter()
    for r in before:
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[r.doc_id, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want
    sequences = defaultdict(list)
    for r in after:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert all(a == b for (a, _), b in zip(places, np.cumsum([0, *(n for _, n in places)]), strict=False)) and sum(n for _, n in places) <= 2048
    assert len(sequences) <= packing.lower_bound(np.array([r.length for r in after])) + 1


def test_run_is_the_chain_of_its_stages(spark):
    docs = table(spark, DIR, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, DIR), "test")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, DIR).select(columns).collect())) == Counter(map(tuple, docs.select(columns).collect()))
