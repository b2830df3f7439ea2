"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; the model of a category also sees the probabilities of the earlier ones.
Those are out-of-fold in training: each labelled document's comes from models that were fitted without it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopylens.llm.common import cut

#: Labelled documents that the models are fitted on at most (those of the smallest hashes), words for each category, folds.
MAX_LABELLED = 12_000
WORDS = 256
MIN_DOCS = 4
FOLDS = 5
STEPS = 200
L2 = 1e-3
PUNCTUATION = ".,;:!?\"'()[]{}*#$%&|<>-_"


def words_in(text: str | None) -> set[str]:
    """Distinct words of a text, without punctuation at their ends, lower-cased."""
    return {w.strip(PUNCTUATION) for w in (text or "").lower().split()} - {""}


def labelled_words(docs: DataFrame, labels: DataFrame, categories: list[str], most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, the categories, words) of at most so many labelled documents; the ids that are sent out are as few.

    An id has one row: of several labels the largest count, of several texts the smallest that isn't null. Words are
    those of the whole text.
    """
    ids = labels.where(" and ".join(f"{c} is not null" for c in [*categories, "doc_id"])).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([sorted(words_in(t)) for t in b.columns[-1].to_pylist()], pa.list_(pa.string()))], names=[*b.schema.names[:-1], "words"])

    schema = "doc_id long, " + ", ".join(f"{c} int" for c in categories) + ", words array<string>"
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", *categories).agg(F.min("text").alias("text"))
    return some.select(F.col("doc_id").cast("long"), *[F.col(c).cast("int") for c in categories], "text").mapInArrow(split, schema)


def choose_words(sample: DataFrame, categories: list[str], n: int = WORDS, least: int = MIN_DOCS) -> list[str]:
    """For each category the words whose presence tells most, by the chi-square of presence against the category."""
    total = sample.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    seen = sample.select(*categories, F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).where(F.col("n") >= least)
    chosen: dict[str, None] = {}
    for c in categories:
        if not total.n or not total[c] or total[c] == total.n:
            continue
        rate = total[c] / total.n
        score = (F.col(c) - F.col("n") * rate) ** 2 / (F.col("n") * rate * (1 - rate))
        chosen |= dict.fromkeys(r.word for r in seen.orderBy(F.desc(score), "word").limit(n).collect())
    return list(chosen)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = STEPS, l2: float = L2) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    y = y.astype(np.float32)
    step = np.float32(2 / (0.25 * float((x * x).sum(1).mean()) + l2))
    w = v = np.zeros(x.shape[1], np.float32)
    rate = float(y.mean())
    weight = np.where(y == 1, 0.5 / max(rate, 1e-3), 0.5 / max(1 - rate, 1e-3)).astype(np.float32) / len(x)
    shrink = np.append(np.full(x.shape[1] - 1, l2, np.float32), np.float32(0))
    for k in range(steps):
        slope = ((sigmoid(x @ v) - y) * weight) @ x + shrink * v
        new = v - step * slope
        w, v = new, new + np.float32(k / (k + 3)) * (new - w)
    return w


def apply(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(np.hstack([x, np.ones((len(x), 1), x.dtype)]) @ w)


def train(docs: DataFrame, labels: DataFrame, categories: list[str]) -> dict:
    """The chain: words, and for each category its weights, threshold and held-out accuracy measures.

    A category without both kinds of labels gets no model; its probability is its rate and nothing is flagged.
    """
    sample = cut(labelled_words(docs, labels, categories), "labelled")
    words = choose_words(sample, categories)
    known = F.array(*[F.lit(w) for w in words]) if words else F.expr("cast(array() as array<string>)")
    rows = sample.select("doc_id", *categories, F.array_intersect("words", known).alias("words")).orderBy("doc_id").collect()
    at = {w: k for k, w in enumerate(words)}
    x = np.zeros((len(rows), len(words)), np.float32)
    for i, r in enumerate(rows):
        x[i, [at[w] for w in r.words]] = 1
    fold = np.array([zlib.crc32(str(r.doc_id).encode()) % FOLDS for r in rows], np.int64)
    chain = []
    for c in categories:
        y = np.array([r[c] for r in rows], float)
        if not len(y) or y.min() == y.max():
            chain.append({"category": c, "weights": None, "rate": float(y.mean()) if len(y) else 0.0, "threshold": 2.0})
            p = np.full(len(rows), chain[-1]["rate"])
        else:
            p = np.empty(len(rows))
            for f in range(FOLDS):
                out = fold == f
                rest = y[~out]
                if out.any() and len(rest) and rest.min() < rest.max():
                    p[out] = apply(x[out], fit(x[~out], rest))
                else:  # nothing to tell the kinds apart by
                    p[out] = rest.mean() if len(rest) else y.mean()
            cuts = np.unique(np.round(p, 3))
            f1 = [2 * y[p >= t].sum() / ((p >= t).sum() + y.sum()) for t in cuts]
            best = int(np.argmax(f1))
            flagged = p >= cuts[best]
            chain.append({"category": c, "weights": [round(float(v), 6) for v in fit(x, y)], "threshold": float(min(max(cuts[best], 0.3), 0.7)), "f1": float(f1[best]), "recall": float(y[flagged].sum() / y.sum()), "precision": float(y[flagged].sum() / max(1, flagged.sum()))})
        x = np.hstack([x, p[:, None].astype(np.float32)])
    return {"words": words, "chain": chain}


def predict(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, p_ and flag of each category) of every row, from its whole text.

    A null or empty text has no words and gets what the intercepts say. Repeated rows and ids are each judged, and so is
    a text of any length as a whole. Other columns are left out, whatever their names. An empty table gives an empty
    table.
    """
    names = [m["category"] for m in model["chain"]]
    schema = "doc_id long, " + ", ".join(f"p_{c} double, {c} boolean" for c in names)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: k for k, w in enumerate(model["words"])}
        known = set(at)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                b = whole.slice(first, 500)
                x = np.zeros((b.num_rows, len(at)), np.float32)
                for i, t in enumerate(b.column(1).to_pylist()):
                    x[i, [at[w] for w in words_in(t) & known]] = 1
                out = [b.column(0)]
                for m in model["chain"]:
                    p = np.full(len(x), m["rate"]) if m["weights"] is None else apply(x, np.array(m["weights"]))
                    out += [pa.array(p, pa.float64()), pa.array(p >= m["threshold"], pa.bool_())]
                    x = np.hstack([x, p[:, None].astype(np.float32)])
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", *[f"{a}{c}" for c in names for a in ("p_", "")]])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(judged, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's probabilities: first of low quality, then, knowing that, of being toxic."""
    known = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return predict(docs, train(docs, known, ["low_quality", "toxic"]))
