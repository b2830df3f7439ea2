"""Secret scan: fixed patterns, and character Markov models that tell random strings from identifiers."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns: kind, expression, group whose length counts, least length. A run of 32 hex digits or of 16
#: key letters is found at the same place whether the length is asked for in the expression or afterwards.
KEYWORDS = r"(?i:password|passwd|secret|token|api_?key)"
PATTERNS = [
    ("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
KINDS = [k for k, *_ in PATTERNS] + ["markov"]
#: What the models judge: runs of these characters, of this length at least.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST = 20
#: Share of the ordinary held-out samples that may count as random, and of the random ones that should: the threshold on
#: the mean log-likelihood ratio for each pair of characters is the middle of those that keep both, or else the least
#: one that keeps the first. One sample in HELD_OUT is held out.
FALSE_POSITIVES = 0.001
RECALL = 0.99
HELD_OUT = 5
#: Ratios are counted in steps of this width.
STEP = 0.02
#: Matches of a text whose places are added up together.
BLOCK = 256
SPANS = "array<struct<start:int,end:int,hit:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use takes it into a lambda."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, pattern: str, hits: Column, values: Column, least: int) -> Column:
    """(start, end, hit) of the matches whose value is long enough: the texts between matches give the places.

    Lengths are added up in blocks, so that a text of very many matches costs in proportion to them.
    """
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    tested = F.zip_with(hits, values, lambda h, v: F.struct(h.alias("hit"), (F.length(v) >= least).alias("good")))
    steps = F.zip_with(tested, gaps, lambda x, g: F.struct(x["hit"].alias("hit"), x["good"].alias("good"), F.length(g).alias("gap")))
    none = F.expr(f"cast(array() as {SPANS})")

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(x["good"], F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))

    def block(all_steps: Column, k: Column) -> Column:
        before = F.aggregate(F.slice(all_steps, F.lit(1), k * BLOCK), F.lit(0), lambda n, x: n + x["gap"] + F.length(x["hit"]))
        return F.aggregate(F.slice(all_steps, k * BLOCK + 1, F.lit(BLOCK)), F.struct(before.alias("at"), none.alias("out")), add)["out"]

    last = F.floor((F.size(hits) - 1) / BLOCK).cast("int")
    found = _let(steps, lambda all_steps: F.flatten(F.transform(F.sequence(F.lit(0), last), lambda k: block(all_steps, k))))
    return F.when(F.size(hits) > 0, found).otherwise(none)


def find_fixed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one array of (start, end, hit) for each fixed pattern: columns spans_assign, spans_access, spans_hex.

    Places are code points, ends exclusive. A null text has no spans.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    for kind, pattern, group, _ in PATTERNS:
        holds = body.rlike(KEYWORDS) if kind == "assign" else F.lit(True)
        none = F.expr("cast(array() as array<string>)")
        docs = docs.withColumns({f"hits_{kind}": F.when(holds, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(none), f"values_{kind}": F.when(holds, F.regexp_extract_all(body, F.lit(pattern), F.lit(group))).otherwise(none)} if group else {f"hits_{kind}": F.regexp_extract_all(body, F.lit(pattern), F.lit(0))})
    docs = docs.withColumns({f"spans_{kind}": _spans(body, pattern, F.col(f"hits_{kind}"), F.col(f"values_{kind}" if group else f"hits_{kind}"), least) for kind, pattern, group, least in PATTERNS})
    return docs.drop(*[f"{a}_{k}" for a in ("hits", "values") for k, *_ in PATTERNS])


def random_samples(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """Labelled samples of random strings, made from hashes: base64, its letters alone, hex and upper-case keys.

    rows bounds them.
    """
    seed = F.sha2(F.col("id").cast("string"), 256)
    letters = F.regexp_replace(F.base64(F.unhex(seed)), "[^A-Za-z]", "")
    forms = F.array(F.base64(F.unhex(F.substring(seed, 1, 48))), F.substring(seed, 1, 40), F.upper(F.substring(F.base64(F.unhex(F.substring(seed, 5, 40))), 1, 24)), letters)
    return spark.range(rows).select(F.explode(forms).alias("value"), F.lit(True).alias("secret"))


def identifier_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labelled samples of ordinary identifiers, from all documents.

    Runs of candidate characters without digits as they stand, and of each document a name made of three of its words
    in the manner of code, paths and keys, with a number.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    runs = F.filter(F.regexp_extract_all(body, F.lit(r"[A-Za-z0-9+/_=-]{12,}"), F.lit(0)), lambda r: ~r.rlike("[0-9+/=]"))
    words = F.filter(F.split(body, "[^A-Za-z]+"), lambda w: F.length(w) > 2)

    def name(w: Column) -> Column:
        h = F.xxhash64(w)
        pick = lambda k: F.lower(F.get(w, F.pmod(F.shiftright(h, 8 * k), F.size(w)).cast("int")))
        a, b, c, n = pick(1), pick(2), pick(3), F.pmod(h, F.lit(3000)).cast("string")
        forms = F.array(
            F.concat_ws("_", a, b, c, n), F.concat_ws("-", a, b, n, c), F.concat_ws("/", a, b, n, c), F.concat(a, F.initcap(b), F.initcap(c), n), F.concat(F.initcap(a), F.initcap(b), F.initcap(c)),
            F.upper(F.concat_ws("_", a, b, c)), F.concat(a, n, F.lit("_"), b, F.lit("/"), c), F.concat(a, b, c),
        )
        return F.get(forms, F.pmod(h, F.lit(8)).cast("int"))

    named = F.when(F.size(words) > 0, F.array(_let(words, name))).otherwise(F.expr("cast(array() as array<string>)"))
    return docs.select(F.explode(F.concat(runs, named)).alias("value"), F.lit(False).alias("secret"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of ASCII characters, random against identifier, at 128 * first + second.

    Both models are first-order Markov chains with half a count added to each of the 67 candidate characters.
    Pairs are counted for every sample; the table is at most 2 x 16,384 rows.
    """
    value = F.col("value")
    pair = lambda i: F.ascii(F.substring(value, i, 1)) * 128 + F.ascii(F.substring(value, i + 1, 1))
    pairs = samples.where(F.length(value) >= 2).select("secret", F.explode(F.transform(F.sequence(F.lit(1), F.length(value) - 1), pair)).alias("pair"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in pairs.where("pair between 0 and 16383").groupBy("secret", "pair").count().collect():
        counts[r.secret][r.pair] = r["count"]

    def chain(seen: dict[int, int]) -> list[float]:
        of = [0] * 128
        for pair, n in seen.items():
            of[pair // 128] += n
        return [math.log((seen.get(p, 0) + 0.5) / (of[p // 128] + 0.5 * 67)) for p in range(128 * 128)]

    return [round(a - b, 6) for a, b in zip(chain(counts[True]), chain(counts[False]), strict=True)]


def fit(docs: DataFrame, text: str = "text") -> dict:
    """table: the ratios of train(); threshold, recall and false_positives: of the held-out samples of LEAST characters.

    A sample is held out by its hash, so that equal ones are on one side. Without ordinary held-out samples the
    threshold is 0.
    """
    samples = random_samples(docs.sparkSession).unionByName(identifier_samples(docs, text))
    out = F.pmod(F.xxhash64("value"), F.lit(HELD_OUT)) == 0
    table = train(samples.where(~out))
    held = samples.where(out & (F.length("value") >= LEAST)).select("secret", F.floor(ratio(F.col("value"), table) / STEP).alias("bin"))
    counts = {(r.secret, r["bin"]): r["count"] for r in held.groupBy("secret", "bin").count().collect()}  # a few hundred bins
    above = lambda secret, k: sum(n for (s, b), n in counts.items() if s == secret and b >= k)
    ordinary, secrets = above(False, -(10**9)), above(True, -(10**9))
    bins = sorted({b for _, b in counts} | {0})
    low = next((k for k in range(bins[0], bins[-1] + 2) if above(False, k) <= FALSE_POSITIVES * ordinary), 0) if ordinary else 0
    high = next((k for k in range(bins[-1], low, -1) if above(True, k) >= RECALL * secrets), low)
    k = (low + high) // 2
    return {"table": table, "threshold": k * STEP, "recall": above(True, k) / max(1, secrets), "false_positives": above(False, k) / max(1, ordinary)}


def ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio over the pairs of characters of value; 0 for fewer than two characters."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    total = F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, F.ascii(F.substring(value, i, 1)) * 128 + F.ascii(F.substring(value, i + 1, 1))))
    return F.when(F.length(value) >= 2, total / (F.length(value) - 1)).otherwise(0.0)


def _tagged(no: int, kind: str) -> Column:
    return F.transform(f"spans_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["hit"].alias("hit")))


def _outside(run: Column, fixed: Column) -> Column:
    """The parts of a run, of LEAST characters or more, that no fixed span covers."""
    over = F.array_sort(F.filter(fixed, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])))

    def between(spans: Column) -> Column:
        after = lambda k: F.aggregate(F.slice(spans, F.lit(1), k), run["start"], lambda at, b: F.greatest(at, b["end"]))
        gaps = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: F.struct(after(k).alias("start"), F.coalesce(F.get(spans, k)["start"], run["end"]).alias("end")))
        part = lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), F.substring(run["hit"], g["start"] - run["start"] + 1, g["end"] - g["start"]).alias("hit"))
        return F.transform(F.filter(gaps, lambda g: g["end"] - g["start"] >= LEAST), part)

    return _let(over, between)


def scan(docs: DataFrame, model: dict, text: str = "text", threshold: float | None = None) -> DataFrame:
    """docs with found: array of (start, kind_no, end, kind, hit), ordered by start, then kind as in KINDS.

    Fixed spans always stay. The models judge each run of candidate characters, or what fixed spans leave of it, and add
    those whose mean ratio is the model's threshold or more. Null and empty texts have no spans; repeated rows are each
    scanned; a text of any length is scanned as a whole. Columns of docs whose names begin with hits_ or spans_, and
    found, are replaced. An empty table gives an empty table.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    least = model["threshold"] if threshold is None else threshold
    docs = find_fixed(docs, text).withColumn("hits_markov", F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)))
    runs = _spans(body, CANDIDATE, F.col("hits_markov"), F.col("hits_markov"), LEAST)
    fixed = F.concat(*[F.col(f"spans_{k}") for k, *_ in PATTERNS])
    parts = _let(fixed, lambda spans: F.flatten(F.transform(runs, lambda r: _outside(r, spans))))
    docs = docs.withColumn("spans_markov", F.filter(parts, lambda s: ratio(s["hit"], model["table"]) >= least))
    tagged = [_tagged(no, kind) for no, kind in enumerate(KINDS)]
    return docs.withColumn("found", F.array_sort(F.concat(*tagged))).drop("hits_markov", *[f"spans_{k}" for k in KINDS])


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts by kind, digest of the fixed spans, and all spans."""
    found = scan(docs.select("doc_id", "text"), fit(docs))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k, *_ in PATTERNS], F.sha2(joined(F.filter("found", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
