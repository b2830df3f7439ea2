"""URL filter: host rules first, then pattern rules found by their rarest literal token."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopylens.llm.common import ascii_lower, cut, shielded

#: Host rules: a host with all its subdomains, and a prefix of the path.
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Pattern rules: regular expressions over the lower-cased url.
PATTERN_RULES = [
    ("session", r"[?&](sid|session)=[0-9a-f]+"),
    ("feed", r"[?&]utm_source=feed(&|#|$)"),
    ("paging", r"\?page=[0-9]+&ref="),
    ("mobile-es", r"://m\.[^/]+/es/"),
    ("login", r"/login(/|\?|$)"),
    ("cart", r"/cart/(add|checkout)"),
    ("casino", r"[./-]casino[./-]"),
    ("adult", r"[./-]xxx[./-]"),
    ("admin", r"/wp-admin/[a-z-]+\.php"),
    ("print", r"/print/[0-9]+\.html"),
]
#: What a pattern is read as: a class, a group, an escape or one character, with the sign of repetition that may follow
#: it; a sign may be lazy or possessive, by a second one.
_PIECE = re.compile(r"(\[[^\]]*\]|\([^()]*\)|\\.|.)((?:[?*+]|\{[^}]*\})[?+]?)?", re.DOTALL)


def literal_tokens(pattern: str) -> list[str]:
    """The tokens that every match of pattern holds whole, alternatives joined by |; none where that isn't certain.

    A token is a run of literal letters and digits, or a group of such runs, between two pieces that can't be letters or
    digits: other literals, classes without letters, digits and ranges, or a group of such. What may be missing or
    repeated, lazily or not, is no boundary. Patterns with | outside groups, with nested or unusual groups and classes,
    with quotes or with flags have no tokens.
    """
    if re.search(r"\([^()]*\(|\(\?|[A-Z]|\[\^?\]|\[[^\]]*(\[|&&)|\\[pkxucN]", pattern) or "|" in re.sub(r"\([^()]*\)|\[[^\]]*\]|\\.", "", pattern):
        return []
    kinds: list[tuple[str, str]] = []
    for piece, sign in _PIECE.findall(pattern):
        inner = piece[1:-1]
        if sign:
            kinds.append(("unknown", ""))
        elif piece.startswith("["):
            kinds.append(("edge" if not inner.startswith("^") and not re.search(r"[a-z0-9\\]|.-.", inner) else "unknown", ""))
        elif piece.startswith("("):
            options = inner.split("|")
            plain = all(re.fullmatch("[a-z0-9]+", x) for x in options)
            edge = all(re.fullmatch(r"\\[?.]|[&#/$=-]", x) for x in options)
            kinds.append(("word", inner) if plain else ("edge" if edge else "unknown", ""))
        elif re.fullmatch("[a-z0-9]", piece):
            kinds.append(("letter", piece))
        else:
            kinds.append(("edge" if re.fullmatch(r"\\[^a-z0-9]|[^a-z0-9.()\[\]]", piece) else "unknown", ""))
    out, at = [], 0
    while at < len(kinds):
        end = at
        while end < len(kinds) and kinds[end][0] == "letter":
            end += 1
        if end == at and kinds[at][0] == "word":
            end = at + 1
        if end > at and 0 < at and end < len(kinds) and kinds[at - 1][0] == kinds[end][0] == "edge":
            out.append("".join(x for _, x in kinds[at:end]))
        at = max(end, at + 1)
    return list(dict.fromkeys(out))


def as_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rules as a table that no Python process has to make."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kinds = ", ".join(c.replace(" ", ": ", 1) for c in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kinds}>>")))


def pattern_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(pattern_id, pattern, tokens) of some thousand rules; larger sets are given as such a table."""
    return as_table(spark, [(i, p, literal_tokens(p)) for i, p in rules], "pattern_id string, pattern string, tokens array<string>")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or where there is no '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(url), "[^a-z0-9]+"), lambda t: t != ""))


#: Rules without a token are listed under so many numbers instead, one of which each url gets by its hash.
DEALS = 256


def index_rules(url_token: DataFrame, rules: DataFrame) -> DataFrame:
    """Each pattern rule under that of its tokens which the fewest urls hold; ties go to the smaller token.

    Alternatives count together, and the rule is listed under each of them. A rule without tokens is listed nowhere.
    """
    of_rules = rules.select("pattern_id", "pattern", F.explode("tokens").alias("any")).withColumn("token", F.explode(F.split("any", r"\|")))
    seen = url_token.join(of_rules.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rare = of_rules.join(seen, "token", "left").fillna(0, ["n"]).groupBy("pattern_id", "pattern", "any").agg(F.sum("n").alias("n"))
    rare = rare.groupBy("pattern_id", "pattern").agg(F.min(F.struct("n", "any"))["any"].alias("any"))
    return rare.select("pattern_id", "pattern", F.explode(F.split("any", r"\|")).alias("token"))


NEW = ["host", "path", "rule", "verdict", "pattern_id"]


def judge_urls(pages: DataFrame, host_rules: DataFrame | None = None, pattern_rules: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and pattern_id (of the pattern rule that decided, the smallest of several).

    host_rules: (rule_host, rule_path, rule_verdict); pattern_rules: (pattern_id, pattern, tokens). The longest host rule
    that fits decides; without one, a matching pattern rule blocks; all else is allowed. A null url and one without
    '://' have an empty host and path. Repeated rows stay, their url is judged once. A url of any length is judged whole.
    Columns of pages with the names of the new ones are replaced. An empty table gives an empty table.
    """
    return shielded(pages.drop(*NEW), (url,), lambda d: _judged(d, host_rules, pattern_rules, url), NEW)


def _judged(pages: DataFrame, host_rules: DataFrame | None, pattern_rules: DataFrame | None, url: str) -> DataFrame:
    spark = pages.sparkSession
    hosts = as_table(spark, HOST_RULES, "rule_host string, rule_path string, rule_verdict string") if host_rules is None else host_rules
    rules = pattern_table(spark, PATTERN_RULES) if pattern_rules is None else pattern_rules
    host, path = split_url(F.col("u"))
    urls = pages.select(F.col(url).alias("u")).where("u is not null").distinct().withColumns({"host": host, "path": path})

    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = urls.select("u", "path", F.explode(suffixes).alias("rule_host")).join(hosts, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    by_host = fits.groupBy("u").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))

    tokens = urls.select("u", F.explode(url_tokens(F.col("u"))).alias("token"))
    index = index_rules(tokens, rules)
    others = rules.where(F.size("tokens") == 0).select("pattern_id", "pattern", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))).alias("deal"))
    every = urls.select("u", F.pmod(F.xxhash64("u"), F.lit(DEALS)).alias("deal")).join(others, "deal")
    fetched = tokens.join(index, "token").select("u", "pattern_id", "pattern").unionByName(every.select("u", "pattern_id", "pattern"))
    fetched = fetched.where(F.expr("rlike(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), pattern)"))
    by_pattern = fetched.groupBy("u").agg(F.min("pattern_id").alias("pattern_id"))

    # written, so that the join back is one of two scans, whose hot urls Spark splits
    decided = cut(urls.join(by_host, "u", "left").join(by_pattern, "u", "left").select(
        "u", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("pattern_id").isNotNull(), "block"), F.lit("allow")).alias("verdict"),
        F.when(F.col("best").isNull(), F.col("pattern_id")).alias("pattern_id"),
    ), "judged-urls")
    return pages.join(decided, pages[url] == decided["u"], "left").select(
        *[pages[c] for c in pages.columns], F.coalesce(decided["host"], F.lit("")).alias("host"), F.coalesce(decided["path"], F.lit("")).alias("path"),
        "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "pattern_id",
    )


def oracle() -> str:
    """DuckDB SQL with the same rules, each evaluated on every url."""
    low = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hosts = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in HOST_RULES)
    patterns = " ".join(f"when regexp_matches({low}, '{p}') then '{i}'" for i, p in sorted(PATTERN_RULES))
    return f"""
with rest as (select row_number() over () as rid, page_id, url,
    case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
parts as (select rid, page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, case {patterns} end as pid from rest),
rules(h, p, v) as (values {hosts}),
best as (select rid, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as v
    from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by rid)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule,
    coalesce(v, case when pid is not null then 'block' end, 'allow') as verdict, case when rule is null then pid end as pattern_id
from parts left join best using (rid)"""
