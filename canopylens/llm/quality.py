"""Quality rules, lines first: lines that fail a rule are removed, then documents that lost too much are rejected."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from canopylens.llm.common import forget, shielded

#: ASCII white space, characters that count as symbols, separators of menus, ends of sentences.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "»", " > ", " · ")
ENDINGS = (".", "!", "?", ":", ";", '"', "'", ")", "”", "»", "…")
#: Phrases of lines that belong to a site and not to its text, by language.
BOILERPLATE_PHRASES = {
    "en": (
        "all rights reserved", "accept (all )?cookies", "cookie policy", "privacy policy", "terms of (use|service)", "enable javascript", "lorem ipsum",
        "click here", "subscribe to our", "sign up for", "log in to", "licensed under", "released under", "share on (facebook|twitter)",
    ),
    "de": ("alle rechte vorbehalten", "cookies (akzeptieren|zulassen)", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "javascript aktivieren", "hier klicken", "newsletter abonnieren", "lizenziert unter"),
    "fr": ("tous droits réservés", "accepter (tous )?les cookies", "politique de confidentialité", "conditions d.utilisation", "activer javascript", "cliquez ici", "abonnez-vous à", "partager sur (facebook|twitter)", "mentions légales"),
    "es": ("todos los derechos reservados", "aceptar (todas )?las cookies", "política de (cookies|privacidad)", "(términos|condiciones) de uso", "(active|habilite) javascript", "haga clic aquí", "suscríbase a", "compartir en (facebook|twitter)", "aviso legal"),
}
#: Phrases of lines that lead elsewhere, where a line has few words.
NAVIGATION_PHRASES = {
    "en": ("skip to (main )?content", "back to top", "read more", "(next|previous) page", "main menu", "site map"),
    "de": ("zum (inhalt|hauptmenü)", "nach oben", "weiterlesen", "(nächste|vorherige) seite", "hauptmenü", "startseite"),
    "fr": ("aller au contenu", "haut de page", "lire la suite", "page (suivante|précédente)", "menu principal", "plan du site"),
    "es": ("(ir|saltar) al contenido", "volver arriba", "(leer|seguir) (más|leyendo)", "página (siguiente|anterior)", "menú principal", "mapa del sitio"),
}
BOILERPLATE, NAVIGATION = (re.compile("|".join(p for own in phrases.values() for p in own)) for phrases in (BOILERPLATE_PHRASES, NAVIGATION_PHRASES))
NAVIGATION_WORDS = 6
#: A line fails with more than this many symbols for each word; unpunctuated, with fewer words than this; as a menu, with so many separators.
SYMBOLS_A_WORD = 0.2
SHORT_LINE = 4
MENU_SEPARATORS = 3
#: A document is rejected if it lost more than this share of its words with its lines.
MAX_LOST = 0.5

MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "n_lost_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])


def line_fails(line: str, words: int) -> bool:
    """Whether a line with that many words breaks a line rule; blank lines break none."""
    if not words:
        return False
    if sum(line.count(c) for c in SYMBOLS) > SYMBOLS_A_WORD * words:
        return True
    if line.count("!!") * 2 > words or words >= SHORT_LINE and line.isupper():
        return True
    if words < SHORT_LINE and not line.rstrip(SPACES).endswith(ENDINGS):
        return True
    if sum(line.count(s) for s in SEPARATORS) >= MENU_SEPARATORS:
        return True
    lower = line.lower()
    return BOILERPLATE.search(lower) is not None or words <= NAVIGATION_WORDS and NAVIGATION.search(lower) is not None


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, hit = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit[i : i + 3] = b"\1\1\1"
    return sum(hit)


def judge(text: str | None, max_lost: float = MAX_LOST) -> tuple[tuple, str]:
    """The measures of a text, in the order of MEASURES, and the text without its failed lines."""
    text = text or ""
    words = text.encode().split()
    lines = text.split("\n")
    counts = [len(x.encode().split()) for x in lines]
    bad = [line_fails(x, n) for x, n in zip(lines, counts, strict=True)]
    full = [x for x, n in zip(lines, counts, strict=True) if n]
    lost = sum(n for n, b in zip(counts, bad, strict=True) if b)
    repeats = repeated_words(words)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    return (
        len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS), len(full) - len(set(full)), repeats,
        len(full), sum(bad), lost, failed, not failed and lost <= max_lost * len(words),
    ), "\n".join(x for x, b in zip(lines, bad, strict=True) if not b) if lost else text


def clean(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """docs with the columns of MEASURES and clean_text; columns of docs with these names are replaced.

    A null text has no words: it fails and its clean text is empty. Every row is judged alone, so that repeated rows
    and columns of any name make no difference. An empty table gives an empty table.
    """
    docs = docs.drop(*MEASURES.names, "clean_text")
    schema = T.StructType([*docs.schema, *MEASURES, T.StructField("clean_text", T.StringType())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        types = [pa.int64()] * 8 + [pa.bool_()] * 2
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = [judge(t, max_lost) for t in batch.column(text).to_pylist()]
                new = [pa.array([m[k] for m, _ in rows], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new, pa.array([c for _, c in rows], pa.string())], names=schema.names)

    return docs.mapInArrow(judged, schema)


def verdicts(docs: DataFrame) -> DataFrame:
    """One row for each document: the base measures and whether the document is kept."""
    return clean(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(docs: DataFrame) -> DataFrame:
    """The documents kept, with their failed lines removed, in the columns of docs.

    Null and empty texts go. Columns of any name come through as they are; repeated rows are each judged alike, and a
    text of any length as a whole. An empty table gives an empty table.
    """

    def kept(rows: DataFrame) -> DataFrame:
        out = clean(rows).where("kept")
        return out.select(*[out["clean_text"].alias("text") if c == "text" else out[c] for c in rows.columns])

    return shielded(docs, ("text",), kept)


def oracle() -> str:
    """DuckDB SQL with the same rules."""
    word = r"[^\x20\x09-\x0D]+"
    symbols = "length(regexp_replace({}, '[^#*$%&|<>]', '', 'g'))"
    count = lambda s: f"(length(line) - length(replace(line, '{s}', ''))) // {len(s)}"
    ends = " or ".join(f"ends_with(tail, '{e.replace(chr(39), chr(39) * 2)}')" for e in ENDINGS)
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, regexp_extract_all(text, '{word}') as words from d),
tri as (select rid, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] as g
    from (select rid, words, unnest(range(1, len(words) - 1)) as i from w)),
rep as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p
    from (select rid, i, count(*) over (partition by rid, g) as c from tri) where c > 1) group by rid),
l as (select rid, unnest(string_split(text, chr(10))) as line from d),
n as (select rid, line, len(regexp_extract_all(line, '{word}')) as k, regexp_replace(line, '[\\x20\\x09-\\x0D]+$', '') as tail from l),
f as (select rid, line, k, k > 0 and ({symbols.format('line')} > {SYMBOLS_A_WORD} * k
    or ({count('!!')}) * 2 > k or (k >= {SHORT_LINE} and regexp_matches(line, '\\p{{Lu}}') and not regexp_matches(line, '\\p{{Ll}}'))
    or (k < {SHORT_LINE} and not ({ends}))
    or ({' + '.join(count(s) for s in SEPARATORS)}) >= {MENU_SEPARATORS}
    or regexp_matches(lower(line), '{BOILERPLATE.pattern}')
    or (k <= {NAVIGATION_WORDS} and regexp_matches(lower(line), '{NAVIGATION.pattern}'))) as bad from n),
g as (select rid, (count(*) filter (k > 0)) - count(distinct case when k > 0 then line end) as n_dup_lines, coalesce(sum(k) filter (bad), 0) as lost from f group by rid),
m as (select doc_id, len(words) as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars, {symbols.format('text')} as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(lost, 0) as lost
    from d join w using (rid) left join rep using (rid) left join g using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost <= {MAX_LOST} * n_words as kept from m"""
