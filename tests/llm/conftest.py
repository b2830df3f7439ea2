import random

import pytest

ODD = ["", None, "   \n\t", "one", "a b c d", "ünï cödé ñ\nline two here", "x " * 30_000]


def prose(seed: int, words: int, lines: int = 1, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    text = [f"w{r.randrange(vocabulary)}" for _ in range(words)]
    cuts = sorted(r.sample(range(1, words), lines - 1)) if lines > 1 else []
    return "\n".join(" ".join(text[a:b]) + "." for a, b in zip([0, *cuts], [*cuts, words], strict=True))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Prose, near copies, exact copies, odd texts, a null id and a null source, and a row that is there twice."""
    texts = [prose(i, 120 + i, 1 + i % 6) for i in range(40)]
    texts += [t.replace("w7 ", "changed ", 1) for t in texts[:10]] + texts[10:15] + ODD
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, prose(99, 80, 3), "en", "s0", 5)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
