import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, score string"


def made(seed=7, n=60):
    """Random small texts with nulls, blanks, repeats, copies, near copies and one long text."""
    r = random.Random(seed)
    vocab = ["the", "Of", "and", "été", "naïve", "x1", "über", "a", "b", "c", "fooBar", "zzz"] + [f"w{i}" for i in range(80)]
    sep = [" ", "\n", "  ", ", ", "\t", ". "]

    def text(k):
        return "".join(r.choice(vocab) + r.choice(sep) for _ in range(k))

    texts = [None, "", "   \n", "one", "two words", "\x00 \x1c odd     x"]
    texts += [text(r.randint(1, 60)) for _ in range(n)]
    texts += [text(4000)]
    base = text(80)
    texts += [base, base, base.upper(), base + " tail", "head " + base, base.replace("w1", "v1")]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "clash", None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "null id text here", None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)
