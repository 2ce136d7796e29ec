import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, n_words long, g long, key long, at long, n_removed long"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with those of results."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    shared = text(70)
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, shared + " " + text(60)), (5, text(50) + " " + shared), (6, ""), (7, None), (8, "   \n\n "), (9, "short"), (10, text(20_000)), (11, "Ünïcödé ß <|endoftext|> 日本語 \U0001f389 x"), (None, text(40)), (None, None), (12, text(30) + "\nmenu home\n" + text(30)), (13, "menu home\n" + text(20)), (14, "menu home"), (14, "menu home"), (15, "A b C d"), (15, text(44))]
    rows += [(20 + i, text(rng.randint(1, 150))) for i in range(40)]
    rows.append(rows[0])
    return spark.createDataFrame([(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), None, "x", 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
