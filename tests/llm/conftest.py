import random

import pytest

#: Columns whose names the operators use inside.
CLASHING = "id long, n long, key long, rep long, source string, lang string, shard int, rank long, at long, label string, kind byte, keys string, value string"


def rows_of(texts, start=0):
    """(doc_id, text, then clashing columns)."""
    return [(start + i, t, 7, 7, 7, 7, f"s{i % 3}", "en", 3, 7, 7, "x", 1, "k", "v") for i, t in enumerate(texts)]


@pytest.fixture
def make_docs(spark):
    def make(texts, ids=None):
        rows = rows_of(texts)
        if ids is not None:
            rows = [(i, *r[1:]) for i, r in zip(ids, rows, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, " + CLASHING)

    return make


@pytest.fixture(scope="session")
def near_texts():
    """Documents with exact and near copies of every degree, short and empty ones."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(3, 120))] for _ in range(40)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(r.randint(0, 5)):
            x = list(b)
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = r.choice(words)
            texts.append(r.choice((" ", "\n", "  ")).join(x).upper() if r.random() < 0.2 else " ".join(x))
    return [*texts, None, "", "  \n ", "one", "One", "two words", "a b c d e", "a b c d e", "x " * 20000]
