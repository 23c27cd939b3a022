import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = os.environ.get("WARDLAKE_DATA", "/root/testdata/sf0.001")

#: Rows every operator must take: nulls, blanks, one very long text, repeated rows, odd characters.
ODD_TEXTS = [None, "", " \n\t ", "word", "\x00 \U0001f600 é x", "long " * 60_000 + "end", "repeated row", "repeated row", "null id"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, ties, and extra columns named like what operators make inside."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", i % 2, "x") for i, t in enumerate(ODD_TEXTS)]
    rows[7] = rows[6]
    rows[8] = (None, "null id", None, None, None, None)
    names = "doc_id long, text string, lang string, source string, quality int, words string, "
    extra = ["score", "class", "key", "line", "at", "rank", "share", "features", "deduped", "mixed", "base", "spans", "n", "word", "item_id"]
    rows = [(*r, *["x"] * len(extra)) for r in rows]
    return spark.createDataFrame(rows, names + ", ".join(f"{c} string" for c in extra))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture
def prose():
    """A maker of made-up sentences, the same on every run."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("bdklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    return lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
