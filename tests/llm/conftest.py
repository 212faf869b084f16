import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, _h string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text[, lang, source]) rows with extra columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or ""), 1, "x") for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null and empty texts, a null id, a long text, odd white space, repeated rows and repeated texts."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "δέλτα", "x1"]) for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one\x0btwo\x0cthree four"), (6, "same text here"), (7, "same text here"), (8, "tie"), (8, "tie"), (None, "no id at all"), (9, "n" * 5000), (10, "<|endoftext|> plain")]
    return make_docs([(*r, "en", s) for r, s in zip(rows, ["a", "b", None, "a", "a", "b", None, "c", "c", "a", "c", "b"], strict=True)])


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
