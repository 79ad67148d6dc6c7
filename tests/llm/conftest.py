import random

import pytest

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "a", "a b", "A\x0b b\x1c c", "x" * 50_000, "word " * 6_000, "\u00a0 é ü 漢字 \n\n\n z"]


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents, odd texts, repeated rows, null ids, and columns whose names clash."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    data = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, "x") for r in rows]
    data += [(10_000 + i, t, None, None, None, 2, None) for i, t in enumerate(ODD)]
    data += [data[0], data[0], (None, data[1][1], "en", "s", 3, 0, "y"), (None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string"
    return spark.createDataFrame(data, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture
def rng():
    return random.Random(7)
