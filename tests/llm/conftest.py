import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40000))
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from here to the old mill. "
ROWS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one two three"), (4, PROSE * 3), (5, PROSE * 3), (6, PROSE * 3 + "extra words"), (7, LONG), (8, "a" * 30000),
    (9, "Write to ann.b+c@mail.example.com, +1 (555) 010-9999 or 10.0.0.255; card 4111 1111 1111 1111."), (10, "ü日本 é ñ 😀😀\nx\nx\nx\n"), (11, "x<|endoftext|>y it's"),
    (12, PROSE.upper()), (13, PROSE), (None, PROSE), (None, None), (14, "dup row"), (14, "dup row"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with names that operators might use."""
    rows = [(i, t, "en" if i != 3 else None, f"src{i}", len(t or ""), 1.0, "k") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(15)] + [(3, None, None), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
