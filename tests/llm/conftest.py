"""Small documents with the awkward cases: nulls, empty and long texts, repeated rows, and columns with clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, bands string, component_id int, score string, marks string, block int"


def random_text(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def make_rows() -> list[tuple]:
    rng = random.Random(4)
    base = [random_text(rng, rng.randrange(1, 160)) for _ in range(30)]
    passage = random_text(rng, 70)
    texts = [*base]
    texts += [base[3], base[3], base[7] + " tail", "head " + base[7], base[9].upper()]  # copies and near copies
    texts += [base[k] + "\n" + passage + "  " + base[k + 1] for k in range(12, 18)]  # a passage that documents share
    texts += ["", "   \n\t ", "one", "one two three four", "12 34 !!", "Ünïcode straße été " * 30, random_text(rng, 6000, 5000)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(1001, None), (None, base[3]), (None, None)]
    rows += [rows[5], rows[5], rows[-3]]  # repeated rows
    rng.shuffle(rows)
    return [(i, t, None if i is None or i % 7 == 0 else "en", None, None, "x", "y", 5, "z", "m", 1) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
