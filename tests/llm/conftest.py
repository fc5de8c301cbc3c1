import random

import pytest

SF = "/root/testdata/sf0.001"
#: Names that operators use inside, as columns of the input.
CLASHING = ("fp", "k", "h", "n", "m", "score", "c0", "c1", "blk", "kept", "list", "cls", "component_id", "once", "at", "row", "length", "salt", "pii")


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "éclair", "naïve", "日本語", "👍🏽"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same, base = text(40), text(120)
    return [
        (0, None), (1, ""), (2, " \n\t "), (None, "a row without id " + same), (None, None), (3, same), (3, same), (3, base), (4, text(60_000)), (5, "x"), (6, base),
        (7, base + " tail"), (8, base), (9, same.upper()), (10, "mail a.b@mail1.example.com and 4111 1111 1111 1111"), (2**40, text(30)),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """Nulls, empty and long texts, repeated rows and ids, and clashing columns."""
    extra = tuple(range(len(CLASHING)))
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in CLASHING)
    return spark.createDataFrame([(i, t, "en", *extra) for i, t in edge_rows], schema)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
