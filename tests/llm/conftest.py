import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, digest string, copies int, row long, start long"


def small_documents():
    """Nulls, empty and blank texts, ties, repeated ids and rows, a very long text, near copies, and columns that clash."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega", "Ünï", "x9", "kappa.", "(psi)"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))
    base, passage = prose(60), prose(60)
    near = base.split()
    near[50] = "changed"
    texts = [None, "", "   ", " \n\t", "one", "One", "a b c d", "A b c D", base, base.upper(), " ".join(near), base + " more", passage, prose(40) + " " + passage + " " + prose(30), prose(5) + "\n" + passage, prose(6000), "ab" * 300, "ab" * 290 + "c", "é" * 250, prose(8)]
    rows = [(k, t, rng.choice(["en", None]), rng.choice(["s1", "s1", "s2", "s3", None]), None, True, 1, "d", 2, 3, 4) for k, t in enumerate(texts)]
    # a null id, a repeated row, and an id that two texts share
    rows += [(None, base, None, None, 1, None, None, None, None, None, None), rows[8], (8, prose(30), "en", "s1", 1, None, None, None, None, None, None), (-5, "one", "en", "s9", 1, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def small(spark):
    return spark.createDataFrame(small_documents(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def unique(spark):
    """The same with unique ids."""
    return spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(small_documents())], COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
