import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Small texts over invented words, with copies, near copies, repeated lines and odd cases."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice(["ba", "ke", "lo", "mi", "nu", "é", "st", "tr"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = ["\n".join(line(r.randint(1, 30)) for _ in range(r.randint(1, 8))) for _ in range(60)]
    near = []
    for t in texts[:20]:
        words = t.split(" ")
        words[len(words) // 2] = "other"
        near.append(" ".join(words))
    odd = [None, "", " \n\t ", "one", "\n\n", "a b c d e", "a b c d e", line(30) + " " + line(30) * 2, "x " * 300, line(4000)]
    return texts + texts[:10] + near + odd


@pytest.fixture(scope="session")
def docs(spark, prose):
    """As documents, with a null id, a repeated row and columns whose names clash with those that operators use."""
    rows = [(i, t, "x", i, "y") for i, t in enumerate(prose)] + [(None, "nobody here " * 9, None, None, None), (3, prose[3], "x", 3, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n long, lines string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
