import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def sentence(rng, n, base="abcdefghij"):
    return " ".join("".join(rng.choice(base) for _ in range(rng.randint(1, 7))) for _ in range(n))


def make_rows(seed=1, n=60):
    """Random documents with copies, near copies, shared lines, nulls, blanks and repeated rows."""
    rng = random.Random(seed)
    texts = ["\n".join(sentence(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    rows = []
    for i, t in enumerate(texts):
        rows.append([i * 3, t])
    for i in range(n // 3):
        words = rng.choice(texts).split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        rows.append([i * 3 + 1, " ".join(words)])
    for i in range(10):  # one character put in, left out or changed
        t = rng.choice(texts)
        k = rng.randrange(len(t))
        rows.append([i * 3 + 2, t[:k] + rng.choice(["", "x", t[k] + "y"]) + t[k + 1 :]])
    rows += [[500, None], [501, ""], [502, "  \n\t "], [503, "one two"], [503, "one two"], [504, "One  two"], [505, "!!! 123"], [506, sentence(rng, 9000) + "\n" + "z" * 3000], [None, texts[0]], [507, "é" * 30 + " ça\n" + "é" * 29 + "x ça"]]
    return [(i, t, None if t is None or (i or 0) % 7 == 3 else "en" if (i or 0) % 2 else "de", None if (i or 0) % 11 == 5 else f"s{(i or 0) % 4}", None, "x") for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
