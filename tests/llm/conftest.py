"""Documents with every odd case at once, and a small corpus with copies."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, chunk int, rep long, h long"


def rows_of(texts):
    """Extra columns with names that operators use inside."""
    return [(i, t, None, "src0", len(t) if t else None, 7, 7, 7, 7) for i, t in texts]


def prose(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "and", *("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300))]
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="session")
def odd_texts():
    long = " ".join(f"w{i}" for i in range(20_000))
    base = prose(1, 120)
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, "one two"), (6, "a b c d e"), (7, long), (8, "x" * 50_000), (9, base), (10, base),
        (11, base + " tail"), (12, base.upper()), (13, "é 漢字 🙂 \x1c \x85 end"), (14, " ".join(["same"] * 400)), (15, "tie tie tie"), (15, "tie tie tie"), (None, base), (None, None),
        (16, "write to a.b@c.org or +1 (017) 555-7713, 4111 1111 1111 1111, 10.0.0.1"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return spark.createDataFrame(rows_of(odd_texts), SCHEMA)


@pytest.fixture(scope="session")
def corpus_texts():
    rng = random.Random(5)
    texts = []
    shared = prose(99, 60)
    for i in range(60):
        t = prose(i, rng.randint(30, 200))
        texts.append(t)
        if i % 3 == 0:  # near copies: a few words changed
            for k in range(3):
                w = t.split()
                for _ in range(k):
                    w[rng.randrange(len(w))] = f"new{k}"
                texts.append(" ".join(w))
        if i % 5 == 0:
            texts.append(t[: len(t) // 2] + " " + shared + " " + t[len(t) // 2 :])
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def corpus(spark, corpus_texts):
    return spark.createDataFrame(rows_of(corpus_texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
