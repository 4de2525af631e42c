import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, rng string"


def corpus():
    """Edge cases: nulls, empty, one word, copies, near copies, shared passages, long and odd texts."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("aeioustrnl") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long_ = prose(60), prose(4000)
    texts = [None, "", " ", "one", "two words", "Émile naïve ß 中文 字 <|endoftext|> tail", "\n\n a\n a\n b\n a", "x" * 700, "ab" * 300, "…" * 100, "I'll we're  it's   'r", "'", "a <|endoftext|><|endoftext|>"]
    texts += [prose(200) for _ in range(5)]
    texts += [shared + " " + prose(80) for _ in range(6)] + [prose(50) + "\n" + shared + "\n" + prose(30) for _ in range(4)]
    texts += [long_, long_ + " end", "start " + long_, shared, shared]
    base = prose(300).split()
    for k in (0, 1, 2, 5, 20, 60):
        w = list(base)
        for _ in range(k):
            w[r.randrange(len(w))] = word()
        texts += [" ".join(w)] * (1 + k % 3)
    texts += ["the the the the the the", "A " * 90, "!!! WOW !!! " * 30, "Released under the MIT License.\n" + prose(60)]
    return [(i, t, None, "s" if i % 3 else "hot", None, 1, 0.5, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
