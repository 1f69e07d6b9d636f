import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest long, score double, k long, block int, quality string"


def corpus(seed=3):
    """Texts with copies, near copies, long and odd ones; (doc_id, text, source)."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeghilmnorstu") for _ in range(draw.randint(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(draw.choice(vocabulary) + ("." if draw.random() < 0.1 else "") for _ in range(n))

    rows = []
    base = prose(160)
    for k in range(60):
        rows.append((k, prose(draw.randint(20, 200)), f"s{k % 3}"))
    for k in range(60, 72):
        words = base.split(" ")
        for _ in range(k - 60):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        rows.append((k, " ".join(words), "s0"))
    rows += [(72, base, "s1"), (73, base, None), (74, prose(5000), "s2"), (75, "x" * 3000, "s2"), (76, "ab " * 700, "s1")]
    rows += [(77, rows[3][1] + "\n" + rows[4][1], "s0"), (78, "", "s1"), (79, None, "s1"), (80, " \n\t ", "s2"), (None, base, "s0"), (None, None, None)]
    rows += [(81, "one two", "s0"), (82, "One two", "s0"), (83, "Ünïcödé straße " * 60, "s1"), (83, "Ünïcödé straße " * 60, "s1"), (84, "a  b\t c\n\n d <|endoftext|> e ", "s2")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with extra columns whose names the operators use themselves."""
    full = [(d, t, "en", s, None if t is None else len(t), 1, 0.5, 2, 3, "q") for d, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
