import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, shard int, spans string, hash long, text_key long"


def frame(spark, rows):
    """documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), 1, 2, "x", 3, 4) for d, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, white space, repeats, ties, long texts, and words that come everywhere."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["été", "naïve", "日本語", "🙂x", "a'll", "don't"]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = words(80)
    rows = [(0, None), (1, ""), (2, "   "), (3, "\n\t \n"), (4, "one"), (5, "one two three four"), (6, "One  two\tthree four"), (7, words(6000)), (8, "x" * 20_000), (9, " lead"), (10, "trail "), (11, "nbsp    gap  \n\n  end\n")]
    rows += [(20 + i, base) for i in range(7)] + [(30 + i, base.replace("w1", "w2", i)) for i in range(6)]
    rows += [(40 + i, base + " " + words(3)) for i in range(12)]
    rows += [(60 + i, words(rng.randrange(1, 120))) for i in range(40)]
    rows += [(4, "one"), (4, "one"), (None, "one"), (None, base), (None, words(30)), (101, words(30) + " <|endoftext|> and <|endoftext|>")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
