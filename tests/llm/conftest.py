import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    parts = "the er ing on ti en an re th nd ou ha é ü ñ".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    """Small texts with copies, near copies, shared passages, nulls, ties and odd characters."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 8, 40, 60, 90, 150, 400)]
    passage = prose(rng, 25)
    texts = [*base, *base[2:5], base[0], None, "", " \n\t ", "a", "The END", "x" * 300, "it's  we'll\n\n don't <|endoftext|> done", "日本語 " * 30]
    for i in range(30):
        words = base[5 + i % 2].split()
        for _ in range(rng.randint(1, 12)):
            words[rng.randrange(len(words))] = rng.choice("abcdefgh")
        texts.append(" ".join(words))
    for _ in range(8):
        texts.append(f"{prose(rng, 20)}\n{passage}\n{prose(rng, 20)}")
    texts.append(prose(rng, 20) + "ab" * 40 + prose(rng, 20) + "ab" * 40)
    texts.append("ab" * 60)
    return [(i * 3 + 1, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, rows):
    """The corpus with a column whose name clashes with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumn("rep", F.lit(1)).withColumn("_k", F.lit("x")).withColumn("family", F.lit(2.0))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
