import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, words, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(words)).capitalize() + "."


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def rows(vocabulary):
    """Plain texts, copies, near copies, a shared passage, null and empty texts, a very long text, null ids, repeated rows."""
    rng = random.Random(5)
    passage = sentence(rng, 90, vocabulary)
    out = []
    for i in range(40):
        text = "\n".join(sentence(rng, rng.randint(5, 40), vocabulary) for _ in range(rng.randint(1, 8)))
        if i % 7 == 0:
            text += "\n" + passage
        out.append((i, text, "en" if i % 2 else "fr", f"s{i % 3}", len(text)))
    out += [(100 + k, out[0][1], "en", "s0", 1) for k in range(5)]  # copies
    out += [(110 + k, out[1][1].replace(" ", "  ", k), "en", "s0", 1) for k in range(3)]  # near copies
    out += [(200, None, "en", "s1", 0), (201, "", None, None, 0), (202, "   \n\t", "en", "s1", 0), (203, "x", "fr", "s2", 1), (204, "é" * 900 + " ünï " * 50, "fr", "s2", 1)]
    out += [(205, " ".join(rng.choice(vocabulary) for _ in range(20_000)), "en", "s1", 1), (206, "ab " * 3000, "en", "s1", 1)]
    out += [(None, "no id here at all", "en", "s1", 1), (None, "no id here at all", "en", "s1", 1), (7, out[7][1], "fr", "s1", 1), (7, "same id, another text", "en", "s1", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("shard", "size", "key", "th", "words", "fp", "node", "hash", "n", "slot", "tokens", "p", "spans")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
