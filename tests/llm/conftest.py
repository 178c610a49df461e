import random

import pytest


def prose(rng, words=60):
    stems = "lantern orchard copper valley bridge harvest signal engine marble winter needle candle forest anchor saddle ribbon".split()
    tails = "s ed ing ly er less ward ful".split()
    return " ".join(rng.choice(stems) + rng.choice(["", *tails]) for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, nulls, blanks, one very long text, junk and repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(40)]
    out = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    out += [(100 + i, base[0], "en", "s", 0) for i in range(6)]
    for i in range(8):
        words = base[1].split()
        words[rng.randrange(len(words))] = "changed"
        out.append((200 + i, " ".join(words), "en", "s", 0))
    out += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, " \n\t ", "en", "s", 0), (303, "12 34 !!", "en", "s", 0), (None, "no id here at all", "en", "s", 0), (304, "word", "en", "s", 4)]
    out += [(305, " ".join(base) * 6, "en", "s", 0)] + [(306, "twice the same row", "en", "s", 0)] * 2
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, texts):
    # Extra columns with names that operators use inside.
    frame = spark.createDataFrame([(*t, 1, "x") for t in texts], SCHEMA + ", fp int, key string")
    return frame.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
