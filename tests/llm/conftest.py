import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words):
    return " ".join(rng.choice(VOCABULARY) for _ in range(words))


VOCABULARY = ["".join(random.Random(i).choices("abcdeiounrst", k=2 + i % 7)) for i in range(400)]


def corpus():
    """Rows with nulls, empty and long texts, copies, near copies, repeated lines and rows, junk, clashing ids."""
    rng = random.Random(7)
    out = [(i, "\n".join(prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 8))), ["en", "fr"][i % 2], f"s{i % 4}") for i in range(40)]
    text = {i: t for i, t, _, _ in out}
    out += [(40, text[3], "en", "s0"), (41, text[3], "en", None), (42, text[3] + " tail", "fr", "s1"), (43, "lead " + text[8], None, "s2")]
    out += [(44, None, None, None), (45, "", "en", "s0"), (46, " \n\t ", "en", "s0"), (47, "!!! 123 ###", "en", "s1"), (48, "To " * 160, "en", "s2")]
    out += [(49, text[5] + "\n" + text[6], "en", "s3"), (50, text[9].upper(), "fr", "s1"), (51, prose(rng, 6000), "en", "s3"), (52, "one", "en", "s0")]
    out += [(53, "x" * 5000 + " y", "en", "s1"), (54, "é́ 日本語 😀\r\nＡ", "fr", "s2"), (7, text[7], "fr", "s3"), (None, text[11], "en", "s0")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
