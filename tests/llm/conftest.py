import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, size string, kind string, spans string, shard int, id string"


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + r.choice(["", "", ".", ",", "\n", "é", "ß"]) for _ in range(n))


def tricky():
    """Documents with nulls, empty and long texts, copies, near copies, passages that recur, and odd characters."""
    base = prose(1, 300)
    words = base.split(" ")
    passage = prose(2, 70)
    texts = [
        base,
        base,
        " ".join([*words[:150], "CHANGED", *words[151:]]),
        prose(3, 120) + "\t" + passage + " " + prose(4, 60),
        passage + " " + prose(5, 80),
        prose(6, 40) + "\n" + passage,
        None,
        "",
        " \n\t ",
        "one",
        "two words",
        "same line\nsame line\nother\nsame line\n\n" + prose(7, 60),
        "ha " * 400,
        prose(8, 20_000, 300),
        "\U0001f600 emoji  nbsp\x00nul " + prose(9, 55),
        "x" * 30_000,
        prose(10, 50),
        "|" * 50 + " " + prose(11, 90),
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "c")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, base, None, None, 1), (None, None, None, None, None), (40, passage.upper(), "en", "a", 3)]
    return [(*r, 1, "s", "k", "x", 2, "i") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return tricky()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    def build(pairs):
        return spark.createDataFrame([(i, t, "en", "s", None, None, None, None, None, None, None) for i, t in pairs], SCHEMA)

    return build


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.fixture(scope="session")
def same():
    def check(df, expected, *columns):
        got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
        assert got == sorted(expected, key=key)

    return check
