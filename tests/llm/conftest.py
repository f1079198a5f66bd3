import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the and of to in that is was for with house river stone light water green paper".split(),
    "de": "der die und das nicht ist mit ein haus fluss stein licht wasser grün papier straße".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and blank texts, a very long text, ties, repeated rows, and columns that clash with the operators' own."""
    rng = random.Random(7)
    rows = [(i, " ".join(sentence(rng, lang, 12) for _ in range(8)), lang, "s", 1) for i, lang in enumerate(["en", "de"] * 30)]
    rows += [(100, None, "en", "s", 0), (101, "", "de", None, 0), (102, " \t\n", None, "s", 3), (103, "12 34 !?", "en", "s", 8), (104, "word", "en", "s", 4)]
    rows += [(105, "tie tie tie", "en", "s", 1), (106, "tie tie tie", "en", "s", 1), (107, rows[0][1], "en", "s", 1), (107, rows[0][1], "en", "s", 1)]
    rows += [(None, "no id here", "en", "s", 1), (None, None, None, None, None), (108, "x" * 5000 + " " + "ab cd " * 20000, "en", "s", 1), (109, "日本語 é́ \x1c  <|endoftext|>", None, "s", 1)]
    clash = "0 as words, 'a' as piece, 1 as length, 2 as start, 'b' as rank, 3 as id, 4 as part, 5 as n, 'c' as kept, 6 as score, 7 as task, 8 as _t, 9 as bands, 0 as items, 1 as print, 1 as n_words"
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *clash.split(", ")).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
