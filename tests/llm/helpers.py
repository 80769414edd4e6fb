"""Small tables with the awkward rows that every operator must take."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, component_id int, length string"


def prose(seed: int, words: int = 60, kind: str = "en") -> str:
    rng = random.Random(f"{seed} {kind}")
    parts = {"en": "the and ing tion er th of ou st ly".split(), "de": "der die und ung sch ein ü ß keit zu".split(),
             "fr": "le la é è eau que oi ment ç une".split()}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words)).capitalize() + "."


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src", None if text is None else len(text), "x", "y", 7, "z")


def awkward(spark):
    """Null ids and texts, empty and blank texts, copies, one id with two texts, a very long text, a giant word."""
    long_text = " ".join(prose(k, 400) for k in range(300)) + "\n" + "w" * 100_000
    rows = [row(1, prose(1)), row(2, prose(1)), row(3, prose(2)), row(3, prose(2)), row(3, prose(3)), row(None, prose(4)), row(None, prose(1)),
            row(None, None), row(4, None, None), row(5, ""), row(6, " \t\n "), row(7, "one"), row(8, "one two"), row(9, long_text),
            row(10, prose(5, kind="fr"), "fr"), row(11, prose(6, kind="de"), "de"), row(12, "12345 !!! ---", None), row(13, "ÀÉ ß İ́ 日本語 \U0001f600  x y")]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
