"""Small tables with the awkward cases that every operator has to survive."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(words))


def awkward(spark):
    """Null id, null and empty text, repeated rows, one id with two texts, white space only, long and non-Latin text."""
    rows = [
        (None, "no id but some text here", "en", "a", 24), (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4),
        (4, prose(1, 60), "en", "a", 1), (4, prose(1, 60), "en", "a", 1), (5, prose(1, 60), None, "a", 1), (5, prose(2, 40), "de", "b", 1),
        (6, "été " * 30 + "日本語 текст 🙂", "fr", "b", 1), (7, prose(3, 9000), "en", "b", 1), (-8, "x", "en", "b", 1), (9, "  double  spaces \n here", "en", "b", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df, *names):
    """The same table with extra columns that bear the operators' own names."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("extra"))
    return df
