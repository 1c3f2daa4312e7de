"""Small tables with the cases every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random
import string

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma tau upsilon omega river stone cloud bright".split()


def prose(seed: int, n: int = 80) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def awkward(spark, extra: str = ""):
    """Rows with every awkward case; ``extra`` adds columns named like those that operators make."""
    rows = [(1, prose(1), "en", "a", 1), (2, prose(1), "en", "a", None), (2, prose(2), None, None, 2), (2, prose(2), None, None, 2), (3, None, "en", "a", 0),
            (4, "", "de", "b", 0), (None, prose(3), "en", None, 5), (None, None, None, None, None), (5, "  \n\n \t", "de", "b", 5), (6, "one", "de", "b", 3),
            (7, "\n".join(prose(i, 12) for i in range(1500)), "en", "c", 9), (8, "x" * 50_000, "en", "c", 9), (9, "中文 ümläut 🎉 ½   á", "de", "c", 9)]
    df = spark.createDataFrame(rows, DOCS)
    for name in extra.split():
        from pyspark.sql import functions as F
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def token(seed: int, n: int, alphabet: str = string.ascii_letters + string.digits) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))
