"""Rows that every text operator has to stand, and plain versions of what they compute."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    rng = random.Random(5)
    words = "the of and house tree river under again never little green stone walk".split()
    base = " ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(120))
    near = base.split()
    near[60] = "changed"
    long = " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(30_000))
    texts = [base, base, " ".join(near), None, "", " \n\t ", "one two", "one two", "x", long, base + " tail", "ÉÀÈ ünï\n\nünï 😀 <|endoftext|> fin", "a\x00b " * 30, "same same " * 200, "Ｆｕｌｌ ⅷ ² no break"]
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (0, base, "en", "s", len(base)), (None, "null id here " * 10, None, None, None), (None, None, None, None, None)]


def odd_docs(spark):
    """The rows, with more columns whose names the operators use themselves."""
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for name in ("t", "n", "node", "root", "row", "gram", "n_words", "kept", "score", "word", "h", "place", "held_out", "ids"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty_docs(spark):
    return odd_docs(spark).limit(0)


def plain_words(text):
    return (text or "").encode().lower().split()
