"""Small tables with the odd cases every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string, rep long, tile int"
WORDS = "the of and river stone water light field house road cloud garden winter summer morning paper letter number circle line".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def documents(spark, texts, first=0):
    rows = [(first + k, t, "en", "s", None if t is None else len(t), "x", "y", 7, 9) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", "   \n\t", "one", "two words", "Ünïcode 日本語 😀 ﬁ", "a" * 30_000, "word " * 8_000, "\u2581 mark", "nul\x00byte", " lead and trail "]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
