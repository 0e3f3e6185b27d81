"""Documents that try the edges: nulls, empty and long texts, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n, words="the cat sat on a mat and then der hund lief schnell le chat dort el perro come"):
    r = random.Random(seed)
    return " ".join(r.choice(words.split()) + str(r.randrange(30)) for _ in range(n))


LONG = text(99, 60_000)
ROWS = [
    (1, text(1, 50), "en", "b", 1), (1, text(1, 50), "en", "b", 1), (2, text(1, 50), "en", None, 1), (3, None, "en", "a", None), (4, "", None, "a", 0), (5, " \t\n ", "de", "a", 3),
    (None, text(2, 40), "fr", "c", 9), (6, LONG, "en", "a", len(LONG)), (7, "Ünï 12 <|im_end|> éñ", "de", "c", 5), (8, "12345 !!!", "en", "b", 9), (9, text(3, 50), "es", "", 1), (2, "other text for the same id", "en", "b", 2)]


def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted(map(repr, df.select(*(cols or df.columns)).collect()))
