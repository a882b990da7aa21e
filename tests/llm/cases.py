"""Small documents that hold the awkward cases every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that was with for it as on are this by be from or had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def frame(spark, rows, parts=3):
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def awkward():
    """Null, empty, blank, tiny, very long, repeated rows, and white space of all kinds."""
    long = prose(99, 9000)
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, long), (6, long), (7, "a  b \n\n c d é ﬁ 日本語 😀"), (8, prose(8, 120)), (8, prose(8, 120)), (9, prose(8, 120)), (10, "x" * 5000), (11, "<|endoftext|> </s> ▁a\r\n"), (-12, prose(12, 60)), (None, prose(13, 70)), (None, None)]
