"""Rows with every awkward case, and a table of them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, tag string"


def words(seed, n, alphabet="the of and to in is was for der die und les des que"):
    rng = random.Random(seed)
    pool = alphabet.split() + ["".join(rng.choices("abcdefghij", k=5)) for _ in range(40)]
    return " ".join(rng.choice(pool) for _ in range(n))


def awkward():
    """(doc_id, text): null, empty, white space, ties, repeated rows, null ids, a very long text."""
    texts = [None, "", " \n\t ", "one", "one two", "One TWO", "a" * 5000, words(1, 60), words(1, 60), words(1, 60) + " more",
             words(2, 30_000), "Ünïcödé 中文 😀 \x00 \x1c x", "  two  spaces ", "password = hunter22 AKIA" + "Q" * 16, "!!! ??? 123"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(7, texts[7]), (3, "another text with id three"), (None, "no id"), (None, None)]


def table(spark, rows, lang="en", source="s"):
    """`rows` with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 0.5, 1, "x") for i, t in rows], SCHEMA)
