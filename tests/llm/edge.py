"""Document tables with the cases that every operator defines."""

import random

#: A table with nulls, empty and white texts, repeats, ties, a very long text, and columns of clashing names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, kept boolean, digest string, spans string, key long, node long, t string, score double, dropped_id long, repeated_id long"


def texts(seed=1, n=40):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "the", "MIT", "License", "general", "public", "license", "été", "Straße", "😀", "x1", "stupid", "Apache"]
    out = [None, "", " \n\t", "one", "one two", "ONE  two three", "one two three", "onetwothree", "x" * 30_000, "a b " * 8_000]
    out += [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(n)]
    out += [out[12] + " tail", out[13], out[13] + "\n", out[14].upper()]
    return out


def docs(spark, values=None):
    values = texts() if values is None else values
    rows = [(i, t, None if i % 3 else "en", None, None if t is None else len(t), i, i % 2 == 0, "d", "s", 1, 2, "t", 0.5, i, i) for i, t in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_docs(spark):
    """Repeated rows and null ids."""
    rows = [(7, "same text", "en", "a", 9), (7, "same text", "en", "a", 9), (None, "same text", None, None, None), (3, "other", "en", "b", 5), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
