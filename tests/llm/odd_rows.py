"""Rows with nulls, empty and long texts, ties, repeats and clashing column names."""

from pyspark.sql import types as T

LONG = "word " * 30_000

ROWS = [
    (0, "Alpha beta gamma.\nAlpha beta gamma.\n\ndelta", "en", "a", 40),
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, LONG, "de", "b", len(LONG)),
    (4, "the same text in two rows, and more words to be above ten of them", "en", "a", 10),
    (4, "the same text in two rows, and more words to be above ten of them", "en", "a", 10),
    (5, "the same text in two rows, and more words to be above ten of them", "en", "b", 10),
    (None, "no id here, though the text has enough words to stay in, all in all", "fr", "b", 10),
    (None, None, None, None, None),
    (6, " \t\n ", "fr", "", 5),
    (7, "ein Satz über Öl und Straße, é à ñ; don't <|endoftext|> they'll 12 ½  x 中文 \U0001f600 á ΣΣ", "de", "b", 9),
]


def schema(extra=()):
    return T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in extra],
    ])


CLASHES = ("id", "kept", "slot", "shard", "KEY", "root", "fp", "h", "n_words", "ids", "start", "src", "__t", "piece")
