"""Small inputs with every awkward row: nulls, empty and long texts, ties, repeated rows, clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use for their own columns.
CLASHING = ["size", "score", "shard", "slot", "fp", "target", "taken", "copies", "component_id", "predicted", "capture",
            "digest", "uid", "number", "length", "__text_", "language"]
LONG = " ".join(f"word{i % 977} thing{i % 31}" for i in range(40_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and then some more words", "en", "a", 1),
    (2, "The Quick brown fox jumps over the lazy dog and then some more words", "en", "a", 1),
    (2, "The Quick brown fox jumps over the lazy dog and then some more words", "en", "a", 1),  # repeated row
    (3, None, "en", "b", 0),
    (4, "", None, "b", 0),
    (5, "  \t\n\r ", "de", None, 3),
    (6, LONG, "en", "c", len(LONG)),
    (None, "no id here", "en", "c", 2),
    (None, "no id here", "en", "c", 2),
    (None, None, None, None, None),
    (7, "one", "fr", "d", 1),
    (8, "über straße und ähnliches\n\n mit  leerzeichen hier", "de", "a", 1),
    (8, "another text under the same id", "en", "b", 1),  # the id repeats, the row does not
    (-9, "negative ids \U0001F600 and <|endoftext|> as text", "en", "a", 1),
]


def awkward(spark, clash: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clash else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    """What the contracts call words: runs without ASCII white space."""
    return (text or "").encode().split()
