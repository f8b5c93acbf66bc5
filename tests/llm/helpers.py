"""Rows with everything that is awkward: nulls in every column, empty and long texts, ties, repeated rows, columns of clashing names."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["id", "digest", "score", "slot", "kept", "label", "key", "a", "b", "row", "size", "start", "node", "component", "f0", "media", "bin", "rank", "lang_pred", "word", "bits", "keep_id", "sequence_id", "before", "block"]
LONG = "lorem ipsum dolor sit amet consectetur " * 4000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from here", "en", "a", 66),
    (2, "the quick brown fox jumps over the lazy DOG and runs away from here", "en", "a", 66),
    (3, None, "en", "b", None),
    (4, "", None, "b", 0),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund und läuft weg", "de", None, 68),
    (6, LONG, "la", "c", len(LONG)),
    (7, "12345 !!! ???", None, "c", 13),
    (8, "ÄÖÜ straße Überall 日本語 😀", "de", "c", None),
    (9, "x", "en", "a", 1),
    (9, "x", "en", "a", 1),
    (10, " \n\t ", "en", "a", 4),
    (None, "a row without an identifier", "en", "a", 27),
    (None, None, None, None, None),
    (11, "The quick brown fox jumps over the lazy dog and runs away from here", "en", "b", 66),
]


def awkward(spark, extra=True):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        rows = rows.withColumns({c: F.lit("clash") for c in CLASHING})
    return rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(tmp_path, spark, **tables):
    """A folder that looks like test data."""
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
