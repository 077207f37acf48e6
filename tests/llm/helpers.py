DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    """Rows (doc_id, text) as documents, with a column that clashes with names used inside."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in any column, empty and blank texts, a very long one, ties and repeated rows."""
    long = "lorem ipsum dolor sit amet consectetur " * 20000
    odd = [(None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, "the same text twice"), (6, "the same text twice"), (7, "x"), (7, "x"), (7, "another text under one id"), (8, "é😀 ünï"), (None, None)]
    df = documents(spark, odd)
    return df.union(spark.createDataFrame([(9, "null columns", None, None, None)], DOCS))


def clashing(df):
    """df with extra columns named as operators name theirs inside."""
    from pyspark.sql import functions as F

    extra = ["fp", "kept", "found", "host", "rank", "w", "n", "rid", "ids", "sequence_id", "component_id", "_key", "_row", "_text", "_rid", "verdict", "p_good", "n_words", "label", "start"]
    return df.withColumns({c: F.lit("clash") for c in extra if c not in df.columns})
