"""Small tables for all operators: nulls, empty and long texts, ties, repeated rows, an extra column of a clashing name."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, payload string"


def documents(spark, texts, first=0):
    rows = [(first + i, t, None, "src0", None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " ", "one", "Ünïcode ß 你好 — “q” don't 12 34  \n\n x", "a b c d e f g h " * 3, "long word " * 5000, "a\tb\x0bc\n" * 9, "twin", "twin"]


def odd_documents(spark):
    """ODD, and its last row once more under the same id."""
    df = documents(spark, ODD)
    return df.union(df.where(f"doc_id = {len(ODD) - 1}"))
