"""Rows that every text operator has to take."""

SF = "/root/testdata/sf0.001"


def texts_of(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"word{i % 4000}" for i in range(60_000))
    rows = [
        (1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, " \t\n "), (5, long),
        (6, "One two THREE four five six seven eight nine ten"), (7, "same text here"), (7, "same text here"), (None, "no id at all for this one text"),
        (None, None), (8, "x"), (9, "éàü ß 中文 𝒳 �"),
    ]
    return spark.createDataFrame([(i, t, 1, "s", 0, "b", 0.5, True) for i, t in rows], "doc_id long, text string, row int, id string, n int, band string, score double, kept boolean")
