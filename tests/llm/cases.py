"""Rows that every text operator must bear."""

DDL = "doc_id long, text string, lang string, source string, n_chars long, page string, token string"


def odd_documents(spark):
    """Null, empty, blank, very long, repeated, non-ASCII; with null columns and further columns of clashing names."""
    long = "The and of thion " * 9000
    texts = [None, "", " \n\t ", "a", "é" * 30, long, long, "x" * 70_000, "Ünïcode 東京 \U0001f600 mixed 123 's"]
    rows = [(i, t, None, "src0", None if t is None else len(t), "p", "t") for i, t in enumerate(texts)]
    rows.append((5, long, "en", None, len(long), None, None))  # a repeated row's id
    return spark.createDataFrame(rows, DDL)


def empty_documents(spark):
    return spark.createDataFrame([], DDL)
