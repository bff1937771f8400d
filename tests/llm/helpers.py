"""Small document tables for edge cases."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, ids string, salt int, label string"


def docs(spark, texts: dict[int | None, str | None] | list[tuple]):
    """Documents with more columns, whose names operators use inside."""
    pairs = list(texts.items()) if isinstance(texts, dict) else texts
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "d", 1, "x", 2, "y") for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


#: A null text, an empty one, white space, a repeated row, ties, a long word, a very long text.
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "same text here"), (5, "same text here"), (5, "same text here"), (6, "x" * 5000), (7, LONG), (None, "no id"), (8, "grüße, 世界! <|endoftext|> 'll don't  two  spaces\n\nnew")]
