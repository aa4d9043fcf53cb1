"""Awkward documents that every operator has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, ids string, words int"


def awkward(spark, texts=()):
    rows = [
        (1, None, "en", "a", None, 7, "x", 1),
        (2, "", None, None, 0, None, None, None),
        (3, "one two  three", "en", "a", 14, 7, "x", 1),
        (3, "one two  three", "en", "a", 14, 7, "x", 1),
        (4, "tab\tnew\nline\r\n\n é漢字 🙂🙂 ascii_under 12 ½ ² ª", "fr", "b", 1, 7, "x", 1),
        (5, "word " * 30_000, "fr", "b", 1, 7, "x", 1),
        (6, "x" * 100_000, None, "b", 1, 7, "x", 1),
    ]
    rows += [(100 + n, t, "en", "c", len(t), n, "y", 2) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def unnamed(spark, shared="a passage that stands in three of the rows, in full " * 20):
    """Rows without an id and rows with one id and different texts: each its own text, some with the shared passage."""
    own = lambda n: "\n".join(f"line {k * 7919 % 1000003} of text {'abcdefghij'[n] * 12} alone {k * k}" for k in range(n + 2))
    texts = [(None, own(0)), (None, own(1) + "\n" + own(0)), (None, own(2) + "\n" + shared), (7, own(3)), (7, own(4) + "\n" + shared), (7, "short"), (8, shared + "\n" + own(5)), (None, None)]
    return spark.createDataFrame([(i, t, "en", "a", len(t or ""), 7, "x", 1) for i, t in texts], SCHEMA)
