"""Rows that the tests of the text operators share."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, rows):
    """Documents of (doc_id, text, lang, source) tuples."""
    full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(start, n):
    """n words that differ from those of other starts."""
    return " ".join(f"{WORDS[(start + i) % len(WORDS)]}{start}x{i}" for i in range(n))


#: Nulls in every column, empty and blank texts, repeated rows, a long text and signs of many bytes.
ODD = [
    (None, None, None, None),
    (None, "alone without an id", "en", "s1"),
    (1, None, "en", "s1"),
    (2, "", None, "s1"),
    (3, " \t\n\r", "de", None),
    (4, "one", "en", "s2"),
    (5, prose(1, 30), "en", "s1"),
    (5, prose(1, 30), "en", "s1"),
    (6, prose(1, 30), "en", "s2"),
    (7, "Größe 漢字 \U0001f600 naïve é" * 3, "fr", "s2"),
    (8, prose(2, 40_000), "en", "s1"),
    (9, "x" * 300_000, "en", "s3"),
]
