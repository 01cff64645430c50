"""Rows that every operator must take."""


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    long_text = "alpha beta gamma delta epsilon\n" * 40_000
    return [
        (1, "The quick brown fox jumps over the lazy dog near the river", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog near the river", "en", "a"),
        (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "de", "b"),
        (None, "ein text ohne nummer der etwas länger ist", "de", None),
        (None, None, None, None), (5, long_text, "en", "b"), (6, "x" * 300_000, None, "c"),
        (7, "123 456 !!!", "en", "c"), (8, "퟿ é ü 日本語 🙂", "fr", "b"),
    ]
