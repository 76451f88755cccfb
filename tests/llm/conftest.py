import pytest


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
    line = "this very line is found in many documents"
    plain = "The quick brown fox jumps over the lazy dog and runs away from all of the hounds."
    rows = [
        (1, plain, "en", "a"), (1, plain, "en", "a"), (2, plain.upper(), "en", "b"), (3, None, "en", "a"), (4, "", None, None),
        (None, "no id here, but a text of a few words more than ten in all", "en", "a"), (5, long, "en", None),
        (6, f"{line}\n{line}\nown", "en", "b"), (7, f"  {line.upper()}\t\nown words of seven", None, "b"), (8, f"x\n{line}", "en", "b"),
        (9, "\n\n", "en", "a"), (10, " \t\x0b\x0c\r ", "en", "c"), (11, "12 34 !!", "en", "c"), (12, "Été où à l'école 😀", "fr", "c"), (None, None, None, None),
    ]
    extra = [(*row, 0, False, "k", "t", 1.0, "x") for row in rows]
    return spark.createDataFrame(
        extra, "doc_id long, text string, lang string, source string, n_words long, kept boolean, key string, token string, score double, row string"
    )
