import pytest

LONG = "word another third fourth " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (None, "The quick brown fox jumps over the lazy dog and runs away", "en", None),
        (4, " \n\t ", "xx", "b"),
        (5, LONG, "en", "b"),
        (6, "été à la plage — 日本語 😀 <|endoftext|> ▁x", "fr", "c"),
        (1, "another text under a repeated id with enough words to count", "de", "c"),
        (7, "1234 5678 !!!", None, "c"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = {c: "clash" for c in ("kept", "n_words", "row", "node", "rep", "f", "f_words", "component", "line_no", "piece", "n_bytes", "media", "score", "held_out", "h", "n_tokens", "key")}
    from pyspark.sql import functions as F

    return frame.withColumns({k: F.lit(v) for k, v in clash.items()})
