import pytest

#: Texts that every operator on documents has to bear: nulls, empty, blank, odd signs, long ones, ties and repeats.
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog and runs away from the farm as fast as it can"),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "The quick brown fox jumps over the lazy dog and runs away from the farm as fast as it can"),
    (5, "éàü ÇÖ ß 日本語 😀 \x00 ▁▁ <s> <|endoftext|>  x"),
    (6, "word " * 4000),
    (7, "x" * 5000),
    (7, "x" * 5000),
    (None, "an orphan text without any id that still has to be read like all of the others here"),
    (9, "a b c"),
    (10, "\n".join(f"line {i} of many | {i}%%%" for i in range(300))),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts, with columns whose names clash with those that operators make."""
    rows = [(i, t, "en" if i != 3 else None, "src", "bucket", 1, 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bucket string, fp int, score int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
