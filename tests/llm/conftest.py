import pytest

#: Texts that every operator must take: null, empty, blank, very long, repeated, odd characters, special strings.
ODD = [None, "", "  \n\t ", "one", "word " * 30_000, "Ünïcode ÉCOLE ß ſ K İ", "<|endoftext|> and <|startoftext|>  x", "中文字符 混合 text", "a\x00b\x01\x1cc", "AKIA" + "A" * 40, "same text here now again", "same text here now again"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names clash with what operators use inside."""
    rows = [(i, t, "en", "s", 0, 1.0, 2, "k") for i, t in enumerate(ODD)] + [(7, ODD[7], "en", "s", 0, 1.0, 2, "k"), (None, "no id at all here today", "en", "s", 0, 1.0, 2, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, key string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
