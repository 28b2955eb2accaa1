import pytest


@pytest.fixture(scope="session")
def byte_bpe():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def pieces():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


TRICKY = [
    None, "", " ", "  a  b ", "a\n b", " \n\t x  y\n", "it's we'll 'S don't", "漢字 かな  👍🏽", "x <|endoftext|> y<|endoftext|>", "<|endoftext|>", "a" * 3000, "\x1c a\x85 b", "x\xa0 b", "1234567 89,0", "ÀÉ é́ ſ", "word " * 900,
]


@pytest.fixture(scope="session")
def texts():
    return TRICKY


@pytest.fixture(scope="session")
def tricky(spark):
    """Texts of many kinds, one twice, a null key, and columns with names the operators use themselves."""
    rows = [(i, t, "n", 1.0, 7) for i, t in enumerate(TRICKY)] + [(2, " ", "n", 1.0, 7), (None, "no key here", "n", 1.0, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score double, key int")
