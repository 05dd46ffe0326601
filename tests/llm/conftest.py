import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def byte_path():
    return public_tokenizers.path("byte_bpe_50k.json")


ODD = ["", "   ", "a  b\n\n c \t", "aaaaaaaaaaaaaaaa", "日本語 テスト  x", "<|endoftext|>hi <|endoftext|>", "don't I'll 'tis '",
       "\x1c a\x1fb  \x85 c\xa0d", "😀😀 é́", " " * 50 + "x", "İstanbul ß ΑΣ x́ ́", "hola " * 30_000, None]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Texts that are null, empty, very long or repeated; a null id; columns named as results are."""
    rows = [(i, t, "n", 1) for i, t in enumerate([*ODD, "hi there", "hi there"])] + [(None, "no id", "n", 2), (3, "same id again", "n", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, kept int")
