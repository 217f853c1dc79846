import public_tokenizers
import pytest
from tokenizers import Tokenizer


@pytest.fixture(scope="session")
def tokenizer_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def library(tokenizer_path):
    return Tokenizer.from_file(tokenizer_path)


def documents(spark, rows):
    """A documents table with all its columns from (doc_id, text)."""
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
