import public_tokenizers
import pytest

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: Texts with the cases that every operator must stand: nulls, nothing, white space, repeats, long words, odd signs.
TEXTS = [
    None,
    "",
    "  \n\t ",
    "The cat sat on the mat. It's the cat's mat, isn't it?",
    "The cat sat on the mat. It's the cat's mat, isn't it?",
    "The  cat sat on\tthe mat. It's the cat's mat, isn't it?",
    "x" * 5000,
    "ab " * 3000,
    "été où naïve 中文字 1234567 😀😀 <|endoftext|> end",
    "one",
    "don't  'tis 'll we've  \r\n   trailing   ",
]


@pytest.fixture(scope="session")
def documents(spark):
    """Eleven rows with extra columns whose names operators use themselves, null and repeated ids."""
    rows = [(i if i != 4 else None, t, "en", "s", 1, "k", 2.0) for i, t in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, row long, key string, score double"
    return spark.createDataFrame(rows, schema).coalesce(2)
