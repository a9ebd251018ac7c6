import pytest

ODD_TEXTS = [
    None,
    "",
    " ",
    "a",
    "Plain words, in a row.",
    "Plain words, in a row.",
    "tabs\tand\r\nlines \n\n and   runs ",
    "  leading",
    "İstanbul ΣΑΣ Straße ﬁ é é 日本語 12345 x'll DON'T",
    "odd\x1cseparators\x85and no-break　wide line",
    "a<|endoftext|>b <|startoftext|> <|endoftext|><|end <| x",
    "w" * 900 + " " + "ab" * 400,
    "long text " * 5000,
    "\n",
    "emoji 👩‍👩‍👧 zero\x00byte",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with null and repeated ids, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "x", i) for i, t in enumerate(ODD_TEXTS)] + [(None, "null id", "y", None), (3, "a", "x", 1), (3, "a", "x", 1), (3, "other text, same id", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, name string, uid long")
