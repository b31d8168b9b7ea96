import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Texts that have caused trouble: null, empty, blank, one word, runs of white space, very long, special tokens, other scripts.
ODD = [None, "", " \n\t ", "word", "a  b\n\n c\t\r d", "<|endoftext|> <|startoftext|>", "日本語 テキスト　全角", "é é Σ İ ß 😀", "x" * 5000, "lorem ipsum " * 4000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """ODD and repeated rows, a repeated id and a null id, with columns named like those that operators add."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "word"), (3, "other word"), (None, "nobody's text"), (None, None)]
    rows = [(i, t, "piece", 1, "row", -1) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, rest string, row int, ranges string, n_words int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
