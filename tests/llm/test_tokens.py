import pytest
from scenequarry.llm import tokens

TEXTS = [
    None, "", "Hello, world's BEST ᾈΣ ΣΑΣ test_1234 don't", "a<|endoftext|>b <|startoftext|> c", "été café ̀x", "İstanbul  Tab\tnew\nline\x0bvt\x0cff\r\n",
    "\x1c\x1d sep nbsp em　ideo 日本語 🙂🙂 ‍", "word " * 30_000, "x" * 3000, "Hello, world's BEST ᾈΣ ΣΑΣ test_1234 don't",
]


@pytest.mark.parametrize("head", [0, 5, 65_536])
def test_counts_equal_the_library(spark, head):
    tok = tokens.tokenizer(tokens.vocabulary_path())
    docs = spark.createDataFrame([(i or None, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int").repartition(3)
    got = {(r.doc_id or 0): r for r in tokens.token_counts(docs, head=head).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048), t


def test_ids_equal_the_library():
    import numpy as np

    path = tokens.vocabulary_path()
    for t in TEXTS:
        assert np.frombuffer(tokens.ids_of(path, (t or "").encode()), "<u4").tolist() == tokens.tokenizer(path).encode(t or "", add_special_tokens=False).ids


def test_empty_table(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
