import random

import public_tokenizers
import pytest
import sentencepiece

from moodspark.llm import queries, token_count
from tests.llm import helpers as H

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_random_texts(library):
    rnd = random.Random(1)
    parts = [*"ab  ▁\n\t\0é漢😀<s>0xÁ　", "<s>", "</s>", "<unk>", "<0x0A>", "the ", "   ", "http://", "ing", "\r\n"]
    counter = token_count.PieceCounter(MODEL)
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert counter.count(text) == len(library.encode(text)), repr(text)


@pytest.mark.parametrize("text", ["a" * 30000, " " * 30000, "ab" * 20000, "é" * 9999, "x" * 30000 + " y"])
def test_very_long(library, text):
    assert token_count.PieceCounter(MODEL).count(text) == len(library.encode(text))


def test_segments_do_not_matter(library):
    counter = token_count.PieceCounter(MODEL)
    counter.by_segment = False
    for text in ("two  words and   spaces ", "a▁b", "x"):
        assert counter.count(text) == len(library.encode(text))


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(token_count, "REMEMBERED", 10)
    counter = token_count.PieceCounter(MODEL)
    text = " ".join(f"word{i}" for i in range(100))
    assert counter.count(text) == len(library.encode(text)) and len(counter.known) <= 11


def test_query(spark, sf_small, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op2_token_counts"](spark, sf_small).collect()}
    want = {d: (len(t.encode()), n := len(library.encode(t)), n > 4096) for d, t in H.documents(sf_small)}
    assert got == want


def test_edges(spark, library):
    out = token_count.count_tokens(H.edge_rows(spark, "n_bytes", "n_tokens"), MODEL, limit=100).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for d, t, *_ in H.EDGES]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    assert token_count.count_tokens(H.empty_table(spark), MODEL).count() == 0
