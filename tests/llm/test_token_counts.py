"""Counts against the library that the vocabulary is made for."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sumwise.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tc.Counter(PATH)


def expected(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


CASES = [
    "", None, " ", "  ", "a", "a b", "it's we're 'tis they'll x'll 'l 'r", "''s 'RE !'s \n's", "a  b   c\n\n d\t\te ",
    "'", "x'", "x'r", "x'l", "x'v ", "'re", "12 345six7", "...!!!  ??", "naïve Ünïcödé 漢字かな 🙂🙂 ١٢٣ ½", "aaaaaaaaaaaaaaaaaaaaa",
    "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>c", "<|endoftext", "  x　", "\x00\x1f\x85y",
    "the " * 3000, "z" * 5000, " " * 5000, "\n \n" * 900 + "'re", "Ġ ġ Ċ", "é" * 50,
]


def test_cases():
    assert tc.counts(CASES, COUNTER).tolist() == expected(CASES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab srtvmlde'1\n\t.!é漢  "), max_size=60), max_size=6))
def test_strings_near_the_borders(texts):
    assert tc.counts(texts, COUNTER).tolist() == expected(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_strings(texts):
    assert tc.counts(texts, COUNTER).tolist() == expected(texts)


def test_chunks_of_any_length_agree():
    rng = random.Random(3)
    kinds = np.array([rng.randrange(11) for _ in range(5000)], np.uint8)
    whole = tc.piece_starts(kinds, 5000)
    for chunk in (1, 2, 7, 64, 999):
        assert (tc.piece_starts(kinds, chunk) == whole).all()


def test_real_words():
    rng = random.Random(5)
    words = [t.replace("Ġ", " ") for t in LIBRARY.get_vocab() if t.replace("Ġ", "").isalpha()]
    texts = ["".join(rng.choice(words) for _ in range(400)) for _ in range(30)]
    assert tc.counts(texts, COUNTER).tolist() == expected(texts)


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(tc, "MOST_STATES", 5)
    monkeypatch.setattr(tc, "MOST_PIECES", 3)
    assert tc.counts(CASES, tc.Counter(PATH)).tolist() == expected(CASES)


def test_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (None, None, None), (3, "", "z"), (4, "the " * 600, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(docs, PATH).collect()}
    assert got == {(1, 3, 2, False), (None, 0, 0, False), (3, 0, 0, False), (4, 2400, 601, True)}
    assert tc.token_counts(docs, PATH).count() == 5
    assert tc.token_counts(docs.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tc.Counter(public_tokenizers.path("word_bpe_49k.json"))
