import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corvane.llm import common, tokens
from tests.llm.support import odd_rows, words

TEXTS = [r[1] for r in odd_rows()]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_are_those_of_the_pattern(kind):
    column = pa.array(["skipped", *TEXTS], kind).slice(1)
    raw, offsets = common.text_bytes(column)
    starts, ends, first = common.word_spans(raw, offsets)
    found = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert [found[a:b] for a, b in zip(first[:-1], first[1:])] == [words(t) for t in TEXTS]


def test_equal_words_have_equal_hashes_and_others_do_not(monkeypatch):
    flat = [w for t in TEXTS for w in words(t)] + ["ABC", "abc", "É", "é"]
    column = pa.array(flat, pa.string())
    whole = common.word_hashes(*_spans(column))
    assert len(set(whole.tolist())) == len({w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in flat})
    assert len(set(common.word_hashes(*_spans(column), lower=False).tolist())) == len(set(flat))
    # Cutting the work into small steps changes nothing.
    monkeypatch.setattr(common, "STEP_BYTES", 64)
    assert (common.word_hashes(*_spans(column)) == whole).all()


def _spans(column):
    raw, offsets = common.text_bytes(column)
    starts, ends, _ = common.word_spans(raw, offsets)
    return raw, starts, ends


def test_windows_are_the_shingles():
    column = pa.array(TEXTS, pa.string())
    raw, offsets = common.text_bytes(column)
    starts, ends, first = common.word_spans(raw, offsets)
    h, begin = common.windows(common.word_hashes(raw, starts, ends), first, 4)
    for i, text in enumerate(TEXTS):
        w = words(text, lower=True)
        want = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}
        assert len(np.unique(h[begin[i] : begin[i + 1]])) == len(want)


def test_slices_cover_all_rows_once():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS, pa.string())], ["text"])
    parts = list(common.text_slices(batch, "text", 500))
    assert [x for p in parts for x in p.column("text").to_pylist()] == TEXTS and len(parts) > 5
    assert list(common.text_slices(batch.slice(0, 0), "text")) == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_ids_are_those_of_the_tokenizer(name, monkeypatch):
    own = Tokenizer.from_file(public_tokenizers.path(name))
    odd = ["<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "•a • b", "é ÉX", "don't I'LL 'S", "漢字かな交じり文 123456 !!??", "a\x1cb\x85c\xa0d", "ß ΑΣ σς"]
    texts = TEXTS + odd
    rng = random.Random(1)
    for most in (10, 1_000_000):
        monkeypatch.setattr(tokens, "MOST_WORDS", most)
        cache = tokens.WordIds(public_tokenizers.path(name), 0)
        for _ in range(2):
            rng.shuffle(texts)
            ids, offsets = tokens.encode(cache, pa.array(texts, pa.string()))
            for i, text in enumerate(texts):
                assert ids[offsets[i] : offsets[i + 1]].tolist() == own.encode(text or "", add_special_tokens=False).ids + [0]
