import random

import pytest
from llm_helpers import path_of

from tidemark.llm import bpe, tokencount

SIGNS = list("abcdezéÉßΣσςİiI' \n\t\r\x0b\x1c\x85\xa0​0123²Ⅷ½.,!?<|>_-日本한글🙂ͅǅ\x00") + ["'ll", "'re", "<|endoftext|>", "<|startoftext|>", "the ", " and", "   ", "don't"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ["".join(rng.choices(SIGNS, k=rng.randint(0, 40))) for _ in range(1500)] + ["ab" * 3000, ""]


def test_word_bpe_is_the_library(texts):
    from tokenizers import Tokenizer

    path = path_of("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    for t in texts:
        ids = other.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t, path) == ids
        assert bpe.decode(ids, path) == other.decode(ids, skip_special_tokens=False)


def test_every_code_point_is_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    path = path_of("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and not 0xE000 <= c <= 0xF8FF and c < 0xF0000]
    for a in range(0, len(points), 64):
        text = " ".join(chr(c) + "x" for c in points[a : a + 64])
        if bpe.encode(text, path) != other.encode(text, add_special_tokens=False).ids:
            assert not [hex(c) for c in points[a : a + 64] if bpe.encode(chr(c), path) != other.encode(chr(c), add_special_tokens=False).ids]


def test_both_merges_agree():
    from tidemark.llm.vocab import load

    vocab = load(path_of("word_bpe_49k.json"))
    rng = random.Random(2)
    for _ in range(200):
        parts = [vocab.first[b] for b in "".join(rng.choices("aehilnorst", k=rng.randint(1, 60))).encode()]
        assert bpe.merge_short(list(parts), vocab) == bpe.merge_long(list(parts), vocab)


def test_counts_at_every_prefix_are_the_library(texts):
    from tokenizers import Tokenizer

    path = path_of("byte_bpe_50k.json")
    other, own = Tokenizer.from_file(path), tokencount.counter(path)
    for t in texts:
        assert own.count(t) == len(other.encode(t, add_special_tokens=False).ids)
    for t in texts[:200]:
        want = [len(other.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert own.counts(t) == want
        assert own.truncate(t, 5) == t[: max(i for i, n in enumerate(want) if n <= 5)]


def test_rows(spark, odd, none):
    path = path_of("word_bpe_49k.json")
    rows = bpe.encode_documents(odd, path).collect()
    assert len(rows) == odd.count() and all(r.decoded == bpe.decode(r.ids, path) for r in rows)
    assert [r.ids for r in rows if r.id == 3] == [[]]
    digests = bpe.encode_digests(odd, path).collect()
    assert sorted(r.n_tokens for r in digests) == sorted(len(r.ids) for r in rows)
    counts = {r.id: r for r in tokencount.token_counts(odd, path_of("byte_bpe_50k.json")).collect()}
    assert counts[6].over_limit and counts[4].n_tokens == 0 and counts[3].n_bytes == 0
    cut = {r.id: r.text for r in tokencount.truncated(odd, path_of("byte_bpe_50k.json"), 10).collect()}
    assert cut[6].startswith("word word") and cut[3] == ""
    for f in (bpe.encode_documents(none, path), bpe.encode_digests(none, path), tokencount.token_counts(none, path_of("byte_bpe_50k.json"))):
        assert f.count() == 0
