"""Tokens of random texts over all planes, and tree concatenation with small leaves and windows, against the library."""

import random

import numpy as np
import pytest


@pytest.fixture(scope="module")
def kit():
    import public_tokenizers
    from tokenizers import Tokenizer

    from pageloom.llm.bpe import vocabulary

    path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path), vocabulary(path)


def fuzz(n, seed=5):
    rnd = random.Random(seed)
    planes = [(0, 0x80), (0, 0x250), (0x250, 0x3000), (0, 0x10000), (0x10000, 0x20000), (0x16000, 0x17000), (0x11300, 0x11400), (0x10500, 0x10E00), (0xE0000, 0x110000)]

    def char():
        low, high = rnd.choice(planes)
        c = rnd.randrange(low, high)
        return chr(c) if not 0xD800 <= c < 0xE000 else "x"

    some = ["an", "er", "'s", "'", "'re", " ", "\n", "the", "ing", "x", "<|endoftext|>", "<|", "1"]
    return ["".join(char() if rnd.random() < 0.5 else rnd.choice(some) for _ in range(rnd.choice([0, 1, 3, 10, 40, 200]))) for _ in range(n)]


def whole(vocab, leaf):
    def coded(words):
        words = [w if len(w) <= leaf else b"" for w in words]
        return vocab.merge(*vocab.symbols(words, np.array([len(w) > 0 for w in words])))

    return coded


@pytest.mark.parametrize("leaf, window", [(1, 1), (7, 1), (64, 2), (512, 4)])
def test_tree_concatenation(kit, leaf, window):
    from pageloom.llm.bpe import Words
    from pageloom.llm.bpe_codec import encode

    theirs, vocab = kit
    texts = [*fuzz(700), "x" * 3000, "ab " * 900, "abeinrst" * 400, ""]
    ids, ends, joins = encode(vocab, Words(vocab, whole(vocab, leaf)), texts, leaf, window)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    # a text that is longer than a leaf comes through joins
    assert all(j > 0 for j, t in zip(joins, texts) if len("".join(t.split()).replace("<|endoftext|>", "")) > 4 * leaf + 60) and joins[-1] == 0


@pytest.mark.parametrize("most", [1, 5, 4096])
def test_whole_words(kit, most):
    from pageloom.llm.bpe import Words, encode_words

    theirs, vocab = kit
    texts = [*fuzz(400, seed=9), "x" * 9000, "abeinrst" * 900]
    table = Words(vocab, lambda words: encode_words(vocab, words, most))
    at, bounds, _ = table.rows(texts)
    n = np.concatenate([[0], np.cumsum(np.diff(table.bounds)[at])])[bounds]
    assert np.diff(n).tolist() == [len(theirs.encode(t, add_special_tokens=False).ids) for t in texts]


def test_stacked_marks(kit):
    """Each mark of Python's tables beside marks of other classes, and canonical compositions taken apart."""
    import unicodedata

    from pageloom.llm.bpe import Words, encode_words

    theirs, vocab = kit
    rnd = random.Random(3)
    chars = [chr(c) for c in range(0x80, 0x32000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in chars if unicodedata.combining(c)]
    apart = [c for c in chars if unicodedata.decomposition(c) and unicodedata.decomposition(c)[0] != "<"]
    classes = [next(c for c in marks if unicodedata.combining(c) == k and c < " ") for k in (1, 7, 9, 220, 230)]
    texts = [f"e{a}{b}{a} x{b}{a}" for a in marks for b in classes]
    texts += [unicodedata.normalize("NFD", c) + rnd.choice(marks) + "s" for c in apart]
    texts += ["".join(rnd.choice(marks if rnd.random() < 0.7 else apart) for _ in range(rnd.randint(1, 30))) for _ in range(1500)]
    table = Words(vocab, lambda words: encode_words(vocab, words))
    at, bounds, _ = table.rows(texts)
    ids = [table.ids[table.bounds[k] : table.bounds[k + 1]].tolist() for k in range(len(table.at))]
    got = [[i for k in at[a:b] for i in ids[k]] for a, b in zip(bounds[:-1], bounds[1:])]
    assert len(texts) > 5000 and got == [theirs.encode(t, add_special_tokens=False).ids for t in texts]
