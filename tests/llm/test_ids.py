"""Null ids and rows that share an id: what each operator's docstring says of them."""

from collections import Counter

import numpy as np
import pytest

from tests.llm.test_whole_bytes import brute_bytes

ONE, OTHER = "the first text of two that share an id, " * 9, "licensed under cc by, all rights reserved. " * 8
ROWS = [(None, ONE), (None, OTHER), (7, ONE), (7, OTHER), (7, OTHER), (8, None), (9, ""), (None, None), (10, "words of its own stand here")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_tokens(docs, vocabulary):
    from tokenizers import Tokenizer

    from pageloom.llm.bpe_codec import bpe_encode_decode
    from pageloom.llm.token_counts import token_counts

    theirs = Tokenizer.from_file(vocabulary)
    of = lambda t: theirs.encode(t or "", add_special_tokens=False).ids
    assert Counter((r["doc_id"], r["n_tokens"]) for r in token_counts(docs, vocabulary, 10).collect()) == Counter((i, len(of(t))) for i, t in ROWS)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe_encode_decode(docs, vocabulary).collect()) == Counter((i, tuple(of(t)), theirs.decode(of(t), skip_special_tokens=False)) for i, t in ROWS)


def test_bytes(docs):
    from pageloom.llm.suffix_dedup import suffix_dedup

    kept = brute_bytes([t for _, t in ROWS], 200)
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in suffix_dedup(docs).collect()) == Counter((i, k) for (i, _), (k, _) in zip(ROWS, kept))


def test_media_and_licences(docs):
    from pageloom.llm.flac import media_column
    from pageloom.llm.license_scan import license_scan, words_of

    def payload(text):
        raw = (text or "").encode()
        return raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))

    assert Counter((r["doc_id"], bytes(r["payload"])) for r in media_column(docs).collect()) == Counter((i, payload(t)) for i, t in ROWS)
    assert Counter((r["doc_id"], r["n_words"]) for r in license_scan(docs).collect()) == Counter((i, len(words_of(t or ""))) for i, t in ROWS)


def test_classifiers(spark, docs):
    from pageloom.llm.quality_gam import quality_scores
    from pageloom.llm.toxicity import toxicity_scores

    labels = spark.createDataFrame([(7, 1, 1), (9, 0, 0), (10, 1, 0), (None, 0, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    for scores in (quality_scores, toxicity_scores):
        got = scores(docs, labels).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ROWS) and all(0 <= r["score"] <= 1 for r in got)
        assert not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_runs(docs):
    from pageloom.llm.word_runs import word_runs

    got = Counter((r["doc_id"], r["n_words"], len(r["runs"]), r["collapsed"]) for r in word_runs(docs).collect())
    once = lambda t: " ".join((t or "").split()[: len((t or "").split()) // (9 if t == ONE else 8)]) if t in (ONE, OTHER) else t or ""
    assert got == Counter((i, len((t or "").split()), int(t in (ONE, OTHER)), once(t)) for i, t in ROWS)


def test_mixing(spark, docs):
    from pageloom.llm.mixing import mix_sources, mixing_rates

    labelled = spark.createDataFrame([(7, "a"), (10, "b"), (None, "b"), (9, None)], "doc_id long, domain string")
    rates = mixing_rates(docs, labelled, {"a": 0.5, "b": 0.5}, low=0.0, high=4.0).collect()
    assert {r["doc_id"] for r in rates} == {i for i, _ in ROWS} and all(np.isfinite(r["rate"]) and 0 <= r["rate"] <= 4 for r in rates)
    mixed = Counter((r["doc_id"], r["text"]) for r in mix_sources(docs, labelled, {"a": 0.5, "b": 0.5}, low=1.0, high=4.0).collect())
    assert all(mixed[row] >= n for row, n in Counter(ROWS).items()) and set(mixed) == set(ROWS)


def test_neighbours(spark):
    from pageloom.llm.nn_graph import nearest_neighbours

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8)).round(3).tolist()
    rows = [(k, v) for k, v in enumerate(vectors)] + [(None, vectors[0]), (None, vectors[1]), (5, [9.0] * 8), (100, vectors[2]), (100, [8.0] * 8)]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100, top=5).collect()
    held = {}
    for i, v in rows:
        if i is not None:
            held[i] = min(held.get(i, v), v)
    want = set()
    for q in (0, 100):
        near = sorted((float(np.sqrt(((np.array(held[q]) - np.array(v)) ** 2).sum())), i) for i, v in held.items() if i != q)[:5]
        want |= {(q, n + 1, i) for n, (_, i) in enumerate(near)}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == want


def test_vector_codes(spark):
    from pageloom.llm.vector_codes import compress

    rows = [(None, [0.1, 0.2]), (None, [0.3, 0.4]), (5, [0.5, 0.5]), (5, [0.1, 0.1]), (5, [0.5, 0.5])]
    coded, books = compress(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int"), parts=1, entries=2, rounds=0)
    # the two smallest of equal ids by their components
    assert books[0].tolist() == [[25, 25], [128, 128]] and Counter(r["vec_id"] for r in coded.collect()) == Counter(i for i, _ in rows)
