"""Suffix dedup with small blocks, hot anchors and shuffled joins, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_corpus import TEXTS, make


def brute_bytes(texts, width):
    count = Counter()
    for t in texts:
        raw = (t or "").encode()
        count.update(raw[k : k + width] for k in range(len(raw) - width + 1))
    out = []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - width + 1):
            if count[raw[k : k + width]] > 1:
                gone[k : k + width] = True
        out.append((bytes(np.frombuffer(raw, np.uint8)[~gone]), int(gone.sum())))
    return out


@pytest.mark.parametrize("hot, block, sent", [(2, 1 << 20, 1 << 18), (5, 4000, 0), (1 << 30, 2000, 1 << 18)])
def test_suffix_dedup_hot_anchors_and_blocks(spark, monkeypatch, hot, block, sent):
    from pageloom.llm import suffix_dedup as S

    for name, value in (("HOT", hot), ("HOT_MOST", 1 << 30), ("BLOCK", block), ("SENT", sent)):
        monkeypatch.setattr(S, name, value)
    rnd = random.Random(hot)
    letters = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    passages = [letters(n) for n in (200, 201, 260, 420, 900)]
    texts = [letters(rnd.randint(0, 300)) + rnd.choice(passages)[rnd.randint(0, 3) :] + letters(rnd.randint(0, 300)) for _ in range(60)]
    texts += [p * 2 for p in passages] + [texts[0]] * 4 + TEXTS[-8:] + ["z" * 900, None]
    got = {r["doc_id"]: (bytes(r["kept"]), sum(s["end"] - s["start"] for s in r["spans"])) for r in S.suffix_dedup(make(spark, texts).repartition(3)).collect()}
    assert got == dict(enumerate(brute_bytes(texts, 200)))


def test_often():
    from pageloom.llm.suffix_dedup import Often

    often = Often(most=2)
    sure, send = often.meet(np.array([5, 7, 5, 9, 7, 7], np.uint64))
    assert sure.tolist() == [True, True, True, False, True, True] and send.tolist() == [True, True, False, True, False, False]
    sure, send = often.meet(np.array([9, 9, 5, 8], np.uint64))
    assert sure.tolist() == [True, True, True, False] and send.tolist() == [True, False, False, True]
    assert often.values.tolist() == [5, 7] and often.counts.tolist() == [1, 0]
