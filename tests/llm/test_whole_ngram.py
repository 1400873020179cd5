"""The n-gram join in cases in which it once lost links, against brute force."""

import numpy as np
import pytest

from tests.llm.test_corpus import make


@pytest.mark.parametrize("members", [40, 300])
def test_ngram_join_handed_on_members(spark, monkeypatch, members):
    from pageloom.llm import ngram_join as J, textkit as tk

    # order by hash alone, so that the prefixes are known; any order gives right results
    monkeypatch.setattr(J, "FREQUENT", 1 << 40)
    pool = [f"v{k}" for k in range(800)]
    data = np.frombuffer(" ".join(pool).encode(), np.uint8)
    starts, ends = tk.runs(tk.NOT_SPACE[data], np.array([0, len(data)]))
    flat, _ = tk.shingle_hashes(tk.span_hashes(data, starts, ends), np.arange(len(pool) + 1), 1)
    pool = [pool[k] for k in np.argsort(flat)]
    x, y, core, own, rest = pool[:7], pool[7:14], pool[14:107], pool[107:407], pool[407:493]
    # one-word documents lead the lists of the core; the root shares x with the leader, which shares y with the members
    sets = [*([w] for w in core), core + x, x + y + rest, *(core + y[:6] + [own[k]] for k in range(members))]
    got = {r["doc_id"]: r["component_id"] for r in J.ngram_jaccard_components(make(spark, [" ".join(s) for s in sets]), n=1).collect()}
    sets = [set(s) for s in sets]
    want = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if want[a] != want[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((want[a], want[b]))
                want = [low if v == high else v for v in want]
    assert want[-1] == len(core)
    assert got == dict(enumerate(want))


def test_ngram_join_null_id_copy(spark):
    from pageloom.llm.ngram_join import ngram_jaccard_components

    words = [f"q{k}" for k in range(100)]
    text, near = " ".join(words), " ".join([*words, "other"])
    docs = make(spark, [text, text, near], [None, 1, 2]).coalesce(1)
    got = {(r["doc_id"], r["component_id"]) for r in ngram_jaccard_components(docs).collect()}
    assert got == {(None, None), (1, 1), (2, 1)}
