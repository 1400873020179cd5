"""Line dedup in cases in which it once did less than the whole job, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import brute_lines, make


def test_line_dedup_in_any_order(spark, tmp_path):
    from pageloom.llm.line_dedup import dedup_lines

    # 3 and 5 hold one set; near copies stand before, between and after them
    line = "a b c d e f g h i j"
    texts = {2: f"{line} k", 3: line, 4: f"{line} l", 5: line, 6: f"{line} m", 7: "one two three four five"}
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(30)]
    lines = [" ".join(rnd.sample(words, 9)) for _ in range(25)]
    for i in range(10, 150):
        some = [rnd.choice(lines).split(" ") for _ in range(3)]
        for s in some:
            if rnd.random() < 0.3:
                s[rnd.randrange(9)] = rnd.choice(words)
        texts[i] = "\n".join(" ".join(s) for s in some)
    for texts_now, orders in (({k: texts[k] for k in (3, 4, 5)}, ([5, 3, 4],)), (texts, (sorted(texts, reverse=True), rnd.sample(sorted(texts), len(texts))))):
        ids = sorted(texts_now)
        gone, compared = brute_lines([texts_now[i] for i in ids])
        want = {i: "\n".join(x for n, x in enumerate(texts_now[i].split("\n")) if n not in gone.get(k, ())) for k, i in enumerate(ids) if len(gone.get(k, ())) < compared[k]}
        for order in orders:
            path = str(tmp_path / f"t{len(order)}{order[0]}")
            for part in np.array_split(order, min(len(order), 3)) if len(order) > 3 else [order]:
                make(spark, [texts_now[i] for i in part], [int(i) for i in part]).coalesce(1).write.mode("append").parquet(path)
            got = dedup_lines(spark.read.parquet(path).coalesce(1))
            assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_line_dedup_keeps_short_lines_of_their_own(spark):
    from pageloom.llm.line_dedup import dedup_lines

    common = "this line stands in every document"
    texts = [f"{common}\nkeep me", f"{common}\nred\n\nblue", f"{common}\n  keep me ", common, f"{common}\n\n ", f"{common}\nblue\nred\nkeep me", f"{common}\nme keep"]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(make(spark, texts), least_words=5).collect()}
    assert got == {0: texts[0], 1: "red\n\nblue", 6: "me keep"}
    got = {r["doc_id"]: r["text"] for r in dedup_lines(make(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "red\n\nblue"}


@pytest.mark.parametrize("percent", [80, 50, 95])
def test_lines_of_few_words(spark, percent):
    """Sets of one to seven words of a small alphabet: equal sets, and sets with a word more or less on the threshold's both sides."""
    from pageloom.llm.line_dedup import removed_lines

    rnd = random.Random(percent)
    texts = ["\n".join(" ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 6, 9]))) for _ in range(rnd.randint(1, 5))) for _ in range(90)]
    seen, want = [], {}
    for i, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            if words := frozenset(line.split()):
                if any(100 * len(words & s) >= percent * len(words | s) for s in seen):
                    want.setdefault(i, []).append(k)
                seen.append(words)
    assert {r["doc_id"]: r["removed"] for r in removed_lines(make(spark, texts), percent=percent).collect()} == want


@pytest.mark.parametrize("hot, open_sent, words_sent", [(10, 1 << 18, 1 << 20), (10, 0, 0), (1 << 30, 1 << 18, 0), (10, 1 << 18, 0)])
def test_line_dedup_hot_words_and_open_lines(spark, monkeypatch, hot, open_sent, words_sent):
    from pageloom.llm import line_dedup as L

    for name, value in (("HOT", hot), ("HOT_MOST", 1 << 30), ("OPEN_SENT", open_sent), ("WORDS_SENT", words_sent), ("TRIED", 1), ("CLASSES_SENT", 3), ("DOCS_SENT", 3), ("SEEN", 4), ("PAIRS_AT_ONCE", 500)):
        monkeypatch.setattr(L, name, value)
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(14)]
    texts = ["\n".join(" ".join(rnd.sample(words, rnd.randint(4, 12))) for _ in range(rnd.randint(1, 6))) for _ in range(220)]
    gone, compared = brute_lines(texts)
    got = {r["doc_id"]: r["removed"] for r in L.removed_lines(make(spark, texts)).collect()}
    assert got == gone and sum(map(len, gone.values())) > 100


def test_line_dedup_clashing_names(spark):
    from pageloom.llm.line_dedup import dedup_lines

    texts = ["one two three four five"] * 2 + [None, "x"]
    docs = make(spark, texts).select("doc_id", "text", *(F.lit(k).alias(k) for k in ("__id", "removed", "stays", "doc", "own", "a.b", "compared")))
    got = dedup_lines(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["removed"], r["a.b"]) for r in got.collect() if r["text"]) == [(0, texts[0], "removed", "a.b"), (3, "x", "removed", "a.b")] and got.count() == 3
