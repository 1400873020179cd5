"""Operators 11 to 13 against brute force: toxicity, vector codes, runs of words."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_corpus import TEXTS, make

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- toxicity ----------------------------------------------------------------

def _talk(seed, n=400):
    """Invented talk; a fifth holds words of abuse, some disguised, and one clean phrase holds one."""
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice("abdegmnoprtuv") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    bad = ["zorgling", "fleckwit", "snarbage"]
    texts, labels = [], []
    for k in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(10, 60))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(max(2, len(words) // 10)):
                words.insert(rnd.randint(0, len(words)), rnd.choice(bad))
        elif k % 20 == 3:
            words[3:3] = ["snarbage", "collector"]
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def _fit(spark, texts, labels, **more):
    from pageloom.llm.toxicity import fit_toxicity

    return fit_toxicity(make(spark, texts), spark.createDataFrame([(k, y) for k, y in enumerate(labels)], "doc_id long, toxic int"), **more)


def test_fold():
    from pageloom.llm.toxicity import fold

    assert fold("1d10t IDIOT idi​ot іdіоt ｉｄｉｏｔ \xadidiot!! $idiot$") == " idiot idiot idiot idiot idiot idiot idiot "
    assert fold("") == fold(" \t.,!") == "  " and fold("12 345 a_b") == " 12 345 ab "


def test_hits_against_search():
    from pageloom.llm.toxicity import Lexicon, fold, hits

    rnd = random.Random(3)
    entries = {" abab ": 2.0, " aba": 1.5, " ba": 0.5, " bb ": 3.0}
    model = Lexicon(entries=entries, exceptions=frozenset({" abab ba ", " bb bb "}))
    for _ in range(300):
        text = fold(" ".join("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 12))))
        spared = [(m.start(), m.start() + len(p) - 1) for p in model.exceptions for m in re.finditer(f"(?={re.escape(p)})", text)]
        want = {}
        for entry, weight in entries.items():
            for m in re.finditer(f"(?={re.escape(entry)})", text):
                if not any(low <= m.start() < high for low, high in spared):
                    want[m.start()] = max(weight, want.get(m.start(), 0))
        assert hits(model.automaton(), text) == want


def test_toxicity_held_out(spark):
    from pageloom.llm.toxicity import toxicity_scores

    texts, labels = _talk(1)
    texts += ["you f1eckw1t, you zоrgling, total snarbage " * 2, "a snarbage collector came by and took all of it away with the others of the town", "", None, "clean talk " * 50_000]
    labelled = spark.createDataFrame([(k, y) for k, y in enumerate(labels)] + [(3, None), (None, 1), (10_000, 1)], "doc_id long, toxic int")
    docs = make(spark, texts).withColumnRenamed("n_chars", "score")
    got = {r["doc_id"]: r for r in toxicity_scores(docs, labelled).collect()}
    assert len(got) == len(texts)
    for k, row in got.items():
        assert row["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.7)
    assert [got[k]["predicted"] for k in range(400)] == labels
    assert [got[k]["predicted"] for k in range(400, 405)] == [1, 0, 0, 0, 0]


@pytest.mark.parametrize("labels, score", [([], 0.5), ([1, 1, 1], None), ([0, 0, 0], None)])
def test_toxicity_without_both_classes(spark, labels, score):
    from pageloom.llm.toxicity import HELD_OUT, toxicity_scores

    assert "mod" in HELD_OUT
    used = [y for k, y in enumerate(labels) if zlib.crc32(str(k).encode()) % 3 != 1]
    score = score or (sum(used) + 0.5) / (len(used) + 1)
    labelled = spark.createDataFrame([(k, y) for k, y in enumerate(labels)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(0, "a b"), (1, None), (2, ""), (2, ""), (None, "trash")], "doc_id long, text string")
    got = toxicity_scores(docs, labelled).collect()
    assert len(got) == 5 and all(abs(r["score"] - score) < 1e-9 for r in got) and not [r for r in got if r["doc_id"] is None][0]["held_out"]
    assert toxicity_scores(docs.limit(0), labelled).count() == 0


def test_copies_of_one_toxic_text_teach_little(spark):
    texts, labels = _talk(2, 300)
    rnd = random.Random(9)
    own = [f"word{k}" for k in range(40)]
    for _ in range(200):
        copy = list(own)
        copy[rnd.randint(0, 39)] = "other"
        texts.append(" ".join(copy))
        labels.append(1)
    assert not [e for e in _fit(spark, texts, labels).entries if re.fullmatch(r" word\d+ ", e) and e.count("0") > 5] and " zorgiing " in _fit(spark, texts, labels).entries


# ---- vector codes ------------------------------------------------------------

def brute_codes(rows, parts, entries, rounds):
    """rows: (vec_id, integers) in order. Codes, errors and codebooks by whole distance tables."""
    x = np.array([r[1] for r in rows], dtype=np.int64).reshape(len(rows), parts, -1)
    codes, error, books = np.empty((len(rows), parts), int), np.zeros(len(rows), np.int64), []
    for p in range(parts):
        book = x[:entries, p].copy()
        for turn in range(rounds + 1):
            far = ((x[:, p][:, None] - book[None]) ** 2).sum(axis=2)
            at = far.argmin(axis=1)
            if turn < rounds:
                for k in range(len(book)):
                    if (at == k).any():
                        book[k] = x[at == k, p].sum(axis=0) // (at == k).sum()
        codes[:, p], error = at, error + far.min(axis=1)
        books.append(book)
    return codes, error, books


@pytest.mark.parametrize("n, leaf, block, grid", [(300, 4, 64, 8), (70, 16, 8192, 2), (5, 1, 3, 50), (900, 3, 500, 400)])
def test_filter_tree_against_whole_tables(n, leaf, block, grid):
    """Coarse grids make ties between entries and repeated points common."""
    from pageloom.llm import vector_codes as V

    rnd = np.random.default_rng(n)
    for _ in range(6):
        points = rnd.integers(-grid, grid, (n, 3))
        book = np.concatenate([points[: n // 2][:20], rnd.integers(-grid, grid, (10, 3))])
        order = V.build_order(points, leaf)
        here = points[order]
        lows, highs = [], []
        for level in range(V.tree_levels(n, leaf)):
            first = V.tree_bounds(n, level)[:-1]
            lows.append(np.minimum.reduceat(here, first, axis=0)), highs.append(np.maximum.reduceat(here, first, axis=0))
        low, high, entry = V.filter_tree(here, lows, highs, book)
        got = np.full(n, -1)
        for a, b, e in zip(low, high, entry):
            assert (got[a:b] == -1).all()
            got[a:b] = e
        assert (got == ((here[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_vector_codes(spark, monkeypatch):
    from pageloom.llm import vector_codes as V

    monkeypatch.setattr(V, "BLOCK", 50)
    rnd = random.Random(4)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [rnd.choice([rnd.uniform(-1, 1), 0.25, -0.001]) for _ in range(8)], rnd.choice([0, 0, 0, 1, 2, None])) for k in range(160)]
    rows += [(k + 160, list(rows[k][1]), 7) for k in range(20)]
    bad = [(900, None, 1), (901, [0.1] * 7 + [None], 1), (902, [nan] * 8, 1), (903, [inf] + [0.0] * 7, 1), (904, [0.5] * 6, 1), (905, [], None)]
    rnd.shuffle(rows)
    table = spark.createDataFrame([(i, v, y, "x") for i, v, y in rows + bad], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    coded, books = V.compress(table, parts=4, entries=16, rounds=2)
    rows.sort()
    codes, error, want = brute_codes([(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows], 4, 16, 2)
    assert all((a == b).all() for a, b in zip(books, want))
    sums = {}
    for (_, _, y), e in zip(rows, error):
        sums[y] = sums.get(y, 0) + int(e)
    for sent in (1 << 16, 2, 1):
        got = {r["vec_id"]: r for r in V.with_label_sums(coded, sent).collect()}
        assert len(got) == len(rows)
        for k, (i, _, y) in enumerate(rows):
            assert (list(got[i]["code"]), got[i]["error"], got[i]["label"], got[i]["label_error"]) == (codes[k].tolist(), int(error[k]), y, sums[y])
    assert V.books_digest(books) == hashlib.sha256(",".join(str(x) for b in want for x in b.ravel()).encode()).hexdigest()


def test_vector_codes_edges(spark):
    from pageloom.llm import vector_codes as V

    schema = "vec_id long, embedding array<float>, label int"
    coded, books = V.compress(spark.createDataFrame([], schema))
    assert V.with_label_sums(coded).count() == 0 and V.books_digest(books) == hashlib.sha256(b"").hexdigest()
    few = [(3, [0.5, -0.5, 1e30], None), (3, [0.5, -0.5, 1e30], None), (None, [0.0, 0.0, 0.0], 1), (1, [0.1, 0.2, 0.3], 1)]
    coded, books = V.compress(spark.createDataFrame(few, schema), parts=2, entries=2, rounds=1)
    got = V.with_label_sums(coded).collect()
    assert len(got) == 4 and [b.shape for b in books] == [(2, 2), (2, 2)] and len({bytes(r["code"]) for r in got if r["vec_id"] == 3}) == 1


# ---- runs of words -----------------------------------------------------------

def brute_runs(words, least=6, power=4):
    n, out = len(words), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, power * q) and not any(all(words[i + k] == words[i + k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out)


def _periodic(rnd):
    words = []
    for _ in range(rnd.randint(0, 4)):
        base = [rnd.choice("abc") for _ in range(rnd.randint(1, 6))]
        words += base * rnd.randint(1, 7) + base[: rnd.randint(0, len(base))]
    return words


@pytest.mark.parametrize("least, power", [(6, 4), (1, 3), (9, 5)])
def test_find_runs(least, power):
    from pageloom.llm.word_runs import find_runs

    rnd = random.Random(power)
    for _ in range(150):
        texts = [_periodic(rnd) for _ in range(rnd.randint(1, 5))]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found = find_runs(np.array([ord(w) for t in texts for w in t], dtype=np.int64), bounds, least, power)
        assert [[tuple(map(int, r)) for r in f] for f in found] == [brute_runs(t, least, power) for t in texts]


def test_next_smaller_long_stairs():
    from pageloom.llm.word_runs import next_smaller

    rnd = np.random.default_rng(1)
    for values in (np.arange(500), np.concatenate([[0], np.arange(500, 1, -1)]), rnd.permutation(400)):
        want = [next((j for j in range(i + 1, len(values)) if values[j] < values[i]), len(values)) for i in range(len(values))]
        for rounds in (200, 1, 0):
            assert next_smaller(values.astype(np.int64), np.full(len(values), len(values)), rounds).tolist() == want


def test_op13_query(spark, tmp_path):
    from pageloom.llm.queries import op13_word_runs

    rnd = random.Random(8)
    texts = TEXTS + [" ".join(_periodic(rnd)) for _ in range(120)] + ["w\tv\r\n" * 30 + "x", "a " * 3000, " \n ", "é ü " * 9, None]
    make(spark, texts).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op13_word_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute_runs(words)
        gone = {k for start, length, q in runs for k in range(start + q, start + length)}
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        want = (len(runs), *top, 1000 * top[1] // top[2] if runs else None)
        row = got[i]
        assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == want, i
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
