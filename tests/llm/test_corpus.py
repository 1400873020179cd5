"""Each operator against a brute-force version on small tables with nulls, empties, long texts, ties, copies and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, lang string, n long, node string, key string, words string"


def make(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", 1, "x", "y", "z") for i, t in zip(ids, texts)], SCHEMA)


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["an", "er", "tion", "on", "ing", "ÉA", "s"]) for _ in range(rnd.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(rnd.randint(1, 30)))
    texts = ["\n".join(line() for _ in range(rnd.randint(1, 8))) for _ in range(n)]
    for k in range(12):
        source = rnd.choice(texts).split(" ")
        for _ in range(rnd.randint(0, 2)):
            source[rnd.randrange(len(source))] = word()
        texts.append(" ".join(source))
    common = " ".join(word() for _ in range(70))
    texts += [f"{line()}\n{common}\n{line()}" for _ in range(6)] + [texts[0]] * 5
    return [*texts, None, "", " \n ", "A", "licensed under CC BY-NC 4.0. All rights reserved. GNU General Public License", "x" * 5000, "ab " * 3000, "<|endoftext|> it's ½ Σ"]


TEXTS = corpus()


def test_ngram_join(spark):
    from pageloom.llm.ngram_join import ngram_jaccard_components

    sets = []
    for t in TEXTS:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))
        sets.append({tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_components(make(spark, TEXTS)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert ngram_jaccard_components(make(spark, [])).count() == 0
    odd = ngram_jaccard_components(make(spark, ["a b c d e", "a b c d e", None], [None, 4, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in odd) == [(-1, -1), (-1, -1), (4, 4)]


def test_nearest(spark):
    from pageloom.llm.nn_graph import nearest_neighbours

    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.normal(size=6)], 1) for i in range(300)]
    vectors += [(300 + i, vectors[0][1], 1) for i in range(20)] + [(900, None, 1), (1000, [0.0] * 6, 1), (1100, [float("nan")] * 6, 1), (1200, [1.0], 1)]
    got = nearest_neighbours(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")).toPandas()
    usable = {i: np.array(v, np.float32).astype(float) for i, v, _ in vectors[:320]}
    assert set(got.query_id) == {0, 100, 200, 300}
    for q, part in got.groupby("query_id"):
        exact = sorted((float(np.sqrt(((usable[q] - v) ** 2).sum())), i) for i, v in usable.items() if i != q)[:10]
        assert part.sort_values("rank").vec_id.tolist() == [i for _, i in exact]
    assert nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert nearest_neighbours(spark.createDataFrame(vectors[99:102], "vec_id long, embedding array<float>, label int")).count() == 2


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pageloom.llm.bpe_codec import bpe_encode_decode
    from pageloom.llm.token_counts import token_counts

    path = public_tokenizers.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    want = {i: theirs.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    counts = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(make(spark, TEXTS), path, 50).collect()}
    assert counts == {i: (len((TEXTS[i] or "").encode()), len(ids), len(ids) > 50) for i, ids in want.items()}
    coded = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe_encode_decode(make(spark, TEXTS), path, leaf=8).collect()}
    assert coded == {i: (ids, theirs.decode(ids, skip_special_tokens=False)) for i, ids in want.items()}
    assert token_counts(make(spark, []), path, 5).count() == bpe_encode_decode(make(spark, []), path).count() == 0


def test_suffix_dedup(spark):
    from pageloom.llm.suffix_dedup import difference_cover, suffix_dedup

    texts = [*TEXTS, "q" * 199, "w" * 200, "ab" * 150]
    count = Counter()
    for t in texts:
        raw = (t or "").encode()
        count.update(raw[k : k + 200] for k in range(len(raw) - 199))
    got = {r["doc_id"]: r for r in suffix_dedup(make(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 199):
            if count[raw[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert bytes(got[i]["kept"]) == bytes(np.frombuffer(raw, np.uint8)[~gone])
        assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == gone.sum()
    assert suffix_dedup(make(spark, [])).count() == 0
    cover = difference_cover(32)
    assert {(a - b) % 32 for a in cover for b in cover} == set(range(32))


def test_mixing(spark):
    from pageloom.llm.mixing import mix_sources, mixing_rates

    docs = make(spark, ["der die das und " * 9] * 6 + ["the and of is " * 9] * 14 + [None, ""])
    labelled = spark.createDataFrame([(i, "de" if i < 6 else "en") for i in range(0, 20, 2)] + [(99, "de"), (3, None), (None, "en")], "doc_id long, domain string")
    got = mixing_rates(docs, labelled, {"de": 0.5, "en": 0.5}).toPandas()
    totals = {d: (got.tokens * got.rate * got[f"p_{d}"]).sum() for d in ("de", "en")}
    assert abs(totals["de"] / sum(totals.values()) - 0.5) < 0.01 and got.rate.min() >= 1
    mixed = mix_sources(docs, labelled, {"de": 0.5, "en": 0.5})
    assert mixed.columns == docs.columns and set(r["doc_id"] for r in mixed.collect()) == set(range(22))
    assert mixed.count() == got.copies.sum()
    assert mix_sources(make(spark, []), labelled, {"de": 0.5, "en": 0.5}).count() == 0


def test_mixing_against_least_squares(spark):
    """Posteriors against plain naive Bayes, rates against a plain projected gradient, and a table with clashing names."""
    import math

    import xxhash
    from pyspark.sql import functions as F

    from pageloom.llm import mixing as M

    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(("der die das und " * 3 + "the and of is " * rnd.randint(0, 3)).split()) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(rnd.choice("the and of is house".split()) for _ in range(rnd.randint(1, 60))) for _ in range(90)] + [None, ""]
    labels = {i: "de" if i < 60 else "en" for i in range(0, 150, 3)}
    docs = make(spark, texts)
    labelled = spark.createDataFrame(list(labels.items()), "doc_id long, domain string")
    targets = {"de": 0.6, "en": 0.4}
    got = M.mixing_rates(docs, labelled, targets, low=0.0, high=5.0).toPandas().sort_values("doc_id")

    def bucket(word):
        h = xxhash.xxh64_intdigest(word.encode(), seed=42)
        return (h - (1 << 64) if h >> 63 else h) % M.BUCKETS

    words = [[bucket(w) for w in (t or "").lower().split()] for t in texts]
    counts, share = {d: Counter() for d in targets}, Counter(labels.values())
    for i, d in labels.items():
        counts[d].update(words[i])
    p = []
    for w in words:
        logit = [math.log((share[d] + 1) / (len(labels) + 2)) + sum(math.log((counts[d][b] + 0.5) / (sum(counts[d].values()) + 0.5 * M.BUCKETS)) for b in w) / math.sqrt(max(1, len(w))) for d in sorted(targets)]
        e = [math.exp(x - max(logit)) for x in logit]
        p.append([x / sum(e) for x in e])
    p, tokens = np.array(p), np.array([len(w) for w in words], float)
    assert np.allclose(got[["p_de", "p_en"]].to_numpy(), p) and (got["tokens"] == tokens).all()
    mass, want = tokens @ p, np.array([0.6, 0.4])
    budget = (mass / want).max()
    error = lambda r: (((r * tokens) @ p - want * budget) / mass)
    rate = np.ones(len(texts))
    for _ in range(4000):
        rate = np.clip(rate - 0.5 * p @ error(rate), 0.0, 5.0)
    mine = got["rate"].to_numpy()
    assert (error(mine) ** 2).sum() <= (error(rate) ** 2).sum() + 1e-4 and mine.min() >= 0 and mine.max() <= 5
    named = docs.select("doc_id", "text", *(F.lit(k).alias(k) for k in ("__id", "__copies", "copies", "doc", "key", "id", "col")))
    mixed = M.mix_sources(named, labelled, targets)
    assert mixed.columns == named.columns and mixed.where("id <> 'id' or doc <> 'doc'").count() == 0 and mixed.count() >= len(texts)


def plain_features(text):
    import math

    raw, count = text.encode(), lambda chars: sum(chr(b) in chars for b in text.encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [x for x in raw.split(b"\n") if x]
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    beyond, n = sum(b > 127 for b in raw), max(1, len(raw))
    letters, w = max(1, upper + lower + beyond), max(1, len(words))
    return [
        math.log2(1 + len(raw)), upper / letters, count("0123456789") / n, beyond / n, count(",.;:?'\"-()") / n, count("!") / n, count("|<>[\\]{}") / n,
        count("#$%&*+/=@^_`~") / n, sum(b < 9 or 10 < b < 32 or b == 127 for b in raw) / n, math.log2(1 + w / max(1, len(lines))), sum(map(len, words)) / w,
        sum(len(x) <= 3 for x in words) / w, len(set(words)) / w, len(set(lines)) / max(1, len(lines)), sum(a == b for a, b in zip(words, words[1:])) / w,
    ]


def test_quality_against_plain_code(spark):
    import math

    from pageloom.llm import quality_gam as Q

    assert [f for f in Q.FEATURES] and len(plain_features("a")) == len(Q.FEATURES)
    texts = [t or "" for t in TEXTS]
    raw = [t.encode() for t in texts]
    x = Q.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert np.allclose(x, [plain_features(t) for t in texts])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    model = Q.fit_quality(make(spark, TEXTS), labels)
    got = Q.quality_scores(make(spark, TEXTS), labels).toPandas().set_index("doc_id")["score"]
    for i, t in enumerate(texts):
        at = [sum(v >= c for c in cuts) for v, cuts in zip(x[i], model.cuts)]
        total = model.intercept + sum(float(table[b]) for table, b in zip(model.tables, at)) + sum(float(table[at[a], at[b]]) for a, b, table in model.pairs)
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-9

    def slow_tree(g, w, depth):
        leaf = [sum(g) / (sum(w) + 1)] * len(g)
        if depth == 0 or len(g) < 2:
            return leaf
        gain = lambda c: sum(g[:c]) ** 2 / (sum(w[:c]) + 1) + sum(g[c:]) ** 2 / (sum(w[c:]) + 1)
        cut = max(range(1, len(g)), key=lambda c: (gain(c), -c))
        return slow_tree(g[:cut], w[:cut], depth - 1) + slow_tree(g[cut:], w[cut:], depth - 1)

    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 30):
        g, w = rng.normal(size=n), rng.random(n)
        assert np.allclose(Q._tree(g, w, 2), slow_tree(g.tolist(), w.tolist(), 2))


def test_flac(spark):
    from pageloom.llm.flac import decode_files, media_column, read_samples

    texts = [*TEXTS, "\x00\x7f" * 700]
    for r in media_column(make(spark, texts)).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        assert bytes(r["payload"]) == full and r["n_bytes"] == len(raw)
        blob, offsets = bytes(r["media"]), np.array(r["frame_offsets"])
        assert read_samples(blob, offsets, 50, 300) == full[50:350]
        broken = bytearray(blob)
        broken[-9] ^= 4
        with pytest.raises(ValueError):
            decode_files([(bytes(broken), offsets)])
    assert media_column(make(spark, [])).count() == 0


def test_quality(spark):
    from pageloom.llm.quality_gam import quality_scores

    good, bad = ["the and of. " * (5 + k % 7) for k in range(60)], ["### $$$ %%% x|y|" * (5 + k % 7) for k in range(60)]
    docs = make(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(5, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).toPandas().set_index("doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    assert (got.predicted[:60] == 1).all() and (got.predicted[60:120] == 0).all() and got.score.between(0, 1).all()
    assert quality_scores(docs, labels.where("false")).toPandas().score.eq(0.5).all()
    assert quality_scores(make(spark, []), labels).count() == 0


def brute_lines(texts, least=1):
    seen, gone, compared = [], {}, Counter()
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            words = frozenset(re.findall(rb"[^\x20\x09-\x0D]+", line.encode().translate(LOWER)))
            if len(words) >= least:
                compared[i] += 1
                if any(100 * len(words & s) >= 80 * len(words | s) for s in seen):
                    gone.setdefault(i, []).append(k)
                seen.append(words)
    return gone, compared


def test_line_dedup(spark):
    from pageloom.llm.line_dedup import dedup_lines

    gone, compared = brute_lines(TEXTS)
    want = {i: t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in enumerate(TEXTS) if len(gone.get(i, ())) < compared[i] or not compared[i]}
    got = dedup_lines(make(spark, TEXTS))
    assert got.columns == make(spark, []).columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert dedup_lines(make(spark, [])).count() == 0 and dedup_lines(make(spark, ["a b c d e"] * 2, [None, None])).count() == 2


def test_license_scan(spark):
    from pageloom.llm.license_scan import BASE, SuffixAutomaton, license_scan, words_of

    texts = [*TEXTS, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "cc by cc by", "general public license general public"]
    got = {r["doc_id"]: r for r in license_scan(make(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words_of(t or "")
        places = sorted((j, label) for p, label in BASE for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        assert sorted((b["word"], b["label"]) for b in got[i]["base"]) == places and got[i]["n_words"] == len(w)
    assert [s["label"] for s in got[len(TEXTS)]["spans"]] == ["mit"]
    rnd = random.Random(1)
    seqs = [[rnd.randrange(3) for _ in range(rnd.randint(1, 12))] for _ in range(6)]
    text = [rnd.randrange(4) for _ in range(200)]
    has = lambda s: any(q[k : k + len(s)] == s for q in seqs for k in range(len(q) - len(s) + 1))
    want = [max(n for n in range(i + 2) if n == 0 or has(text[i + 1 - n : i + 1])) for i in range(200)]
    assert [n for _, n in SuffixAutomaton(seqs).stream(text)] == want
    assert license_scan(make(spark, [])).count() == 0


def test_license_spans(spark):
    """A whole licence with some words changed is one span; its coverage is the share of template words in order."""
    from pageloom.llm.license_scan import WHOLE, license_scan, words_of

    texts, want = [], []
    for k, (label, text) in enumerate(WHOLE):
        words = words_of(text)
        for at in range(10, len(words) - 5, 25):
            words[at] = "zzz"
        texts.append("Some words before. " + " ".join(words).upper() + "\n\nand after " * k)
        want.append((label, (len(words) - len(range(10, len(words) - 5, 25))) / len(words)))
    texts.append(" ".join(words_of(WHOLE[0][1])[:60]))
    got = {r["doc_id"]: r["spans"] for r in license_scan(make(spark, texts)).collect()}
    for i, (label, share) in enumerate(want):
        wide = max(got[i], key=lambda s: s["end"] - s["start"])
        assert (wide["label"], wide["start"]) == (label, 3) and abs(wide["coverage"] - share) < 1e-9
    # a third of a licence is no span of the whole, only of the notice that it holds
    assert max(s["end"] - s["start"] for s in got[len(WHOLE)]) < 30


def test_pipeline(spark, tmp_path):
    """Stage by stage on the table with nulls, empties and clashing names, each against what its operator's brute-force version says of its own input."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from pageloom.llm import quality_gam as Q

    schema = "doc_id long, text string, lang string, source string, n_chars long, removed string, copies int, id string"
    data = [(i, t, "en" if i % 2 else "de", "s", len(t or ""), "r", 1, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "en", "s", 5, "r", 1, "x")]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, len(TEXTS), 3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, (theirs, out) = docs.columns, (Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), None)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, str(tmp_path))
        after = out.collect()
        keyed = lambda rows: {r["doc_id"]: r["text"] for r in rows}
        if name == "encoding":
            assert Counter((r["doc_id"], tuple(r["ids"])) for r in after) == Counter((r["doc_id"], tuple(theirs.encode(r["text"] or "", add_special_tokens=False).ids)) for r in before)
            assert all(r["n_tokens"] == len(r["ids"]) for r in after)
            break
        assert out.columns == columns, name
        if name == "quality":
            model = Q.fit_quality(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
            raw = [(r["text"] or "").encode() for r in before]
            score = model.score(Q.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])))
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r, v in zip(before, score) if v >= Q.THRESHOLD)
        elif name == "lines":
            rows = sorted((r for r in before if r["doc_id"] is not None), key=lambda r: r["doc_id"])
            gone, compared = brute_lines([r["text"] for r in rows])
            kept = {r["doc_id"]: (r["text"] if k not in gone else "\n".join(x for n, x in enumerate(r["text"].split("\n")) if n not in gone[k])) for k, r in enumerate(rows) if len(gone.get(k, ())) < compared[k] or not compared[k]}
            assert keyed(after) == kept | {r["doc_id"]: r["text"] for r in before if r["doc_id"] is None}
            assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)
        elif name == "near_duplicates":
            sets, left = {}, {}
            for r in before:
                w = re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode().translate(LOWER))
                sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
            root = {i: i for i in sets if i is not None}
            for a in sorted(root):
                for b in sorted(root):
                    if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                        low, high = sorted((root[a], root[b]))
                        root = {k: low if v == high else v for k, v in root.items()}
            left = {i for i, v in root.items() if i == v} | ({None} & set(sets))
            assert set(keyed(after)) == left and len(after) == len(left)
        else:
            assert set(keyed(after)) == set(keyed(before)) and len(after) >= len(before) and all(r["removed"] == "r" and r["copies"] == 1 for r in after)
        docs = spark.createDataFrame(after, docs.schema)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert whole and Counter(r["doc_id"] for r in whole) == Counter(r["doc_id"] for r in after)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_few_row_groups_are_dealt_to_all_cores(spark, tmp_path):
    """A file of one row group is one task as it is read; scoring and encoding need all cores."""
    import corpus_pipeline

    rows = [(k, f"Words of document {k}, in a plain sentence.", "en", "a", 40) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert docs.rdd.getNumPartitions() == 1
    cores = spark.sparkContext.defaultParallelism
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.encoding_stage):
        assert stage(spark, docs, str(tmp_path)).rdd.getNumPartitions() >= cores
    assert sorted(r["doc_id"] for r in corpus_pipeline.encoding_stage(spark, docs, str(tmp_path)).collect()) == list(range(60))
