"""NN-descent and greedy search on a table of many groups: recall against brute force, hubs, repeats."""

import numpy as np
import pytest


@pytest.mark.parametrize("spread", ["even", "clustered"])
def test_recall(spark, monkeypatch, spread):
    from pageloom.llm import nn_graph as G

    monkeypatch.setattr(G, "GROUP", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2500, 24))
    if spread == "clustered":
        x = rng.normal(size=(40, 24))[rng.integers(0, 40, 2500)] * 4 + x * 0.3
        x[:100] = x[0]  # one vector in many copies
    rounds = []
    save = G.Scratch.save
    monkeypatch.setattr(G.Scratch, "save", lambda self, df, name: rounds.append(name) or save(self, df, name))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = G.nearest_neighbours(table, every=25).toPandas()
    assert "graph3" in rounds, "the graph is improved in rounds"
    hits = 0
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert part["rank"].tolist() == list(range(1, 11)) and np.allclose(part["score"], d[part["vec_id"]])
        assert list(zip(part["score"], part["vec_id"])) == sorted(zip(part["score"], part["vec_id"]))
        hits += (part["score"] <= np.sort(d)[9] + 1e-12).sum()
    assert got["query_id"].nunique() == 100 and hits >= 950, hits


def test_degree_is_bounded(spark):
    from pageloom.llm import nn_graph as G

    # all nodes have node 0 as their nearest
    edges = spark.createDataFrame([(v, 0, float(v), True) for v in range(1, 200)], "v long, u long, d double, new boolean")
    links = G.both_ways(edges).toPandas()
    assert (links["v"] == 0).sum() == G.REVERSE and set(links[links["v"] == 0]["u"]) == set(range(1, G.REVERSE + 1))
