"""Scratch tables and their end."""

import os

from pageloom.runtime import Scratch, clean


def test_clean_deletes_the_runs_of_a_context(spark, tmp_path, monkeypatch):
    kept = getattr(spark.sparkContext, "_pageloom_runs", [])
    spark.sparkContext._pageloom_runs = []
    scratch = Scratch(spark, "test")
    assert scratch.save(spark.range(3), "a").count() == 3 and scratch.save(spark.range(4), "b").count() == 4
    folder = scratch.base.removeprefix("file://")
    scratch.drop("a")
    assert sorted(os.listdir(folder)) == ["b"]
    clean(spark)
    assert not os.path.exists(folder) and spark.sparkContext._pageloom_runs == []
    spark.sparkContext._pageloom_runs = kept
