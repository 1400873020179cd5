"""Session helpers: shipping the package to executors and cutting lineage.

Lineage is cut only by tables written to the folder that all executors share
(``spark.checkpoint.dir``), so a lost executor costs a re-read, never a result.
"""

from __future__ import annotations

import gc
import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make ``pageloom`` importable in Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_pageloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="pageloom-")
    target = os.path.join(folder, "pageloom.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(_ROOT.rglob("*.py")):
            out.write(path, str(path.relative_to(_ROOT.parent)))
    sc.addPyFile(target)
    sc._pageloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = getattr(sc, "_pageloom_dir", None)
    if own is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = sc._pageloom_dir = tempfile.mkdtemp(prefix="pageloom-shared-")
    return f"file://{own}"


#: The folder of the slice at work: runs that begin in a slice are under it and end with it.
_SLICE_DIR: ContextVar[str | None] = ContextVar("_SLICE_DIR", default=None)


class Scratch:
    """Tables of one run under the shared folder; ``drop`` frees one that is no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        within = _SLICE_DIR.get()
        self.base = f"{within or shared_dir(spark)}/pageloom-{label}-{uuid.uuid4().hex[:12]}"
        sc = spark.sparkContext
        if not within:
            sc._pageloom_runs = [*getattr(sc, "_pageloom_runs", ()), self.base]

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.load(name, df.schema)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        _delete(self.spark, *(f"{self.base}/{name}" for name in names))
        # shuffle files of plans that nothing refers to any more are freed when the driver collects garbage
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


#: Rows of a slice, about: what they shuffle and write on the way is on disk at once.
SLICE = 1 << 23


def by_slices(of: Callable[..., DataFrame], rows: DataFrame, *others: DataFrame, key: str = "image_id", most: int | None = None) -> DataFrame:
    """``of(rows, *others)`` where no key knows of another, for tables of any size: over ``most`` rows, slices of keys go one after another.

    What a slice shuffles and writes on the way is deleted before the next, so disk holds one slice's, the tables and what is returned.
    All rows of a key are in one slice, however many there are; ``rows`` is written first, so it is worked out once.
    """
    scratch = Scratch(rows.sparkSession, "slices")
    rows = scratch.save(rows, "rows")
    n = math.ceil(rows.count() / (most or SLICE))
    if n <= 1:
        return of(rows, *others)
    dealt = []
    for i, table in enumerate((rows, *others)):
        part = table.withColumn("_slice", F.expr(f"cast(pmod(xxhash64({key}), {n}) as int)"))
        part.write.partitionBy("_slice").parquet(f"{scratch.base}/dealt{i}")
        dealt.append(scratch.load(f"dealt{i}", part.schema))
    scratch.drop("rows")
    for k in range(n):
        token = _SLICE_DIR.set(f"{scratch.base}/slice{k}")
        try:
            found = scratch.save(of(*(t.where(F.col("_slice") == k).drop("_slice") for t in dealt)), f"found{k}")
        finally:
            _SLICE_DIR.reset(token)
        scratch.drop(f"slice{k}")
    scratch.drop(*(f"dealt{i}" for i in range(len(dealt))))
    return rows.sparkSession.read.schema(found.schema).parquet(*(f"{scratch.base}/found{k}" for k in range(n)))


def _delete(spark: SparkSession, *paths: str) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Deletes the folders of all runs of this context. To be called when their results have been read: a result may still refer to them."""
    sc = spark.sparkContext
    _delete(spark, *getattr(sc, "_pageloom_runs", ()))
    sc._pageloom_runs = []
