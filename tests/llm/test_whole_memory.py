"""What travels between Spark and its workers is bounded in bytes, whatever the rows hold."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_corpus import make


def test_pipeline_batches_are_blocks(spark, tmp_path):
    import corpus_pipeline
    from pageloom.llm import textkit as tk

    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {key: spark.conf.get(key) for key in keys}
    make(spark, ["a", "b"], [1, 2]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, False, "en"), (2, 1, False, "de")], "doc_id long, quality int, toxic boolean, lang string").write.parquet(f"{tmp_path}/labels.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    try:
        for name, stage in corpus_pipeline.STAGES:
            if name == "mixing":  # no workers
                continue
            for key in keys:
                spark.conf.set(key, before[key])
            stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
            # 2,000 rows of 4,000 bytes, as one task reads them
            rows = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("word word "), 400).alias("text"))
            assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= tk.BLOCK_BYTES, name
    finally:
        for key in keys:
            spark.conf.set(key, before[key])


def test_index_rows_are_bounded():
    from pageloom.llm import line_dedup as ld, textkit as tk

    rng = np.random.default_rng(3)
    records = np.zeros(90_000, dtype=ld.RECORD)
    # half of the records are of one word, whose bucket is far longer than a row
    records["token"] = np.where(rng.random(len(records)) < 0.5, 7, rng.integers(0, 5000, len(records)))
    records["doc_id"] = np.arange(len(records))
    for buckets in (1, 12, 3000):
        batches = list(ld._dealt(records, buckets))
        assert max(b.nbytes for b in batches) <= tk.BLOCK_BYTES
        rows = [(k, np.frombuffer(x, dtype=ld.RECORD)) for b in batches for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert max(x.nbytes for _, x in rows) <= 1 << 16
        assert all((tk.mix(x["token"]) % np.uint64(buckets) == k).all() for k, x in rows)
        got = np.concatenate([x for _, x in rows])
        assert (got[np.argsort(got["doc_id"])] == records).all()
