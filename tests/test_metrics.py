"""Counts observed while a detection runs, in a batch and in a stream's listener; perimeter samples as a table function."""

from pyspark.sql import Observation, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from pageloom import registry
from pageloom.operators import colour as C, detect as D

SF = "/root/testdata/sf0.001"


def test_observed_counts_equal_the_grouped_ones(spark):
    seen = Observation("detection")
    found = D.detect(registry._frames(spark, SF), registry._mosaic_words(spark, SF), 64, 64, registry.MOSAIC_HEIGHT, observation=seen)
    want = D.counts(found).agg(F.sum("boxes"), F.sum("words"), F.sum("seas")).first()
    area = found.boxes.agg(F.sum(F.expr("cast(w as bigint) * h"))).first()[0]
    assert (seen.get["boxes"], seen.get["words"], seen.get["seas"], seen.get["area"]) == (*want, area) and want[0] and want[1] and want[2] < want[0]


def test_a_streams_listener_gets_the_counts(spark, tmp_path):
    class Keeps(StreamingQueryListener):
        def __init__(self):
            self.rows = []

        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            self.rows += [r.asDict() for k, r in event.progress.observedMetrics.items() if k == "batch"]

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            self.rows.append(None)

    schema = "image_id long, x int, y int, w int, h int, is_word boolean, founder boolean"
    for k in range(2):
        spark.createDataFrame([(k, n, n, 2, 3, n % 2 == 0, n < 2) for n in range(5 + k)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    keeps = Keeps()
    spark.streams.addListener(keeps)
    boxes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    asked = D.observed(boxes, "batch").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    asked.awaitTermination(120)
    import time

    for _ in range(100):
        if None in keeps.rows:
            break
        time.sleep(0.2)
    spark.streams.removeListener(keeps)
    got = [r for r in keeps.rows if r]
    assert sum(r["boxes"] for r in got) == 11 and sum(r["words"] for r in got) == 6 and sum(r["seas"] for r in got) == 4 and sum(r["area"] or 0 for r in got) == 66


def test_perimeter_function_by_name(spark):
    boxes = spark.createDataFrame([(1, 5, 6, 7, 8), (1, 0, 0, 1, 1), (2, -3, 4, 30, 2)], "image_id long, x int, y int, w int, h int")
    key = lambda df: sorted(map(tuple, df.select("image_id", "fx", "fy", "fw", "fh", "side", "k", "y", "x").collect()))
    assert key(C.perimeter_lateral(boxes, 2, 3)) == key(C.perimeter(boxes, 2, 3))
    assert spark.sql("SELECT count(*) FROM perimeter_samples(0, 0, 10, 20, 2, 10)").first()[0] == 6
    assert spark.sql("SELECT count(*) FROM perimeter_samples(CAST(NULL AS INT), 0, 10, 20, 2, 10)").first()[0] == 0
