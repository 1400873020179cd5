"""Layout tables derived from the star-schema tables by integer arithmetic, in DataFrame form and as SQL for the oracle.

Everything is keyed by image_id. pixels: mosaics of 64 x 64; boxes: three colour
groups of an image 1200 x 800, some oversized, most tagged as words on lines of 20
pixels; words: document text laid out on a character grid; pointer events: the event
stream as moves, clicks and keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v, r, g, b"""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    e = e.select(
        F.expr("vec_id div 64").alias("image_id"),
        F.expr("cast(((vec_id % 64) div 8) * 8 + p div 8 as int)").alias("y"),
        F.expr("cast((vec_id % 8) * 8 + p % 8 as int)").alias("x"),
        F.expr("cast(least(255, greatest(0, floor((cast(e as double) + 0.5) * 255))) as int)").alias("v"),
    )
    return e.select("*", F.col("v").alias("r"), F.expr("(3 * v + 17 * x) % 256").alias("g"), F.expr("(5 * v + 29 * y) % 256").alias("b"))


PIXELS_SQL = """pixels AS (SELECT *, v AS r, (3 * v + 17 * x) % 256 AS g, (5 * v + 29 * y) % 256 AS b FROM (
  SELECT vec_id // 64 AS image_id, CAST(((vec_id % 64) // 8) * 8 + p // 8 AS INT) AS y, CAST((vec_id % 8) * 8 + p % 8 AS INT) AS x,
    CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.5) * 255))) AS INT) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)))"""

_BOX = """SELECT DISTINCT l_orderkey {div} 30 AS image_id, CAST((7 * l_partkey) % 1200 AS INT) AS x, CAST((13 * l_suppkey + 97 * l_linenumber + l_partkey) % 800 AS INT) AS y,
  CAST(CASE WHEN l_partkey % 40 = 0 THEN 120 + l_suppkey % 100 ELSE 8 + l_quantity END AS INT) AS w,
  CAST(CASE WHEN l_partkey % 40 = 0 THEN 90 + l_suppkey % 60 ELSE 10 + l_partkey % 5 END AS INT) AS h, CAST(l_partkey % 3 AS INT) AS sea FROM lineitem"""
_TAGGED = "SELECT *, (w < 100 AND (x + y) % 5 <> 0) AS is_word, CASE WHEN w < 100 AND (x + y) % 5 <> 0 THEN y {div} 20 END AS line_id FROM ({box}) boxes0"
BOXES_SQL = "boxes AS (" + _TAGGED.format(div="//", box=_BOX.format(div="//")) + ")"


def boxes(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """image_id, x, y, w, h, sea, is_word, line_id; not distinct, as they are read: for those who make them distinct image by image."""
    text = _TAGGED.format(div="div", box=_BOX.format(div="div").replace("FROM lineitem", "FROM {lineitem}"))
    return spark.sql(text if distinct else text.replace("SELECT DISTINCT", "SELECT"), lineitem=table(spark, sf_dir, "lineitem"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, line_id, word_idx, text, x, y, w, h: every document's text, tokens of single spaces on lines."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "\n")).alias("line_id", "line"))
    tokens = lines.select("image_id", "line_id", F.posexplode(F.split("line", " ")).alias("word_idx", "text"), "line")
    start = F.expr("length(text) * 0 + word_idx + coalesce(aggregate(transform(slice(split(line, ' '), 1, word_idx), t -> length(t)), 0, (s, t) -> s + t), 0)")
    return tokens.select("image_id", "line_id", "word_idx", "text", (start * 8).cast("int").alias("x"), (F.col("line_id") * 20).alias("y"), (F.length("text") * 8).alias("w"), F.lit(14).alias("h")).where("text <> ''")


_KIND = """case event_type when 'view' then case event_id % 5 when 3 then 'press' when 4 then 'release' else 'move' end
  when 'click' then 'click' when 'purchase' then 'save'
  when 'signup' then case event_id % 2 when 0 then 'toggle_autocluster' else 'toggle_flow' end else 'dismiss' end"""


def pointer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, event_id, ts, kind, px, py"""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("session_id"),
        "event_id",
        "ts",
        F.expr(_KIND).alias("kind"),
        F.expr("cast((37 * event_id + 53 * user_id) % 1200 as int)").alias("px"),
        F.expr("cast((91 * event_id) % 800 as int)").alias("py"),
    )


EVENTS_SQL = f"""pointer AS (SELECT user_id AS session_id, event_id, ts, {_KIND} AS kind,
  CAST((37 * event_id + 53 * user_id) % 1200 AS INT) AS px, CAST((91 * event_id) % 800 AS INT) AS py FROM events)"""

#: Purchases, signups and errors are keys: the code is one of those that actions have or have had, modifiers come with bits that don't count.
_KEY = "SELECT user_id, event_id, ts, CAST((ARRAY[0, 1, 3, 8, 9, 12, 53, 40])[1 + (event_id * 5) % 8] AS INT) AS key_code, CAST((event_id % 3 = 0)::INT * 131072 + (event_id % 5 = 0)::INT * 256 AS BIGINT) AS flags FROM events WHERE event_type IN ('purchase', 'signup', 'error')"
#: Every fourth click is also a change of that user's settings: an action gets a key.
_SETTING = "SELECT user_id, ts, (ARRAY['dismiss', 'save', 'copy', 'preview', 'toggle_autocluster', 'toggle_flow', 'unknown'])[1 + event_id % 7] AS action, CAST((ARRAY[0, 1, 3, 8, 9, 12, 53, 40])[1 + event_id % 8] AS INT) AS key_code, CAST((event_id % 2) * 131072 AS BIGINT) AS mods FROM events WHERE event_type = 'click' AND event_id % 4 = 0"
KEYS_SQL = f"keys AS ({_KEY}), settings AS ({_SETTING})"


def key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, ts, key_code, flags"""
    codes = "element_at(array(0, 1, 3, 8, 9, 12, 53, 40), cast(1 + (event_id * 5) % 8 as int))"
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'signup', 'error')")
    return e.select("user_id", "event_id", "ts", F.expr(codes).alias("key_code"), F.expr("cast(if(event_id % 3 = 0, 131072, 0) + if(event_id % 5 = 0, 256, 0) as bigint)").alias("flags"))


def key_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ts, action, key_code, mods"""
    actions = "element_at(array('dismiss', 'save', 'copy', 'preview', 'toggle_autocluster', 'toggle_flow', 'unknown'), cast(1 + event_id % 7 as int))"
    codes = "element_at(array(0, 1, 3, 8, 9, 12, 53, 40), cast(1 + event_id % 8 as int))"
    e = table(spark, sf_dir, "events").where("event_type = 'click' and event_id % 4 = 0")
    return e.select("user_id", "ts", F.expr(actions).alias("action"), F.expr(codes).alias("key_code"), F.expr("cast(event_id % 2 * 131072 as bigint)").alias("mods"))


#: Bunches of boxes around a place of each order: a tiny word between two wide ones, or a box with four small words and a large box.
_BUNCH = """SELECT DISTINCT image_id, CAST(cx + dx AS INT) AS x, CAST(cy + dy AS INT) AS y, w, h, sea, is_word, CASE WHEN is_word THEN CAST(cy + dy AS INT) {div} 20 END AS line_id
  FROM (SELECT o_orderkey {div} 40 AS image_id, (97 * o_orderkey) % 1000 + 80 AS cx, (61 * o_orderkey) % 700 + 40 AS cy, CAST(o_orderkey % 3 AS INT) AS sea, o_orderkey % 2 AS kind FROM {orders}) places
  JOIN (VALUES (0, 0, 0, 6, 8, true), (0, -59, 0, 55, 14, true), (0, 10, 0, 55, 14, true), (1, 0, 0, 60, 20, false), (1, 0, -14, 10, 10, true), (1, 15, -14, 10, 10, true),
    (1, 30, -14, 10, 10, true), (1, 45, -14, 10, 10, true), (1, 0, 24, 100, 30, false)) AS parts(part, dx, dy, w, h, is_word) ON kind = part"""
BUNCHES_SQL = "boxes AS (" + _BUNCH.format(div="//", orders="orders") + ")"


def bunches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``boxes``."""
    return spark.sql(_BUNCH.format(div="div", orders="{orders}"), orders=table(spark, sf_dir, "orders"))


_GAPPED = "SELECT DISTINCT image_id {div} 10 AS image_id, x, CAST(y + 40 * ((y {div} 20) {div} 4) AS INT) AS y, w, h, sea, is_word, 2 * line_id + x {div} 600 AS line_id FROM {boxes}"
GAPPED_SQL = BOXES_SQL.replace("boxes AS (", "boxes1 AS (") + ", boxes AS (" + _GAPPED.format(div="//", boxes="boxes1") + ")"


def gapped_boxes(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """``boxes`` of ten images on one, with a gap of 40 pixels after every fourth line, and lines in two columns, so that they form several paragraphs."""
    text = _GAPPED.format(div="div", boxes="{boxes}")
    return spark.sql(text if distinct else text.replace("SELECT DISTINCT", "SELECT"), boxes=boxes(spark, sf_dir, distinct))
