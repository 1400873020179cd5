"""Keys of a session to what they do, by the settings in force at their time, and saves to files.

A key event matches an action if its code is the action's and its modifiers, apart from those that
don't count, are exactly the action's. Escape always dismisses; else the first match in a fixed order
counts. Settings change in time: each user's binding of an action holds from its row until the next one
of that user and action, and before the first row the default holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pageloom.functions.text import capture_name

# Modifier bits (shift, control, option, command), the escape key, the order in which actions are tried, and default bindings (key code, modifiers).
MASK = 1 << 17 | 1 << 18 | 1 << 19 | 1 << 20
ESCAPE = 53
ORDER = ("dismiss", "save", "copy", "preview", "toggle_autocluster", "toggle_flow")
DEFAULTS = {"dismiss": (12, 0), "save": (1, 0), "copy": (8, 0), "preview": (9, 0), "toggle_autocluster": (0, 0), "toggle_flow": (3, 0)}
#: Up to so many bindings are sent to all executors; beyond, keys of a user are dealt to so many parts, so that a busy user is no single task.
SENT, PARTS = 1 << 18, 16


def bindings(settings: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, place (in ORDER), key_code, mods, since, until (null: still) of every binding of ``settings(user_id, ts, action, key_code, mods)`` and of the defaults of ``users(user_id)``.

    Of several rows of one user, action and time the one with the largest key code and modifiers holds.
    """
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("action")).cast("int")
    known = settings.select("user_id", place.alias("place"), "ts", F.struct("key_code", "mods").alias("b")).where("place > 0 and ts is not null")
    known = known.groupBy("user_id", "place", "ts").agg(F.max("b").alias("b"))
    start = F.array(*(F.struct(F.lit(k + 1).alias("place"), F.lit(DEFAULTS[a][0]).alias("key_code"), F.lit(DEFAULTS[a][1]).cast("long").alias("mods")) for k, a in enumerate(ORDER)))
    default = users.select("user_id").distinct().select("user_id", F.explode(start).alias("d")).select("user_id", "d.place", F.expr("timestamp'0001-01-01 00:00:00'").alias("ts"), F.struct("d.key_code", "d.mods").alias("b"))
    every = default.unionByName(known.select("user_id", "place", "ts", F.struct(F.col("b.key_code").cast("int").alias("key_code"), F.col("b.mods").cast("long").alias("mods")).alias("b")))
    until = F.lead("ts").over(Window.partitionBy("user_id", "place").orderBy("ts"))
    return every.select("user_id", "place", "b.key_code", "b.mods", F.col("ts").alias("since"), until.alias("until"))


def dispatch(keys: DataFrame, settings: DataFrame) -> DataFrame:
    """``keys(user_id, event_id, ts, key_code, flags, ...)`` with kind: what the key does, null if nothing. event_id tells keys apart."""
    held = bindings(settings, keys)
    asked = keys.select("user_id", "event_id", "ts", "key_code", F.col("flags").bitwiseAND(F.lit(MASK)).cast("long").alias("mods"))
    on = ["user_id", "key_code", "mods"]
    if held.count() <= SENT:
        held = F.broadcast(held)
    else:
        held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        asked, on = asked.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(PARTS)).cast("int")), [*on, "part"]
    met = asked.join(held, on).where("ts >= since and (until is null or ts < until)")
    first = met.groupBy("event_id").agg(F.min("place").alias("place"))
    kind = F.when(F.col("key_code") == ESCAPE, "dismiss").when(F.col("place").isNotNull(), F.expr(f"element_at(array({', '.join(map(repr, ORDER))}), place)"))
    return keys.join(first, "event_id", "left").withColumn("kind", kind).drop("place")


def save_files(changes: DataFrame, events: DataFrame) -> DataFrame:
    """A named rectangle for each save (and preview, which saves first) of ``changes`` (sessions.OUT): event_id, image_id, name, left, top, right, bottom in the view's units.

    ``events(event_id, image_id, ts)`` gives the frame and the time, which is the file's name.
    """
    side = lambda k: f"cast(split(rect, ',')[{k}] as int)"
    taken = changes.where("kind in ('save', 'preview') and rect <> ''").select("event_id", F.expr(side(0)).alias("left"), F.expr(side(1)).alias("top"), F.expr(f"{side(0)} + {side(2)}").alias("right"), F.expr(f"{side(1)} + {side(3)}").alias("bottom"))
    return taken.join(events.select("event_id", "image_id", capture_name(F.col("ts")).alias("name")), "event_id").select("event_id", "image_id", "name", "left", "top", "right", "bottom")
