"""Pointer sessions: one state machine for streams and for replays of a table.

State of a session: hovered box and what it leads to, selected boxes, flow and autocluster
modes, the press and whether it became a drag, and the drawn rectangle. Boxes and clusters
of the session's image are looked up before (``nearest``, ``containing``, ``clusters``), so
state stays small.

Events: move, press, release, click (press and release on one spot), toggle_autocluster,
toggle_flow, dismiss, save, copy, preview; other kinds change nothing. A move between press and release
draws. Keys become such events in ``streaming.keys``.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from pageloom.runtime import ship

#: Pixels that the pointer moves before a press is a drag; squared reach of flow mode.
DRAG, FLOW_REACH = 6, 225
OUT = "session_id long, event_id long, kind string, hovered string, selected string, rect string"
STATE = "hovered string, members string, selected string, flow boolean, auto boolean, rect string, anchor string, dragging boolean"
TAKES = ("save", "copy", "preview")
START = ("", "", "", False, False, "", "", False)


def step(state: tuple, event: dict) -> tuple[tuple, bool]:
    """The state after one event, and whether the selection changed. Boxes are texts "x,y,w,h"; lists are joined by ";"."""
    hovered, members, selected, flow, auto, rect, anchor, dragging = state
    kind, chosen = event["kind"], selected.split(";") if selected else []
    if kind == "move" and anchor:
        x, y = map(int, anchor.split(","))
        dx, dy = abs(event["px"] - x), abs(event["py"] - y)
        if not dragging and (dx > DRAG or dy > DRAG):
            dragging, hovered, members, selected = True, "", "", ""
        if dragging:
            rect = f"{min(x, event['px'])},{min(y, event['py'])},{dx},{dy}"
    elif kind == "move" and rect:
        # a drawn rectangle stays until the pointer is inside a box
        if event["inside"]:
            rect, hovered, members = "", event["inside"], event["inside_cluster"] or event["inside"]
            selected = members if auto and not flow else hovered
    elif kind == "move":
        near = "" if flow and event["gap2"] is not None and event["gap2"] >= FLOW_REACH else event["box"] or ""
        if near and near != hovered:
            hovered, members = near, event["cluster"] or near
            if flow:
                selected = ";".join(chosen if near in chosen else [*chosen, near])
            else:
                selected = members if auto else near
    elif kind == "press":
        anchor, dragging = f"{event['px']},{event['py']}", False
    elif kind == "click" or kind == "release" and not dragging:
        anchor, dragging, rect = "", False, ""
        if hovered:
            chosen = [b for b in chosen if b != hovered] if hovered in chosen else [*chosen, hovered]
            selected = ";".join(b for b in chosen if not any(o != b and _holds(o, b) for o in chosen))
    elif kind == "release":
        anchor, dragging = "", False
    elif kind in ("toggle_autocluster", "toggle_flow"):
        auto, flow = auto != (kind == "toggle_autocluster"), flow != (kind == "toggle_flow")
        selected = members if auto else hovered
    elif kind == "dismiss":
        return START, bool(selected or rect)
    return (hovered, members, selected, flow, auto, rect, anchor, dragging), (selected, rect) != (state[2], state[5])


@dataclass(frozen=True)
class View:
    """Padding around selected boxes, and the view's size, which what is saved stays inside."""

    padding: int = 8
    width: int = 1200
    height: int = 800


def saved_rect(state: tuple, view: View) -> str:
    """What a save would cut out, as text: the drawn rectangle as it is, else the selected boxes' padded extent; empty without a selection."""
    selected, rect = state[2], state[5]
    if rect:
        (x, y, w, h), pad = map(int, rect.split(",")), 0
        x1, y1 = x + w, y + h
    elif selected:
        boxes, pad = [tuple(map(int, b.split(","))) for b in selected.split(";")], view.padding
        x, y, x1, y1 = min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[0] + b[2] for b in boxes), max(b[1] + b[3] for b in boxes)
    else:
        return ""
    left, top = max(0, x - pad), max(0, y - pad)
    return f"{left},{top},{min(view.width, x1 + pad) - left},{min(view.height, y1 + pad) - top}"


def play(state: tuple, event: dict, view: View = View()) -> tuple[tuple, dict | None]:
    """The state after an event, and its row: a change of the selection, or for save, copy and preview with a selection what they take. A preview ends the session as a dismissal does."""
    made = {"session_id": event["session_id"], "event_id": event["event_id"], "kind": event["kind"]}
    if event["kind"] in TAKES:
        rect = saved_rect(state, view)
        row = made | {"hovered": state[0], "selected": state[2], "rect": rect} if rect else None
        return (START if rect and event["kind"] == "preview" else state), row
    state, changed = step(state, event)
    return state, made | {"hovered": state[0], "selected": state[2], "rect": state[5]} if changed else None


def _holds(a: str, b: str) -> bool:
    ax, ay, aw, ah = map(int, a.split(","))
    bx, by, bw, bh = map(int, b.split(","))
    return ax <= bx and ay <= by and ax + aw >= bx + bw and ay + ah >= by + bh


def _advance(state: tuple, events: pd.DataFrame, view: View) -> list[dict]:
    rows = []
    events = events.astype(object).where(events.notna(), None)
    for event in events.sort_values(["ts", "event_id"]).to_dict("records"):
        state, row = play(state, event, view)
        rows += [row] if row else []
    return rows


#: What ``step`` reads of an event.
WAITS = {"kind": "string", "px": "int", "py": "int", "box": "string", "gap2": "double", "inside": "string", "cluster": "string", "inside_cluster": "string"}
COLUMNS = ("session_id", "event_id", "ts", "kind", "px", "py", "box", "gap2", "inside", "cluster", "inside_cluster")


def resolved(events: DataFrame, near: DataFrame, inside: DataFrame, clusters: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Events with what ``step`` reads: box and gap2 (nearest), inside (containing), and the clusters of both, by image
    (the two tables of ``network.clusters``; without, each box is alone)."""
    text = lambda b: F.concat_ws(",", *(F.col(f"{b}{k}") for k in ("x", "y", "w", "h")))
    out = events.join(near.select("event_id", "gap2", text("").alias("box")), "event_id", "left").join(inside.select("event_id", text("").alias("inside")), "event_id", "left")
    if clusters is None:
        return out.select("*", F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("string").alias("inside_cluster"))
    members = F.concat_ws(";", F.transform("members", lambda m: F.concat_ws(",", *(m[k] for k in ("x", "y", "w", "h")))))
    of, held = clusters
    found = of.join(held.select("cluster", members.alias("members")), "cluster").select("image_id", text("box.").alias("box"), F.col("members").alias("cluster"))
    return out.join(found, ["image_id", "box"], "left").join(found.withColumnsRenamed({"box": "inside", "cluster": "inside_cluster"}), ["image_id", "inside"], "left")


def replay(events: DataFrame, view: View = View()) -> DataFrame:
    """Changes of selection, and what is saved, copied and previewed, of a table of resolved events, session by session."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_advance(START, pdf, view), columns=["session_id", "event_id", "kind", "hovered", "selected", "rect"])

    ship(events.sparkSession)
    return events.select(*COLUMNS).groupBy("session_id").applyInPandas(run, OUT)


class Sessions(StatefulProcessor):
    """A session a key: its state, and the events that wait until no earlier one can come.

    An event waits until the watermark has reached its time; then the timer of that time plays all
    events that are due, in order of time and id, so batches and their order don't matter. Events of
    one id and time count once. The state goes when the watermark is ``idle_ms`` beyond the last event.
    """

    def __init__(self, idle_ms: int, view: View):
        self.idle_ms, self.view = idle_ms, view

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.last = handle.getValueState("last", "ms long")
        self.waiting = handle.getMapState("waiting", "us long, event_id long", ", ".join(f"{c} {t}" for c, t in WAITS.items()))

    def handleInputRows(self, key, rows, timerValues):
        for row in rows:
            us = _micros(row["ts"])
            self.waiting.updateValue((us, row["event_id"]), tuple(row[c] for c in WAITS))
            self.handle.registerTimer(-(-us // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= 1000 * now)
        if not due:
            if self.last.exists() and self.last.get()[0] + self.idle_ms <= now and not any(True for _ in self.waiting.keys()):
                self.state.clear()
                self.last.clear()
            return
        state = tuple(self.state.get()) if self.state.exists() else START
        out = []
        for (us, event_id), values in due:
            self.waiting.removeKey((us, event_id))
            state, row = play(state, dict(zip(WAITS, values)) | {"session_id": key[0], "event_id": event_id}, self.view)
            out += [Row(**row)] if row else []
        self.state.update(state)
        self.last.update((due[-1][0][0] // 1000,))
        self.handle.registerTimer(due[-1][0][0] // 1000 + self.idle_ms)
        yield from out


def _micros(ts) -> int:
    return int(ts.replace(microsecond=0).timestamp()) * 1_000_000 + ts.microsecond


def stream(events: DataFrame, watermark: str = "10 minutes", idle_ms: int = 3_600_000, view: View = View()) -> DataFrame:
    """The same over a stream, in order of event time across batches: an event is played when the watermark reaches its time, and
    one that comes later than the watermark is dropped. Needs the RocksDB state store (``use_rocksdb``)."""
    ship(events.sparkSession)
    slim = events.select(*COLUMNS).withWatermark("ts", watermark)
    return slim.groupBy("session_id").transformWithState(Sessions(idle_ms, view), OUT, "append", "eventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """State variables and timers need this state store; it also keeps state outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
