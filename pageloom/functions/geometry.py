"""Box geometry as SQL expression text over prefixed columns x, y, w, h; right and bottom are exclusive.

Each function takes the prefixes of one or two boxes ("a_", "b_") and returns an
expression that both Spark SQL and other SQL engines read. Sizes are integers,
products are widened to 64 bits.
"""

from __future__ import annotations


def right(a: str) -> str:
    return f"({a}x + {a}w)"


def bottom(a: str) -> str:
    return f"({a}y + {a}h)"


def area(a: str) -> str:
    return f"(CAST({a}w AS BIGINT) * {a}h)"


def contains(a: str, b: str) -> str:
    return f"({a}x <= {b}x AND {right(a)} >= {right(b)} AND {a}y <= {b}y AND {bottom(a)} >= {bottom(b)})"


def overlaps(a: str, b: str) -> str:
    """Closed intervals: boxes that touch overlap."""
    return f"NOT ({right(a)} < {b}x OR {a}x > {right(b)} OR {bottom(a)} < {b}y OR {a}y > {bottom(b)})"


def x_overlap(a: str, b: str) -> str:
    return f"(least({right(a)}, {right(b)}) - greatest({a}x, {b}x))"


def y_overlap(a: str, b: str) -> str:
    return f"(least({bottom(a)}, {bottom(b)}) - greatest({a}y, {b}y))"


def overlap(a: str, b: str) -> str:
    return f"CAST(CAST(greatest(0, {x_overlap(a, b)}) AS BIGINT) * greatest(0, {y_overlap(a, b)}) AS DOUBLE)"


def gap2(a: str, b: str) -> str:
    """Squared distance between the edges."""
    dx, dy = (f"CAST(greatest(0, -{f(a, b)}) AS DOUBLE)" for f in (x_overlap, y_overlap))
    return f"({dx} * {dx} + {dy} * {dy})"


def edge_distance(a: str, b: str) -> str:
    return f"sqrt({gap2(a, b)})"


def alignment(a: str, b: str, margin: str) -> str:
    """Share of b's width or height covered by a's shadow; relative to b, so not symmetric."""
    wide = f"least((greatest(0, {x_overlap(a, b)}) + {margin}) / {b}w, 1.0e0) * least(({a}h + {margin}) / {b}h, 1.0e0)"
    high = f"least((greatest(0, {y_overlap(a, b)}) + {margin}) / {b}h, 1.0e0) * least(({a}w + {margin}) / {b}w, 1.0e0)"
    return f"greatest({wide}, {high})"


def nearness(edge: str, distance: str) -> str:
    """1 up to one distance between the edges, falling to 0 at three."""
    return f"least(1.0e0, greatest(0.0e0, ({distance} * 3 - {edge}) / {distance} / 2))"


def closeness(a: str, b: str, edge: str, distance: str) -> str:
    return f"(least(1.0e0, {distance} / greatest(1.0e0, {edge}) / 2) * least({area(a)} * 5.0e0 / {area(b)}, 1.0e0))"


def shrinkage(a: str, b: str, distance: str) -> str:
    """Below 1 where even the smallest side is long for the distance."""
    return f"least(1.0e0, {distance} * 8 / greatest(1.0e0, CAST(least({a}w, {a}h, {b}w, {b}h) AS DOUBLE)))"


def connection(a: str, b: str, distance: str, edge: str | None = None, close: str | None = None, align: str | None = None, near: str | None = None, shrink: str | None = None) -> str:
    """Likeliness that a connects to b, 0 to 1; 0 where one holds the other and where the distance is 0 or less. Parts that are known may be columns."""
    edge = edge or edge_distance(a, b)
    close = close or closeness(a, b, edge, distance)
    score = f"({close} + (1 - {close}) * {align or alignment(a, b, distance)})"
    shrink = shrink or shrinkage(a, b, distance)
    return f"CASE WHEN {distance} <= 0 OR {contains(a, b)} OR {contains(b, a)} THEN 0.0e0 ELSE {near or nearness(edge, distance)} * {score} * {shrink} * {shrink} END"


def point_gap2(p: str, a: str) -> str:
    """Squared distance of a point px, py to a box; inside, to its nearest side."""
    inside = f"({p}px >= {a}x AND {p}px <= {right(a)} AND {p}py >= {a}y AND {p}py <= {bottom(a)})"
    side = f"least({p}px - {a}x, {right(a)} - {p}px, {p}py - {a}y, {bottom(a)} - {p}py)"
    dx, dy = f"greatest({a}x - {p}px, 0, {p}px - {right(a)})", f"greatest({a}y - {p}py, 0, {p}py - {bottom(a)})"
    return f"CASE WHEN {inside} THEN CAST({side} AS BIGINT) * {side} ELSE CAST({dx} AS BIGINT) * {dx} + CAST({dy} AS BIGINT) * {dy} END"


def segment(a: str, b: str) -> dict[str, str]:
    """Ends x0, y0 (at a) and x1, y1 (at b) of the shortest segment between two boxes."""
    out = {}
    for axis, size, k in (("x", "w", "x"), ("y", "h", "y")):
        ea, eb = f"({a}{axis} + {a}{size})", f"({b}{axis} + {b}{size})"
        middle = f"(greatest({a}{axis}, {b}{axis}) + least({ea}, {eb})) / 2.0e0"
        out[f"{k}0"] = f"CAST(CASE WHEN {ea} <= {b}{axis} THEN {ea} WHEN {eb} <= {a}{axis} THEN {a}{axis} ELSE {middle} END AS DOUBLE)"
        out[f"{k}1"] = f"CAST(CASE WHEN {ea} <= {b}{axis} THEN {b}{axis} WHEN {eb} <= {a}{axis} THEN {eb} ELSE {middle} END AS DOUBLE)"
    return out


def crosses(c: str) -> str:
    """A segment x0, y0, x1, y1 passes through a box's interior: the slabs' parameter ranges meet in more than a point."""
    low, high, clear = ["CAST(0 AS DOUBLE)"], ["CAST(1 AS DOUBLE)"], []
    for v, from_, to in (("x", f"{c}x", right(c)), ("y", f"{c}y", bottom(c))):
        d, t0, t1 = f"({v}1 - {v}0)", f"({from_} - {v}0)", f"({to} - {v}0)"
        low.append(f"CASE WHEN {d} = 0 THEN 0.0e0 ELSE least({t0} / nullif({d}, 0), {t1} / nullif({d}, 0)) END")
        high.append(f"CASE WHEN {d} = 0 THEN 1.0e0 ELSE greatest({t0} / nullif({d}, 0), {t1} / nullif({d}, 0)) END")
        clear.append(f"({d} <> 0 OR ({v}0 >= {from_} AND {v}0 <= {to}))")
    return f"({' AND '.join(clear)} AND greatest({', '.join(low)}) < least({', '.join(high)}))"


def quad_box(xs: list[str], ys: list[str], width: str, height: str) -> dict[str, str]:
    """The box of pixels around corners that are shares of a frame, counted from its lower left: flipped, rounded, at least one pixel wide and high, its start inside the frame."""
    low = lambda v: f"least({', '.join(v)})"
    high = lambda v: f"greatest({', '.join(v)})"
    whole = lambda v: f"CAST(round({v}) AS INT)"
    left, right_ = whole(f"{low(xs)} * {width}"), whole(f"{high(xs)} * {width}")
    top, bottom_ = whole(f"(1 - {high(ys)}) * {height}"), whole(f"(1 - {low(ys)}) * {height}")
    return {"x": f"greatest(0, {left})", "y": f"greatest(0, {top})", "w": f"greatest(1, {right_} - {left})", "h": f"greatest(1, {bottom_} - {top})"}


def expanded(by: int, a: str = "") -> dict[str, str]:
    """A box grown by so many pixels on all sides."""
    return {"x": f"{a}x - {by}", "y": f"{a}y - {by}", "w": f"{a}w + {2 * by}", "h": f"{a}h + {2 * by}"}


def scaled(sx: str, sy: str, a: str = "") -> dict[str, str]:
    """A box in another unit; fractions are cut off."""
    return {k: f"CAST({a}{k} * {s} AS INT)" for k, s in (("x", sx), ("y", sy), ("w", sx), ("h", sy))}


def kernel_size(size: int, height: str, up: bool = False) -> str:
    """A size tuned at 1964 rows, for frames of so many rows: at least 1, rounded down or up."""
    return f"greatest(1, CAST({'ceil' if up else 'floor'}({size} * {height} / 1964.0e0) AS INT))"
