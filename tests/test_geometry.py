"""Geometry and colour formulas against plain versions found another way: counted places, sampled segments, exact fractions, arrays of colour."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from pageloom.functions import geometry as G
from pageloom.operators import network as N, pixels as P

D = 7.0


def places(b):
    """Unit squares of a box."""
    x, y, w, h = b
    return set(itertools.product(range(x, x + w), range(y, y + h)))


def corners(b):
    """All lattice points of a closed box."""
    x, y, w, h = b
    return itertools.product(range(x, x + w + 1), range(y, y + h + 1))


def near(a, b):
    """Least distance between two closed boxes, over lattice points of their borders' coordinates."""
    return min(math.dist(p, q) for p in corners(a) for q in corners(b))


def shadow(a, b, axis):
    return len(set(range(a[axis], a[axis] + a[axis + 2])) & set(range(b[axis], b[axis] + b[axis + 2])))


def aligned(a, b):
    rows, columns = shadow(a, b, 1), shadow(a, b, 0)
    part = lambda share, size: min((share + D) / size, 1.0)
    return max(part(columns, b[2]) * part(a[3], b[3]), part(rows, b[3]) * part(a[2], b[2]))


def connected(a, b):
    if places(a) <= places(b) or places(b) <= places(a):
        return 0.0
    gap, small = near(a, b), min(*a[2:], *b[2:])
    close = min(1.0, D / max(1.0, gap) / 2) * min(5 * len(places(a)) / len(places(b)), 1.0)
    return min(1.0, max(0.0, (3 * D - gap) / D / 2)) * (close + (1 - close) * aligned(a, b)) * min(1.0, 8 * D / max(1.0, small)) ** 2


def between(a, b):
    """The shortest segment, an axis at a time: the gap's two ends, or twice the middle of what both cover."""
    ends = []
    for k in (0, 1):
        (p, q), (r, s) = (a[k], a[k] + a[k + 2]), (b[k], b[k] + b[k + 2])
        ends.append((q, r) if q <= r else (p, s) if s <= p else (Fraction(sum(sorted((p, q, r, s))[1:3]), 2),) * 2)
    (x0, x1), (y0, y1) = ends
    return x0, y0, x1, y1


def passes(segment, c):
    """Some open stretch of the segment lies in the closed box: exact, over the parameters at which it meets a side's line."""
    x0, y0, x1, y1 = map(Fraction, segment)
    cuts = {Fraction(0), Fraction(1)}
    for low, high, p, q in ((c[0], c[0] + c[2], x0, x1), (c[1], c[1] + c[3], y0, y1)):
        if p != q:
            cuts |= {t for side in (low, high) if 0 <= (t := (side - p) / (q - p)) <= 1}
    cuts = sorted(cuts)
    for s, t in zip(cuts, cuts[1:]):
        x, y = x0 + (s + t) / 2 * (x1 - x0), y0 + (s + t) / 2 * (y1 - y0)
        if c[0] <= x <= c[0] + c[2] and c[1] <= y <= c[1] + c[3]:
            return True
    return False


@pytest.fixture(scope="module")
def pairs():
    rnd = random.Random(12)
    some = lambda: (rnd.randint(-3, 14), rnd.randint(0, 14), rnd.choice([1, 2, 5, 9]), rnd.choice([1, 3, 4, 8]))
    return [(some(), some(), some()) for _ in range(400)]


def frame(spark, pairs):
    names = [f"{p}_{k}" for p in "abc" for k in "xywh"]
    return spark.createDataFrame([(i, *itertools.chain(*t)) for i, t in enumerate(pairs)], "i long, " + ", ".join(f"{n} int" for n in names))


def test_two_boxes(spark, pairs):
    d = N.real(D)
    columns = {
        "area": G.area("a_"), "contains": G.contains("a_", "b_"), "overlaps": G.overlaps("a_", "b_"), "overlap": G.overlap("a_", "b_"), "gap": G.edge_distance("a_", "b_"),
        "align": G.alignment("a_", "b_", d), "connect": G.connection("a_", "b_", d), **G.segment("a_", "b_"),
    }
    got = frame(spark, pairs).selectExpr("i", *(f"{e} AS {k}" for k, e in columns.items())).collect()
    for row in got:
        a, b, _ = pairs[row["i"]]
        assert row["area"] == len(places(a)) and row["contains"] == (places(b) <= places(a)), (a, b)
        assert row["overlap"] == len(places(a) & places(b)) and row["overlaps"] == bool({*corners(a)} & {*corners(b)}), (a, b)
        assert row["gap"] == pytest.approx(near(a, b)) and row["align"] == pytest.approx(aligned(a, b)), (a, b)
        assert row["connect"] == pytest.approx(connected(a, b)), (a, b)
        assert tuple(row[k] for k in ("x0", "y0", "x1", "y1")) == tuple(map(float, between(a, b))), (a, b)
    assert sum(r["connect"] > 0.5 for r in got) > 20 and sum(r["contains"] for r in got) > 3


def test_crossing(spark, pairs):
    seg = G.segment("a_", "b_")
    got = frame(spark, pairs).selectExpr("*", *(f"{e} AS {k}" for k, e in seg.items())).where("x0 <> x1 OR y0 <> y1").selectExpr("i", f"{G.crosses('c_')} AS hit").collect()
    assert {r["i"]: r["hit"] for r in got} == {r["i"]: passes(between(*pairs[r["i"]][:2]), pairs[r["i"]][2]) for r in got}
    assert 20 < sum(r["hit"] for r in got) < len(got) - 20


def test_point(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(-5, 15), rnd.randint(-5, 15), rnd.randint(-2, 8), rnd.randint(-2, 8), rnd.randint(1, 8), rnd.randint(1, 8)) for _ in range(300)]
    got = spark.createDataFrame(rows, "px int, py int, x int, y int, w int, h int").selectExpr("px", "py", "x", "y", "w", "h", f"{G.point_gap2('', '')} AS g").collect()
    for px, py, x, y, w, h, g in got:
        border = [(u, v) for u, v in corners((x, y, w, h)) if u in (x, x + w) or v in (y, y + h)]
        assert g == min((px - u) ** 2 + (py - v) ** 2 for u, v in border)


def test_sizes(spark):
    got = spark.range(0, 4000, 7).selectExpr("id", *(f"{e} AS {k}" for k, e in {"a": G.kernel_size(8, "id"), "b": G.kernel_size(2, "id", up=True)}.items())).collect()
    assert all(r["a"] == max(1, 8 * r["id"] // 1964) and r["b"] == max(1, -(-2 * r["id"] // 1964)) for r in got)
    one = spark.sql("SELECT 5 AS x, -7 AS y, 9 AS w, 2 AS h").selectExpr(*G.expanded(3).values(), *G.scaled("0.5D", "1.5D").values()).first()
    assert tuple(one) == (2, -10, 15, 8, 2, -10, 4, 3)


def test_lab(spark):
    """White, black and greys are known; for the rest, XYZ by a matrix and the cube root's inverse."""
    rgb = np.array([(255, 255, 255), (0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255), *np.random.default_rng(2).integers(0, 256, (500, 3)).tolist()])
    rows = spark.createDataFrame([(1, 0, k, *map(int, v)) for k, v in enumerate(rgb)], "image_id long, y int, x int, r int, g int, b int")
    got = P.to_lab(rows).toPandas().sort_values("x")[["lab_l", "lab_a", "lab_b"]].to_numpy()
    assert got[:5].tolist() == [[255, 128, 128], [0, 128, 128], [136, 208, 195], [224, 42, 211], [82, 207, 20]]
    # back from lightness and opponents to linear light, within what rounding allows
    l, a, b = got[:, 0] * 100 / 255, got[:, 1] - 128.0, got[:, 2] - 128.0
    fy = (l + 16) / 116
    light = lambda f: np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29))
    xyz = np.stack([0.95047 * light(fy + a / 500), light(fy), 1.08883 * light(fy - b / 200)])
    linear = np.linalg.inv([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]) @ xyz
    back = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * np.maximum(linear, 0.0031308) ** (1 / 2.4) - 0.055).T * 255
    # a dark channel beside bright ones is lost in the rounding of the others
    assert np.quantile(np.abs(back - rgb), 0.98) < 5 and np.abs(back - rgb).mean() < 1
