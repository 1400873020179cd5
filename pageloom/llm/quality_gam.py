"""Operator 8. Quality classifier: a generalised additive model with pairwise interactions.

Text features are binned at training quantiles. Cyclic boosting visits the features
in turn and adds a shallow regression tree over the bins of one feature to its lookup
table; then the pairs whose bins explain most of what is left get two-dimensional
tables in the same way. A score is the logistic of an intercept plus table entries:
vectorised bin additions. Only the text enters a score.

The model is fitted on the driver from at most ``max_labelled`` labelled rows, those
with the smallest hash of their id. Rows whose crc32(id as text) mod 5 is 0 are held
out and never used. All rows are scored.

Defined cases: null text is scored as the empty text; labels that are null or of ids
without document are ignored; with no labelled row every score is 0.5, with one class
only it is that class's smoothed share; rows are scored independently, so repeated
rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm import textkit as tk
from pageloom.runtime import ship

HELD_OUT = "coalesce(pmod(crc32(cast({0} as string)), 5) = 0, false)"
THRESHOLD = 0.3

_CLASS = {
    "upper": tk.byte_class((65, 90)),
    "lower": tk.byte_class((97, 122)),
    "digit": tk.byte_class((48, 57)),
    "beyond": tk.byte_class((128, 255)),
    "stop": tk.byte_class((44, 44), (46, 46), (59, 59), (58, 58), (63, 63), (39, 39), (34, 34), (45, 45), (40, 41)),
    "bang": tk.byte_class((33, 33)),
    "bar": tk.byte_class((124, 124), (60, 60), (62, 62), (91, 93), (123, 123), (125, 125)),
    "mark": tk.byte_class((35, 38), (42, 43), (47, 47), (61, 61), (64, 64), (94, 96), (126, 126)),
    "line": tk.byte_class((10, 10)),
    "control": tk.byte_class((0, 8), (11, 31), (127, 127)),
}
FEATURES = ("size", "upper", "digit", "beyond", "stop", "bang", "bar", "mark", "control", "line_words", "word_bytes", "short_words", "distinct_words", "distinct_lines", "word_doubled")


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows of FEATURES for a block of texts."""
    n = len(offs) - 1
    size = np.diff(offs)
    whole = np.maximum(size, 1)

    def count(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])[offs])

    of = {k: count(table[data]) for k, table in _CLASS.items()}
    starts, ends = tk.runs(tk.NOT_SPACE[data], offs)
    bounds = tk.row_bounds(starts, offs)
    words = np.maximum(np.diff(bounds), 1)
    row = np.repeat(np.arange(n), np.diff(bounds))
    length = ends - starts
    hashes = tk.span_hashes(data, starts, ends)
    short = np.bincount(row, weights=length <= 3, minlength=n)
    doubled = np.zeros(len(row), dtype=bool)
    doubled[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])

    def distinct(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        keys = (values & ~tk.U(0xFFFF)) ^ tk.mix(rows.astype(np.uint64))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[1:] != keys[:-1]
        return np.bincount(rows[order][first], minlength=n)

    lines_at = tk.runs(data != 10, offs)
    line_row = np.searchsorted(offs, lines_at[0], side="right") - 1
    lines = np.bincount(line_row, minlength=n)
    letters = np.maximum(of["upper"] + of["lower"] + of["beyond"], 1)
    columns = [
        np.log2(1 + size),
        of["upper"] / letters,
        of["digit"] / whole,
        of["beyond"] / whole,
        of["stop"] / whole,
        of["bang"] / whole,
        of["bar"] / whole,
        of["mark"] / whole,
        of["control"] / whole,
        np.log2(1 + words / np.maximum(lines, 1)),
        np.bincount(row, weights=length, minlength=n) / words,
        short / words,
        distinct(hashes, row) / words,
        distinct(tk.span_hashes(data, *lines_at), line_row) / np.maximum(lines, 1),
        np.bincount(row, weights=doubled, minlength=n) / words,
    ]
    return np.stack(columns, axis=1)


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Bin values of a regression tree over ordered bins, from sums of gradient and weight; leaves shrink towards 0."""
    ridge = 1.0
    out = np.full(len(gradient), gradient.sum() / (weight.sum() + ridge))
    if depth == 0 or len(gradient) < 2:
        return out
    g, w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    gain = g**2 / (w + ridge) + (gradient.sum() - g) ** 2 / (weight.sum() - w + ridge)
    cut = int(gain.argmax()) + 1
    out[:cut], out[cut:] = _tree(gradient[:cut], weight[:cut], depth - 1), _tree(gradient[cut:], weight[cut:], depth - 1)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The same over a grid of bins: one cut along an axis, then a cut of each side along the other."""
    best, out = -1.0, np.zeros_like(gradient)
    for turned in (False, True):
        g, w = (gradient.T, weight.T) if turned else (gradient, weight)
        a, b = np.cumsum(g.sum(axis=1))[:-1], np.cumsum(w.sum(axis=1))[:-1]
        if not len(a):
            continue
        gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (w.sum() - b + 1)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > best:
            best = gain[cut - 1]
            value = np.empty_like(g)
            value[:cut], value[cut:] = _tree(g[:cut].sum(axis=0), w[:cut].sum(axis=0), 1), _tree(g[cut:].sum(axis=0), w[cut:].sum(axis=0), 1)
            out = value.T if turned else value
    return out


@dataclass
class Gam:
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[at[k]]
        for a, b, table in self.pairs:
            total += table[at[a], at[b]]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, n_pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15) -> Gam:
    if not len(y):
        return Gam()
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(intercept=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    at = model.bins(x)
    width = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(w) for w in width]
    total = np.full(len(y), model.intercept)

    def sums(place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(place, weights=y - p, minlength=size), np.bincount(place, weights=p * (1 - p), minlength=size)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            step = rate * _tree(*sums(at[k], width[k]), depth=2)
            table += step
            total += step[at[k]]
    found = []
    for a in range(len(width)):
        for b in range(a + 1, len(width)):
            g, w = (s.reshape(width[a], width[b]) for s in sums(at[a] * width[b] + at[b], width[a] * width[b]))
            value = _pair_tree(g, w)
            found.append((float((value * g).sum() - 0.5 * (value**2 * w).sum()), a, b))
    model.pairs = [(a, b, np.zeros((width[a], width[b]))) for _, a, b in sorted(found, key=lambda f: (-f[0], f[1:]))[:n_pairs]]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            place = at[a] * width[b] + at[b]
            step = rate * _pair_tree(*(s.reshape(table.shape) for s in sums(place, table.size)))
            table += step
            total += step[at[a], at[b]]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> Gam:
    """A model of ``labels(id, label)`` for the texts of ``docs``; at most ``max_labelled`` rows travel to the driver, as numbers."""
    ship(docs.sparkSession)
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(f"y in (0, 1) and doc_id is not null and not {HELD_OUT.format('doc_id')}")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled)

    @tk.releasing
    def rows(batches):
        for batch, data, offs in tk.slices(batches, "text"):
            x = features(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # at most max_labelled rows are sent to all executors
    got = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(rows, "doc_id long, y int, x array<double>").toPandas()
    if not len(got):
        return Gam()
    got = got.assign(first=[tuple(v) for v in got["x"]]).sort_values(["doc_id", "y", "first"])
    return fit(np.stack(got["x"].to_numpy()), got["y"].to_numpy(dtype=float))


def quality_score(docs: DataFrame, model: Gam, text: Column) -> Column:
    """The score of a text column, 0 to 1, higher where label 1 is likelier."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        parts = [sent.value.score(features(data, offs)) for _, data, offs in tk.slices(iter([batch]), "text")]
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, score, predicted."""
    model = fit_quality(docs, labels, id_col, text_col, label_col, max_labelled)
    scored = docs.select(F.col(id_col).alias("doc_id"), F.expr(HELD_OUT.format(f"`{id_col}`")).alias("held_out"), quality_score(docs, model, F.col(text_col)).alias("score"))
    return scored.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
