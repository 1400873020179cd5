"""Operator 13. Periodic runs of words, by the runs theorem.

The words of each text are numbered exactly, and the suffixes of all texts of a block are
sorted by prefix doubling; words of different texts count as different, so a text's order
doesn't depend on its block. The longest Lyndon word from a place, under the order and
under its reverse, ends before the next smaller (larger) value of the inverse suffix array.
Every run has such a Lyndon word, repeated, as its root. A root is extended to both sides by
longest common extensions: range minima of the LCP array over a sparse table, for the text
and for its reverse. The table is made level by level, so it takes one array.

A run is a stretch with smallest period q and length >= max(least, power * q) that no
neighbouring word extends. Every run of exponent 4 or more has its first root less than q
words after its start, and from there the text agrees with itself q words on for more than
2 q words: other candidates are left out before LCP arrays are made.

Defined cases: null text has no words; rows are independent, so repeated rows and null ids
pass through; texts are read whole whatever their length; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm import textkit as tk
from pageloom.runtime import ship


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words get equal numbers, exactly."""
    size = ends - starts
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts - bounds[:-1], size) + np.arange(bounds[-1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def suffix_ranks(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Inverse suffix array of texts one after another; ``last`` is the end of the text of each place.

    A text's suffixes stand together, in the order of texts; the end of a text is less than any word.
    """
    n = len(words)
    key = last * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    shared = ~fresh
    shared[:-1] |= ~fresh[1:]
    places, slots, h = order[shared], np.flatnonzero(shared), 1
    while len(places):
        ahead = places + h
        second = np.where(ahead < last[places], rank[np.minimum(ahead, n - 1)] + 1, 0)
        first = rank[places]
        order = np.lexsort((second, first))
        places, first, second = places[order], first[order], second[order]
        fresh = np.ones(len(places), dtype=bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[places] = np.maximum.accumulate(np.where(fresh, slots, 0))
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        places, slots, h = places[shared], slots[shared], 2 * h
    return rank


def next_smaller(rank: np.ndarray, last: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The next place of the text with a smaller value, else the text's end. Places whose next one isn't smaller jump on by its own answer."""
    n = len(rank)
    after = np.arange(1, n + 1)
    open_ = np.arange(n)
    for _ in range(rounds):
        to = after[open_]
        open_ = open_[(to < last[open_]) & (rank[np.minimum(to, n - 1)] > rank[open_])]
        if not len(open_):
            return after
        after[open_] = after[after[open_]]
    # long stairs: one pass from the right ends each of the texts left
    for low, high in {(int(np.searchsorted(last, last[k], side="left")), int(last[k])) for k in open_}:
        value, stack = rank[low:high].tolist(), []
        for k in range(high - low - 1, -1, -1):
            while stack and value[stack[-1]] > value[k]:
                stack.pop()
            after[low + k] = low + stack[-1] if stack else high
            stack.append(k)
    return after


def common_prefixes(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[r]: words that the suffixes of ranks r - 1 and r of one text have in common; lcp[0] = 0."""
    n = len(words)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    w, before = words.tolist(), np.concatenate([[-1], suffix[:-1]])[rank].tolist()
    out, h = [0] * n, 0
    for k in range(n):
        j = before[k]
        if j < 0:
            h = 0
            continue
        most = n - (k if k > j else j)
        while h < most and w[k + h] == w[j + h]:
            h += 1
        out[k] = h
        if h:
            h -= 1
    lcp = np.empty(n, np.int64)
    lcp[rank] = out
    return lcp


def extensions(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far the text agrees from places a and b on (a < b; b may be its end)."""
    n = len(words)
    out = np.zeros(len(a), np.int64)
    use = np.flatnonzero(b < n)
    if not len(use):
        return out
    rank = suffix_ranks(words, np.full(n, n))
    low, high = np.minimum(rank[a[use]], rank[b[use]]) + 1, np.maximum(rank[a[use]], rank[b[use]]) + 1
    level = np.frexp((high - low).astype(float))[1] - 1
    least, width = common_prefixes(words, rank), 1
    for k in range(int(level.max()) + 1):
        here = level == k
        out[use[here]] = np.minimum(least[low[here]], least[high[here] - width])
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least
        width *= 2
    return out


def text_runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, power: int) -> np.ndarray:
    """Rows (start, length, period) of one text's runs, from candidates [start, end) of Lyndon roots."""
    n, period = len(words), ends - starts
    right = extensions(words, starts, ends)
    keep = right >= (power - 2) * period
    starts, ends, period, right = starts[keep], ends[keep], period[keep], right[keep]
    # to the left: the reversed text, from the places before both
    left = extensions(np.ascontiguousarray(words[::-1]), n - ends, np.minimum(n - starts, n)) if len(starts) else right
    found = np.stack([starts - left, ends + right - (starts - left), period], axis=1)
    return np.unique(found[found[:, 1] >= np.maximum(least, power * period)], axis=0)


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = 6, power: int = 4) -> list[np.ndarray]:
    """The runs of each text of a block, as rows (start, length, period) by start and period. power is 3 or more."""
    none = np.empty((0, 3), np.int64)
    found = [none] * (len(bounds) - 1)
    if not len(words):
        return found
    last = np.repeat(bounds[1:], np.diff(bounds))
    rank = suffix_ranks(words, last)
    text = np.searchsorted(bounds, np.arange(len(words)), side="right") - 1
    pairs = []
    for turned in (False, True):
        # under the reverse order the text's end is larger than any word: a word that reaches it is no root
        ends = next_smaller(-rank if turned else rank, last)
        starts = np.flatnonzero(ends < last) if turned else np.arange(len(words))
        ends = ends[starts]
        for k in range(power - 1):
            same = (ends + k < last[starts]) & (words[starts + np.minimum(k, last[starts] - 1 - starts)] == words[np.minimum(ends + k, len(words) - 1)])
            starts, ends = starts[same], ends[same]
        pairs.append((starts, ends))
    starts, ends = (np.concatenate(x) for x in zip(*pairs))
    order = np.argsort(text[starts], kind="stable")
    starts, ends = starts[order], ends[order]
    at = text[starts]
    for k in np.unique(at):
        low, high = np.searchsorted(at, [k, k + 1])
        found[k] = text_runs(words[bounds[k] : bounds[k + 1]], starts[low:high] - bounds[k], ends[low:high] - bounds[k], least, power)
    return found


def word_runs(docs: DataFrame, least: int = 6, power: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, runs (array of start, length, period), collapsed (the words outside repeats, joined by a space).

    A word is a repeat where a run contains it after the run's first period.
    """
    if power < 3:
        raise ValueError("power must be 3 or more")
    ship(docs.sparkSession)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @tk.releasing
    def rows(batches):
        for batch, data, offs in tk.slices(batches, "text"):
            starts, ends = tk.runs(tk.NOT_SPACE[data], offs)
            bounds = tk.row_bounds(starts, offs)
            found = find_runs(word_numbers(data, starts, ends), bounds, least, power)
            change = np.zeros(len(starts) + 1, np.int64)
            for k, runs in enumerate(found):
                np.add.at(change, bounds[k] + runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, bounds[k] + runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(change[:-1]) == 0
            # the words that stay, each with a space before it but the first of a text
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[kept]
            at, size = starts[kept], (ends - starts)[kept]
            first = np.ones(len(row), dtype=bool)
            first[1:] = row[1:] != row[:-1]
            size = size + ~first
            to = np.concatenate([[0], np.cumsum(size)])
            source = np.repeat(at - ~first - to[:-1], size) + np.arange(to[-1])
            out = data[source] if len(source) else np.empty(0, np.uint8)
            out[to[:-1][~first]] = 32
            text_bounds = to[np.searchsorted(row, np.arange(len(bounds)))]
            collapsed = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(text_bounds.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            many = np.concatenate([[0], np.cumsum([len(r) for r in found])])
            flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            runs = pa.ListArray.from_arrays(pa.array(many, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], fields=list(run_type)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), runs, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(rows, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
