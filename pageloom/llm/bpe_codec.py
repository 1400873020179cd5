"""Operator 4. BPE encoding and decoding by tree concatenation.

A whole text is halved, wherever the middle falls, down to leaves of ``leaf`` bytes at most,
which are encoded together; the halves are joined level by level, and growing windows around
each join, word borders included, are re-encoded until both sides agree (join_leaves). Inside
a leaf, words are looked up in a table of words that the task has met.
Ids are those of the tokenizers library for the same file without added special
tokens; special strings inside texts become their token. Decoding joins the
tokens' strings with one space, as that library does for a file without decoder.

Defined cases: null text is empty, has no ids and decodes to the empty string;
rows are independent, so repeated rows and null ids pass through; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.llm import textkit as tk
from pageloom.llm.bpe import Vocabulary, Words, join_leaves, ragged_index, vocabulary as read_vocabulary
from pageloom.runtime import ship


#: Bytes of text coded at once, and words that a task remembers.
BLOCK, WORDS = 1 << 18, 120_000


def decode(vocab: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Ragged ids to strings: the tokens' texts with a space between."""
    if not len(ids):
        return pa.array([""] * (len(bounds) - 1), pa.large_string())
    start, size = vocab.text_bounds[ids], np.diff(vocab.text_bounds)[ids]
    last = np.zeros(len(ids), dtype=bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    width = size + ~last
    ends = np.cumsum(width)
    out = np.full(ends[-1], 32, dtype=np.uint8)
    out[ragged_index(ends - width, size)] = vocab.text[ragged_index(start, size)]
    offs = np.concatenate([[0], ends])[bounds].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offs), pa.py_buffer(out))


def encode(vocab: Vocabulary, table: Words, texts: list[str], leaf: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ragged ids of texts, their bounds, and how many joins each took."""
    at, words_of, words = table.rows(texts)
    size = table.size[at]
    stop = np.cumsum(size)
    start = stop - size
    ends = np.concatenate([[0], stop])[words_of]
    low, high = ends[:-1], ends[1:]
    # halved until no part is longer than a leaf; a special string is never cut
    parts = np.int64(1) << np.ceil(np.log2(np.maximum(1, (high - low) / leaf))).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), parts - 1)
    cut = low[text] + (high - low)[text] * ragged_index(np.ones(len(texts), np.int64), parts - 1) // parts[text]
    inside = np.searchsorted(stop, cut, side="right")
    cut = np.unique(np.where(at[inside] < len(vocab.special), start[inside], cut)) if len(cut) else cut
    cut = cut[~np.isin(cut, low)]
    # pieces: words, and parts of words that are cut
    begin = np.unique(np.concatenate([start, cut]))
    end = np.append(begin[1:], stop[-1] if len(stop) else 0)[: len(begin)]
    of = np.searchsorted(stop, begin, side="right")
    broken = np.flatnonzero((begin != start[of]) | (end != stop[of]))
    parts_of = [words[w].encode("utf-8")[a:b] for w, a, b in zip(of[broken].tolist(), (begin - start[of])[broken].tolist(), (end - start[of])[broken].tolist())]
    ids, bounds = vocab.merge(*vocab.symbols(parts_of, end[broken] == stop[of[broken]]))
    first, many = table.bounds[at[of]], np.diff(table.bounds)[at[of]]
    first[broken], many[broken] = len(table.ids) + bounds[:-1], np.diff(bounds)
    ids = np.concatenate([table.ids, ids])[ragged_index(first, many)]
    leaves = np.unique(np.concatenate([low[high > low], cut]))
    tokens = np.concatenate([[0], np.cumsum(many)])
    bounds = np.append(tokens[np.searchsorted(begin, leaves)], tokens[-1])
    text_of = np.searchsorted(high, leaves, side="right")
    ids, bounds = join_leaves(vocab, ids, np.repeat(of, many), bounds, text_of, window)
    every = np.zeros(len(texts), dtype=np.int64)
    every[np.unique(text_of)] = np.diff(bounds)
    return ids, np.concatenate([[0], np.cumsum(every)]), np.bincount(text_of, minlength=len(texts)) - (high > low)


def bpe_encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 512, window: int = 4) -> DataFrame:
    """A row for each row of ``docs``: doc_id, ids array<int>, decoded string, n_joins int (of leaves)."""
    ship(docs.sparkSession)

    @tk.releasing
    def rows(batches):
        vocab = read_vocabulary(vocabulary)

        def whole(words: list[bytes]):
            # words longer than a leaf are always cut, so the table needs no tokens of theirs
            words = [w if len(w) <= leaf else b"" for w in words]
            return vocab.merge(*vocab.symbols(words, np.array([len(w) > 0 for w in words])))

        table = Words(vocab, whole, WORDS)
        for batch, _, _ in tk.slices(batches, text_col, BLOCK):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            ids, ends, joins = encode(vocab, table, texts, leaf, window)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64()), lists, decode(vocab, ids, ends).cast(pa.string()), pa.array(joins.astype(np.int32))], ["doc_id", "ids", "decoded", "n_joins"])

    return docs.select(id_col, text_col).mapInArrow(rows, "doc_id long, ids array<int>, decoded string, n_joins int")
