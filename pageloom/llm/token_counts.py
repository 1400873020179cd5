"""Operator 3. Token counts by rank-synchronous array merging.

Distinct pre-tokens of a block are held as one ragged array, merged in synchronous
rounds, and the surviving symbols are counted; a text's count is the sum over its
pre-tokens. Counts are those of the tokenizers library for the same file without
added special tokens; special strings inside texts count as one token.

Defined cases: null text is empty and has no tokens; rows are independent, so
repeated rows and null ids simply pass through; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.llm import textkit as tk
from pageloom.llm.bpe import Words, encode_words, vocabulary as read_vocabulary
from pageloom.runtime import ship

def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    ship(docs.sparkSession)

    @tk.releasing
    def rows(batches):
        vocab = read_vocabulary(vocabulary)
        table = Words(vocab, lambda words: encode_words(vocab, words))
        for batch, data, offs in tk.slices(batches, text_col):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            at, bounds, _ = table.rows(texts)
            sums = np.concatenate([[0], np.cumsum(np.diff(table.bounds)[at])])
            n = sums[bounds[1:]] - sums[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64()), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
