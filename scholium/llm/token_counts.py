"""Token counts of whole texts, by rank-synchronous array merging.

The distinct pre-tokens of a chunk are held as a ragged array; each round applies every sequence's
own lowest-rank pair at once, and what is counted at the end are the surviving symbols. No ids of
texts are built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, Words, merge_rounds, vocabulary
from .ragged import chunks


def count_chunk(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Each text's number of tokens; a special string inside a text is one token."""
    words = Words(data, offsets, vocab)
    _, surviving = merge_rounds(words.symbols, words.lengths, vocab)
    per_part = np.bincount(words.part_of, weights=surviving[words.which], minlength=len(words.part_doc))
    per_part += words.part_after >= 0
    return np.bincount(words.part_doc, weights=per_part, minlength=words.docs).astype(np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, repeats and null ids included.

    A null or empty text has 0 bytes and 0 tokens. Texts are never cut. Other columns are not read.
    """
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for rows, data, offsets in chunks(batches, "text", 3 << 20):
            n = count_chunk(data, offsets, vocab)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
