"""Token counts: heap-and-linked-list byte-pair merging, no ids made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import held_as, vocabulary
from .tables import by_batch, slabs, utf8_bytes


def count_tokens(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row: tokens of the whole text.

    No shuffle and no state beyond a bounded memory of pieces per Python worker. A null
    text counts as empty (0 bytes, 0 tokens); rows with a null or repeated id stay as
    they are, one row out for each row in; an empty table gives an empty table; other
    columns are ignored.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = vocabulary(vocabulary_path)
        n = np.concatenate([words.counts(texts) for _, texts in slabs(batch.column("t"))])
        return pa.RecordBatch.from_arrays(
            [batch.column("i"), batch.column("b"), pa.array(n, pa.int64())], [id_column, "n_bytes", "n_tokens"]
        )

    kind = docs.schema[id_column].dataType.simpleString()
    text = docs[text_column]
    rows = docs.select(docs[id_column].alias("i"), utf8_bytes(text).alias("b"), text.alias("t"))
    return by_batch(rows, count, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint", held_as(vocabulary_path))


def with_limit(counts: DataFrame, limit: int) -> DataFrame:
    """Add ``over_limit``: more than ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
