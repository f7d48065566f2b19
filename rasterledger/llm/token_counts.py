"""Token counts: lengths only, encoded in batches of about equal bytes inside Arrow functions.

A text is encoded as the pieces in front of white space (``tokens.Encoder``), so a
long text is never one call of the tokenizer and nothing is cut or padded.
Null text counts as empty (0 bytes, 0 tokens, not over the limit); repeated rows
stay; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, byte_lengths, texts
from .tokens import ENCODED_BYTES, encoder

SCHEMA = "id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` per row of ``docs`` under the tokenizer file ``path``; no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, True)
        for batch in batches:
            for part in by_bytes(batch, limit=ENCODED_BYTES):
                body = texts(part.column("text"))
                tokens = enc.counts(body.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(byte_lengths(body)), pa.array(tokens, pa.int64()), pa.array(np.asarray(tokens > limit))], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(count, SCHEMA)
