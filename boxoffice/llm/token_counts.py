"""Token counts of whole texts by compiled transducers (see ``token_fst``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boxoffice.llm import token_fst
from boxoffice.llm.textkit import slices, text_bytes


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    ``tokenizer`` is the path of a byte-level BPE file. Counts are those of the library without added
    begin or end tokens. A null or empty text has no bytes and no tokens; a null id stays; repeated
    rows are counted each on its own. Other columns are ignored. A task holds about 60 bytes for each
    byte of a slice of half a MB, or of one longer text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_fst.counter(tokenizer)
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column(1))
            sizes = [np.diff(offsets), counter.count(data, offsets)]
            yield pa.record_batch([part.column(0), *map(pa.array, sizes)], names=[id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count, f"`{id_col}` long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
