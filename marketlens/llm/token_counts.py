"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch of texts become one flat array of symbols; each round merges every
sequence's pair of lowest rank at once, and the symbols that survive are counted (see ``bpe``).
Texts that repeat units pay for each once per worker. Rows are independent: no shuffle.

A null or empty text has no bytes and no tokens; special strings inside a text count as one
token, as the tokenizer's default has it; repeated rows are counted each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import bpe
from marketlens.llm.common import ship
from marketlens.llm.shingles import text_slices

LIMIT = 512


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = bpe.count_units(path)
        for whole in batches:
            for batch in text_slices(whole, "text"):
                texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
                tokens = np.fromiter(map(sum, units.values(texts)), np.int64, len(texts))
                size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), pa.array(tokens)], names=["id", "n_bytes", "n_tokens"])

    return run


def count(docs: DataFrame, tokenizer: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per document; ``tokenizer`` is the path of a byte-level BPE file."""
    ship(docs.sparkSession)
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    out = given.mapInArrow(_counted(tokenizer), f"id {given.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
