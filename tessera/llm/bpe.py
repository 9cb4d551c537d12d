"""BPE encoding and decoding of whole texts by forced-boundary splitting (see tokenizer.py), one pass and no shuffle.

Defined cases: a null or empty text and a text of white space have no ids and decode to the empty text; the strings of
special tokens in a text become their ids; repeated rows give their own rows; a null doc_id is kept; other columns are
ignored; an empty table gives no rows. A very long text is a piece of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, texts
from .tokenizer import PIECE, worker_bpe

VOCABULARY = "word_bpe_49k.json"


def _encode(vocabulary: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, coder, decimals, strings = worker_bpe(public_tokenizers.path(vocabulary))
        for batch in (p for b in batches for p in pieces(b, "text", PIECE)):
            ids, bounds = coder.ids(batch.column("text"))
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(bounds))}
            back = strings.joined(ids, bounds)  # decode() of the ids
            if digests:
                out["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in decimals.joined(ids, bounds)], pa.string())
                out["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())
            else:
                out["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                out["decoded"] = pa.array([str(x, "utf-8") for x in back], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded string of every text."""
    return texts(docs).mapInArrow(_encode(vocabulary, False), "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 of every text."""
    return texts(docs).mapInArrow(_encode(vocabulary, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
