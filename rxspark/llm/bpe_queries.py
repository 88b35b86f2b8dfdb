"""Encoding and decoding of whole documents with the word-end BPE vocabulary (see ``bpe``).

A null text is empty: no tokens, and the digests of the empty string.  Repeated rows give repeated results, an empty table
gives no rows.  Texts are encoded whole, however long; columns besides doc_id and text are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .base import chunks, table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, vocabulary: str, decode: bool = True) -> DataFrame:
    """(doc_id, ids, decoded): the token ids of each text, and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocabulary)
        for batch in chunks(batches):
            ids, offsets = coder.encode(batch.column("text").to_pylist())
            decoded = [coder.decode(ids[a:b].tolist()) if decode else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype("int32")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, _id(docs) + ", ids array<int>, decoded string")


def _id(docs: DataFrame) -> str:
    return "doc_id " + docs.schema["doc_id"].dataType.simpleString()


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), digested where the ids are made: neither ids nor decoded texts
    leave the Python worker."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocabulary)
        for batch in chunks(batches):
            ids, offsets = coder.encode(batch.column("text").to_pylist())
            names, of_ids, of_text = coder.id_texts, [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = ids[a:b].tolist()
                of_ids.append(sha(" ".join([names[i] for i in own])))
                of_text.append(sha(coder.decode(own)))
            counts = pa.array(offsets[1:] - offsets[:-1], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, _id(docs) + ", n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())
