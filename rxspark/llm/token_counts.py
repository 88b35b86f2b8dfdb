"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole.  The byte lengths of its tokens give their character spans, and the spans are
joined to the sections by interval search.  Rule for a token that crosses a boundary: it belongs to the section that
holds most of its characters, the earlier one on a tie; a token of which no character begins (the later bytes of a
character that takes several tokens) belongs where that character stands.  Every token is allocated exactly once, so
the counts of a document's sections sum to its own.

Sections are the lines of a text, each with the line end that closes it; other sections can be given as arrays of start
positions.  A null or empty text has one empty section with no tokens; an empty table has no rows.  Repeated rows give
repeated results, and columns besides those named are never looked at.  Texts are encoded whole, however long; runs of
more than ``RUN`` white-space characters, which the library's pattern engine can't hold, are cut where it always ends a word.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import chunks, table

RUN = 4096
#: White space of the library's pattern engine, in runs of over RUN characters.
_RUNS = re.compile(f"[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{RUN + 1},}}")
_kept: dict = {}


def _coder(path: str, pattern: str):
    """(encoder, bytes of each token) of a file of byte-level merge ranks."""
    if path not in _kept:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        sizes[list(ranks.values())] = [len(x) for x in ranks]
        _kept[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _kept[path]


def encode(coder, text: str) -> np.ndarray:
    """The ids of a text.  A run of white space is one word of the pattern, but for its last character if another follows it;
    so the text is cut before a long run and before that last character, and the tokens stay the same."""
    parts, at = [], 0
    for run in _RUNS.finditer(text):
        end = run.end() - (run.end() < len(text))
        parts.append(coder.encode_ordinary(text[at : run.start()]))
        parts.append(coder._core_bpe.encode_single_piece(text[run.start() : end].encode()))
        at = end
    parts.append(coder.encode_ordinary(text[at:]))
    return np.concatenate([np.array(x, np.int64) for x in parts])


def allocate(text: str, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The section of each token: ``sizes`` are the tokens' bytes, ``starts`` the sections' first characters, from 0."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
    ends = np.cumsum(sizes)
    b = begun[ends]  # a token's characters: those that begin in it ...
    a = begun[ends - sizes]
    a = np.where(a == b, np.maximum(b - 1, 0), a)  # ... or the one it continues
    first = np.searchsorted(starts, a, side="right") - 1
    last = np.searchsorted(starts, np.maximum(b - 1, a), side="right") - 1
    best, most = first.copy(), np.minimum(np.append(starts[1:], len(text))[first], b) - a
    for i in np.flatnonzero(first < last):
        for s in range(first[i] + 1, last[i] + 1):
            own = min(starts[s + 1] if s + 1 < len(starts) else len(text), b[i]) - starts[s]
            if own > most[i]:
                best[i], most[i] = s, own
    return best


def attribute(docs: DataFrame, ranks: str, pattern: str, sections: str | None = None) -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens), a row for each section.  ``sections``: a column of ascending
    start positions, the first 0; by default the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = _coder(ranks, pattern)
        for batch in chunks(batches):
            ids, own = batch.column("doc_id"), (batch.column(sections).to_pylist() if sections else None)
            row, number, begins, ends, counts = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                if own is None:
                    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
                    starts = np.concatenate([[0], at[at < len(text)]])
                else:
                    starts = np.array(own[i] or [0], np.int64)
                tokens = encode(coder, text)
                where = allocate(text, sizes[tokens], starts) if len(tokens) else tokens
                row.append(np.full(len(starts), i))
                number.append(np.arange(len(starts)))
                begins.append(starts)
                ends.append(np.append(starts[1:], len(text)))
                counts.append(np.bincount(where, minlength=len(starts)))
            columns = [ids.take(pa.array(np.concatenate(row)))]
            columns += [pa.array(np.concatenate(x), kind) for x, kind in ((number, pa.int32()), (begins, pa.int64()), (ends, pa.int64()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "section", "start_char", "end_char", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "text", *([sections] if sections else [])]
    return docs.select(*columns).mapInArrow(run, f"doc_id {kind}, section int, start_char long, end_char long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return attribute(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
