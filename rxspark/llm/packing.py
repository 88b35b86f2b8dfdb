"""Best-two-fit packing of token pieces into sequences.

The sizes of pieces are integers from 1 to the length of a sequence, so the count of each size is all that packing
needs: at most ``LENGTH`` numbers reach the driver, however many documents there are.  ``plan`` fills a bin greedily
(the largest size that fits, again and again), then replaces its smallest piece by two unpacked ones that fit the
widened gap more tightly, and repeats the resulting pattern as often as the counts allow.  Each repetition ends with a
size that can't fill the pattern again, so there are at most about LENGTH * ln(LENGTH) patterns.  The pieces of each
size are then numbered in parallel (in buckets of about ``BUCKET`` rows, so that a size which many copies share is
spread) and take the slots of their size in order.

A null text is empty; its one piece is the closing id.  Every row is packed, repeated rows too, with one place each; ties of
equal pieces go by nothing else than their bucket's order.  A text of any length is cut into pieces; an empty table gives
no rows.  Columns besides doc_id and text are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .base import chunks, materialize, table
from .bpe_queries import vocabulary_path

LENGTH, CLOSING, BUCKET = 2048, 0, 256


def cut(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each document's ids and a closing id, in pieces of at most
    ``length``; all but a document's last are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocabulary)
        for batch in chunks(batches):
            ids, offsets = coder.encode(batch.column("text").to_pylist())
            row, piece, start, size, crc, own = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                raw = np.append(ids[a:b], CLOSING).astype("<u4")
                for k, at in enumerate(range(0, len(raw), length)):
                    part = raw[at : at + length]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    own.append(part)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(own).astype("int32")))
            yield pa.RecordBatch.from_arrays([*columns, lists], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>")


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(sizes of a sequence, how many such sequences): uses up all counts."""
    left = np.zeros(length + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    out = []
    while left.any():
        # below[x]: the largest size up to x that is still there, 0 if none
        below = np.maximum.accumulate(np.where(left > 0, np.arange(length + 1), 0))
        used: dict[int, int] = {}

        def most(gap: int, used=used, below=below) -> int:
            size = int(below[gap])
            while size and left[size] <= used.get(size, 0):
                size = int(below[size - 1])
            return size

        sizes, gap = [], length
        while gap and (size := most(gap)):
            take = min(gap // size, int(left[size]) - used.get(size, 0))
            sizes += [size] * take
            used[size] = used.get(size, 0) + take
            gap -= size * take
        while gap and len(sizes) > 0:
            small = sizes[-1]
            room = gap + small
            free = left - np.bincount(list(used), weights=list(used.values()), minlength=length + 1).astype(np.int64)
            free[small] += 1
            have = np.flatnonzero(free[:room] > 0)
            have = have[have > 0]
            if not len(have):
                break
            near = np.maximum.accumulate(np.where(free > 0, np.arange(length + 1), 0))
            second = near[room - have]
            twice = (second == have) & (free[have] < 2)
            second[twice] = near[np.maximum(have[twice] - 1, 0)]
            total = np.where(second > 0, have + second, 0)
            best = int(total.argmax())
            if total[best] <= small:
                break
            a, b = int(have[best]), int(second[best])
            used[small] -= 1
            for x in (a, b):
                used[x] = used.get(x, 0) + 1
            sizes = sorted([*sizes[:-1], a, b], reverse=True)
            gap = room - a - b
        used = {s: n for s, n in used.items() if n}
        times = min(int(left[s]) // n for s, n in used.items())
        for s, n in used.items():
            left[s] -= n * times
        out.append((tuple(sizes), times))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]], length: int = LENGTH) -> dict[str, np.ndarray]:
    """For each size its slots: runs of ranks with the first sequence and the offset of each, ordered by size and rank."""
    ranks = np.zeros(length + 1, np.int64)
    rows, sequence = [], 0
    for sizes, times in patterns:
        at = 0
        for s in sizes:
            rows.append((s, int(ranks[s]), sequence, at))
            ranks[s] += times
            at += s
        sequence += times
    rows = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"size": rows[:, 0], "rank": rows[:, 1], "sequence": rows[:, 2], "offset": rows[:, 3]}


def number(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``pieces`` with ``size_rank``: 0, 1, ... within each length, without gathering a length in one task."""
    spark = pieces.sparkSession
    buckets = {s: -(-n // BUCKET) for s, n in counts.items()}
    spread = F.broadcast(spark.createDataFrame(list(buckets.items()) or [(0, 1)], "length long, size_buckets long"))  # at most LENGTH rows
    df = pieces.join(spread, "length").withColumn("size_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("size_buckets"))).drop("size_buckets")
    before = Window.partitionBy("length").orderBy("size_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy("length", "size_bucket").agg(F.count("*").alias("n")).withColumn("size_first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "size_bucket").orderBy("doc_id", "piece", "ids_crc32")
    return df.withColumn("size_rank", F.row_number().over(inside) - 1).join(first, ["length", "size_bucket"]).withColumn("size_rank", F.col("size_rank") + F.col("size_first")).drop("size_first", "size_bucket")


def place(pieces: DataFrame, counts: dict[int, int], length: int = LENGTH) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    table = slots(plan(counts, length), length)
    key = table["size"] << 40 | table["rank"]  # ascending

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "size_rank"))
            at = np.searchsorted(key, size << 40 | rank, side="right") - 1
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(table["sequence"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])], [*names, "sequence_id", "offset"])

    names = pieces.columns
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    return number(pieces, counts).select(*names, F.col("size_rank").cast("long")).mapInArrow(run, ", ".join([*kinds, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with their places; ``ids`` keeps the token ids themselves."""
    pieces = cut(docs, vocabulary, length)
    pieces = materialize(pieces if ids else pieces.drop("ids"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``length`` rows
    return place(pieces, counts, length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents with their token ids."""
    return pack(docs, vocabulary_path(), ids=True)
