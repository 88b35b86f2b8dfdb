"""Fingerprints of documents by randomised edit embedding.

A walk over the characters of a text is steered by shared random bits: at time t it stands on some character c and moves
on if bit(t, c) is set, else it waits.  Two texts that differ by a few edits fall into step again soon after each edit,
so the Hamming distance between what their walks see, time by time, follows their edit distance.  What a walk sees is
the character under it with the two after it, hashed to four bits.

The fingerprint samples the walk at times common to all texts: ``SAMPLES`` in each interval [64 * 2**k, 64 * 2**(k+1)) (and
in the first 64), as long as the walk lasts, written as hexadecimal digits and "." past its end.  Whole texts are
walked.  ``likeness`` of two fingerprints is the share of equal samples, each weighted by the time that it stands for,
less what chance gives: 1 for equal texts and near 0 for unrelated ones.

Banding (``groups``): samples drawn from the time that a fingerprint fills form band keys; documents that share a key are
candidates of each other, and a link needs the likeness of the two whole fingerprints.  Links make components.

A null text is empty, its fingerprint too; two empty ones have likeness 1, an empty and another 0.  The next document is
the next row by doc_id, then by a hash of the text; null ids come first, repeated rows follow one another.  An
empty table has no rows; ids may be of any type that can be ordered, and columns besides doc_id and text are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import CHUNK_BYTES, chunks, materialize, partitions_for, table
from .minhash import components
from .textscan import U, mix, ranges

SAMPLES, FIRST, CLASSES, PERIOD = 64, 64, 64, 1 << 16
#: Fewer texts than this are walked one by one.
_ALONE = 24
#: Members of a band key that are compared at once with each other, or with as many others.
BLOCK = 512
_kept: dict = {}


def _waits() -> tuple[np.ndarray, list[list[int]]]:
    """Steps until a walk that reaches a character of class c at time t (modulo PERIOD) has left it, flat and as lists."""
    if "waits" not in _kept:
        go = np.random.default_rng(11).random((CLASSES, PERIOD)) < 0.5
        twice = np.concatenate([go, go], 1)
        at = np.where(twice, np.arange(2 * PERIOD), 4 * PERIOD)
        following = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1][:, :PERIOD]
        waits = (following - np.arange(PERIOD) + 1).astype(np.int64)
        _kept["waits"] = waits.ravel(), waits.tolist()
    return _kept["waits"]


def sample_times(end: int) -> tuple[np.ndarray, np.ndarray]:
    """(times, weights) of the samples in all intervals that begin before ``end``."""
    n = 1 if end <= FIRST else int(np.ceil(np.log2(end / FIRST))) + 1
    if ("times", n) not in _kept:
        times, weights = [], []
        for k in range(n):
            low, size = (0, FIRST) if not k else (FIRST << (k - 1), FIRST << (k - 1))
            offset = np.random.default_rng(100 + k).random(SAMPLES)
            times.append(low + ((np.arange(SAMPLES) + offset) * size / SAMPLES).astype(np.int64))
            weights.append(np.full(SAMPLES, size / SAMPLES))
        _kept["times", n] = np.concatenate(times), np.concatenate(weights)
    return _kept["times", n]


def walk(classes: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time at which each character is reached, time at which each text is left), for all texts side by side."""
    flat, lists = _waits()
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    base, t = offsets[:-1][order], start[order].astype(np.int64)
    reached = np.zeros(len(classes), np.int64)
    live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")  # texts longer than i
    i = 0
    while i < len(live) and live[i] >= _ALONE:
        m = live[i]
        at = base[:m] + i
        now = t[:m]
        reached[at] = now
        t[:m] = now + flat[classes[at] * PERIOD + (now & (PERIOD - 1))]
        i += 1
    if i < len(live):
        for k in range(int(live[i])):
            a, b = int(base[k]) + i, int(base[k]) + int(sizes[order[k]])
            now, times = int(t[k]), []
            for c in classes[a:b].tolist():
                times.append(now)
                now += lists[c][now & 65535]
            reached[a:b] = times
            t[k] = now
    end = np.empty(len(sizes), np.int64)
    end[order] = t
    return reached, end


def _classes(chars: np.ndarray) -> np.ndarray:
    return (mix(chars.astype(U) + U(77)) & U(CLASSES - 1)).astype(np.int64)


_DIGITS = np.frombuffer(b"0123456789abcdef.", np.uint8)
_VALUE = np.full(256, 16, np.uint8)
_VALUE[_DIGITS] = np.arange(17)


def _print(chars: np.ndarray, reached: np.ndarray, end: int) -> np.ndarray:
    """The samples of one text, 16 past its end."""
    if not len(chars):
        return np.zeros(0, np.uint8)
    times, _ = sample_times(end)
    at = np.searchsorted(reached, times, side="right") - 1
    x = np.append(chars, [0, 0]).astype(U)
    seen = (mix(x[at] + (x[at + 1] << U(21)) + (x[at + 2] << U(42))) & U(15)).astype(np.uint8)
    seen[times >= end] = 16
    return seen


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    n = max(len(a), len(b))
    _, weights = sample_times(FIRST << (n // SAMPLES - 1) if n > SAMPLES else FIRST)
    if len(a) != len(b):
        a, b = (np.append(x, np.full(n - len(x), 16, np.uint8)) for x in (a, b))
    counted = (a < 16) | (b < 16)
    share = weights[counted & (a == b)].sum() / weights[counted].sum()
    return float(min(1.0, max(0.0, (share - 1 / 16) / (15 / 16))))


def likeness(a: str, b: str) -> float:
    """Likeness of two written fingerprints."""
    return _likeness(*(_VALUE[np.frombuffer(x.encode(), np.uint8)] for x in (a, b)))


def _chars(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def _written(x: np.ndarray) -> str:
    return _DIGITS[x].tobytes().decode()


def prints(texts: list[str]) -> list[str]:
    chars, offsets = _chars(texts)
    reached, end = walk(_classes(chars), offsets, np.zeros(len(texts), np.int64))
    return [_written(_print(chars[a:b], reached[a:b], int(e))) for a, b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), end, strict=True)]


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints([x or "" for x in batch.column("text").to_pylist()]), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _compare(texts: list[str]) -> list[tuple]:
    """For each text but the last: (n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    chars, offsets = _chars(texts)
    reached, end = walk(_classes(chars), offsets, np.zeros(len(texts), np.int64))
    sizes = np.diff(offsets)
    own = [_print(chars[offsets[i] : offsets[i + 1]], reached[offsets[i] : offsets[i + 1]], int(end[i])) for i in range(len(texts))]
    n = len(texts) - 1
    if n < 1:
        return []
    given = np.minimum(sizes[:n] // 4, sizes[1:])  # characters that the next text gives
    kept = sizes[:n] - sizes[:n] // 4
    tail = chars[ranges(offsets[1 : n + 1], given)]
    tails = np.concatenate([[0], np.cumsum(given)])
    begin = np.where(kept < sizes[:n], reached[np.minimum(offsets[:n] + kept, max(len(reached) - 1, 0))] if len(reached) else 0, end[:n])
    later, last = walk(_classes(tail), tails, begin)
    out = []
    for i in range(n):
        a, k = int(offsets[i]), int(kept[i])
        text = texts[i][:k] + texts[i + 1][: int(given[i])]
        if k == sizes[i]:
            edited = own[i]
        else:
            part = slice(tails[i], tails[i + 1])
            edited = _print(np.concatenate([chars[a : a + k], tail[part]]), np.concatenate([reached[a : a + k], later[part]]), int(last[i]))
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((int(sizes[i]), sha, _written(own[i]), _written(edited), _likeness(own[i], edited), _likeness(own[i], own[i + 1])))
    return out


_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]
_TYPES = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
#: Columns of the ends of ranges, null in other rows.
_END_COLUMNS = "range int, at_last boolean, packed binary"
_END_NAMES = [c.split()[0] for c in _END_COLUMNS.split(", ")]
_END_TYPES = [pa.int32(), pa.bool_(), pa.binary()]


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, packed): texts compressed one by one, which halves what is shuffled; ``tie`` orders rows that repeat an id."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            packed = [_pack(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(packed, pa.binary())], ["doc_id", "tie", "packed"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, tie long, packed binary")


def _pack(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> str:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True).decode("utf-8", "surrogatepass")


def compare_next(docs: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Each document against itself edited and against the next one; with ``components`` (doc_id, component_id) also the group of
    each, null where an id has none.

    Rows are dealt by ranges of doc_id and sorted; inside a range a row's successor follows it.  What crosses ranges is
    one text at either end of each: the last row of a range meets the first of the next range that has rows, by a join on
    the numbers of the ranges.  Both ends come from the pass that compares the rows inside and are stored with its rows: the
    bounds of ranges are sampled, so that ranges dealt once more would be others, and a row would meet a wrong successor.  The
    components are dealt along, a row without a text before the texts of its id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _packed(docs).withColumn("component", F.lit(None).cast(kind))
    if components is not None:
        one = components.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component"))
        rows = rows.union(one.select("doc_id", F.lit(0).cast("long"), F.lit(None).cast("binary"), "component"))
    dealt = rows.repartitionByRange(partitions_for(docs.sparkSession), "doc_id")

    def batch(ids: pa.Array, own: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_TYPES), _TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([ids, *columns, own], ["doc_id", *_NAMES, "component_id"])

    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        nothing = [pa.nulls(rows.num_rows, t) for t in _END_TYPES]
        return pa.RecordBatch.from_arrays([*rows.columns, *nothing], [*rows.schema.names, *_END_NAMES])

    def end(at_last: bool, ids: pa.Array, own: pa.Array, packed: bytes) -> pa.RecordBatch:
        values = TaskContext.get().partitionId(), at_last, packed
        columns = [ids, *(pa.nulls(1, t) for t in _TYPES), own, *(pa.array([v], t) for v, t in zip(values, _END_TYPES, strict=True))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *_NAMES, "component_id", *_END_NAMES])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = carried = None  # (id, text, component) of the row before this chunk; the component given last
        for part in chunks(batches, "packed", CHUNK_BYTES // 2):
            given, real = part.column("component"), part.column("packed").is_valid().to_numpy(zero_copy_only=False)
            carried = pa.nulls(1, given.type) if carried is None else carried
            # the row that gave a text's component: the last one before it without a text, else what the chunk before has carried
            giver = np.maximum.accumulate(np.where(real, 0, np.arange(1, len(real) + 1)))
            own = pa.concat_arrays([carried, given]).take(pa.array(giver[real]))
            if (~real).any():
                carried = given.slice(int(np.flatnonzero(~real)[-1]), 1)
            ids, texts = part.column("doc_id").filter(pa.array(real)), [_unpack(x) for x in part.column("packed").to_pylist() if x is not None]
            if not texts:
                continue
            if last is not None:
                ids, texts, own = pa.concat_arrays([last[0], ids]), [last[1], *texts], pa.concat_arrays([last[2], own])
            else:
                yield end(False, ids.slice(0, 1), own.slice(0, 1), _pack(texts[0]))
            found = _compare(texts)
            if found:
                yield whole(batch(ids.slice(0, len(found)), own.slice(0, len(found)), found))
            last = ids.slice(len(ids) - 1, 1), texts[-1], own.slice(len(own) - 1, 1)
        if last is not None:
            yield end(True, last[0], last[2], _pack(last[1]))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i, (one, other) in enumerate(zip(part.column("packed").to_pylist(), part.column("following").to_pylist(), strict=True)):
                yield batch(part.column("doc_id").slice(i, 1), part.column("component").slice(i, 1), _compare([_unpack(one), _unpack(other)]))

    columns = f"doc_id {kind}, {_COLUMNS}, component_id {kind}"
    compared = dealt.sortWithinPartitions("doc_id", F.col("packed").isNotNull(), "tie").mapInArrow(inside, f"{columns}, {_END_COLUMNS}")
    compared = materialize(compared, "compared", "zstd")
    firsts = compared.where("not at_last").select(F.col("range").alias("following_range"), F.col("packed").alias("following"))
    lasts = compared.where("at_last").select("range", "doc_id", "packed", F.col("component_id").alias("component"))
    order = Window.orderBy("range")  # of the numbers alone, one for each range
    following = F.coalesce(F.lead("range").over(order), F.min("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    numbers = lasts.select("range").select("range", following.alias("following_range"))
    pairs = lasts.join(numbers, "range").join(firsts, "following_range").select("doc_id", "packed", "following", "component")
    found = compared.where("at_last is null").select("doc_id", *_NAMES, "component_id")
    return found.union(pairs.mapInArrow(across, columns))


# -- groups ---------------------------------------------------------------------------------------------------------

BANDS, ROWS, SHORTEST = 12, 6, -3


def _places(level: int, bands: int, rows: int) -> np.ndarray:
    """Samples for the band keys of prints that last FIRST * 2**level time steps: times drawn evenly from all of them."""
    times = np.random.default_rng(1000 + level).random((bands, rows)) * FIRST * 2.0**level
    k = np.where(times < FIRST, 0, np.floor(np.log2(np.maximum(times, FIRST) / FIRST)).astype(int) + 1)
    low = np.where(k > 0, FIRST * 2.0 ** (k - 1), 0)
    size = np.where(k > 0, low, FIRST)
    return k * SAMPLES + np.minimum(((times - low) / size * SAMPLES).astype(int), SAMPLES - 1)


def _keys(written: str, bands: int, rows: int) -> np.ndarray:
    """Band keys of a fingerprint: of the longest time FIRST * 2**level that it fills, and of half of that if it fills little more,
    as a text that is a quarter shorter would have those only."""
    x = _VALUE[np.frombuffer(written.encode(), np.uint8)]
    last = len(x) // SAMPLES - 1
    filled = int((x[last * SAMPLES :] < 16).sum())
    end = filled if not last else (FIRST << (last - 1)) * (1 + filled / SAMPLES)
    level = int(np.floor(np.log2(max(end, 1) / FIRST)))
    if level < SHORTEST:
        return np.array([_short_key(x)], U)
    out = []
    for k in [level, *([level - 1] if end < FIRST * 2.0**level * 4 / 3 and level > SHORTEST else [])]:
        if ("places", k, bands, rows) not in _kept:
            _kept["places", k, bands, rows] = _places(k, bands, rows)
        own = x[_kept["places", k, bands, rows]].astype(U)
        key = np.zeros(bands, U)
        for r in range(rows):
            key = key * U(17) + own[:, r]
        out.append(mix(key * U(1 << 16) + U((k - SHORTEST) << 8) + np.arange(bands, dtype=U) + U(1 << 62)))
    return np.concatenate(out)


def _short_key(x: np.ndarray) -> int:
    key = 0
    for v in x[x < 16].tolist():
        key = (key * 17 + v + 1) % 2**64
    return int(mix(np.array([key], U))[0])


def _links(written: list[str], other: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Links (p, q) between non-empty fingerprints that reach ``least``, thinned to a spanning forest; with ``other`` only
    between those where it is set and those where it isn't."""
    width = max(map(len, written))
    x = np.full((len(written), width), 16, np.uint8)
    for row, w in zip(x, written, strict=True):
        row[: len(w)] = _VALUE[np.frombuffer(w.encode(), np.uint8)]
    _, weights = sample_times(FIRST << (width // SAMPLES - 1) if width > SAMPLES else FIRST)
    alone = np.ones(len(written), bool)
    out = []
    for first in range(len(written)):
        queue = [first] if alone[first] else []
        alone[first] = False
        while queue:
            p = queue.pop()
            rest = np.flatnonzero(alone if other is None else alone & (other != other[p]))
            counted = (x[rest] < 16) | (x[p] < 16)
            share = (counted & (x[rest] == x[p])) @ weights / (counted @ weights)
            near = rest[(share - 1 / 16) / (15 / 16) >= least]
            alone[near] = False
            queue += near.tolist()
            out += [(p, q) for q in near.tolist()]
    return out


def _near(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose fingerprints reach ``least``."""
    kind = prints.schema["doc_id"].dataType.simpleString()
    one = prints.select(F.col("doc_id").alias("a"), F.col("fingerprint").alias("x"))
    two = prints.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [likeness(x, y) >= least for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def groups(printed: DataFrame, least: float = 0.75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, component_id) of fingerprints (doc_id, fingerprint) by bit-sampled banding and verification.

    A band key is ``rows`` samples, drawn evenly from the time that a fingerprint fills.  Equal fingerprints are one node.  The
    members of a key are first verified against its least member, by the likeness of whole fingerprints; keys whose
    members are then in different components have all their pairs verified, in pairs of blocks, keys with the same
    members once.  So all near pairs that share a key are in one component, whatever the size of a key.
    """
    spark, kind = printed.sparkSession, printed.schema["doc_id"].dataType.simpleString()
    digest = [F.xxhash64("fingerprint", *(F.lit(i) for i in range(n))).alias(x) for n, x in enumerate(("h1", "h2"))]
    every = materialize(printed.select("doc_id", "fingerprint", *digest), "prints", "zstd", ("doc_id", partitions_for(spark)))
    prints = every.where("doc_id is not null and fingerprint <> ''")
    folded = materialize(prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "folded")
    # by the id alone, whose buckets the prints lie in: they are never shuffled
    own = prints.join(folded.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "fingerprint")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_keys(x, bands, rows) for x in batch.column("fingerprint").to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            keys = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(keys)], ["node", "key"])

    dealt = own.mapInArrow(spread, f"node {kind}, key long")
    low = dealt.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
    held = materialize(dealt.join(low, "key"), "held")
    found = materialize(_near(held.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), own, least), "near")
    roots = components(found, "edit")
    labelled = held.join(roots.withColumnRenamed("root", "label"), "node", "left").select("node", "key", F.coalesce("label", "node").alias("label"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(salt))).alias(x) for x, salt in (("x", 1), ("y", 2))]
    open_ = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("one"), F.max("label").alias("two"), *marks).where("one <> two and n > 2")
    open_ = materialize(open_.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "open")
    if not open_.isEmpty():
        found = found.union(_all_pairs(held.select("node", "key").join(open_, "key"), own, least))
        roots = components(found, "edit")
    roots = roots.withColumnRenamed("node", "rep")
    of = folded.withColumnRenamed("node", "rep").join(roots, "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("component_id"))
    some = prints.select("doc_id", "h1", "h2").join(of, ["h1", "h2"]).select("doc_id", "component_id")
    return some.union(every.where("doc_id is null or coalesce(fingerprint, '') = ''").select("doc_id", F.col("doc_id").alias("component_id")))


def _all_pairs(held: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """Links (a, b) among all members of each key of ``held`` (node, key, n), thinned to forests; small keys share tasks."""
    kind = own.schema["doc_id"].dataType.simpleString()

    def verify(rows: pa.Table) -> pa.Table:
        key, i, j, block = (rows.column(c).to_numpy() for c in ("key", "i", "j", "block"))
        order = np.lexsort((block, j, i, key))
        parts = [x[order] for x in (key, i, j)]
        cut = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in parts], 0)))
        node, written = rows.column("node").to_pylist(), rows.column("fingerprint")
        a, b = [], []
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            one = order[x:y]
            other = None if i[one[0]] == j[one[0]] else block[one] == j[one[0]]
            for p, q in _links([written[int(k)].as_py() for k in one], other, least):
                a.append(node[one[p]])
                b.append(node[one[q]])
        return pa.table({"a": pa.array(a, rows.schema.field("node").type), "b": pa.array(b, rows.schema.field("node").type)})

    tasks = max(partitions_for(held.sparkSession), held.count() // 4000)
    held = held.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    held = held.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    held = held.select("node", "key", "blocks", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    held = held.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(tasks))).otherwise(F.xxhash64("key", "i", "j")))
    work = held.join(own.withColumnRenamed("doc_id", "node"), "node").select("task", "key", "i", "j", "block", "node", "fingerprint")
    return materialize(work.groupBy("task").applyInArrow(verify, f"a {kind}, b {kind}"), "links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compare_next(docs, materialize(groups(fingerprint(docs)), "groups"))
