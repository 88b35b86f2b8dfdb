"""Language-model scoring with a sharded Elias-Fano n-gram trie.

Model: interpolated trigrams.  A text is (begin) t1 ... tn (end), and

    p(w | u v) = q(u v w) + l(u v) * (q(v w) + l(v) * p1(w))
    q(x w) = c(x w) / (c(x) + m(c(x))),  l(x) = m(c(x)) / (c(x) + m(c(x))),  m(c) = 4 c**0.7
    p1(w) = c(w) / (N + V') for a known word, V' / (N + V') for an unknown one

with counts c and N training tokens; V' estimates the distinct training words (HyperLogLog over all of them), so the share of
unknown words is Witten and Bell's.  q and l are quantised to codes that round down, so the model does not sum to over 1, but for words whose 32 bits coincide
within a context: they share the sum of their counts, with a chance of children / 2**32 for each.

Execution, with nothing of the corpus's size on the driver or in a broadcast:

1.  Texts become blocks of word indices over a block's own sorted vocabulary, written once.
2.  Every block sends each shard its distinct windows (u, v, w) with their training counts, sorted and split into levels.  The
    shard follows from u; for the at most ``HOT`` words with over 1/HOT of the training tokens it follows from (u, v), and if
    both are such words from (u, v, w), so that no shard gets a frequent word's windows whole.  Counts of those words
    and of their pairs with each other (at most HOT * HOT) are summed beforehand and sent to all shards.
3.  A shard merges the counts, builds its trie (``elias_fano.Trie``, memory-mapped) and looks every block's windows up in
    it, level by level, each word by successor search within its context's children; codes go back to the blocks.
4.  A block puts the codes back in the places of its tokens and sums them up for each document.

A shard's blocks are looked up together, so a message costs little besides its bytes; a block sends messages to the shards that
its windows belong to, at most one for each window.

Nulls: a null text is empty and consists of its end; a null ``train`` is not trained on.  Rows that repeat count each time.
Without training rows all words are unknown with probability 1; an empty table has no rows.  Texts are scored whole, however
long, and columns besides doc_id and text are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .base import chunks, materialize, partitions_for, remainder, table
from .elias_fano import VALUES, Trie, quantise
from .textscan import U, mix, ranges

HOT, BLOCK_BYTES, SHARD_WINDOWS, REGISTERS = 256, 8 << 20, 1_000_000, 12
#: Windows that a shard looks up at once, of as many blocks as it takes.
AT_ONCE = 1 << 18
_NONE, _BEGIN, _END = 0, 1, 2  # in place of word hashes, and their indices in every vocabulary


def _damp(c: np.ndarray) -> np.ndarray:
    return 4.0 * np.maximum(c, 1) ** 0.7


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string: a header of dtypes and sizes, then their bytes."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    raw = b"".join([len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + n
    for part in raw[4 : 4 + n].decode().split(";"):
        kind, size = part.split(",")
        dtype = np.dtype(kind)
        out.append(np.frombuffer(raw, dtype, int(size), at))
        at += int(size) * dtype.itemsize
    return out


# -- blocks ---------------------------------------------------------------------------------------------------------


def _planes(a: np.ndarray) -> np.ndarray:
    """The bytes of numbers, first all lowest ones, then the next: they compress better apart."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).ravel()


def _whole(planes: np.ndarray, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words of each text), by small slices: hashing needs many times a slice's bytes."""
    hashes, counts = [np.zeros(0, U)], []
    for part in chunks(iter([batch]), most=1 << 20):
        w = textscan.words(part.column("text"))
        hashes.append(textscan.word_hashes(w))
        counts.append(np.diff(w.first))
    return np.concatenate(hashes), np.concatenate(counts)


def blocks(docs: DataFrame, train: Column) -> DataFrame:
    """(block, tokens, ids, data): data holds the vocabulary, the word indices with begin and end of each text, the texts' sizes
    and whether each is trained on."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, most=BLOCK_BYTES):
            h, counts = _hashes(batch)
            sizes = counts + 2
            begin = np.cumsum(sizes) - sizes
            flat = np.empty(int(sizes.sum()), U)
            flat[begin], flat[begin + sizes - 1] = _BEGIN, _END
            flat[ranges(begin + 1, counts)] = h
            vocabulary, index = np.unique(np.append(np.array([_NONE, _BEGIN, _END], U), flat), return_inverse=True)
            own = batch.column("train").fill_null(False).to_numpy(zero_copy_only=False)
            # Words go by their frequency in the block: the higher bytes of most are 0.
            order = np.argsort(-np.bincount(index[3:], minlength=len(vocabulary)), kind="stable").astype(np.uint32)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            data = _pack(_planes(np.diff(vocabulary, prepend=U(0))), _planes(order), _planes(rank[index[3:]]), sizes.astype(np.uint32), own)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(batch.schema.field("doc_id").type)), pa.array([data], pa.binary())], ["block", "tokens", "ids", "data"])
            number += 1

    return docs.select("doc_id", "text", train.alias("train")).mapInArrow(run, f"block long, tokens long, ids array<{kind}>, data binary")


class Hot(NamedTuple):
    """Frequent words (ascending hashes), and the training counts of them and of their pairs, by keys made of places."""

    words: np.ndarray
    counts: np.ndarray
    pairs: np.ndarray  # ascending: place of u * HOT + place of v
    pair_counts: np.ndarray

    def place(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def correct(self, words: np.ndarray, counts: np.ndarray, parent: np.ndarray, second: np.ndarray, pair_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words, and of pairs (place in words, 32 bits of the other), with those of frequent words and of their
        pairs with each other put in: a shard sees but a part of them."""
        place = self.place(words)
        if len(self.counts):
            counts = np.where(place >= 0, self.counts[place], counts)
        if len(self.pairs) and len(parent):
            short = _short(self.words).astype(np.int64)
            order = np.argsort(short, kind="stable")
            near = np.minimum(np.searchsorted(short[order], second), len(short) - 1)
            other = np.where(short[order][near] == second, order[near], -1)
            key = np.where((place[parent] >= 0) & (other >= 0), place[parent] * HOT + other, -1)
            i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            pair_counts = np.where(self.pairs[i] == key, self.pair_counts[i], pair_counts)
        return counts, pair_counts


def _short(words: np.ndarray) -> np.ndarray:
    """32 bits that stand for a word after one or two others."""
    return np.where(words <= _END, words, words >> U(32)).astype(np.uint32)


def _trained(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary, index, sizes, whether each token is in a training text)."""
    steps, order, ranks, sizes, own = _unpack(data)
    index = _whole(order, np.uint32).astype(np.int64)[_whole(ranks, np.uint32)]
    return np.cumsum(_whole(steps, np.uint64)), index, sizes.astype(np.int64), np.repeat(own, sizes.astype(np.int64))


def frequent(skeleton: DataFrame) -> tuple[Hot, int, int]:
    """(frequent words, training tokens, estimate of the distinct training words)."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(1 << REGISTERS, np.int64)
        tokens, seen = 0, {}
        for batch in batches:
            for data in batch.column("data"):
                vocabulary, index, _, trained = _trained(data.as_py())
                counts = np.bincount(index[trained], minlength=len(vocabulary))
                counts[[_NONE, _BEGIN]] = 0
                tokens += int(counts.sum())
                for i in np.flatnonzero(counts * 2 * HOT >= max(1, counts.sum())).tolist():
                    seen[int(vocabulary[i])] = seen.get(int(vocabulary[i]), 0) + int(counts[i])
                h = mix(vocabulary[counts > 0] + U(0x51ED27))
                rest = h << U(REGISTERS) | U(1 << (REGISTERS - 1))
                zeros = 64 - np.ceil(np.log2(rest.astype(np.float64))).astype(np.int64)  # leading zeros
                np.maximum.at(top, (h >> U(64 - REGISTERS)).astype(np.int64), np.clip(zeros, 0, 64) + 1)
        keys = ["n", *(f"r{i}" for i in np.flatnonzero(top).tolist()), *(f"w{k}" for k in seen)]
        values = [tokens, *top[top > 0].tolist(), *seen.values()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.int64())], ["key", "value"])

    found = skeleton.mapInArrow(survey, "key string, value long").groupBy("key").agg(F.sum("value").alias("total"), F.max("value").alias("most"))
    kinds = F.substring("key", 1, 1)
    tokens = found.where("key = 'n'").agg(F.sum("total")).first()[0] or 0
    registers = [r["most"] for r in found.where(kinds == "r").collect()]  # at most 2**REGISTERS rows
    words = [int(r["key"][1:]) for r in found.where((kinds == "w") & (F.col("total") * HOT >= tokens)).orderBy(F.desc("total"), "key").limit(HOT - 1).collect()]
    words = sorted([_BEGIN, *words])  # all texts begin alike
    m = 1 << REGISTERS
    empty = m - len(registers)
    raw = 0.7213 / (1 + 1.079 / m) * m * m / (sum(2.0**-r for r in registers) + empty)
    distinct = round(m * np.log(m / empty) if empty and raw <= 2.5 * m else raw)
    none = np.zeros(0, np.int64)
    hot = Hot(np.array(words, U), np.zeros(len(words), np.int64), none, none)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double = np.zeros(HOT + 1, np.int64), np.zeros(HOT * HOT, np.int64)
        for batch in batches:
            for data in batch.column("data"):
                vocabulary, index, sizes, trained = _trained(data.as_py())
                place = hot.place(vocabulary)[index]
                single += np.bincount(place[trained] + 1, minlength=HOT + 1)
                last = np.zeros(len(index), bool)
                last[np.cumsum(sizes) - 1] = True
                a = np.flatnonzero(trained[:-1] & ~last[:-1] & (place[:-1] >= 0) & (place[1:] >= 0))
                double += np.bincount(place[a] * HOT + place[a + 1], minlength=HOT * HOT)
        keys = np.append(np.flatnonzero(single[1:]), HOT + np.flatnonzero(double))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.append(single[1:][single[1:] > 0], double[double > 0]))], ["key", "value"])

    if tokens:
        got = sorted((r["key"], r["n"]) for r in skeleton.mapInArrow(count, "key long, value long").groupBy("key").agg(F.sum("value").alias("n")).collect())  # at most HOT + HOT * HOT rows
        single = dict(got)
        counts = np.array([single.get(i, 0) for i in range(len(words))], np.int64)
        pairs = np.array([x for x in got if x[0] >= HOT], np.int64).reshape(-1, 2)
        hot = Hot(hot.words, counts, pairs[:, 0] - HOT, pairs[:, 1])
    return hot, int(tokens), int(distinct)


# -- windows --------------------------------------------------------------------------------------------------------


class Windows(NamedTuple):
    """A block's distinct windows, by shard and within it ascending; ``back``: the window of each token."""

    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    trained: np.ndarray
    cuts: np.ndarray  # where the shards start, and the end
    back: np.ndarray


def _windows(vocabulary: np.ndarray, index: np.ndarray, sizes: np.ndarray, trained: np.ndarray, hot: Hot, shards: int) -> Windows:
    n = len(vocabulary)
    ends = np.cumsum(sizes) - 1
    v, w = np.append(index[1:], 0), np.append(index[2:], [0, 0])
    v[ends] = _NONE
    w[ends] = _NONE
    w[ends - 1] = _NONE
    if n < 1 << 21:
        key, back = np.unique(index << 42 | v << 21 | w, return_inverse=True)
        u, v, w = key >> 42, key >> 21 & (1 << 21) - 1, key & (1 << 21) - 1
    else:
        pair, at = np.unique(index * n + v, return_inverse=True)
        key, back = np.unique(at * n + w, return_inverse=True)
        u, v, w = pair[key // n] // n, pair[key // n] % n, key % n
    counts = np.bincount(back, trained, len(key)).astype(np.int64)
    often = hot.place(vocabulary) >= 0
    name = vocabulary[u]
    name = np.where(often[u], name + mix(vocabulary[v]), name)
    name = np.where(often[u] & often[v], name + mix(vocabulary[w] + U(3)), name)
    shard = (mix(name) % U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Windows(u[order], v[order], w[order], counts[order], np.searchsorted(shard[order], np.arange(shards + 1)), place[back])


class Levels(NamedTuple):
    """Where new contexts begin in a block's windows, and those of each shard: contexts[cuts[s]:cuts[s + 1]]."""

    one: np.ndarray  # windows that begin a new u, or a shard
    two: np.ndarray  # windows that begin a new (u, v), or a shard
    cuts1: np.ndarray
    cuts2: np.ndarray


def _levels(x: Windows) -> Levels:
    first = np.append(True, x.u[1:] != x.u[:-1])[: len(x.u)]
    first[x.cuts[:-1][x.cuts[:-1] < len(x.u)]] = True
    one, two = np.flatnonzero(first), np.flatnonzero(first | np.append(True, x.v[1:] != x.v[:-1])[: len(x.u)])
    return Levels(one, two, np.searchsorted(one, x.cuts), np.searchsorted(two, x.cuts))


def messages(skeleton: DataFrame, hot: Hot, shards: int) -> DataFrame:
    """(shard, block, data): each block's windows for each shard that it has some for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                vocabulary, *rest = _trained(data.as_py())
                x = _windows(vocabulary, *rest, hot, shards)
                short = _short(vocabulary)
                y = _levels(x)
                words, second, third = vocabulary[x.u[y.one]], short[x.v[y.two]], short[x.w]
                children, children2 = np.diff(np.searchsorted(y.two, y.one), append=len(y.two)), np.diff(y.two, append=len(x.u))
                number, out = np.flatnonzero(np.diff(x.cuts)), []
                for s in number.tolist():
                    i, j, k = (slice(int(c[s]), int(c[s + 1])) for c in (y.cuts1, y.cuts2, x.cuts))
                    small = (c.astype(np.min_scalar_type(int(c.max()))) for c in (children[i], children2[j], x.trained[k]))
                    out.append(_pack(words[i], second[j], _planes(third[k]), *small))
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([block] * len(number), pa.int64()), pa.array(out, pa.binary())], ["shard", "block", "data"])

    return skeleton.mapInArrow(run, "shard int, block long, data binary")


def _received(data: bytes) -> list[np.ndarray]:
    part = _unpack(data)
    part[2] = _whole(part[2], np.uint32)
    return part


def build(parts: list[list[np.ndarray]], hot: Hot) -> Trie:
    """The trie of the windows that were counted in training: parts of (words, seconds, thirds, children, children, counts)."""
    u = np.concatenate([np.repeat(np.repeat(p[0], p[3]), p[4]) for p in parts])
    v = np.concatenate([np.repeat(p[1], p[4]) for p in parts])
    w = np.concatenate([p[2] for p in parts])
    c = np.concatenate([p[5].astype(np.int64) for p in parts])
    keep = c > 0
    u, v, w, c = u[keep], v[keep].astype(np.int64), w[keep].astype(np.int64), c[keep]
    words, at = np.unique(u, return_inverse=True)
    second, at2 = np.unique(at << 32 | v, return_inverse=True)
    third, at3 = np.unique(at2 << 32 | w, return_inverse=True)
    c1, c2, c3 = np.bincount(at, c, len(words)), np.bincount(at2, c, len(second)), np.bincount(at3, c, len(third))
    parent, parent2 = second >> 32, third >> 32
    c1, c2 = hot.correct(words, c1, parent, second & 0xFFFFFFFF, c2)
    m1, m2 = _damp(c1), _damp(c2)
    codes = {"pair": quantise(c2 / (c1 + m1)[parent]), "rest2": quantise(m2 / (c2 + m2)), "triple": quantise(c3 / (c2 + m2)[parent2])}
    begin = np.searchsorted(parent, np.arange(len(words) + 1))
    begin2 = np.searchsorted(parent2, np.arange(len(second) + 1))
    return Trie(words, second, third, begin, begin2, c1.astype(np.int64), codes)


def look_up(trie: Trie, part: list[np.ndarray], hot: Hot) -> list[np.ndarray]:
    """For a part's words their counts, for its pairs and triples their codes."""
    words, second, third, children, children2, _ = part
    children, children2 = children.astype(np.int64), children2.astype(np.int64)
    one = trie.nodes(words)
    parent = np.repeat(np.arange(len(words)), children)
    two = trie.pairs(one[parent], second)
    three = trie.triples(np.repeat(two, children2), third)

    def at(values: np.ndarray, place: np.ndarray, other: int) -> np.ndarray:
        return np.where(place >= 0, values[np.maximum(place, 0)], other).astype(values.dtype) if len(values) else np.full(len(place), other, values.dtype)

    # frequent words and pairs may be missing in this shard and yet have been counted elsewhere
    count, known = hot.correct(words, at(trie.count, one, 0), parent, second.astype(np.int64), np.full(len(parent), -1, np.int64))
    c1, m1, m2 = count[parent], _damp(count)[parent], _damp(known)
    pair = np.where(known > 0, quantise(np.maximum(known, 0) / (c1 + m1)), at(trie.codes["pair"], two, 0))
    rest2 = np.where(known > 0, quantise(m2 / (np.maximum(known, 0) + m2)), at(trie.codes["rest2"], two, 1))
    return [count, pair, rest2, at(trie.codes["triple"], three, 0)]


def answers(trie: Trie, parts: list[list[np.ndarray]], hot: Hot) -> Iterator[bytes]:
    """The answer to each part, those of about AT_ONCE windows looked up together."""
    first = 0
    while first < len(parts):
        last, windows = first, 0
        while last < len(parts) and (windows == 0 or windows + len(parts[last][2]) <= AT_ONCE):
            windows += len(parts[last][2])
            last += 1
        own = parts[first:last]
        count, *codes = look_up(trie, [np.concatenate(x) for x in zip(*own, strict=True)], hot)
        ends = [np.cumsum([len(p[k]) for p in own]) for k in (0, 1, 1, 2)]
        for i, p in enumerate(own):
            c, *rest = (x[e[i] - len(p[k]) : e[i]] for x, e, k in zip((count, *codes), ends, (0, 1, 1, 2), strict=True))
            yield _pack(c.astype(np.min_scalar_type(int(c.max()))), *map(_planes, rest))
        first = last


def replies(sent: DataFrame, hot: Hot) -> DataFrame:
    """(block, shard, data): the answers of each shard; under block -1 - shard, how many words it alone was trained on."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [_received(x.as_py()) for x in rows.column("data")]
        trie = build(parts, hot)
        shard = rows.column("shard")[0].as_py()
        own = int((~np.isin(trie.words.get(np.arange(trie.words.n)), hot.words)).sum())  # words that no other shard has
        out = [*answers(trie, parts, hot), _pack(np.array([own]))]
        return pa.table({"block": pa.array([*rows.column("block").to_pylist(), -1 - shard], pa.int64()), "shard": pa.array([shard] * len(out), pa.int32()), "data": pa.array(out, pa.binary())})

    return sent.groupBy("shard").applyInArrow(run, "block long, shard int, data binary")


# -- scores ---------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, train: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document; ``train`` says which are learnt."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    skeleton = materialize(blocks(docs, train), "blocks", buckets=("block", partitions_for(docs.sparkSession)))
    hot, tokens, distinct = frequent(skeleton)
    shards = max(partitions_for(docs.sparkSession), (skeleton.agg(F.sum("tokens")).first()[0] or 0) // SHARD_WINDOWS)
    back = replies(messages(skeleton, hot, shards), hot)
    known, unknown = (1 / (tokens + distinct), distinct / (tokens + distinct)) if tokens else (0.0, 1.0)
    columns = f"doc_id {kind}, n_tokens long, n_known long, logs double, score double, words long"

    def run(own: pa.Table, rows: pa.Table) -> pa.Table:
        shard = rows.column("shard").to_numpy()
        of_id = own.schema.field("ids").type.value_type
        if not own.num_rows:
            n = int(_unpack(rows.column("data")[0].as_py())[0][0])
            return pa.table({"doc_id": pa.nulls(1, of_id), "n_tokens": pa.nulls(1, pa.int64()), "n_known": pa.nulls(1, pa.int64()), "logs": pa.nulls(1, pa.float64()), "score": pa.nulls(1, pa.float64()), "words": pa.array([n], pa.int64())})
        vocabulary, index, sizes, trained = _trained(own.column("data")[0].as_py())
        x = _windows(vocabulary, index, sizes, trained, hot, shards)
        n = len(x.u)
        count, pair, rest2, triple = np.zeros(n, np.int64), *(np.zeros(n, np.uint16) for _ in range(3))
        y = _levels(x)
        of_one, of_two = (np.repeat(np.arange(len(f)), np.diff(f, append=n)) for f in (y.one, y.two))
        for s, data in zip(shard.tolist(), rows.column("data"), strict=True):
            a, b = int(x.cuts[s]), int(x.cuts[s + 1])
            got, *codes = _unpack(data.as_py())
            codes = [_whole(c, np.uint16) for c in codes]
            one, two = of_one[a:b] - y.cuts1[s], of_two[a:b] - y.cuts2[s]
            count[a:b], pair[a:b], rest2[a:b], triple[a:b] = got[one], codes[0][two], codes[1][two], codes[2]
        rest = quantise(_damp(count) / (count + _damp(count)))
        count, rest, pair, rest2, triple = (c[x.back] for c in (count, rest, pair, rest2, triple))
        begin = np.cumsum(sizes) - sizes
        inner = np.ones(len(index), bool)
        inner[begin] = False
        at = np.flatnonzero(inner)  # every token but the begins is scored
        c = count[at]
        p = VALUES[pair[at - 1]] + VALUES[rest[at - 1]] * np.where(c > 0, c * known, unknown)
        second = ~np.isin(at, begin + 1)  # the first word has one word of context only
        far = at[second] - 2
        p[second] = VALUES[triple[far]] + VALUES[rest2[far]] * p[second]
        doc, m = np.repeat(np.arange(len(sizes)), sizes - 1), len(sizes)
        sums = [np.bincount(doc, z, m) for z in (c > 0, np.log10(c + 0.5), np.log10(np.maximum(p, 1e-300)))]
        ids = own.column("ids")[0].values
        return pa.table({"doc_id": ids, "n_tokens": pa.array(sizes - 1, pa.int64()), "n_known": pa.array(sums[0].astype(np.int64)), "logs": pa.array(sums[1]), "score": pa.array(sums[2]), "words": pa.nulls(m, pa.int64())})

    # The blocks lie in buckets by their number and stay where they are; only the answers move.
    done = materialize(skeleton.select("block", "ids", "data").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, columns), "scores")
    words = (done.agg(F.sum("words")).first()[0] or 0) + int((hot.counts[1:] > 0).sum())  # the first is the begin
    whole = float(np.log10(tokens + 0.5 * (words + 1)))
    return done.where("words is null").select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * whole).alias("base_score"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, F.coalesce(remainder(F.col("doc_id"), 5) != 1, F.lit(False))).withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False)))
