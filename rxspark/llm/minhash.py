"""Near-duplicates by min-max hashing, with every link confirmed on full shingle sets.

1.  Each text becomes its set of distinct word shingles (64-bit hashes), a 128-bit digest of the set and ``BANDS`` band
    keys.  A permutation gives two signature values, the minimum and the maximum of the permuted set, so that half as
    many permutations as values are evaluated; both are unbiased estimates of the Jaccard similarity.  Two large sets
    at exactly 0.75 share a band with probability 1 - (1 - 0.75**6)**48 > 0.9999, and closer ones almost surely.  On small
    sets minimum and maximum depend on each other (unions of 8 shingles: 0.9997), so sets of up to ``SMALL`` shingles, and
    those that they can link to, have prefix keys besides: the rarest n - ceil(0.75 n) + 1 of a set's n shingles.  Two
    sets that reach 0.75 have one of these in common, whatever the order, as long as it is the same for all.
2.  Equal sets are folded into one representative (the least doc_id): copies cost nothing further.
3.  Representatives that share a band key are joined into candidate groups (connected components over band keys; each
    key links its members to its least member, so a key with m members gives m links, not m * m).
4.  Inside a group the components are those of all pairs, whatever its size, decided on full sets.  Groups of up to ``BLOCK``
    sets are compared whole, some to a task.  A larger one is cut into blocks, and each block is compared with the
    first and in itself: a group of m sets sends 2 m, and where most link, as in clusters of copies, one component is nearly
    all of it.  Only pairs of different components are still open.  They are decided in the way that sends fewer sets, as counted
    for each group: the nodes outside the largest component against all of the group, in blocks, leaving out sizes too far
    apart; or those that share a prefix key, leaving out keys whose nodes are in one component.  Both find every link.
    A task multiplies 0/1 matrices and links each set with the least of its component there: components are the same as
    with all links, and fewer rows leave than sets went in.
5.  Components of the confirmed links give ``component_id``.

A null text has no words.  A null doc_id takes part in nothing: its component is null and it is kept.  Rows that repeat
a doc_id share its component.  ``stage`` tells rows apart also where ids are null or repeated, and keeps exactly one row of
each group.  An empty table gives an empty one; other columns of the documents are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .base import among, chunks, materialize, partitions_for, release, table
from .textscan import U, mix

WORDS, PERCENT, ROWS, BANDS = 5, 75, 6, 48
#: Sets that are compared at once with each other or with as many others, and the bytes that they may have.
BLOCK, BLOCK_BYTES, SMALL = 512, 4 << 20, 64
#: Shingles that come last in prefixes, as many texts have them: this many at most, each of over 1/OFTEN of the texts.
FREQUENT, OFTEN = 4096, 2000
_STEP = 1 << 17


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**64, n, dtype=U), rng.integers(0, 2**64, n, dtype=U) | U(1)


def signatures(shingles: np.ndarray, offsets: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """Band keys, a row for each non-empty set: shingles[offsets[i]:offsets[i + 1]], none of them empty."""
    n = len(offsets) - 1
    permutations = -(-rows * bands // 2)
    flip, factor = _constants(permutations)
    values = np.empty((n, 2 * permutations), U)
    at = 0
    while at < n:  # runs of sets that stay in the processor's cache
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _STEP, side="right")) - 1)
        own, begin = shingles[offsets[at] : offsets[stop]], offsets[at:stop] - offsets[at]
        work = np.empty_like(own)
        for p in range(permutations):
            np.bitwise_xor(own, flip[p], out=work)
            np.multiply(work, factor[p], out=work)
            values[at:stop, p] = np.minimum.reduceat(work, begin)
            values[at:stop, permutations + p] = np.maximum.reduceat(work, begin)
        at = stop
    weights = np.random.default_rng(8).integers(0, 2**64, (rows, bands), dtype=U) | U(1)
    keys = np.zeros((n, bands), U)
    for r in range(rows):
        keys += values[:, r * bands : (r + 1) * bands] * weights[r]
    return mix(keys)


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, offsets by text), ascending within a text."""
    w = textscan.words(batch.column("text"))
    raw, offsets = textscan.shingle_hashes(textscan.word_hashes(w), w.first, WORDS)
    parts = [np.unique(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else raw), np.concatenate([[0], np.cumsum(sizes)])


def frequent(docs: DataFrame) -> np.ndarray:
    """Hashes of shingles that many texts have, ascending.  Which ones are found changes costs alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            shingles, counts = np.unique(_sets(batch)[0], return_counts=True)
            often = counts > 1 + batch.num_rows // OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(np.append(shingles[often].view(np.int64), 0)), pa.array(np.append(counts[often], 0)), pa.array([0] * int(often.sum()) + [batch.num_rows], pa.int64())], ["shingle", "n", "texts"])

    found = docs.select("text").mapInArrow(run, "shingle long, n long, texts long").groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    found = materialize(found.where("n > 1 or texts > 0"), "frequent")
    texts = found.agg(F.sum("texts")).first()[0] or 0
    rows = found.where(F.col("n") * OFTEN > texts).orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()  # at most FREQUENT rows
    return np.sort(np.array([x["shingle"] for x in rows], np.int64).view(U))


def prefixes(shingles: np.ndarray, offsets: np.ndarray, last: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix keys, offsets by set): the first n - ceil(percent n) + 1 of each set's shingles, those in ``last`` at the end."""
    sizes = np.diff(offsets)
    who = np.repeat(np.arange(len(sizes)), sizes)
    common = np.isin(shingles, last)
    order = np.lexsort((shingles, common, who))
    lengths = np.where(sizes > 0, sizes + (-percent * sizes) // 100 + 1, 0)
    return shingles[order][textscan.ranges(offsets[:-1], lengths)], np.concatenate([[0], np.cumsum(lengths)])


def fingerprint(docs: DataFrame, last: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, prefix); an empty set has a null digest and null bands, prefix is null for large
    sets too."""
    most = SMALL * 100 // percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            shingles, offsets = _sets(batch)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            begin = offsets[:-1][full]
            keys = signatures(shingles, np.append(begin, offsets[-1]))
            halves = [np.add.reduceat(mix(shingles ^ U(salt)), begin) if len(full) else np.zeros(0, U) for salt in (0x5DEECE66D, 0xB5297A4D3F84D5B5)]
            raw = np.stack(halves, 1).astype("<u8").tobytes()
            digest, bands, prefix = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
            few = np.flatnonzero((sizes > 0) & (sizes <= most))
            first, cut = prefixes(shingles[textscan.ranges(offsets[:-1][few], sizes[few])], np.concatenate([[0], np.cumsum(sizes[few])]), last, percent)
            for j, i in enumerate(few.tolist()):
                prefix[i] = first[cut[j] : cut[j + 1]].view(np.int64)
            rows = keys.view(np.int64)
            for j, i in enumerate(full.tolist()):
                digest[i], bands[i] = raw[16 * j : 16 * j + 16], rows[j]
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, prefix array<long>")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node reachable.

    Each round points every node at its least neighbour, follows the pointers once more, and replaces links by links
    between the nodes pointed at; links inside one go, so that links shrink fast.  At least half of the nodes that still
    have links lose them in a round.  Minima are combined before they are shuffled, joins on a node with very many links
    are split by adaptive execution, and each round's tables are written, so lineage stays short.
    """

    def straight(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    edges = materialize(links.where("a <> b").select(*straight("a", "b")).distinct(), name)
    rounds = []
    while not edges.isEmpty():
        lows = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a")).groupBy("node").agg(F.min("near").alias("near"))
        up = materialize(lows.select("node", F.least("node", "near").alias("up")), name)
        up = materialize(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")), name)
        left, right = (up.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in ("a", "b"))
        edges = materialize(edges.join(left, "a").join(right, "b").where("up_a <> up_b").select(*straight("up_a", "up_b")).distinct(), name)
        rounds.append(up)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds.pop().withColumnRenamed("up", "root")
    while rounds:
        later = roots.select(F.col("node").alias("up"), "root")
        roots = materialize(rounds.pop().join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root")), name)
    return roots


def _forest(sets: list[np.ndarray], split: int | None, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between sets that reach ``percent``, thinned to a spanning forest; with ``split`` only between the
    first ``split`` sets and the others."""
    if len(sets) == 2:
        a, b = sets
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (len(a) + len(b) - both) else []
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.append(True, flat[1:] != flat[:-1])
    word = np.cumsum(new) - 1
    often = np.bincount(word)
    keep = often[word] > 1  # a shingle of one set links nothing
    word, who = (np.cumsum(often > 1) - 1)[word[keep]], who[keep]
    shared = np.zeros((len(sets), len(sets)))
    width = 1 << 14
    bounds = np.searchsorted(word, np.arange(0, (int(word[-1]) + 1 if len(word) else 0) + width, width))
    for k in range(len(bounds) - 1):
        a, b = bounds[k], bounds[k + 1]
        if a < b:
            m = np.zeros((len(sets), width), np.float32)
            m[who[a:b], word[a:b] - k * width] = 1
            shared += m @ m.T
    link = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    if split is not None:
        link[:split, :split] = link[split:, split:] = False
    link = np.triu(link, 1)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(link), strict=True):
        x, y = find(int(i)), find(int(j))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(i), int(j)))
    return out


def _sets_of(docs: DataFrame) -> DataFrame:
    """(node, shingles): the set of each text, as bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            shingles, offsets = _sets(batch)
            raw, at = shingles.astype("<u8").tobytes(), (8 * offsets).tolist()
            sets = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, f"node {kind}, shingles binary")


def _stars(links: list[tuple[int, int]], order: list) -> list[tuple[int, int]]:
    """The same components as links of every member with the one that is first in ``order``."""
    near: dict[int, list[int]] = {}
    for p, q in links:
        near.setdefault(p, []).append(q)
        near.setdefault(q, []).append(p)
    out, seen = [], set()
    for k in sorted(near, key=lambda k: order[k]):
        queue = [k] if k not in seen else []
        seen.add(k)
        while queue:
            for other in near[queue.pop()]:
                if other not in seen:
                    seen.add(other)
                    queue.append(other)
                    out.append((other, k))
    return out


def order_of(node) -> tuple:
    """A key that sorts nodes as Spark does: nulls first, structs by their fields."""
    return tuple((x is not None, x if x is not None else 0) for x in (node.values() if isinstance(node, dict) else [node]))


def _decide(work: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of ``work`` (node, task, unit, side): in each unit all pairs are decided, or with sides 1 and 2 those
    between the sides.  A task has one or more units."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        units, sides = (rows.column(c).to_numpy() for c in ("unit", "side"))
        nodes, held = rows.column("node").to_pylist(), rows.column("shingles")
        a, b = [], []
        order = np.lexsort((sides, units))
        cut = np.flatnonzero(np.append(True, units[order][1:] != units[order][:-1]))
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            one = order[x:y]
            first = int((sides[one] == 1).sum())
            if y - x < 2 or sides[one[0]] and first in (0, len(one)):
                continue
            sets = [np.frombuffer(held[int(k)].as_py(), "<u8") for k in one]
            for p, q in _stars(_forest(sets, first if sides[one[0]] else None, percent), [order_of(nodes[int(k)]) for k in one]):
                a.append(nodes[one[p]])
                b.append(nodes[one[q]])
        release()
        return pa.table({"a": pa.array(a, rows.schema.field("node").type), "b": pa.array(b, rows.schema.field("node").type)})

    own = among(docs.select("doc_id", "text"), "doc_id", work.select("node").distinct(), "node")  # others go by the join
    return work.join(_sets_of(own), "node").groupBy("task").applyInArrow(run, f"a {kind}, b {kind}")


def _blocks(sets: Column, shingles: Column) -> Column:
    """Blocks for so many sets with so many shingles in all."""
    return F.ceil(F.greatest(sets / BLOCK, 8 * shingles / BLOCK_BYTES)).cast("int")


def _block(of: str, salt: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(of)).cast("int")


def _first_pairs(members: DataFrame) -> DataFrame:
    """Work of the first round on ``members`` (node, root, size, blocks): small groups whole, some to a task; of a larger one
    every block with the first, all pairs of both."""
    tasks = max(partitions_for(members.sparkSession), members.count() // 500)
    whole = members.where("blocks = 1").select("node", F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task"), F.xxhash64("root").alias("unit"), F.lit(0).alias("side"))
    large = members.where("blocks > 1").withColumn("block", _block("blocks", 1))
    large = large.withColumn("with", F.explode(F.when(F.col("block") == 0, F.expr("sequence(0, blocks - 1)")).otherwise(F.array("block"))))
    unit = F.xxhash64("root", "with")
    return whole.union(large.select("node", unit.alias("task"), unit.alias("unit"), F.lit(0).alias("side")))


def _rest_pairs(open_: DataFrame) -> DataFrame:
    """Work on ``open_`` (node, root, size, class, rest): each node of the rest with every node of its group whose class is next to
    its own, in blocks of both.  Sizes that differ by more than a class are too far apart to link."""
    own_size = F.when(F.col("rest"), F.col("size")).otherwise(0)
    sizes = open_.groupBy("root", "class").agg(_blocks(F.count("*"), F.sum("size")).alias("all_blocks"), _blocks(F.count_if("rest"), F.sum(own_size)).alias("rest_blocks"))
    own = open_.join(sizes, ["root", "class"])
    near = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("near")
    theirs = sizes.select("root", F.col("class").alias("near"), F.col("all_blocks").alias("near_all"), F.col("rest_blocks").alias("near_rest"))
    left = own.where("rest").withColumn("block", _block("rest_blocks", 2)).select("node", "root", "class", "block", near).join(theirs, ["root", "near"])
    left = left.withColumn("other", F.explode(F.expr("sequence(0, near_all - 1)"))).select("node", F.xxhash64("root", "class", "block", "near", "other").alias("unit"), F.lit(1).alias("side"))
    right = own.withColumn("block", _block("all_blocks", 3)).select("node", "root", "class", "block", near).join(theirs, ["root", "near"]).where("near_rest > 0")
    right = right.withColumn("other", F.explode(F.expr("sequence(0, near_rest - 1)"))).select("node", F.xxhash64("root", "near", "other", "class", "block").alias("unit"), F.lit(2).alias("side"))
    return left.union(right).select("node", F.col("unit").alias("task"), "unit", "side")


def _prefix_keys(open_: DataFrame, docs: DataFrame, last: np.ndarray, percent: int) -> tuple[DataFrame, DataFrame]:
    """(held, units) for ``open_`` (node, root, label): held (node, unit), the prefix keys of each node within its group; units (unit,
    root, n, blocks), those that nodes with different labels have in common, once for equal nodes.  Two sets that reach
    ``percent`` have a prefix key in common."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            first, cut = prefixes(*_sets(batch), last, percent)
            who = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(who)), pa.array(first.view(np.int64))], ["node", "key"])

    own = among(docs.select("doc_id", "text"), "doc_id", open_, "node")
    held = own.mapInArrow(run, f"node {kind}, key long").distinct().join(open_.select("node", "root", "label", "size"), "node")
    held = materialize(held.select("node", "root", "label", "size", F.xxhash64("root", "key").alias("unit")), "held")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(salt))).alias(x) for x, salt in (("x", 2), ("y", 3))]
    units = held.groupBy("unit").agg(F.min("root").alias("root"), F.count("*").alias("n"), F.sum("size").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), *marks).where("low <> high")
    units = units.groupBy("root", "n", "size", "x", "y").agg(F.min("unit").alias("unit")).select("unit", "root", "n", _blocks(F.col("n"), F.col("size")).alias("blocks"))
    return held.select("node", "unit"), materialize(units, "units")


def _prefix_pairs(held: DataFrame, units: DataFrame) -> DataFrame:
    """Work on the nodes of each unit, in pairs of blocks; small units share tasks."""
    tasks = max(partitions_for(held.sparkSession), int(units.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) // 500)
    held = held.join(units.select("unit", "blocks"), "unit").withColumn("block", _block("blocks", 4))
    held = held.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(low == high, 0).when(F.col("block") == low, 1).otherwise(2)
    held = held.select("node", F.xxhash64("unit", low, high).alias("unit"), side.alias("side"), "blocks")
    return held.select("node", F.when(F.col("blocks") == 1, F.pmod("unit", F.lit(tasks))).otherwise(F.col("unit")).alias("task"), "unit", "side")


def confirm(groups: DataFrame, sizes: DataFrame, docs: DataFrame, last: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the confirmed links within the candidate ``groups`` (node, root): the same components as from all pairs of
    each group, decided on the sets of ``docs``.  ``sizes``: (node, size) of all sets of a node; ``last``: shingles that come
    last in prefixes."""
    one = sizes.groupBy("node").agg(F.sum("size").alias("size"), F.min("size").alias("least"), F.max("size").alias("most"))
    members = materialize(groups.join(one, "node"), "members")
    sized = members.join(members.groupBy("root").agg(_blocks(F.count("*"), F.sum("size")).alias("blocks")), "root")
    links = materialize(_decide(_first_pairs(sized), docs, percent), "links")
    found = components(links, "links")
    large = sized.where("blocks > 1")
    if large.isEmpty():
        return found
    # What is open in a large group are pairs of different components.  All but those of its largest one have a node outside it.
    labelled = materialize(large.join(found.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    parts = labelled.groupBy("root", "label").agg(F.count("*").alias("k"), F.sum("size").alias("size"))
    parts = parts.groupBy("root").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max_by("size", F.struct("k", "label")).alias("main_size"), F.max("k").alias("most"), F.sum("k").alias("n"), F.sum("size").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    rest, rest_size = F.col("n") - F.col("most"), F.col("size") - F.col("main_size")
    by_blocks = rest * _blocks(F.col("n"), F.col("size")) + F.col("n") * _blocks(rest, rest_size)  # sets that are sent
    parts = materialize(parts.select("root", "main", by_blocks.alias("by_blocks")), "parts")
    open_ = labelled.drop("blocks").join(parts.select("root", "main"), "root")
    held, units = _prefix_keys(open_, docs, last, percent)
    by_keys = units.groupBy("root").agg(F.sum(F.col("n") * F.col("blocks")).alias("by_keys"))
    ways = materialize(parts.join(by_keys, "root").select("root", (F.col("by_blocks") <= F.col("by_keys")).alias("whole")), "ways")
    step = lambda c: F.floor(F.log(F.col(c).cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    whole = open_.join(ways.where("whole"), "root").withColumn("class", F.explode(F.sequence(step("least"), step("most"))))
    work = _rest_pairs(whole.withColumn("rest", F.col("label") != F.col("main")))
    work = work.union(_prefix_pairs(held, units.join(ways.where("not whole").select("root"), "root", "left_semi")))
    more = materialize(_decide(materialize(work, "work"), docs, percent), "links")
    if more.isEmpty():
        return found
    return components(links.union(more), "links")


def cluster(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each document."""
    last = frequent(docs)
    prints = materialize(fingerprint(docs, last, percent), "prints")
    known = prints.where("digest is not null and doc_id is not null")
    folded = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("node")), "folded")
    own = known.join(folded.select(F.col("node").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").withColumnRenamed("doc_id", "node")
    # keys of a set as one array, those of its prefix under the number BANDS
    numbered = F.expr(f"concat(transform(bands, (k, i) -> struct(i as band, k as key)), transform(coalesce(prefix, slice(bands, 1, 0)), k -> struct({BANDS} as band, k as key)))")
    bands = own.select("node", F.inline(numbered))
    keys = bands.groupBy("band", "key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low <> high")
    keys = materialize(keys, "keys")
    links = keys.select(F.col("high").alias("a"), F.col("low").alias("b"))
    links = links.union(bands.join(keys.where("n > 2").select("band", "key", "low"), ["band", "key"]).select(F.col("node").alias("a"), F.col("low").alias("b")))
    # Of the up to BANDS least members that a set is linked to, it keeps the least; the others are linked to that one.
    # Such links repeat from set to set, so a group of m sets has little more than m distinct links left.
    stars = links.groupBy("a").agg(F.collect_set("b").alias("lows")).select("a", F.array_min("lows").alias("b"), "lows")
    links = stars.select("a", "b").union(stars.select(F.explode("lows").alias("a"), "b").where("a <> b"))
    groups = components(links, "candidates")
    # a doc_id whose rows hold different sets is one node: its sets are all compared
    roots = confirm(groups, own.select("node", F.col("n_shingles").alias("size")), docs, last, percent).withColumnRenamed("node", "rep")
    parts = folded.withColumnRenamed("node", "rep").join(roots, "rep", "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    return prints.select("doc_id", "n_shingles", "digest").join(parts, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: The same rows by comparing every two documents that share a shingle, and all that can be reached over links.
SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
    s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(l) >= 5 THEN [array_to_string(l[i : i + 4], ' ') for i in range(1, len(l) - 3)] WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS x FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(node, root) AS (SELECT a, b FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.root),
    c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.root, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.root, d.doc_id) AS kept
    FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id"""


def _without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``drop``; only those that share a mark with one are shuffled."""
    return among(docs, "doc_id", drop, "doc_id", False).union(among(docs, "doc_id", drop, "doc_id").join(drop, "doc_id", "left_anti").select(*docs.columns))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the least doc_id; rows whose ids are null or repeated are told apart by
    numbers of their own, and null ids come last."""
    repeated = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        drop = materialize(cluster(docs).where("doc_id <> component_id").select("doc_id"), "copies")
        return _without(docs, drop).select(*docs.columns)
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    name = lambda number: F.struct(F.isnull("row.doc_id").alias("none"), F.col("row.doc_id").alias("id"), number.alias("number")).alias("doc_id")
    theirs = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["doc_id"]), "left_semi").select(row)
    theirs = materialize(theirs.select(name(F.monotonically_increasing_id()), "row"), "theirs")
    plain = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["doc_id"]), "left_anti").select(row).select(name(F.lit(-1).cast("long")), "row")
    every = plain.union(theirs)
    drop = materialize(cluster(every.select("doc_id", "row.text")).where("doc_id <> component_id").select("doc_id"), "copies")
    return _without(every, drop).select("row.*")
