"""Toxicity by multiple-instance learning.

A text is a bag of sentences.  Each sentence has the probability sigmoid(bias + sum of the weights of its distinct
terms: its words, lower case, and their first 3 and 4 bytes, for languages that inflect), and a text is toxic if any of its sentences is: the noisy-or 1 - prod(1 - p).  Weights are trained from document
labels alone, by the gradient of the noisy-or likelihood with an L1 penalty of ``PENALTY`` / sqrt(texts), and those that it leaves are
trained again with a tenth of it; the sentences at fault then show by their own probabilities.

Training rows are a bounded sample: of each class the ``SAMPLE`` labelled documents with the least hash of doc_id, held
out remainders excluded, as long as their texts have at most ``SAMPLE_BYTES`` together, weighted by the class's whole count.
Terms of fewer than ``LEAST`` sampled texts have no weight; they are counted by the executors and never reach the driver.
Scoring covers whole texts of all documents.

A null or empty text has no sentences and scores 0.  A doc_id labelled more than once takes its highest label; a null one is
never trained on and not held out.  Without labels of both classes every score is 0.  Ties in the sample's order go by
doc_id, repeated rows are scored alike, an empty table has no rows, and columns besides doc_id and text are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .base import chunks, materialize, remainder, table

SAMPLE, SAMPLE_BYTES, LEAST, STEPS, PENALTY = 2000, 64 << 20, 3, 250, 0.017
_END = np.zeros(256, bool)
_END[[0x0A, 0x21, 0x2E, 0x3F]] = True


class Model(NamedTuple):
    terms: np.ndarray  # ascending hashes
    weights: np.ndarray
    bias: float


def _starts(w: textscan.Words, size: int) -> np.ndarray:
    """A hash of the first ``size`` bytes of each word; of shorter words, of the whole and the size."""
    h = np.full(len(w.starts), size, np.uint64)
    for j in range(size):
        byte = w.data[np.minimum(w.starts + j, len(w.data) - 1)].astype(np.uint64)
        byte = np.where((byte >= 65) & (byte <= 90), byte + np.uint64(32), byte)
        h = h << np.uint64(8) | np.where(w.starts + j < w.ends, byte, np.uint64(0))
    return textscan.mix(h)


def _sentences(batch: pa.RecordBatch) -> tuple[textscan.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, hashes of their terms in three columns, the sentence of each word, the text of each sentence); sentences
    without a word are none."""
    w = textscan.words(batch.column("text"), "terms")
    h = np.stack([textscan.word_hashes(w), _starts(w, 3), _starts(w, 4)], 1)
    ends = np.concatenate([[0], np.cumsum(_END[w.data])])[w.starts]
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    new = np.append(True, (ends[1:] != ends[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
    return w, h, np.cumsum(new) - 1, doc[new]


def sample(docs: DataFrame, labels: DataFrame, mod: int, held: int, most: int = SAMPLE) -> DataFrame:
    """(text, label, weight): at most ``most`` labelled documents of each class."""
    own = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    own = own.where(remainder(F.col("doc_id"), mod) != held)
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).where("label in (0, 1)").collect()}
    parts = [own.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("weight", F.lit(max(1.0, counts.get(c, 0) / most))) for c in (0, 1)]
    found = materialize(docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id"), "sample")  # at most 2 * most ids
    sizes = found.select("label", "doc_id", F.octet_length("text").alias("n")).orderBy("label", F.xxhash64("doc_id"), "doc_id").limit(2 * most).collect()
    total, left = {0: 0, 1: 0}, []
    for r in sizes:
        total[r["label"]] += r["n"] or 0
        if total[r["label"]] > SAMPLE_BYTES // 2:
            left.append(r["doc_id"])
    return found.where(~F.col("doc_id").isin(left)) if left else found


def _terms(rows: DataFrame, least: int) -> np.ndarray:
    """The terms of ``least`` texts or more, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w, h, *_ = _sentences(batch)
            own = [np.unique(h[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            terms, often = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(often, pa.int64())], ["term", "n"])

    found = rows.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(found.select("term").toArrow()["term"].to_numpy().view(np.uint64))


def fit(rows: DataFrame) -> Model | None:
    """The model of a sample (text, label, weight); only distinct terms of sentences that have weights reach the driver."""
    kept = _terms(rows, LEAST)
    if not len(kept):
        return None

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w, h, sentence, _ = _sentences(batch)
            terms, where = [], []
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                own = np.stack([np.repeat(sentence[a:b], 3).astype(np.uint64), h[a:b].ravel()], 1)
                own = own[np.lexsort((own[:, 1], own[:, 0]))]
                own = own[np.append(True, (own[1:] != own[:-1]).any(1))[: len(own)]]
                inner, size = own[:, 0] - (own[0, 0] if len(own) else 0), int(own[-1, 0] - own[0, 0]) + 1 if len(own) else 0
                at = np.minimum(np.searchsorted(kept, own[:, 1]), len(kept) - 1)
                has = kept[at] == own[:, 1]
                terms.append(at[has].astype("<u4").tobytes())
                where.append(np.append(inner[has], size).astype("<u4").tobytes())  # the last: how many sentences
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("label").cast(pa.int32()), batch.column("weight"), pa.array(terms, pa.binary()), pa.array(where, pa.binary())], ["doc_id", "label", "weight", "terms", "sentences"])

    got = rows.mapInArrow(reduce, "doc_id string, label int, weight double, terms binary, sentences binary").toArrow().sort_by("doc_id")
    label, weight = got["label"].to_numpy(), got["weight"].to_numpy()
    if len(set(label.tolist())) < 2:
        return None
    terms = [np.frombuffer(x, "<u4") for x in got["terms"].to_pylist()]
    inner = [np.frombuffer(x, "<u4") for x in got["sentences"].to_pylist()]
    sizes = np.array([int(x[-1]) for x in inner])
    base = np.cumsum(sizes) - sizes
    term = np.concatenate(terms).astype(np.int32)
    sentence = np.concatenate([s[:-1] + b for s, b in zip(inner, base.tolist(), strict=True)]).astype(np.int32)
    doc, penalty, weight = np.repeat(np.arange(len(sizes)), sizes), PENALTY / np.sqrt(len(label)), weight / weight.mean()
    first, _ = _train(term, sentence, doc, label, weight, len(kept), penalty)
    left = np.flatnonzero(first)
    has = first[term] != 0
    return Model(kept[left], *_train(np.searchsorted(left, term[has]), sentence[has], doc, label, weight, len(left), penalty / 10))


def _slope(x: np.ndarray, b: float, term: np.ndarray, sentence: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The gradient of the mean negative log-likelihood of the noisy-or, by the weights and the bias."""
    p = 1 / (1 + np.exp(-(b + np.bincount(sentence, x[term], len(doc)))))
    clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(label))  # log of "no sentence is toxic"
    of_doc = np.where(label == 1, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 1.0) * weight
    g = p * of_doc[doc] / len(label)
    return np.append(np.bincount(term, g[sentence], len(x)), g.sum())


def _train(term: np.ndarray, sentence: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray, n: int, penalty: float) -> tuple[np.ndarray, float]:
    """Adam steps on the noisy-or likelihood; each weight is shrunk by the penalty times its own step size, so that a
    rare term gains nothing from the larger steps that it takes."""
    x, b = np.zeros(n), -4.0
    m, v, rate = np.zeros(n + 1), np.zeros(n + 1), 0.1
    for step in range(1, STEPS + 1):
        grad = _slope(x, b, term, sentence, doc, label, weight)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        size = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        move = size * (m / (1 - 0.9**step))
        x = x - move[:-1]
        x = np.sign(x) * np.maximum(np.abs(x) - size[:-1] * penalty, 0)
        b -= move[-1]
    return x, float(b)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, n_sentences, n_toxic, worst_start, worst_end, worst_score): the noisy-or of each text, how many of
    its sentences reach 0.5, and the place (code points) of the worst of them; null places where none does."""
    if model is not None:
        keep = model.weights != 0
        model = Model(model.terms[keep], model.weights[keep], model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n = batch.num_rows
            w, h, sentence, doc = _sentences(batch)
            p = np.zeros(len(doc))
            if model is not None and len(h):
                x = np.full(len(doc), model.bias)
                if len(model.terms):
                    flat = h.ravel()
                    at = np.minimum(np.searchsorted(model.terms, flat), len(model.terms) - 1)
                    hit = np.flatnonzero(model.terms[at] == flat)
                    pair = np.unique(np.stack([sentence[hit // 3], at[hit]], 1), axis=0)
                    x += np.bincount(pair[:, 0], model.weights[pair[:, 1]], len(doc))
                p = 1 / (1 + np.exp(-x))
            total = -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n)) + 0.0  # no -0.0
            starts, ends, worst = [None] * n, [None] * n, [None] * n
            for s in np.flatnonzero(p >= 0.5).tolist():
                d = int(doc[s])
                if worst[d] is None or p[s] > worst[d]:
                    own = np.searchsorted(sentence, [s, s + 1])
                    a, b, c = int(w.offsets[d]), int(w.starts[own[0]]), int(w.ends[own[1] - 1])
                    starts[d] = int(((w.data[a:b] & 0xC0) != 0x80).sum())
                    ends[d] = starts[d] + int(((w.data[b:c] & 0xC0) != 0x80).sum())
                    worst[d] = float(p[s])
            columns = [batch.column("doc_id"), pa.array(np.clip(total, 0, 1)), pa.array(np.bincount(doc, minlength=n), pa.int64()), pa.array(np.bincount(doc, p >= 0.5, n).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(worst, pa.float64())], ["doc_id", "score", "n_sentences", "n_toxic", "worst_start", "worst_end", "worst_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_sentences long, n_toxic long, worst_start long, worst_end long, worst_score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(sample(docs, table(spark, sf_dir, "labels"), 5, 0)))
    return scored.withColumns({"held_out": F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")})
