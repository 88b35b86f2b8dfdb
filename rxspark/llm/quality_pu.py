"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled good; the other class is never shown.  Unlabelled texts are a mixture of both,
with the share ``prior`` of good ones, so the risk on bad texts is the unlabelled risk less ``prior`` times the risk of
calling positives bad, held at zero or more:

    prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)])

The prior is estimated from first classifiers of positives against unlabelled texts, trained on one half of both and
read on the other: among score thresholds that 60 % of the positives pass, the least ratio of the share of
unlabelled texts to the share of positives that pass.  It errs a little low, which the risk bears better than high.

A text becomes a dozen ratios of its characters, words and lines; each is cut at quantiles of the training sample and
the model adds one weight for each bin.  Two bounded samples are used, the ``SAMPLE`` rows with the least hash of
doc_id: of positives (held-out remainders excluded) and of all documents.  Scoring covers whole texts of all documents.

A null text is empty and is scored like one.  A doc_id labelled more than once takes its lowest label; a null one is in
neither sample and not held out.  Without two positives every score is 0.5.  Ties in the samples' order go by doc_id,
repeated rows are scored alike, an empty table has no rows, and columns besides doc_id and text are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan
from .base import chunks, remainder, table

SAMPLE, BINS, STEPS, CUT = 6000, 24, 600, 0.7
FEATURES = ("symbols", "capitals", "digits", "exclaims", "marks", "wide", "variety", "commonest", "stutter", "window_repeats", "word_length", "line_repeats", "line_length", "log_words")


def _flag(characters: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in characters]] = 1
    return out


_KINDS = {"symbols": _flag("#*$%&|<>"), "capitals": _flag("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _flag("0123456789"), "exclaims": _flag("!?"), "marks": _flag(".,;:'\"-_=+/\\()[]{}~^`@")}
_KINDS["wide"] = np.where(np.arange(256) >= 0xC0, 1, 0)


def features(batch: pa.RecordBatch) -> np.ndarray:
    """A row of FEATURES for each text."""
    w = textscan.words(batch.column("text"))
    h = textscan.word_hashes(w)
    n = batch.num_rows
    counts = np.diff(w.first)
    full = np.maximum(counts, 1)
    out = {}
    sizes = np.bincount(np.repeat(np.arange(n), counts), (w.ends - w.starts).astype(float), n)
    edge = np.minimum(w.offsets[:-1], max(len(w.data) - 1, 0))
    for name, flag in _KINDS.items():
        own = np.add.reduceat(flag[w.data], edge) if len(w.data) else np.zeros(n)
        out[name] = np.where(np.diff(w.offsets) > 0, own, 0) / np.maximum(sizes, 1)
    windows, at = textscan.shingle_hashes(h, w.first)
    lines = textscan.words(batch.column("text"), "lines")
    line = textscan.word_hashes(lines, lower=False)
    same = np.append(False, h[1:] == h[:-1]).astype(float)
    out["stutter"] = np.bincount(np.repeat(np.arange(n), counts), same[: len(h)], n) / full
    rest = {k: np.zeros(n) for k in ("variety", "commonest", "window_repeats", "line_repeats")}
    for i in range(n):
        own = h[w.first[i] : w.first[i + 1]]
        if len(own):
            _, often = np.unique(own, return_counts=True)
            rest["variety"][i] = len(often) / len(own) ** 0.8
            rest["commonest"][i] = often.max() / len(own)
            x = windows[at[i] : at[i + 1]]
            rest["window_repeats"][i] = 1 - len(np.unique(x)) / len(x)
            x = line[lines.first[i] : lines.first[i + 1]]
            rest["line_repeats"][i] = 1 - len(np.unique(x)) / len(x)
    out |= rest
    out["word_length"] = sizes / full
    out["line_length"] = counts / np.maximum(np.diff(lines.first), 1)
    out["log_words"] = np.log1p(counts)
    return np.stack([out[f] for f in FEATURES], 1)


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the features x of each text in place of the text."""
    rest = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = pa.FixedSizeListArray.from_arrays(pa.array(features(batch).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), x], [*(f.name for f in rest), "x"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "x array<double>"]))


class Model(NamedTuple):
    cuts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float


def _cuts(x: np.ndarray) -> np.ndarray:
    """At most BINS cuts: half of them at quantiles of all values, half at quantiles without the commonest value, which
    many ratios take for most texts (0) and which so gets a bin to itself."""
    values, often = np.unique(x, return_counts=True)
    rest = x[x != values[often.argmax()]]
    half = BINS // 2
    return np.unique(np.concatenate([np.quantile(x, np.linspace(0, 1, half + 2)[1:-1]), np.quantile(rest, np.linspace(0, 1, half + 1)[:-1]) if len(rest) else []]))


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="right") + j * (BINS + 1) for j, c in enumerate(cuts)], 1)


def _optimise(p: np.ndarray, u: np.ndarray, n: int, prior: float | None) -> tuple[np.ndarray, float]:
    """Weights by Adam: without a prior, on positives against the rest with logistic loss; else on the non-negative risk,
    with logistic loss for the first third of the steps and then with the sigmoid loss, whose bound keeps confident
    positives from using up the risk that the prior leaves for bad texts."""
    x, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        up, uu = (1 / (1 + np.exp(-(x[a].sum(1) + x[n]))) for a in (p, u))
        # slopes of the losses of calling p good, p bad and u bad
        if prior is None:
            a, b = -(1 - up) / len(p), uu / len(u)
        else:
            bounded = 3 * step > STEPS
            good, back, rest = (-up * (1 - up), up * (1 - up), uu * (1 - uu)) if bounded else (up - 1, up, uu)
            low, high = (up, uu) if bounded else (-np.log1p(-np.minimum(up, 1 - 1e-12)), -np.log1p(-np.minimum(uu, 1 - 1e-12)))
            risk = high.mean() - prior * low.mean()
            a, b = (prior * (good - back), rest) if risk >= 0 else (prior * back, -rest)
            a, b = a / len(p), b / len(u)
        g = np.zeros(n + 1)
        g[:n] = np.bincount(p.ravel(), np.repeat(a, p.shape[1]), n) + np.bincount(u.ravel(), np.repeat(b, u.shape[1]), n)
        g[n] = a.sum() + b.sum()
        g[:n] += 0.12 / len(p) * x[:n]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return x[:n], float(x[n])


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in u, from scores of both."""
    order = np.sort(p)[::-1]
    best = 1.0
    for share in np.linspace(0.6, 1.0, 41):
        t = order[max(0, min(len(order) - 1, int(share * len(order)) - 1))]
        q, r = (p >= t).mean(), (u >= t).mean()
        best = min(best, r / q)
    return float(min(max(best, 0.02), 0.98))


def learn(positive: np.ndarray, unlabelled: np.ndarray) -> Model | None:
    if len(positive) < 2 or len(unlabelled) < 2:
        return None
    both = np.concatenate([positive, unlabelled])
    cuts = [_cuts(both[:, j]) for j in range(both.shape[1])]
    p, u = _bins(positive, cuts), _bins(unlabelled, cuts)
    n = len(cuts) * (BINS + 1)
    priors = []
    for half in (0, 1):
        w, _ = _optimise(p[half::2], u[half::2], n, None)
        priors.append(estimate_prior(w[p[1 - half :: 2]].sum(1), w[u[1 - half :: 2]].sum(1)))
    prior = sum(priors) / 2
    return Model(cuts, *_optimise(p, u, n, prior), prior)


def fit(docs: DataFrame, labels: DataFrame, mod: int, held: int, most: int = SAMPLE) -> Model | None:
    """The model of two samples of at most ``most`` ids each; only their texts are measured."""
    own = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    own = own.where((F.col("label") == 1) & (remainder(F.col("doc_id"), mod) != held))
    positive = own.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    unlabelled = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most)
    chosen = positive.withColumn("chosen_good", F.lit(True)).union(unlabelled.withColumn("chosen_good", F.lit(False)))
    got = measure(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).orderBy("doc_id").toArrow()  # chosen: at most 2 * most rows
    good = got["chosen_good"].to_numpy(zero_copy_only=False)
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return learn(x[good], x[~good])


def apply(model: Model | None, batch: pa.RecordBatch) -> np.ndarray:
    """The score of each text of a batch."""
    if model is None:
        return np.full(batch.num_rows, 0.5)
    return 1 / (1 + np.exp(-(model.weights[_bins(features(batch), model.cuts)].sum(1) + model.bias)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(apply(model, batch), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Model | None, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more; all of them without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield batch.filter(pa.array(apply(model, batch) >= cut, pa.bool_()))

    return docs if model is None else docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), 4, 2))
    return scored.withColumns({"held_out": F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)), "predicted": (F.col("score") >= CUT).cast("int")})


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score CUT or more."""
    return keep(docs, fit(docs, table(spark, sf_dir, "labels"), 4, 2))
