"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled texts (U) train a linear numpy classifier over hashed words, which tells a
word that comes once from one that comes again. With a
class prior p the risk is  p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]);  where the bracket falls below
zero the step goes against its gradient instead, so that the model cannot fit U as if it were all negative.

Plan: one scan of documents joins the bounded sample of ids and yields each sampled text's word bins; the
driver picks the bins that tell P from U and fits their weights; a second scan scores every whole text. The
model that travels is two arrays of fixed size (`bins`, `most_features`), whatever the corpus holds.

Edges: null and empty texts have no words and get the score of the bias alone; equal texts get equal scores;
empty tables give no rows; with no positives every score is 0; a null doc_id is held out and still scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _common as C

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters are a-z after lower-casing, and every byte of a non-ASCII character.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass(frozen=True)
class Parameters:
    """The bounds of the training sample (in ids), of the hash space and of the selected features."""

    most_positive: int = 4000
    most_unlabelled: int = 8000
    bins: int = 1 << 20
    most_features: int = 256
    least_z: float = 4.0  # how many standard errors a word's share in P must lie from that in U
    least_texts: int = 3
    prior: float | None = None  # None: the share of label 1 among the rows that may be learnt from
    steps: int = 800
    rate: float = 0.05
    decay: float = 1e-5
    gamma: float = 1.0


@dataclass
class Model:
    slot: np.ndarray  # bin -> feature, most_features where none
    weights: np.ndarray  # one more than features: the last is 0
    bias: float


#: Odd multiplier that deals a word's second bin.
AGAIN = 0x5BD1E995


def word_bins(data: np.ndarray, offsets: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bin), once for each text and bin, sorted: a bin for each word, and one for each that comes again."""
    low = _LOWER[data]
    letter = _LETTER[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words do not run on from one text into the next
    before = np.concatenate(([False], letter[:-1])) if len(data) else letter
    start = np.flatnonzero(letter & (~before | edge[:-1]))
    after = np.concatenate((letter[1:], [False])) if len(data) else letter
    end = np.flatnonzero(letter & (~after | edge[1:])) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = C.Rolling(low).spans(start, end) % np.uint64(bins)
    text = np.searchsorted(offsets, start, side="right") - 1
    keys, times = np.unique(text * bins + hashes.astype(np.int64), return_counts=True)
    # a word that comes again has a second bin
    again = keys[times > 1]
    keys = np.unique(np.concatenate((keys, again - again % bins + (again * AGAIN + 1) % bins)))
    return keys // bins, keys % bins


def _sampled_bins(bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, "text"):
            text, bin_ = word_bins(*C.utf8_view(batch.column(batch.schema.get_field_index("text"))), bins)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bin_, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("positive")), lists], ["positive", "bins"])

    return run


def nnpu(x: np.ndarray, positive: np.ndarray, prior: float, p: Parameters) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model with the least non-negative PU risk, by Adam on whole batches."""
    xp, xu = x[positive], x[~positive]
    w, b = np.zeros(x.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, p.steps + 1):
        gp, gu = xp @ w + b, xu @ w + b
        loss = lambda z: np.logaddexp(0, -z).mean()
        # derivatives by g of p l(g) over P, of l(-g) over U, and of -p l(-g) over P
        pos = -prior * (1 - sigmoid(gp)) / len(gp)
        unl, cor = sigmoid(gu) / len(gu), -prior * sigmoid(gp) / len(gp)
        if loss(-gu) - prior * loss(-gp) >= 0:
            dp, du = pos + cor, unl
        else:
            dp, du = -p.gamma * cor, -p.gamma * unl
        grad = np.append(xp.T @ dp + xu.T @ du + p.decay * w, dp.sum() + du.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(rows: list, prior: float, p: Parameters) -> Model | None:
    """The model from collected (positive, bins) rows; None without positives or without unlabelled texts."""
    positive = np.array([r[0] for r in rows], bool)
    if not positive.any() or positive.all() or not 0 < prior < 1:
        return None
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    bin_ = np.concatenate([np.asarray(r[1], np.int64) for r in rows])
    in_p = np.bincount(bin_[positive[doc]], minlength=p.bins) / positive.sum()
    in_u = np.bincount(bin_[~positive[doc]], minlength=p.bins) / (~positive).sum()
    n_p, n_u = positive.sum(), (~positive).sum()
    pooled = np.clip((in_p * n_p + in_u * n_u) / len(rows), 1e-12, 1 - 1e-12)
    z = (in_p - in_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    best = np.argsort(-np.abs(z), kind="stable")[: p.most_features]
    best = best[(np.abs(z[best]) >= p.least_z) & (np.maximum(in_p[best] * n_p, in_u[best] * n_u) >= p.least_texts)]
    slot = np.full(p.bins, len(best), np.int32)
    slot[best] = np.arange(len(best))
    x = np.zeros((len(rows), len(best) + 1), np.float32)
    x[doc, slot[bin_]] = 1
    w, b = nnpu(x[:, :-1], positive, prior, p)
    return Model(slot.astype(np.int16), np.append(w, 0.0), b)


def fit(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters(), mod: int = 3, rest: int = 1) -> Model | None:
    """Learns from documents outside the fold `rest` of `mod` alone, P from label 1; U from any text, its label unseen."""
    known = C.agreed_labels(labels, "toxic", mod, rest)
    share = known.agg(F.avg("y")).first()[0]
    prior = p.prior if p.prior is not None else share
    if not prior or prior >= 1:
        return None
    sampled = C.first_by_hash(known.where("y = 1").select("doc_id"), p.most_positive).select("doc_id", F.lit(True).alias("positive"))
    open_ids = docs.where(~C.held_out("doc_id", mod, rest)).select("doc_id")
    sampled = sampled.unionByName(C.first_by_hash(open_ids.distinct(), p.most_unlabelled).select("doc_id", F.lit(False).alias("positive")))
    # at most most_positive + most_unlabelled ids are sent out, and as many rows come back, whatever the tables hold
    rows = C.one_text_each(docs, sampled)
    rows = rows.mapInArrow(_sampled_bins(p.bins), "positive boolean, bins array<int>").collect()
    return train(rows, float(prior), p) if rows else None


def _scorer(model: Model | None, bins: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, "text"):
            n = batch.num_rows
            if model is None:
                score = np.zeros(n)
            else:
                text, bin_ = word_bins(*C.utf8_view(batch.column(batch.schema.get_field_index("text"))), bins)
                g = np.bincount(text, model.weights[model.slot[bin_]], minlength=n) + model.bias
                score = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in carry), pa.array(score)], [*carry, "score"])

    return run


def score(docs: DataFrame, model: Model | None, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, score) of every row; the model goes out as one broadcast variable of fixed size."""
    rows = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        return _scorer(shared.value, p.bins, ["doc_id"])(batches)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = score(docs, fit(docs, labels, p), p)
    return out.select("doc_id", C.held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
