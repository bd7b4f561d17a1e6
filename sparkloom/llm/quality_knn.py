"""Quality by nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled texts gives a term-document matrix; its leading right singular vectors span the
latent space. The sample's vectors and labels go out as one broadcast of fixed size (`most_labelled` x `rank`
floats); every document is compared with all of them, in blocks, by exact cosine products, and the `neighbours`
most similar vote for their labels with their similarity (to the power `sharpness`) as weight.

Terms are hashed: words, runs of four characters of the text's shape (letter case, digits, marks), and how much of the
text its commonest word, its repeated words and its marks make up, and its length. Words and shapes are each a vector of
length 1 of log counts; the shares, which tell word salad and boilerplate that words alone do not, are steps of a scale,
`share_weight` / 10 each (the length a quarter of that). Whole texts are read; nothing is cut.

Edges: null and empty texts have the terms of an empty text and are voted on like others; a text whose vector is
zero gets the labelled share of 1; equal similarities go to the lower sample row; without labels all scores
are 1, so that nothing is rejected; empty tables give no rows; a null doc_id is held out and still scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import _common as C

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97  # any lower-case letter
_SHAPE[65:91] = 65  # any capital
_SHAPE[48:58] = 48  # any digit
_SHAPE[128:] = 97  # bytes of non-ASCII letters
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#*$%&|<>!{}[]=~^_\\@"]] = True


@dataclass(frozen=True)
class Parameters:
    most_labelled: int = 4000  # labelled ids that are learnt from and sent out
    grams: int = 1024  # hash bins of shape runs
    words: int = 512  # hash bins of words
    word_weight: float = 0.5
    levels: int = 12  # steps of each share
    share_weight: float = 4.0
    rank: int = 32
    neighbours: int = 25
    sharpness: int = 8
    block: int = 512


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled texts x rank, of length 1
    labels: np.ndarray
    prior: float


def n_terms(p: Parameters) -> int:
    return p.grams + p.words + 4 * p.levels


def term_counts(data: np.ndarray, offsets: np.ndarray, p: Parameters) -> np.ndarray:
    """A row of term weights for each text."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, n_terms(p)), np.float32)
    shape = _SHAPE[data].astype(np.uint32)
    if len(data) >= 4:
        runs = ((shape[:-3] * np.uint32(31) + shape[1:-2]) * np.uint32(31) + shape[2:-1]) * np.uint32(31) + shape[3:]
        runs = ((runs * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(p.grams)
        inside = text[:-3] == text[3:]
        out[:, : p.grams] = np.bincount(text[:-3][inside] * p.grams + runs[inside], minlength=n * p.grams).reshape(n, p.grams)
    out[:, : p.grams] = np.log1p(out[:, : p.grams])
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    out /= np.where(norm > 0, norm, 1)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(~space & (np.concatenate(([True], space[:-1]))[: len(data)] | edge[:-1]))
    end = np.flatnonzero(~space & (np.concatenate((space[1:], [True]))[: len(data)] | edge[1:])) + 1
    of = np.searchsorted(offsets, start, side="right") - 1
    words = np.bincount(of, minlength=n)
    keys, counts = np.unique(np.stack([of.astype(np.uint64), C.Rolling(data).spans(start, end)]), axis=1, return_counts=True) if len(start) else (np.zeros((2, 0), np.uint64), np.zeros(0, int))
    owner = keys[0].astype(np.int64)
    bins = np.bincount(owner * p.words + (keys[1] % np.uint64(p.words)).astype(np.int64), counts, minlength=n * p.words).reshape(n, p.words)
    bins = np.log1p(bins)
    norm = np.sqrt((bins * bins).sum(1, keepdims=True))
    out[:, p.grams : p.grams + p.words] = p.word_weight * bins / np.where(norm > 0, norm, 1)
    top = np.zeros(n)
    np.maximum.at(top, owner, counts)
    some = np.maximum(words, 1)
    size = np.maximum(np.diff(offsets), 1)
    shares = [
        top / some,
        1 - np.bincount(owner, minlength=n) / some,
        np.minimum(1, 4 * np.bincount(text, _MARK[data], minlength=n) / size),
        np.minimum(1, np.log1p(words) / 12),
    ]
    for i, share in enumerate(shares):
        level = np.minimum((share * p.levels).astype(int), p.levels - 1)
        out[np.arange(n), p.grams + p.words + i * p.levels + level] = p.share_weight / (4 if i == 3 else 1) / 10
    return out


def _terms_of(p: Parameters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, "text"):
            rows = term_counts(*C.utf8_view(batch.column(batch.schema.get_field_index("text"))), p)
            flat = pa.array(rows.astype(np.float32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, rows.shape[1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")), lists], ["y", "terms"])

    return run


def train(terms: np.ndarray, labels: np.ndarray, p: Parameters) -> Model:
    idf = np.log((1 + len(terms)) / (1 + (terms > 0).sum(0))).astype(np.float32) + 0.1
    weighted = terms * idf
    values, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    basis = vectors[:, np.argsort(-values)[: p.rank]].astype(np.float32)
    return Model(idf, basis, unit(weighted @ basis), labels.astype(np.float64), float(labels.mean()))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(norm > 1e-12, x / np.where(norm > 1e-12, norm, 1), 0)


def nearest(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k greatest values, of equal ones the first: value and column make one whole number."""
    bits = np.ascontiguousarray(sims, np.float32).view(np.int32).astype(np.int64)
    key = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) * sims.shape[1] - np.arange(sims.shape[1])
    return np.argpartition(-key, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(sims), 1))


def vote(terms: np.ndarray, model: Model, p: Parameters) -> np.ndarray:
    """Similarity-weighted share of label 1 among each row's nearest labelled vectors."""
    out = np.empty(len(terms))
    k = min(p.neighbours, len(model.labels))
    for at in range(0, len(terms), p.block):
        v = unit((terms[at : at + p.block] * model.idf) @ model.basis)
        sims = v @ model.vectors.T
        near = nearest(sims, k)
        weight = np.clip(np.take_along_axis(sims, near, 1).astype(np.float64), 0, 1) ** p.sharpness
        total = weight.sum(1)
        out[at : at + p.block] = np.where(total > 0, (weight * model.labels[near]).sum(1) / np.where(total > 0, total, 1), model.prior)
    return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters(), mod: int = 5, rest: int = 0) -> Model | None:
    """Learns from a hash sample of at most most_labelled labelled ids outside the fold; None where there are none."""
    sampled = C.first_by_hash(C.agreed_labels(labels, "quality", mod, rest), p.most_labelled)
    # at most most_labelled ids are sent out, and as many rows come back, whatever the tables hold
    rows = C.one_text_each(docs, sampled)
    found = rows.mapInArrow(_terms_of(p), "y int, terms array<float>").toArrow()
    if not found.num_rows:
        return None
    terms = found.column("terms").combine_chunks().flatten().to_numpy().reshape(found.num_rows, n_terms(p))
    labels = found.column("y").to_numpy()
    order = np.lexsort([*terms.T[:: max(1, n_terms(p) // 32)], labels])  # one order of the sample, however tasks ended
    return train(terms[order], labels[order], p)


def score(docs: DataFrame, model: Model | None, p: Parameters = Parameters(), keep: list[str] | None = None, name: str = "_score") -> DataFrame:
    """The columns `keep` (doc_id; texts may be among them) and the score, under `name`, for every row."""
    keep = keep or ["doc_id"]
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, "text"):
            if shared.value is None:
                scores = np.ones(batch.num_rows)
            else:
                scores = vote(term_counts(*C.utf8_view(batch.column(batch.schema.get_field_index("text"))), p), shared.value, p)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(scores)], [*keep, name])

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    return rows.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = score(docs, fit(docs, labels, p), p)
    return out.select("doc_id", C.held_out("doc_id", 5, 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, p: Parameters = Parameters()) -> DataFrame:
    """The documents that the vote doesn't reject, with the columns they came with; equal texts fare alike."""
    name = C.free_name(docs, "_score")
    return score(docs, fit(docs, labels, p), p, docs.columns, name).where(F.col(name) >= threshold).drop(name)
