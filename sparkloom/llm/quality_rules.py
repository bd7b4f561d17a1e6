"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

Each whole text yields a row of statistics. Trees are fitted by boosting on histogram bins of a bounded sample of
labelled texts and flattened into numpy node arrays, over which whole batches are scored level by level. On the
statistics of `falling` the score may only fall as they grow: splits that would break this are not taken, and
the middle of a split's two values bounds everything below it.

Plan: one scan for the sample (its ids are broadcast, at most `most_labelled`), one scan for all; no shuffle of
texts. The broadcast model has at most trees x (2^(depth + 1) - 1) nodes.

Edges: null and empty texts have no words and fail the base rules; a text of any length is read whole; without
labels of both kinds the trees reject nothing; equal texts fare alike; empty tables give no rows.
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

#: Kinds of bytes: white space, first bytes of other characters, symbols, letters, capitals, marks that end a sentence, and
#: other ASCII marks that don't end a word of prose.
_SPACE, _CHAR, _SYMBOL, _LETTER, _CAPITAL, _END, _LOOSE = (1 << i for i in range(7))


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    space, alone = [*range(9, 14), 32], [*range(0x80), *range(0xC0, 0x100)]
    letters = [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]
    loose = [b for b in range(128) if not chr(b).isalnum() and b not in space and chr(b) not in ".,;:!?\"')"]
    for flag, members in ((_SPACE, space), (_CHAR, [b for b in alone if b not in space]), (_SYMBOL, b"#*$%&|<>"), (_LETTER, letters), (_CAPITAL, range(65, 91)), (_END, b".!?"), (_LOOSE, loose)):
        out[list(members)] |= flag
    return out


_KINDS = _kinds()
WINDOW = 8
#: Order of the statistics; the first five are also returned.
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "capital_share", "letter_share", "top_word_share", "end_mark_share", "loose_mark_share"]


@dataclass(frozen=True)
class Parameters:
    most_labelled: int = 8000
    trees: int = 60
    depth: int = 3
    bins: int = 64
    rate: float = 0.15
    least_leaf: int = 20
    ridge: float = 1.0
    falling: tuple[str, ...] = ("symbol_share", "dup_line_share", "repeat_share", "top_word_share")
    threshold: float = 0.3  # texts of a lower probability of label 1 are not kept
    least_words: int = 20
    most_repeat_percent: int = 30


@dataclass
class Trees:
    """All trees' nodes in one row of arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def repeated(words: list[bytes]) -> tuple[int, int, int]:
    """Words in windows that occur more than once, distinct words, count of the commonest word.

    Windows are named exactly: pairs of ids get ids of their own, three times over, which is 8 words."""
    ids: dict[bytes, int] = {}
    name = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    top = int(np.bincount(name).max()) if len(name) else 0
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0, len(ids), top
    width = 1
    while width < WINDOW:
        pairs = name[:-width] * (int(name.max()) + 1) + name[width:]
        _, name = np.unique(pairs, return_inverse=True)
        width *= 2
    again = np.bincount(name)[name] > 1
    if not again.any():
        return 0, len(ids), top
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + WINDOW, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum()), len(ids), top


def repeats_of(text: bytes) -> tuple[int, int, int, int, int, int]:
    """Words, lines with a word, lines of these equal to an earlier one, and what repeated() gives. bytes.split() and
    strip() take just the white space that separates words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), len(lines), len(lines) - len(set(lines)), *repeated(words)


def statistics_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text, from the texts' bytes. Letters are a-z, A-Z and characters beyond ASCII."""
    n = len(offsets) - 1
    kind = _KINDS[data]
    sums = lambda flag: np.diff(np.concatenate(([0], np.cumsum((kind & flag) > 0)))[offsets])
    inside = (kind & _SPACE) == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    last = inside & (np.concatenate((~inside[1:], [True]))[: len(data)] | edge[1:])  # last bytes of words
    ends = lambda flag: np.diff(np.concatenate(([0], np.cumsum(last & ((kind & flag) > 0))))[offsets])
    own = np.array([repeats_of(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.float64).reshape(n, 6)
    words, lines, dup, rep, distinct, top = own.T
    chars, symbols = sums(_CHAR), sums(_SYMBOL)
    some, size = np.maximum(words, 1), np.maximum(chars, 1)
    shares = [chars / some, symbols / size, dup / np.maximum(lines, 1), rep / some, distinct / some, sums(_CAPITAL) / size, sums(_LETTER) / size, top / some, ends(_END) / some, ends(_LOOSE) / some]
    return np.stack([words, chars, symbols, dup, rep, *shares], axis=1).astype(np.float64)


def statistics(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return statistics_rows(data, np.array([0, len(data)]))[0]


class _Grower:
    def __init__(self, codes: np.ndarray, edges: list[np.ndarray], p: Parameters):
        self.codes, self.edges, self.p = codes, edges, p
        self.signs = [-1 if s in p.falling else 0 for s in STATISTICS]
        self.nodes: list[list[float]] = []

    def leaf(self, value: float) -> int:
        at = len(self.nodes)
        self.nodes.append([0, np.inf, at, at, value])
        return at

    def grow(self, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, low: float, high: float) -> int:
        p = self.p
        g, h = grad[rows], hess[rows]
        total_g, total_h = g.sum(), h.sum()
        own = float(np.clip(total_g / (total_h + p.ridge), low, high))
        best = None
        if depth < p.depth and len(rows) >= 2 * p.least_leaf:
            for f, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                codes = self.codes[rows, f]
                m = len(edges) + 1
                lg = np.cumsum(np.bincount(codes, g, m))[:-1]
                lh = np.cumsum(np.bincount(codes, h, m))[:-1]
                ln = np.cumsum(np.bincount(codes, minlength=m))[:-1]
                lv = np.clip(lg / (lh + p.ridge), low, high)
                rv = np.clip((total_g - lg) / (total_h - lh + p.ridge), low, high)
                gain = lg * lv - 0.5 * (lh + p.ridge) * lv**2 + (total_g - lg) * rv - 0.5 * (total_h - lh + p.ridge) * rv**2
                ok = (ln >= p.least_leaf) & (len(rows) - ln >= p.least_leaf)
                if self.signs[f]:
                    ok &= (rv - lv) * self.signs[f] >= 0
                gain = np.where(ok, gain, -np.inf)
                at = int(np.argmax(gain))
                if best is None or gain[at] > best[0]:
                    best = (gain[at], f, at, lv[at], rv[at])
        if best is None or best[0] <= total_g * own - 0.5 * (total_h + p.ridge) * own**2 + 1e-9:
            return self.leaf(own * p.rate)
        _, f, at, lv, rv = best
        middle = (lv + rv) / 2
        bounds = ((low, high), (low, high)) if not self.signs[f] else ((middle, high), (low, middle))
        goes = self.codes[rows, f] <= at
        node = self.leaf(own * p.rate)
        left = self.grow(rows[goes], grad, hess, depth + 1, *bounds[0])
        right = self.grow(rows[~goes], grad, hess, depth + 1, *bounds[1])
        self.nodes[node] = [f, float(self.edges[f][at]), left, right, own * p.rate]
        return node


def train(x: np.ndarray, y: np.ndarray, p: Parameters) -> Trees | None:
    """None where the sample has not both labels."""
    if not len(y) or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    grower, roots = _Grower(codes, edges, p), []
    trees = lambda base, depth: Trees(*(np.array(c, t) for c, t in zip(zip(*grower.nodes, strict=True), (np.int64, float, np.int64, np.int64, float), strict=True)), np.array(roots), base, depth)
    total = np.full(len(y), base)
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-total))
        before = len(grower.nodes)
        roots.append(grower.grow(np.arange(len(y)), y - prob, prob * (1 - prob), 0, -np.inf, np.inf))
        node = np.full(len(y), before)
        now = trees(base, p.depth)
        for _ in range(p.depth):
            node = np.where(x[np.arange(len(y)), now.feature[node]] <= now.threshold[node], now.left[node], now.right[node])
        total += now.value[node]
    return trees(base, p.depth)


def _stats_with(carry: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, "text"):
            x = statistics_rows(*C.utf8_view(batch.column(batch.schema.get_field_index("text"))))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATISTICS)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(carry)), lists], names=[carry, "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> Trees | None:
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    sampled = C.first_by_hash(known.select("doc_id", F.col("lo").cast("int").alias("y")), p.most_labelled)
    # at most most_labelled ids are sent out, and as many rows come back, whatever the tables hold
    rows = C.one_text_each(docs, sampled)
    found = rows.mapInArrow(_stats_with("y"), "y int, x array<double>").toArrow()
    if not found.num_rows:
        return None
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    y = found.column("y").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # one order of the sample, however tasks ended
    return train(x[order], y[order], p)


def apply_rules(docs: DataFrame, trees: Trees | None, p: Parameters = Parameters()) -> DataFrame:
    """Every document's statistics, its score, whether it fails the base rules, and whether it is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    rows = docs.select("doc_id", "text")
    longs = STATISTICS[:5]
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in longs), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, "text"):
            x = statistics_rows(*C.utf8_view(batch.column(1)))
            failed = (x[:, 0] < p.least_words) | (100 * x[:, 4] > p.most_repeat_percent * x[:, 0])
            score = shared.value.score(x) if shared.value is not None else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i].astype(np.int64)) for i in range(5)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= p.threshold))], schema=pa.schema([batch.schema.field(0), *((c, pa.int64()) for c in longs), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())]))

    return rows.mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    return apply_rules(docs, fit(docs, labels, p), p)
