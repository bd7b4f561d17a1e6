"""N-gram Jaccard self-join with Bayesian pruning of candidate pairs.

Texts are sets of word shingles; two are linked where their Jaccard similarity reaches `threshold`.

1. Each text gets the 128-bit hash of its word sequence and MinHash values. Equal texts become one row.
2. MinHash bands find candidates. A bucket's least text is its leader, and texts are grouped by leader, so that a
   cluster of near copies is a few groups rather than one for each band. A pair belongs to the least leader that
   both share, and is looked at there alone. Groups of more than `wide` texts are cut into blocks, and pairs of
   blocks go to different tasks: no task holds more than two blocks, and no pair is left out or emitted. What moves is
   each signature once for every `wide` texts of its group: exact counts of links need every pair looked at.
3. Within a group, MinHash values are compared a few at a time; a pair is dropped once the posterior probability
   (uniform prior) that its similarity reaches the threshold falls below `tolerance`.
4. For groups with pairs left, in blocks of `block` texts, the texts are fetched and these pairs verified exactly, from
   shingle incidence products. One row of each text is fetched, by the hash that the first scan noted, in a shuffle of
   both sides whatever their sizes. Tasks return counts of links for each text and the edges of a spanning forest, not
   the pairs.
5. Classes are the connected components of these edges, by alternating large-star and small-star rounds.

A link of similarity 0.8 is missed by all bands with probability 4e-9 and dropped by a posterior below 1e-6.

Edges: texts of 1 to 4 words have one shingle, all their words; null and empty texts, and texts of white space,
have none, are linked to nothing and are classes of their own; repeated rows are copies; a class is named by its
least doc_id, null where all are null; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import _common as C

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Parameters:
    words: int = 5
    threshold: float = 0.8
    bands: int = 28
    band_rows: int = 3
    tolerance: float = 1e-6
    step: int = 12  # MinHash values compared before the next look at the posterior
    wide: int = 1024  # texts of a block whose signatures are compared
    block: int = 256  # texts of a block that are verified
    columns: int = 4096  # shingles in one incidence product

    @property
    def values(self) -> int:
        return self.bands * self.band_rows


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, n + 1 ends of the texts' own, and 128 bits of each word sequence (n x 2)."""
    n = len(offsets) - 1
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(~space & (np.concatenate(([True], space[:-1]))[: len(data)] | edge[:-1]))
    end = np.flatnonzero(~space & (np.concatenate((space[1:], [True]))[: len(data)] | edge[1:])) + 1
    word = C.Rolling(data).spans(start, end) if len(start) else np.zeros(0, np.uint64)
    at = np.searchsorted(start, offsets)  # first word of each text
    count = np.diff(at)
    sums = np.zeros(len(word) + 1, np.uint64)
    weight = C.powers(C.POLY, max(words, 1))
    whole = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    for i, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
        mixed = C.mix64(word ^ np.uint64(salt))
        base = salt | 1
        np.cumsum(mixed * C.powers(base, len(mixed)), out=sums[1:])
        inverse = C.powers(pow(base, -1, 1 << 64), len(mixed) + 1)
        whole[i] = C.mix64((sums[at[1:]] - sums[at[:-1]]) * inverse[at[:-1]] + count.astype(np.uint64))
    many = np.maximum(count - words + 1, np.minimum(count, 1))
    ends = np.concatenate(([0], np.cumsum(many)))
    place = np.repeat(at[:-1] - ends[:-1], many) + np.arange(ends[-1])
    short = np.repeat(count < words, many)
    value = np.zeros(len(place), np.uint64)
    padded = np.concatenate((word, np.zeros(words, np.uint64)))
    for k in range(words):
        value += padded[place + k] * weight[k]
    value = C.mix64(value)
    if short.any():
        value[short] = np.repeat(whole[0], many)[short]
    return value, ends, np.stack(whole, axis=1)


@lru_cache(maxsize=4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, dtype=np.uint64)


def minhashes(value: np.ndarray, ends: np.ndarray, n_values: int) -> np.ndarray:
    """Texts x values, uint32; zero rows for texts without shingles."""
    out = np.zeros((len(ends) - 1, n_values), np.uint32)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        a, b = _functions(n_values)
        for j in range(n_values):
            out[some, j] = np.minimum.reduceat((value * a[j] + b[j]) >> np.uint64(32), ends[some])
    return out


@lru_cache(maxsize=4)
def least_matches(p: Parameters) -> tuple[tuple[int, int], ...]:
    """(n, m): after n values, a pair needs m matches for a posterior of at least the tolerance."""
    out = []
    for n in range(p.step, p.values + 1, p.step):
        # uniform prior: P(J < t | m of n) = P(Binomial(n + 1, t) > m)
        tail = [math.fsum(math.comb(n + 1, i) * p.threshold**i * (1 - p.threshold) ** (n + 1 - i) for i in range(m + 1)) for m in range(n + 1)]
        out.append((n, next((m for m in range(n + 1) if tail[m] >= p.tolerance), n)))
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, mask: np.ndarray, p: Parameters) -> np.ndarray:
    """mask without the pairs that the posterior drops; MinHash values are compared a step at a time."""
    i, j = np.nonzero(mask)
    hits = np.zeros(len(i), np.int32)
    before = 0
    for n, least in least_matches(p):
        for k in range(before, n):
            hits += a[i, k] == b[j, k]
        stay = hits >= least
        i, j, hits, before = i[stay], j[stay], hits[stay], n
    out = np.zeros_like(mask)
    out[i, j] = True
    return out


def intersections(sets: list[np.ndarray], others: list[np.ndarray], columns: int) -> np.ndarray:
    """Sizes of all intersections of distinct-valued arrays, by products of incidence matrices."""
    both = [*sets, *others]
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    values, code, count = np.unique(np.concatenate(both) if both else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    rank = np.full(len(values), -1)
    rank[shared] = np.arange(len(shared))
    code = rank[code]
    owner, code = owner[code >= 0], code[code >= 0]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(sets), len(others)))
    for low in range(0, len(shared), columns):
        a, z = np.searchsorted(code, [low, low + columns])
        grid = np.zeros((len(both), min(columns, len(shared) - low)), np.float32)
        grid[owner[a:z], code[a:z] - low] = 1
        out += grid[: len(sets)] @ grid[len(sets) :].T
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys (none null), from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            new |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            key = [c[start].as_py() for c in columns]
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _binary_matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def signed(docs: DataFrame, p: Parameters) -> DataFrame:
    """(doc_id, th, tid, sig) of every document; th is the text's own hash, sig and tid are null where there are no words."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("th", T.LongType()), T.StructField("tid", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, "text"):
            value, ends, whole = shingles(*C.utf8_view(batch.column(2)), p.words)
            sig = minhashes(value, ends, p.values)
            none = np.diff(ends) == 0
            tid = [None if x else w.tobytes() for x, w in zip(none, whole, strict=True)]
            sigs = [None if x else s.tobytes() for x, s in zip(none, sig, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tid, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "th", "tid", "sig"])

    return rows.mapInArrow(run, schema)


def memberships(texts: DataFrame, p: Parameters) -> DataFrame:
    """(leader, tid): each text of a bucket of two or more, under the bucket's least text; each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                cut = batch.slice(part, 2000)
                sig = np.frombuffer(b"".join(cut.column(1).to_pylist()), np.uint32).reshape(cut.num_rows, p.bands, p.band_rows).astype(np.uint64)
                band = np.zeros(sig.shape[:2], np.uint64) + np.arange(1, p.bands + 1, dtype=np.uint64)
                for k in range(p.band_rows):
                    band = C.mix64(band * np.uint64(C.POLY) + sig[:, :, k])
                tids = cut.column(0).take(pa.array(np.repeat(np.arange(cut.num_rows), p.bands)))
                yield pa.RecordBatch.from_arrays([tids, pa.array(band.ravel().view(np.int64))], names=["tid", "bucket"])

    rows = texts.select("tid", "sig").mapInArrow(run, "tid binary, bucket long")
    full = rows.groupBy("bucket").agg(F.min("tid").alias("leader"), F.count("*").alias("n")).where("n > 1").select("bucket", "leader")
    return rows.join(full, "bucket").select("leader", "tid").distinct()


def active(members: DataFrame, texts: DataFrame, p: Parameters) -> DataFrame:
    """(leader, bi, bj, side, pos, tid, alive): texts with pairs that the posterior leaves, in each pair of small blocks.

    alive is, for the first block's texts, a mask over the positions of the second."""
    sizes = members.groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") > p.wide)
    lists = members.groupBy("tid").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))  # at most `bands` of a text
    sizes = C.written(sizes, "large-groups")  # few: of the others nothing is looked up by leader
    blocks = F.coalesce(F.ceil(F.col("n") / p.wide), F.lit(1)).cast("int")
    rows = members.join(sizes, "leader", "left").withColumn("nb", blocks).withColumn("b", F.pmod(F.xxhash64("tid"), F.col("nb")).cast("int"))
    rows = rows.join(lists, "tid").join(texts.select("tid", "sig"), "tid")
    # block b meets the blocks from itself on as the first of a pair, and those up to itself as the second
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("b", o).alias("bi"), F.greatest("b", o).alias("bj")))
    rows = rows.withColumn("pair", F.explode(pairs)).select("leader", "pair.bi", "pair.bj", "b", "tid", "leaders", "sig")
    keys = ["leader", "bi", "bj"]
    # memberships are dealt out evenly: of a large group, every pair of blocks is a key of its own
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "b", "tid")
    spec = "leader binary, bi long, bj long, side int, pos int, tid binary, alive binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, keys):
            leader, bi, bj = (g.column(k)[0].as_py() for k in keys)
            b = g.column("b").to_numpy()
            tids, sig = g.column("tid").to_pylist(), _binary_matrix(g.column("sig"), np.uint32)
            first = np.flatnonzero(b == bi)
            second = first if bi == bj else np.flatnonzero(b == bj)
            if not len(second):
                continue
            mask = np.triu(np.ones((len(first), len(first)), bool), 1) if bi == bj else np.ones((len(first), len(second)), bool)
            # a pair belongs to the least leader of both
            below = [[x for x in own if x < leader] for own in g.column("leaders").to_pylist()]
            names = {x: i for i, x in enumerate(sorted({x for own in below for x in own}))}
            if names:
                has = np.zeros((len(tids), len(names)), np.float32)
                for i, own in enumerate(below):
                    has[i, [names[x] for x in own]] = 1
                mask &= has[first] @ has[second].T == 0
            mask = surviving(sig[first], sig[second], mask, p)
            if not mask.any():
                continue
            out, kinds = [], [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            for a in range(0, len(first), p.block):
                for z in range(0, len(second), p.block):
                    part = mask[a : a + p.block, z : z + p.block]
                    if part.any():
                        own = leader, (bi << 32) + a, (bj << 32) + z  # names of the small blocks
                        out += [(*own, 0, int(i), tids[first[a + i]], np.packbits(part[i]).tobytes()) for i in np.flatnonzero(part.any(1))]
                        out += [(*own, 1, int(j), tids[second[z + j]], None) for j in np.flatnonzero(part.any(0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in spec.split(", ")])

    return dealt.mapInArrow(run, spec)


def _roots(links: np.ndarray) -> np.ndarray:
    """Least member of each row's connected component in a symmetric matrix."""
    label = np.arange(len(links))
    while True:
        low = np.where(links, label[None, :], len(links)).min(1, initial=len(links))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(found: DataFrame, docs: DataFrame, texts: DataFrame, p: Parameters) -> DataFrame:
    """(tid, links, root): verified links of a text in a group, in documents, and a text of its component there."""
    wanted = found.select("tid").distinct().join(texts.select("tid", "own.doc_id", "own.th"), "tid")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    on = F.col("w.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("w.th") == F.col("t.th"))
    # repeated rows of a text come down to one before they are dealt out
    fetched = rows.alias("t").join(wanted.alias("w").hint("merge"), on).groupBy("w.tid").agg(F.first("t.text").alias("text"))
    full = found.join(texts.select("tid", "n_docs"), "tid").join(fetched, "tid").select("leader", "bi", "bj", "side", "pos", "tid", "alive", "n_docs", "text")
    keys = ["leader", "bi", "bj"]
    dealt = full.repartition(*keys).sortWithinPartitions(*keys, "side", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, keys):
            side, pos = g.column("side").to_numpy(), g.column("pos").to_numpy()
            tids, n_docs, alive = g.column("tid").to_pylist(), g.column("n_docs").to_numpy(), g.column("alive").to_pylist()
            value, ends, _ = shingles(*C.utf8_view(g.column("text")), p.words)
            sets = [np.unique(value[ends[i] : ends[i + 1]]) for i in range(len(tids))]
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            mask = np.stack([np.unpackbits(np.frombuffer(alive[i], np.uint8), count=int(pos[b].max()) + 1 if len(alive[i]) * 8 > pos[b].max() else None)[pos[b]].astype(bool) for i in a])
            same = intersections([sets[i] for i in a], [sets[i] for i in b], p.columns)
            size = np.array([len(x) for x in sets], float)
            union = size[a][:, None] + size[b][None, :] - same
            linked = mask & (same >= p.threshold * union - 1e-9)
            if not linked.any():
                continue
            # one node for each text, whichever side it stands on
            node = {t: i for i, t in enumerate(dict.fromkeys(tids))}
            of = np.array([node[t] for t in tids])
            links = np.zeros((len(node), len(node)), bool)
            i, j = np.nonzero(linked)
            links[of[a[i]], of[b[j]]] = links[of[b[j]], of[a[i]]] = True
            weight = np.zeros(len(node))
            weight[of] = n_docs
            total, root, names = links @ weight, _roots(links), list(node)
            rows = [(names[k], int(total[k]), names[root[k]]) for k in np.flatnonzero(links.any(1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["tid", "links", "root"])

    return dealt.mapInArrow(run, "tid binary, links long, root binary")


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) for every node of an edge, root the least of its component, by large-star and small-star rounds.

    Neighbours' minima are sums made before the shuffle and joined back, so a node of any degree is no hot group."""
    spark = edges.sparkSession
    path = C.fresh_dir(spark, "edges")
    now = C.written(edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges", path)
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = print_of(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        done, path = path, C.fresh_dir(spark, "edges")
        now = C.written(small, "edges", path)
        C.remove(spark, done)
        this = print_of(now)
        if this == last:
            break
        last = this
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def row_classes(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, th, root, class_id, n_links) of every document; root names the class, null for a text without words."""
    members = C.written(signed(docs, p), "signatures")
    texts = members.where("tid IS NOT NULL").groupBy("tid").agg(F.min("doc_id").alias("rep"), F.min(F.struct("th", "doc_id")).alias("own"), F.count("*").alias("n_docs"), F.first("sig").alias("sig"))
    texts = C.written(texts, "texts")
    groups = C.written(memberships(texts, p), "memberships")
    found = C.written(active(groups, texts, p), "active")
    links = C.written(verified(found, docs, texts, p), "links")
    roots = components(links, "tid", "root")
    sums = links.groupBy("tid").agg(F.sum("links").alias("links"))
    named = texts.select("tid", "rep", "n_docs").join(sums, "tid", "left").join(roots.select(F.col("node").alias("tid"), "root"), "tid", "left")
    named = named.withColumn("root", F.coalesce("root", "tid"))
    names = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = named.join(names, "root").select("tid", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    # one text's copies may be a third of all rows: the names are one row for each text, so the join may split them
    plain = members.where("tid IS NULL").select("doc_id", "th", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return members.where("tid IS NOT NULL").select("doc_id", "th", "tid").join(named, "tid").select("doc_id", "th", "root", "class_id", "n_links").unionByName(plain)


def similarity_classes(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, class_id, n_links) of every document: links are other documents of similarity `threshold` or more."""
    return row_classes(docs, p).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """One document of each class, that of its least doc_id, and every text without words; columns as they came."""
    rows = C.written(row_classes(docs, p), "classes")
    first = rows.where(F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id")))
    # rows of one doc_id may hold several texts of a class: that of the least hash stays
    first = first.groupBy("root").agg(F.min(F.struct("th", "doc_id")).alias("r"), F.count("*").alias("k")).select("r.doc_id", "r.th", "k")
    plain = rows.where("root IS NULL").select("doc_id", "th").distinct().withColumn("k", F.lit(1).cast("long"))
    th, k = C.free_name(docs, "_th"), C.free_name(docs, "_k")
    keep = first.unionByName(plain).withColumnRenamed("k", k).alias("k")
    got = docs.withColumn(th, F.xxhash64("text")).alias("d").join(keep, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{th}") == F.col("k.th")))
    got = got.select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col(f"d.{th}").alias(th), F.col(f"k.{k}").alias(k))
    again = got.where(F.col(k) > 1).dropDuplicates(["doc_id", th])
    return got.where(F.col(k) == 1).unionByName(again).drop(th, k)
