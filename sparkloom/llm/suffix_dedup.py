"""Removal of long repeated byte strings by suffix sorting, over all documents.

A byte goes if a string of `depth` bytes that covers it starts anywhere else too. No task sees all suffixes:

1. Every window of `depth` bytes has a key, the least hash of its `gram`-byte strings: equal windows have equal
   keys. Neighbouring windows of one key are a run; there is one for about every 90 bytes. Runs are counted by
   key before the shuffle. A key with one run, whose least string is the only one of its hash in the text, holds no
   repeat; a key whose runs are all of one content holds nothing else. Contents are told by two independent hashes,
   128 bits in all, besides the key: that any two of 10^12 different runs of one key agree has a probability of 1e-15.
2. Of the other keys, one run of each content is fetched from its text. Keys are dealt out, and tasks sort the
   suffixes of as many keys at a time as make up `shard_bytes`, by external induced sorting (induced_sort.py), whose
   common prefixes tell the windows that occur twice. A task holds less than twice `shard_bytes` of text.
3. Keys whose own runs are more, as those of a passage that many texts share, are dealt out by a second key before
   they are sorted. A window holds its key's string at some offset; windows whose offsets lie within the same `width`
   bytes of each other all hold the `depth` - `width` + 1 bytes in the middle. Equal windows agree in both, so offset
   and middle name a narrower key, which splits runs of different surroundings. Those of one run only go, those of one
   content are marked, the others sorted, or, if still too many, split once more with the last of `widths`: strings of
   one such key differ in their first and last byte alone, and so are 65,536 at most, 13 MB.
4. Intervals of windows go back to the runs' documents, are merged, and the texts are cut.

Nothing is collected, dropped or sampled; the marks of a text are bounded by its own length, those of repeated rows
included.

Edges: null texts are empty; texts shorter than `depth` stay whole; copies of a text all go, wherever they are at
least `depth` long; a cut may fall within a character, and `remove_repeats` then drops its remaining bytes;
repeated rows are copies; a null doc_id is an id like others; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import _common as C
from sparkloom.llm.induced_sort import repeated_starts


#: Text bytes whose runs are found at once, so that the arrays stay in a core's cache; a longer text is taken whole.
RUN_BYTES = 1 << 18


@dataclass(frozen=True)
class Parameters:
    depth: int = 200
    gram: int = 24
    shard_bytes: int = 2 << 20
    queue_entries: int = 200_000  # suffixes whose queues are in memory; further ones are on disk
    widths: tuple[int, ...] = (16, 2)  # of offsets, by which a key larger than a shard is split, and split again


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def comes_twice(gram: np.ndarray, text: np.ndarray, offsets: np.ndarray, key: np.ndarray, owner: np.ndarray, p: Parameters) -> np.ndarray:
    """Whether the string of each key comes twice in its text."""
    # strings that could be a key's are no greater than their neighbours
    low = np.ones(len(gram), bool)
    low[1:] &= gram[1:] <= gram[:-1]
    low[:-1] &= gram[:-1] <= gram[1:]
    low[offsets[offsets < len(gram)]] = True  # a text's first and last
    ends = offsets - p.gram
    low[ends[(ends >= 0) & (ends < len(gram))]] = True
    own = np.flatnonzero(low & (text[: len(gram)] == text[p.gram - 1 :]))
    salted = lambda k, o: C.mix64(k + o.astype(np.uint64) * np.uint64(C.POLY))
    names = np.sort(salted(gram[own], text[own]))
    twice = np.unique(names[1:][names[1:] == names[:-1]])
    wanted = salted(key, owner)
    return twice[np.minimum(np.searchsorted(twice, wanted), len(twice) - 1)] == wanted if len(twice) else np.zeros(len(key), bool)


def runs_of(data: np.ndarray, offsets: np.ndarray, p: Parameters, count: bool = True) -> tuple[np.ndarray, ...]:
    """(text number, key, two content hashes, first window, last window, whether the key's string comes twice in the
    text, which is False throughout unless `count`)."""
    if len(data) < p.depth:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    roll = C.Rolling(data)
    gram = roll.every(p.gram)
    least = sliding_least(gram, p.depth - p.gram + 1)
    # windows of one byte throughout are all equal: they are keys of their own, and are never sorted
    agree = np.concatenate(([0], np.cumsum(data[1:] == data[:-1])))
    constant = agree[p.depth - 1 :] - agree[: len(least)] == p.depth - 1
    least = np.where(constant, C.mix64(data[: len(least)].astype(np.uint64) + np.uint64(C.POLY)), least)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = text[: len(least)] == text[p.depth - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    last = np.append(np.flatnonzero(new[1:]), len(least) - 1)  # a run ends before the next begins
    last = last[np.searchsorted(last, first)]
    # a text's last windows end with the text, where `inside` does
    stop = offsets[text[first] + 1] - p.depth
    last = np.minimum(last, stop)
    owner, key = text[first], least[first]
    again = comes_twice(gram, text, offsets, key, owner, p) if count else np.zeros(len(first), bool)
    plain = constant[first]
    end = np.where(plain, first, last) + p.depth
    content, check = roll.spans(first, end), C.Rolling(data, second=True).spans(first, end)
    # of several such windows in a row, the first is a run for itself: the key then has two runs of one content
    more = np.flatnonzero(plain & (last > first))
    if len(more):
        split = lambda x, new: np.concatenate((x, new))
        owner, key, content, check, again = (split(x, x[more]) for x in (owner, key, content, check, again))
        tail = last[more].copy()
        last[more] = first[more]
        first, last = split(first, first[more] + 1), split(last, tail)
    again &= ~constant[first]
    base = offsets[owner]
    return owner, key.view(np.int64), content.view(np.int64), check.view(np.int64), first - base, last - base, again


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def _same_doc(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def all_runs(docs: DataFrame, p: Parameters, count: bool = True) -> DataFrame:
    """(doc_id, th, key, content, check, lo, hi, twice) for the runs of every text; twice as of runs_of."""
    rows = _keyed(docs)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("th", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("key", "content", "check")), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("twice", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, "text", RUN_BYTES):
            owner, key, content, check, lo, hi, twice = runs_of(*C.utf8_view(batch.column(2)), p, count)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(key), pa.array(content), pa.array(check), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(twice.astype(bool))], names=["doc_id", "th", "key", "content", "check", "lo", "hi", "twice"])

    return rows.mapInArrow(run, schema)


NAME = ["key", "content", "check"]  # of a string
SPANS = "spans array<struct<s:int,e:int>>"


def sorted_repeats(strings: DataFrame, folder: str, p: Parameters) -> DataFrame:
    """(key, content, check, spans): of each string (NAME, bytes), the windows that occur elsewhere under its key."""
    spans_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def spans(starts: np.ndarray) -> list[dict]:
        if not len(starts):
            return []
        cut = np.flatnonzero(np.diff(starts) > 1)
        return [{"s": int(a), "e": int(b)} for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)]

    def sort(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        got = repeated_starts([np.frombuffer(x[3], np.uint8) for x in held], p.depth, folder, p.queue_entries)
        return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in held]) for i in range(3)), pa.array([spans(x) for x in got], spans_type)], names=[*NAME, "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= p.shard_bytes and row[0] != last:
                    yield sort(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]), row[0]
        if held:
            yield sort(held)

    return strings.select(*NAME, "bytes").repartition("key").sortWithinPartitions(*NAME).mapInArrow(run, "key long, content long, check long, " + SPANS)


def narrower(strings: DataFrame, width: int, p: Parameters) -> DataFrame:
    """(of_key, of_content, of_check, s, e, key, content, check): each string's windows s .. e whose offsets of the key's
    string lie within `width` bytes, under the narrower key of that offset and the bytes in their middle."""
    names = [*(f"of_{c}" for c in NAME), "s", "e", *NAME]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, "bytes"):
            held = batch.column(4).to_pylist()
            data = np.frombuffer(b"".join(held), np.uint8)
            size = np.array([len(x) for x in held], np.int64)
            start = np.cumsum(size) - size
            key = batch.column(3).to_numpy().view(np.uint64)
            roll = C.Rolling(data)
            owner = np.repeat(np.arange(len(held)), size)
            # where the key's string stands next, from each byte on; each window of a run holds it
            gram = np.concatenate((roll.every(p.gram), np.zeros(p.gram - 1, np.uint64)))
            here = np.where(gram == key[owner], np.arange(len(data)), len(data))
            following = np.minimum.accumulate(here[::-1])[::-1]
            n = size - p.depth + 1
            of = np.repeat(np.arange(len(held)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)  # windows, counted in their strings
            place = following[start[of] + at]
            step = (place - start[of] - at) // width
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1]) | (step[1:] != step[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(of)) - 1
            base = start[of[first]]
            middle = place[first] - step[first] * width  # its first byte
            narrow = C.mix64(roll.spans(middle, middle - width + 1 + p.depth) ^ C.mix64(key[of[first]] + step[first].astype(np.uint64)))
            low, high = base + at[first], base + at[last] + p.depth
            content, check = roll.spans(low, high), C.Rolling(data, second=True).spans(low, high)
            own = pa.array(of[first])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(own) for i in range(3)), pa.array(at[first], pa.int32()), pa.array(at[last], pa.int32()), *(pa.array(x.view(np.int64)) for x in (narrow, content, check))], names=names)

    return strings.select(*NAME, "gram", "bytes").mapInArrow(run, ", ".join(f"{c} {'int' if c in 'se' else 'long'}" for c in names))


def _own_spans(first: str, last: str):
    """What is marked of a run of windows: all of it if its content comes often (`many`), else its `spans`, which count from
    its first. Spans stay in the row of their run: a run holds at most half as many as windows."""
    base = F.col(first)
    inner = F.transform("spans", lambda x: F.struct((base + x["s"]).alias("s"), (base + x["e"]).alias("e")))
    return F.when(F.col("many"), F.array(F.struct(base.alias("s"), F.col(last).alias("e")))).otherwise(inner)


def repeats_among(strings: DataFrame, folder: str, p: Parameters, widths: tuple[int, ...]) -> DataFrame:
    """(key, content, check, spans): of each string (NAME, gram, bytes), each once, the windows that occur elsewhere under its key, or, under
    narrower keys, in it too."""
    size = strings.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("size"))
    large = C.written(size.where(F.col("size") > p.shard_bytes).select("key"), "large-keys")
    if not widths or large.isEmpty():
        return sorted_repeats(strings, folder, p)
    small = sorted_repeats(strings.join(large, "key", "left_anti"), folder, p)
    strings = strings.join(large, "key", "left_semi")
    parts = C.written(narrower(strings, widths[0], p), "narrower-runs")
    each = parts.groupBy(*NAME).agg(F.count("*").alias("n"), F.min(F.struct(*(f"of_{c}" for c in NAME), "s", "e")).alias("r"))
    keys = each.groupBy("key").agg(F.sum("n").alias("runs"), F.count("*").alias("contents")).where("runs > 1")
    each = C.written(each.join(keys, "key").select(*NAME, "r", (F.col("n") > 1).alias("many"), (F.col("contents") > 1).alias("mixed")), "narrower-contents")
    wanted = each.where("mixed").select(*(F.col(c).alias(f"own_{c}") for c in NAME), *(F.col(f"r.of_{c}").alias(c) for c in NAME), "r.s", "r.e")
    cut = F.substring("bytes", F.col("s") + 1, F.col("e") - F.col("s") + p.depth)
    found = wanted.join(strings, NAME).select(*(F.col(f"own_{c}").alias(c) for c in NAME), "gram", cut.alias("bytes"))
    inner = C.written(repeats_among(C.written(found, "narrower-strings"), folder, p, widths[1:]), "narrower-sorted")
    got = parts.join(each.drop("r").join(inner, NAME, "left"), NAME)
    marked = got.select(*(F.col(f"of_{c}").alias(c) for c in NAME), _own_spans("s", "e").alias("spans")).where(F.size("spans") > 0)
    own = marked.groupBy(*NAME).agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a run's windows at most
    return small.unionByName(own)


def _strings(docs: DataFrame, runs: DataFrame, p: Parameters) -> DataFrame:
    """(key, content, check, gram, bytes) of the runs, fetched from their texts, each once; gram is what the key is the hash of."""
    lists = runs.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*NAME, "lo", "hi")).alias("own"))
    texts = _keyed(docs).alias("d").join(lists.alias("l"), _same_doc("d", "l")).select("d.doc_id", "d.th", "d.text", "l.own")
    texts = texts.dropDuplicates(["doc_id", "th"])  # repeated rows
    text = F.col("text").cast("binary")
    strings = texts.select(text.alias("text"), F.explode("own").alias("x"))
    return strings.select("x.key", "x.content", "x.check", F.col("x.key").alias("gram"), F.substring("text", F.col("x.lo") + 1, F.col("x.hi") - F.col("x.lo") + p.depth).alias("bytes"))


def marks(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, th, spans array<struct<s, e>>): for texts with repeats, first and last of neighbouring repeated windows."""
    spark = docs.sparkSession
    kinds = all_runs(docs, p).groupBy("key").agg(F.count("*").alias("n"), *(f(c).alias(f"{a}_{c}") for c in ("content", "check") for a, f in (("least", F.min), ("most", F.max))), F.max("twice").alias("again"))
    one = (F.col("least_content") == F.col("most_content")) & (F.col("least_check") == F.col("most_check"))
    kinds = kinds.where("n > 1 OR again").select("key", ((F.col("n") > 1) & one).alias("whole"))
    found = C.written(all_runs(docs, p, False).drop("twice").join(kinds, "key"), "repeat-runs")
    mixed = found.where("NOT whole").groupBy(*NAME).agg(F.count("*").alias("n"), F.min(F.struct("th", "doc_id", "lo", "hi")).alias("r"))
    mixed = C.written(mixed.select(*NAME, (F.col("n") > 1).alias("many"), F.col("r.doc_id").alias("doc_id"), F.col("r.th").alias("th"), "r.lo", "r.hi"), "mixed-runs")
    strings = C.written(_strings(docs, mixed, p), "mixed-strings")
    repeats = C.written(repeats_among(strings, C.fresh_dir(spark, "queues"), p, p.widths), "sorted-runs")
    parts = mixed.select(*NAME, "many").join(repeats, NAME, "left")
    whole = found.where("whole").select("doc_id", "th", F.array(F.struct(F.col("lo").alias("s"), F.col("hi").alias("e"))).alias("spans"))
    some = found.where("NOT whole").join(parts, NAME).select("doc_id", "th", _own_spans("lo", "hi").alias("spans"))
    rows = whole.unionByName(some.where(F.size("spans") > 0))
    return C.written(rows.groupBy("doc_id", "th").agg(F.flatten(F.collect_set("spans")).alias("spans")), "marks")


def kept_parts(n: int, spans: list[dict] | None, depth: int) -> list[tuple[int, int]]:
    """The spans of bytes that stay, in order."""
    out, at = [], 0
    for s, e in sorted((x["s"], x["e"] + depth) for x in spans or []):
        if s > at:
            out.append((at, s))
        at = max(at, e)
    if at < n:
        out.append((at, n))
    return out


def _with_marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    th = C.free_name(docs, "_th")
    on = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col(f"d.{th}") == F.col("m.th"))
    return docs.withColumn(th, F.xxhash64("text")).alias("d").join(found.alias("m"), on, "left").select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("m.spans").alias(C.free_name(docs, "_spans")))


def report(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    rows = _with_marks(docs.select("doc_id", F.col("text").cast("string").alias("text")), marks(docs, p))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, "text"):
            data, offsets = C.utf8_view(batch.column(1))
            out = []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                parts = kept_parts(len(own), spans, p.depth)
                kept = sum(b - a for a, b in parts)
                gaps = len(parts) - 1 if parts else int(len(own) > 0)
                if parts:
                    gaps += (parts[0][0] > 0) + (parts[-1][1] < len(own))
                digest = hashlib.sha256()
                for a, b in parts:
                    digest.update(own[a:b].tobytes())
                out.append((len(own), len(own) - kept, gaps, digest.hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The documents with their texts cut, and n_chars, where there is one, counted anew; other columns as they came."""
    rows = _with_marks(docs, marks(docs, p))
    spans = rows.columns[-1]
    cut = rows.where(F.col(spans).isNotNull())
    names = [*docs.columns]
    schema = T.StructType([rows.schema[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.sliced(batches, "text"):
            at = batch.schema.get_field_index("text")
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                own = (text or "").encode()
                texts.append(b"".join(own[a:b] for a, b in kept_parts(len(own), spans, p.depth)).decode(errors="ignore"))
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = cut.mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.where(F.col(spans).isNull()).drop(spans).unionByName(out)
