"""What the corpus operators share: shared folder, written tables, byte views of Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task holds at once in a Python worker, besides its largest single text.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of its own only where that is unset and all tasks run
    in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it as long as df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Lists of the folders made inside of the scratch() blocks that are open, innermost last.
_SCRATCH: list[list[str]] = []


def fresh_dir(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside is removed at the end. Results must have been written elsewhere by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        remove(spark, *_SCRATCH.pop())


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later stages survive lost executors."""
    path = path or fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id, mod: int, rest: int):
    """True where crc32(doc_id as text) mod `mod` is `rest`; a null doc_id is held out, since nothing can label it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(True))


def agreed_labels(labels: DataFrame, column: str, mod: int, rest: int) -> DataFrame:
    """(doc_id, y) of the rows that may be learnt from; ids whose rows disagree, and nulls, are left out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out("doc_id", mod, rest))
    seen = usable.groupBy("doc_id").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return seen.where("lo = hi").select("doc_id", F.col("lo").cast("int").alias("y"))


def first_by_hash(ids: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A reproducible sample of at most n rows: those whose doc_id hashes lowest."""
    return ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(n)


def one_text_each(docs: DataFrame, sampled: DataFrame) -> DataFrame:
    """The bounded sample (doc_id, a label) with one text for each row, as (label, text): of an id's texts, the one that
    hashes lowest. Rows of one doc_id are reduced before the shuffle, so that one with any number of them is no hot key."""
    label = [c for c in sampled.columns if c != "doc_id"]
    rows = docs.select("doc_id", "text").join(F.broadcast(sampled), "doc_id")
    least = rows.groupBy("doc_id", *label).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return least.select(*label, F.col("least.text").alias("text"))


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column, without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches where their texts pass `most` bytes; one longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


#: Odd multiplier of the rolling polynomial and its inverse modulo 2^64.
POLY = 0x9E3779B97F4A7C15
POLY_INV = pow(POLY, -1, 1 << 64)


#: The longest row of powers of each base so far; tasks of a worker share it.
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64, by doubling."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        have = 1
        while have < len(out):
            step = np.uint64(pow(base, have, 1 << 64))
            take = min(have, len(out) - have)
            out[have : have + take] = out[:take] * step
            have += take
        known = _POWERS[base] = out
    return known[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


#: A second base and what it weighs each byte by, for hashes of 128 bits in all.
POLY2 = 0xD1342543DE82EF95
_BYTES2 = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Rolling:
    """Hashes of any byte spans of one buffer from prefix sums of a polynomial; `second` gives independent ones."""

    def __init__(self, data: np.ndarray, second: bool = False):
        n, base = len(data), POLY2 if second else POLY
        self.sums = np.zeros(n + 1, np.uint64)
        weight = _BYTES2[data] if second else data.astype(np.uint64) + np.uint64(1)
        np.cumsum(weight * powers(base, n), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)

    def every(self, width: int) -> np.ndarray:
        """The hash of each span of `width` bytes, as spans() gives it."""
        n = len(self.sums) - width
        return mix64((self.sums[width:] - self.sums[:n]) * self.inverse[:n] + np.uint64(width * 0xC2B2AE3D27D4EB4F % (1 << 64)))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
