"""Benchmark decontamination by winnowing. DataFrame functions only.

Texts become words; a window is `window` consecutive words of an item, or all words of a shorter item. Of every
`window - gram + 1` consecutive hashes of `gram` words the least is kept (of equal ones each), in documents and items
alike, so that any shared window has a kept hash at the same place in both. Documents' kept hashes are joined with the distinct
kept hashes of the items' windows; each hit is extended to the windows of the document that cover it, and those
are joined with the items' windows word for word. Items of fewer than `window` words are looked up by hashes of
exactly their length, at every position.

Scale: documents are scanned where they lie; a kept hash leaves a task only if an item has it. The items' hashes
are broadcast up to `most_broadcast` bytes (summed first); beyond, both sides are shuffled by hash. A place of
a document meets at most one row in either join, however many items share a hash or a window, so nothing
multiplies; items are told by the sets of them that share windows, each once for a document. Places are gathered by
document, bounded by its own length, and stored; texts are shuffled to them at every size.

Edges: null and empty texts have no words, are not contaminated and have the hash of an empty list; items without
words mark nothing; repeated documents are judged alike; repeated item_ids count once, and an item without an id marks words but is
not counted; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _common as C

#: Fixed value: what stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Parameters:
    window: int = 10
    gram: int = 6
    most_broadcast: int = 32 << 20  # bytes of item hashes or windows that are sent to every task


def words_of(text: Column) -> Column:
    """The words of a text, of null none. Splitting takes a tenth of the time of extracting every match."""
    parts = F.split(F.translate(text, CAPITALS, SMALL), BETWEEN)
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def let(value: Column, use) -> Column:
    """use(value), value computed once: the optimizer copies no column into a lambda that runs for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shifted(values: Column, by: Column | int) -> Column:
    """The values from the one `by` places on."""
    return F.slice(values, F.lit(by) + 1, F.greatest(F.size(values) - by, F.lit(0)))


def rolled(values: Column, n: int, use) -> Column:
    """use() over every n consecutive values (array; empty if there are fewer). Results for 2, 4, 8.. values are made of
    those for half as many, in whole arrays, so that a place costs log n calls; use() must bear a null on its right."""

    def go(power: Column, size: int, done: Column | None, have: int) -> Column:
        if n & size:
            done = power if done is None else F.zip_with(done, shifted(power, have), use)
            have += size
        if 2 * size > n:
            return F.slice(done, 1, F.greatest(F.size(done) - (n - 1), F.lit(0)))
        return let(F.zip_with(power, shifted(power, size), use), lambda x: go(x, 2 * size, done, have))

    return let(values, lambda x: go(x, 1, None, 0))


def gram_hashes(words: Column, n: int) -> Column:
    """A hash of the n words from each position on (array; empty if there are fewer words)."""
    return rolled(F.transform(words, lambda w: F.xxhash64(w)), n, lambda a, b: F.xxhash64(a, b))


def all_hashes(text: Column, n: int) -> Column:
    return gram_hashes(words_of(text), n)


def kept_hashes(hashes: Column, span: int) -> Column:
    """The hashes that are the least of any `span` consecutive ones, at their places, and nulls at the others."""
    # a hash is no less than the least of the spans that cover it, and is kept if it equals the greatest of these
    beyond = F.array_repeat(F.lit(None).cast("bigint"), span - 1)
    least = rolled(hashes, span, lambda a, b: F.least(a, b))
    most = rolled(F.concat(beyond, least, beyond), span, lambda a, b: F.greatest(a, b))
    return F.zip_with(hashes, most, lambda h, x: F.when(h == x, h))


def fingerprints(text: Column, p: Parameters) -> Column:
    """array<bigint>: the kept hashes of a text at their places, and nulls at the others."""
    return let(gram_hashes(words_of(text), p.gram), lambda hashes: kept_hashes(hashes, p.window - p.gram + 1))


def windows_of(text: Column, p: Parameters) -> Column:
    """All windows of an item (array of arrays of words), repeats included; empty without words."""

    def cut(words: Column) -> Column:
        n = F.least(F.size(words), F.lit(p.window))
        return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n))

    return F.filter(let(words_of(text), cut), lambda w: F.size(w) > 0)


def item_windows(items: DataFrame, p: Parameters) -> DataFrame:
    """(window array<string>, n) of all items, each distinct window once."""
    rows = items.select(F.explode(windows_of(F.col("text").cast("string"), p)).alias("window"))
    return rows.distinct().withColumn("n", F.size("window"))


def _sent(items: DataFrame, p: Parameters) -> DataFrame:
    each = F.lit(64)  # a row's own bytes
    if "window" in items.columns:
        each = each + F.octet_length(F.concat_ws(" ", "window")) + 16 * F.size("window")
    return F.broadcast(items) if (items.agg(F.sum(each)).first()[0] or 0) <= p.most_broadcast else items


def found_places(docs: DataFrame, windows: DataFrame, p: Parameters) -> DataFrame:
    """(_doc, start, n): where windows of n words may begin; docs has _doc and _text."""
    span = p.window - p.gram + 1
    full = windows.where(F.col("n") == p.window).select(F.array_min(gram_hashes(F.col("window"), p.gram)).alias("hash")).distinct()
    full = C.written(full, "item-hashes")
    rows = docs.select("_doc", F.posexplode(fingerprints(F.col("_text"), p)).alias("at", "hash")).select("_doc", (F.col("at") + 1).alias("at"), "hash")
    # the windows that cover a kept hash begin at most span - 1 words before it
    near = rows.join(_sent(full, p), "hash", "left_semi").select("_doc", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - span + 1), "at")).alias("start"), F.lit(p.window).alias("n"))
    short = windows.where(F.col("n") < p.window)
    for (n,) in sorted(short.select("n").distinct().collect()):  # fewer than `window` lengths
        own = C.written(short.where(F.col("n") == n).select(F.element_at(gram_hashes(F.col("window"), n), 1).alias("hash")).distinct(), "short-items")
        at = docs.select("_doc", F.posexplode(all_hashes(F.col("_text"), n)).alias("at", "hash"))
        near = near.unionByName(at.join(_sent(own, p), "hash", "left_semi").select("_doc", (F.col("at") + 1).alias("start"), F.lit(n).alias("n")))
    return near


def decontaminate(docs: DataFrame, items: DataFrame, p: Parameters = Parameters()) -> tuple[DataFrame, DataFrame]:
    """Confirmed hits (_doc, start, n, window) in words, counted from 1, each once, and the items' distinct windows.

    _doc is (doc_id, xxhash64(text)): rows that share both are one document here."""
    doc = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    text = docs.select(doc.alias("_doc"), F.col("text").cast("string").alias("_text"))
    windows = C.written(item_windows(items, p), "item-windows")
    places = found_places(text, windows, p)
    places = places.groupBy("_doc").agg(F.collect_set(F.struct("start", "n")).alias("_places"))
    places = C.written(places, "places")
    back = text.join(places.hint("merge"), "_doc").dropDuplicates(["_doc"])  # places grow with the corpus

    def windows_at(words: Column) -> Column:
        cut = F.transform("_places", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.slice(words, x["start"], x["n"]).alias("window")))
        return F.filter(cut, lambda x: F.size(x["window"]) == x["n"])

    cut = let(words_of(F.col("_text")), windows_at)
    proposed = back.select("_doc", F.explode(cut).alias("x")).select("_doc", "x.*")
    return C.written(proposed.join(_sent(windows.select("window"), p), "window", "left_semi"), "confirmed-hits"), windows


def report(docs: DataFrame, items: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The registered query's columns for every document."""
    hits, _ = decontaminate(docs, items, p)
    owned = items.select(F.col("item_id").cast("string").alias("item_id"), F.explode(windows_of(F.col("text").cast("string"), p)).alias("window")).distinct()
    owners = owned.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("owners"))
    sets = hits.select("_doc", "window").distinct().join(owners, "window").select("_doc", "owners").distinct()
    found = sets.groupBy("_doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("owners")))).alias("_items"))
    # spans are merged from left to right: a span adds what lies beyond the last end
    span = lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["n"]).alias("end"))
    add = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
    spans = hits.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("_spans"))
    marks = spans.select("_doc", F.aggregate(F.transform("_spans", span), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda a: a["n"]).alias("_n_hit"))
    doc = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    rows = docs.select("doc_id", doc.alias("_doc"), F.size(words_of(F.col("text").cast("string"))).cast("long").alias("n_words"))
    rows = rows.join(marks.join(found, "_doc", "left"), "_doc", "left")
    none = F.array().cast("array<string>")
    return rows.select("doc_id", "n_words", F.coalesce("_n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("_items", none)).cast("long").alias("n_items"), F.sha2(F.array_join(F.coalesce("_items", none), ","), 256).alias("items_sha256"), (F.coalesce("_n_hit", F.lit(0)) > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The documents without any window of an item, with the columns they came with."""
    hits, _ = decontaminate(docs, items, p)
    doc = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    name = C.free_name(docs, "_doc")
    bad = hits.select(F.col("_doc").alias(name)).distinct()
    return docs.withColumn(name, doc).join(bad, name, "left_anti").select(*docs.columns)
