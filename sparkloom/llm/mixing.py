"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are words. Sources in code-point order (null last) have the weights of a repeating pattern and share a
budget of words; a target stops at `most_epochs` times its source and the excess goes to the others by weight,
until none is above. Of a target, whole epochs of the source come first. The rest is a weighted sample without
replacement: document i has the key  -ln(u_i) / w_i  with u_i from a hash of its id and text and w_i its quality weight,
and the documents with the least keys are taken until the words suffice; the last is taken in part.

Prefix sums at scale: keys fall into `buckets` of about equal number. The share of a source's keys below a key is the
mean of  1 - exp(-w key)  over its weights, which are counted by levels (an eighth of an octave each) beforehand. Sums
by bucket (counted before the shuffle) tell which buckets are taken whole; of the one bucket of each source where the
words run out, sums by key tell the key at which they do. A source with a third of all rows is so split over all tasks.
Buckets grow in number with the rows, so that a bucket has about `bucket_rows` keys however large the input. Rows of
that last key, be they any number of equal ones, are summed by the part of the written table that they stand in, and
only within a part one by one.

What goes to one task is one row for each source: the mixing table, which is written by people.

Edges: null and empty texts have size 0 and are taken 0 times; equal rows tie and share what their tie gets in
either order; a null doc_id or text hashes as ''; a weight that is null or not positive counts as the least double;
empty tables give no rows; reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import _common as C

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>!]+"


@dataclass(frozen=True)
class Parameters:
    weights: tuple[int, ...] = (3, 1, 2)
    budget_percent: int = 150
    most_epochs: int = 2
    bucket_rows: int = 20_000
    least_buckets: int = 64


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str) -> Column:
    """1 for plain text, less by its share of symbols, 0.1 at least."""
    size = F.length(text)
    share = (size - F.length(F.regexp_replace(F.col(text), SYMBOLS, ""))) / size
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.lit(0.1)).otherwise(F.greatest(F.lit(0.1), 1.0 - 4.0 * share))


def exponential(doc_id: str, text: str) -> Column:
    """-ln(u), u in (0, 1) from the first 12 hexadecimal digits of the MD5 of the id, a colon and the text's MD5."""
    name = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")))
    digits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.ln((digits + 0.5) / float(1 << 48))


def targets(sizes: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Sources whose cap is reached first, in the order of cap / weight, are at their caps; the others share what
    is left by weight. The first n of this order are at their caps for the n where that stays true."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    pattern = F.array(*map(F.lit, p.weights))
    rows = sizes.withColumn("weight", F.element_at(pattern, ((F.row_number().over(order) - 1) % len(p.weights) + 1).cast("int")).cast("double"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    rows = rows.withColumn("cap", (F.col("source_size") * p.most_epochs).cast("double"))
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * p.budget_percent / 100.0)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("sharing", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("capped", F.col("left") * F.col("weight") >= F.col("cap") * F.col("sharing"))
    # the first source that stays below its cap sets the share of all from there on
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "left", "sharing"))).over(everything)
    rows = rows.withColumn("free", free)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("free.left") * F.col("weight") / F.col("free.sharing"))
    return rows.select("source", "source_size", target.alias("target"))


def bucketed(slim: DataFrame, buckets: int) -> DataFrame:
    """slim (_source, _key, _weight, ..) with _bucket: ascending with the key, of about equal numbers in each source."""
    level = F.floor(8 * F.log2("_weight")).cast("int")
    levels = slim.groupBy("_source", level.alias("_level")).agg(F.count("*").alias("_n"), F.avg("_weight").alias("_w"))
    mixture = levels.groupBy("_source").agg(F.sum("_n").alias("_all"), F.collect_list(F.struct("_n", "_w")).alias("_levels"))  # some 17,000 levels at most
    rows = _join_source(slim, C.written(mixture, "mix-weights"), [])  # its size is known from here on: rows stay where they are
    below = F.aggregate("_levels", F.lit(0.0), lambda a, x: a + x["_n"] * (1 - F.exp(-x["_w"] * F.col("_key")))) / F.col("_all")
    return rows.withColumn("_bucket", F.least(F.floor(below * buckets), F.lit(buckets - 1)).cast("int")).drop("_all", "_levels")


def _within_last_key(rows: DataFrame) -> DataFrame:
    """rows (_source, _row, _size, _room, ..) of each source's last key with _extra: of _room words, the first rows' sizes."""
    part = F.shiftright("_row", 33)
    sums = rows.groupBy("_source", part.alias("_part_no")).agg(F.sum("_size").alias("_words"))
    upto = Window.partitionBy("_source").orderBy("_part_no").rowsBetween(Window.unboundedPreceding, -1)  # one for each part
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_words").over(upto), F.lit(0))).drop("_words")
    rows = _join_source(rows.withColumn("_part_no", part), sums, ["_part_no"])
    running = Window.partitionBy("_source", "_part_no").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_room") - F.col("_offset") - F.coalesce(F.sum("_size").over(running), F.lit(0))
    return rows.withColumn("_extra", F.least("_size", F.greatest(room, F.lit(0)))).drop("_part_no", "_offset")


def mix(docs: DataFrame, p: Parameters = Parameters(), weight: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, and the columns of `carry` that have other names."""
    own = ("doc_id", "size", "source_size", "target", "taken")
    carry = [c for c in carry or [] if c not in own]
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    weight = (weight if weight is not None else quality_weight("text")).cast("double")
    weight = F.when(weight > 0, weight).otherwise(F.lit(5e-324))
    slim = docs.select("doc_id", source.alias("_source"), n_words("text").alias("_size"), exponential("doc_id", "text").alias("_key"), weight.alias("_weight"), F.monotonically_increasing_id().alias("_row"), *(F.col(c).alias(f"_carry_{c}") for c in carry))
    slim = C.written(slim.withColumn("_key", F.col("_key") / F.col("_weight")), "mix-sizes")  # texts are read once
    sizes = slim.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(sizes.select(F.col("_source").alias("source"), "source_size"), p).withColumnRenamed("source", "_source")
    plan = plan.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = C.written(plan.withColumn("_part", (F.floor("target") - F.col("_epochs") * F.col("source_size")).cast("long")), "mix-plan")
    rows = sizes.agg(F.max("n")).first()[0] or 0
    slim = bucketed(slim, max(p.least_buckets, rows // p.bucket_rows))
    sums = slim.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"))
    # at most `buckets` rows of a source, sums already
    upto = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(upto), F.lit(0)))
    state = F.when(F.col("_before") + F.col("_words") <= F.col("_part"), "whole").when(F.col("_before") < F.col("_part"), "cut").otherwise("none")
    sums = _join_source(sums, plan, []).withColumn("_state", state).drop("_words")
    sums = C.written(sums, "mix-buckets")
    got = _join_source(slim, sums, ["_bucket"])
    keys = got.where("_state = 'cut'").groupBy("_source", "_part", "_before", "_key").agg(F.sum("_size").alias("_words"))
    running = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_part") - F.col("_before") - F.coalesce(F.sum("_words").over(running), F.lit(0))
    last = keys.withColumn("_room", room).where("_room > 0 AND _room <= _words").select("_source", F.col("_key").alias("_last"), "_room")
    last = C.written(last, "mix-last-keys")  # one row for each source that has a part
    got = _join_source(got, last, [], "left")
    inside = F.when(F.col("_state") == "whole", True).when(F.col("_state") == "none", False).otherwise(F.col("_key") < F.col("_last"))
    tied = (F.col("_state") == "cut") & (F.col("_key") == F.col("_last"))
    plain = got.where(~tied).withColumn("_extra", F.when(inside, F.col("_size")).otherwise(0))
    taken = (F.col("_epochs") * F.col("_size") + F.col("_extra")).cast("long")
    columns = ["doc_id", F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), *(F.col(f"_carry_{c}").alias(c) for c in carry)]
    return plain.select(*columns).unionByName(_within_last_key(got.where(tied)).select(*columns))


def _join_source(rows: DataFrame, few: DataFrame, also: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns that few has for their source (null is a source) and the columns `also`."""
    few = few.withColumnsRenamed({c: f"_few{c}" for c in ["_source", *also]})
    on = F.col("_source").eqNullSafe(F.col("_few_source"))
    for c in also:
        on = on & (F.col(c) == F.col(f"_few{c}"))
    return rows.join(few, on, how).drop("_few_source", *(f"_few{c}" for c in also))
