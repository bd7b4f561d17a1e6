"""URL filters: host and path rules, then a ratio of character language models. DataFrame functions only.

URLs that a rule decides are the examples: allowed ones train the model of accepted URLs, blocked ones that of
rejected URLs. Both are variable-order Markov models over an alphabet of 40 character classes with Witten-Bell
smoothing: P_k(c | h) = (n(hc) + t(h) P_{k-1}(c | h')) / (n(h) + t(h)), h' without its first character, t(h) the
number of different successors. For each n-gram that either class has, the difference of the two models' log
probabilities is kept, and for each context that of ln(t(h) / (n(h) + t(h))), which an unseen successor owes.
A character's part of the score is the difference for the longest n-gram known, plus the escapes of all longer
contexts known, in whole millionths, so that sums are exact. A URL's score is their sum, divided by its length. The threshold is the cut with the highest mean of both
classes' hit rates on held-out examples: one in `folds`, by a hash of the URL, which the models don't learn from.

Scale: counts are grouped before the shuffle, and every n-gram has a row of its own: the orders' tables grow with
the input. Only tables of at most `slots` possible rows (n-grams of up to three characters) are sent to every task;
the others are joined by shuffles, in which a key has at most 40 rows. Scoring looks up each different n-gram of the
URLs once; the positions then get their n-gram's value by a shuffled join, except the n-grams that make up more than
1 / `often` of all positions: these are fewer than `often`, would be hot keys, and are sent to every task. Sums are
joined back by a row number, so a frequent URL is no hot key.

The model reads the whole URL, scheme, query and fragment included; host and path are for the rules alone.

Edges: a null URL, or one without "://", has empty host and path, which no rule fits unless it is empty too; a null or
empty URL scores 0 and is judged by that like others; a score at the threshold is allowed; without examples of both kinds every undecided URL is allowed; where one kind is missing
among those held out, or among the others, all examples are both learnt from and calibrated on; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import _common as C

#: (host, path, verdict). The rules of the registered query.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Character classes 1 to 38; 0 stands before the first character, 39 for all others.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./"
BASE = 40
MILLION = 1_000_000


@dataclass(frozen=True)
class Parameters:
    rules: tuple[tuple[str, str, str], ...] = RULES
    order: int = 4  # characters of context
    slots: int = 65_521  # tables of at most so many possible rows are sent to every task
    often: int = 1000  # n-grams of more than 1 / often of the positions are looked up by a broadcast
    folds: int = 5  # one in so many examples is kept for the threshold
    levels: int = 2000  # steps of the score between which the threshold is sought


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (host and path together; of equals the first); null where none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _positions(rows: DataFrame, p: Parameters) -> DataFrame:
    """A row for each character of `text`: the codes c0 (its own), c1 (the one before) .. of it and its context."""
    chars = F.array(*map(F.lit, ALPHABET))
    text = F.lower("text")
    rows = rows.withColumn("_codes", F.transform(F.split(text, ""), lambda c: F.when(F.array_position(chars, c) > 0, F.array_position(chars, c)).otherwise(F.lit(39)).cast("long")))
    rows = rows.withColumn("_codes", F.concat(F.array_repeat(F.lit(0).cast("long"), p.order), F.when(F.length(text) > 0, F.col("_codes")).otherwise(F.array().cast("array<bigint>"))))
    grams = F.transform(F.sequence(F.lit(p.order + 1), F.size("_codes")), lambda i: F.aggregate(F.slice("_codes", i - p.order, p.order + 1), F.lit(0).cast("long"), lambda a, c: a * BASE + c))
    grams = F.when(F.size("_codes") > p.order, grams).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("_gram", F.explode(grams)).drop("_codes", "text")


def _gram(k: int) -> Column:
    """The last k + 1 characters of a position as one number."""
    return F.col("_gram") % BASE ** (k + 1)


def _context(gram: Column) -> Column:
    """An n-gram without its last character."""
    return F.floor(gram / BASE)


def _sent(table: DataFrame, possible: int, p: Parameters) -> DataFrame:
    """table, to be sent to every task if `possible`, the most rows that it can have whatever the input, are few."""
    return F.broadcast(table) if possible <= p.slots else table


def train(examples: DataFrame, p: Parameters = Parameters()) -> list[tuple[DataFrame, DataFrame]]:
    """For each order k, the differences of log probabilities: (gram_k, diff_k) of its n-grams and (context_k, escape_k)
    of an unseen successor of its contexts. examples: text, accepted."""
    counted = _positions(examples.select("text", "accepted"), p).groupBy("_gram").agg(F.sum(F.col("accepted").cast("long")).alias("n1"), F.sum((~F.col("accepted")).cast("long")).alias("n0"))
    counted = C.written(counted, "url-grams")
    tables: list[tuple[DataFrame, DataFrame]] = []
    for k in range(p.order + 1):
        rows = counted.groupBy(_gram(k).alias(f"gram_{k}")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        rows = rows.withColumn("context", _context(F.col(f"gram_{k}"))).withColumn("lower", F.col(f"gram_{k}") % BASE**k)
        sums = rows.groupBy("context").agg(*(f(c).alias(a) for c in ("n1", "n0") for f, a in ((F.sum, f"all_{c}"), (lambda x: F.sum((F.col(x) > 0).cast("long")), f"kinds_{c}"))))
        rows = rows.join(_sent(sums, BASE**k, p), "context")
        if k:
            lower = tables[-1][0].select(F.col(f"gram_{k - 1}").alias("lower"), F.col("p1").alias("lower_p1"), F.col("p0").alias("lower_p0"))
            rows = rows.join(_sent(lower, BASE**k, p), "lower")
        escape = lambda c: F.ln(F.greatest(F.col(f"kinds_{c}"), F.lit(1)) / (F.col(f"all_{c}") + F.greatest(F.col(f"kinds_{c}"), F.lit(1))))
        escapes = C.written(sums.select(F.col("context").alias(f"context_{k}"), (escape("n1") - escape("n0")).alias(f"escape_{k}")), f"url-escapes-{k}")
        for c in ("n1", "n0"):
            own = F.col(f"lower_p{c[1]}") if k else F.lit(1.0 / BASE)
            kinds = F.greatest(F.col(f"kinds_{c}"), F.lit(1))
            rows = rows.withColumn(f"p{c[1]}", (F.col(c) + kinds * own) / (F.col(f"all_{c}") + kinds))
        tables.append((C.written(rows.select(f"gram_{k}", (F.ln("p1") - F.ln("p0")).alias(f"diff_{k}"), "p1", "p0"), f"url-order-{k}"), escapes))
    return [(t.drop("p1", "p0"), escapes) for t, escapes in tables]


def _values(grams: DataFrame, tables: list[tuple[DataFrame, DataFrame]], p: Parameters) -> DataFrame:
    """grams (_gram, each once, and other columns) with value: its last character's part of the score, in millionths."""
    keep, value = grams.columns, F.lit(0.0)
    for k, (table, escapes) in enumerate(tables):
        grams = grams.withColumn(f"gram_{k}", _gram(k)).join(_sent(table, BASE ** (k + 1), p), f"gram_{k}", "left")
        grams = grams.withColumn(f"context_{k}", _context(_gram(k))).join(_sent(escapes, BASE**k, p), f"context_{k}", "left")
        value = F.coalesce(F.col(f"diff_{k}"), F.coalesce(F.col(f"escape_{k}"), F.lit(0.0)) + value)
    return grams.select(*keep, F.round(MILLION * value).cast("long").alias("value"))


def score(rows: DataFrame, tables: list[tuple[DataFrame, DataFrame]], p: Parameters = Parameters()) -> DataFrame:
    """rows (text, and columns to keep) with score: millionths for each character, rounded down; 0 for an empty text."""
    keep = [c for c in rows.columns if c != "text"]
    rows = C.written(rows.withColumn("_row", F.monotonically_increasing_id()), "url-rows")
    at = _positions(rows.select("_row", "text"), p)
    values = C.written(_values(at.groupBy("_gram").agg(F.count("*").alias("_n")), tables, p), "url-values")
    most = (values.agg(F.sum("_n")).first()[0] or 0) / p.often
    # fewer than p.often rows
    at = at.join(F.broadcast(values.where(F.col("_n") > most).select("_gram", "value")), "_gram", "left")
    rest = at.where("value IS NULL").select("_row", "_gram").join(values.where(F.col("_n") <= most), "_gram")
    parts = at.where("value IS NOT NULL").select("_row", "value").unionByName(rest.select("_row", "value"))
    totals = parts.groupBy("_row").agg(F.sum("value").alias("_total"))
    each = F.coalesce(F.col("_total"), F.lit(0)) / F.greatest(F.length(F.lower("text")), F.lit(1))
    return rows.join(totals, "_row", "left").select(*keep, F.floor(each).cast("long").alias("score"))


def calibrate(scored: DataFrame, p: Parameters = Parameters()) -> int:
    """The threshold, in millionths, with the best mean of both classes' hit rates; scored: accepted, score."""
    step = 20 * MILLION // p.levels
    level = F.greatest(F.lit(-p.levels), F.least(F.lit(p.levels), F.floor(F.col("score") / step)))
    rows = scored.groupBy(level.alias("level")).agg(F.sum(F.col("accepted").cast("long")).alias("n1"), F.sum((~F.col("accepted")).cast("long")).alias("n0"))
    below = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 levels + 1 rows
    everything = Window.partitionBy()
    rows = rows.withColumn("hits", (1 - F.coalesce(F.sum("n1").over(below), F.lit(0)) / F.sum("n1").over(everything)) + F.coalesce(F.sum("n0").over(below), F.lit(0)) / F.sum("n0").over(everything))
    best = rows.orderBy(F.desc("hits"), "level").first()
    return int(best["level"]) * step if best and best["hits"] is not None else -(1 << 62)


def held_out(text: str, p: Parameters) -> Column:
    """Whether an example is kept for the threshold."""
    return F.pmod(F.xxhash64(text), F.lit(p.folds)) == 0


def filter_urls(pages: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page; score is null where a rule decided."""
    host, path = split_url(F.col("url").cast("string"))
    # the text that the model reads is the whole URL
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce(F.lower(F.col("url").cast("string")), F.lit("")).alias("text"))
    name, verdict = matched(F.col("host"), F.col("path"), p.rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), "text")
    ruled = rows.where("ruled IS NOT NULL").select("text", (F.col("ruled") == "allow").alias("accepted"), held_out("text", p).alias("held"))
    kinds = {(r["accepted"], r["held"]) for r in ruled.select("accepted", "held").distinct().collect()}  # four at most
    if len({accepted for accepted, _ in kinds}) < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("long").alias("score"))
    apart = len(kinds) == 4
    tables = train(ruled.where("NOT held") if apart else ruled, p)
    scored = C.written(score(rows.withColumn("held", held_out("text", p)), tables, p), "url-scores")
    threshold = calibrate(scored.where("ruled IS NOT NULL AND held" if apart else "ruled IS NOT NULL").select((F.col("ruled") == "allow").alias("accepted"), "score"), p)
    open_verdict = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", open_verdict).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score"))
