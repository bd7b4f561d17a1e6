"""The corpus pipeline: every stage against a brute-force version on its own input, their chain, empty and odd tables."""

import os
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import _common as C
from sparkloom.llm import quality_knn
from tests.llm.conftest import CLASHING, edge_rows, words
from tests.llm.test_pair_ops import SCHEMA, brute_classes, brute_repeats, near_copies, water_filled

ITEMS = [(1, words(70, 14)), (2, "short item here"), (3, None), (4, "")]


def all_rows():
    shared = words(71, 60)
    rows = [*edge_rows(), *((4000 + i, *r) for i, *r in near_copies(72, 40))]
    rows += [(3000 + i, f"{words(300 + i, 30)} {shared} {words(400 + i, 30)}", "en", "c", 1) for i in range(6)]
    rows += [(3100, f"{words(310, 25)} {ITEMS[0][1].upper()}, {words(311, 25)}", "en", "b", 1), (3101, f"a Short ITEM here {words(312, 25)}", "en", "b", 1)]
    return rows + [(3200 + i, "#### buy $$$ now " * (5 + i), "en", "a", 1) for i in range(20)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(all_rows(), SCHEMA)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("own"))
    docs.repartition(3).write.parquet(f"{top}/documents.parquet")
    labels = [(i, int(i < 3200), 0) for i, *_ in all_rows() if i is not None and (i % 3 or i >= 3200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def brute_quality(rows, spark, folder):
    docs = C.read_table(spark, folder, "documents")
    model, p = quality_knn.fit(docs, C.read_table(spark, folder, "labels")), quality_knn.Parameters()
    vote = lambda t: quality_knn.vote(quality_knn.term_counts(*C.utf8_view(pa.array([t], pa.string())), p), model, p)[0]
    return [r for r in rows if vote(r[1]) >= 0.3]


def brute_copies(rows):
    """How many rows stay of each (class, has words): one of a class, every distinct text without words of an id."""
    plain = lambda t: not re.search(r"[^\x20\x09-\x0D]", t or "")
    classes = brute_classes([r for r in rows if not plain(r[1])])
    return {c for _, c, _ in classes}, {(r[0], r[1]) for r in rows if plain(r[1])}


def brute_repeats_cut(rows, depth=200):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - depth + 1):
            if seen[d[i : i + depth]] > 1:
                gone[i : i + depth] = [True] * depth
        out.append(bytes(b for b, g in zip(d, gone, strict=True) if not g).decode(errors="ignore"))
    return out


def brute_leak(text):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    for _, item in ITEMS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").lower())
        n = min(len(w), 10)
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        if any(tuple(own[i : i + n]) in windows for i in range(len(own) - n + 1)):
            return True
    return False


def as_rows(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_order_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "leaks", "mix"]


def test_each_stage_and_the_run(spark, folder):
    source = C.read_table(spark, folder, "documents")
    columns, docs, rows = source.columns, source, as_rows(source)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = C.written(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == columns and docs.where(" AND ".join(f"{c} = 'own'" for c in CLASHING)).count() == docs.count()
        got = as_rows(docs)
        if name == "quality":
            assert sorted(got, key=str) == sorted(brute_quality(rows, spark, folder), key=str) and len(got) < len(rows)
        elif name == "near_copies":
            classes, plain = brute_copies(rows)
            assert set(got) <= set(rows)
            has = [r for r in got if re.search(r"[^\x20\x09-\x0D]", r[1] or "")]
            named, lone = {c for c in classes if c is not None}, [r for r in has if r[0] is None]
            assert sorted(r[0] for r in has if r[0] is not None) == sorted(named) and bool(lone) == (None in classes)
            assert {(r[0], r[1]) for r in got if r not in has} == plain and len(got) - len(has) == len(plain)
        elif name == "repeats":
            cut = {(r[0], t, r[2], r[3]) for r, t in zip(rows, brute_repeats_cut(rows), strict=True)}
            assert {(r[0], r[1] or "", r[2], r[3]) for r in got} == cut and len(got) == len(rows)
            assert [b for *_, b in map(tuple, brute_repeats([r[1] for r in rows]))] and all(r[4] == len(r[1]) for r in got if (r[0], r[1]) not in {(x[0], x[1]) for x in rows})
        else:
            assert sorted(got, key=str) == sorted((r for r in rows if not brute_leak(r[1])), key=str) and len(got) < len(rows)
        rows = got
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    sizes, by = {(r[0], r[1]): len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}, defaultdict(int)
    for r in rows:
        by[r[3]] += sizes[r[0], r[1]]
    targets, taken = water_filled(dict(by)), defaultdict(int)
    for r in mixed:
        assert r["size"] == sizes[r.doc_id, r.text] and 0 < r.taken <= 2 * r["size"] and abs(r.target - targets[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(0 <= targets[s] - taken[s] < 1 for s in by if by[s])
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, mixed))


def test_tables_of_finished_stages_are_removed(spark, folder):
    top = C.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(top))
    got = corpus_pipeline.run(spark, folder)
    left = set(os.listdir(top)) - before
    assert got.count() > 0 and len(left) == 1 and next(iter(left)).startswith("stage-mix")


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        C.read_table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = C.read_table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
