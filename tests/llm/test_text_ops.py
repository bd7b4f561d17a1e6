"""Toxicity, quality, quality rules and token counts."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import quality_knn, quality_rules, token_counts, toxicity
from sparkloom.llm._common import read_table
from tests.llm.conftest import SCHEMA, edge_rows, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


def by_text(rows, *columns):
    """The values that rows of each doc_id have."""
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).add(tuple(r[c] for c in columns))
    return out


def fold(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = read_table(spark, sf, "labels")
    got = toxicity.toxicity(read_table(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    hit = Counter((r.toxic, r.predicted) for r in got)
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) > 0.85 and hit[0, 1] <= 0.006 * hit[0, 0]


def test_toxicity_edges(edge_docs, no_docs, labels, spark):
    got = toxicity.toxicity(edge_docs, labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({s for (s,) in by_text(got, "score")[2]}) == 1
    assert toxicity.toxicity(no_docs, labels).count() == 0
    none = toxicity.toxicity(edge_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and {r.predicted for r in none} == {0}


def test_nnpu_keeps_its_risk_from_going_below_zero():
    x = np.eye(4, dtype=np.float32)[[0] * 30 + [1] * 200 + [0] * 20]
    positive = np.array([True] * 30 + [False] * 220)
    w, b = toxicity.nnpu(x, positive, 20 / 220, toxicity.Parameters())
    score = 1 / (1 + np.exp(-(x @ w + b)))
    assert score[positive].min() > 0.7 and score[40] < 0.2


def test_word_bins_split_texts_and_letters():
    data = np.frombuffer("Idiot idiot,scum".encode() + b"scum", np.uint8)
    text, bins = toxicity.word_bins(data, np.array([0, 16, 16, 20]), 1 << 20)
    # two words, one of them again, in the first text; of the second none; the third is the first's last word
    assert text.tolist() == [0, 0, 0, 2] and bins[3] in bins[:3]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = read_table(spark, sf, "labels")
    got = quality_knn.quality(read_table(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.quality == r.predicted for r in got]) > 0.97


def test_quality_edges(edge_docs, no_docs, labels):
    got = quality_knn.quality(edge_docs, labels).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality_knn.quality(no_docs, labels).count() == 0
    assert {r.score for r in quality_knn.quality(edge_docs, labels.limit(0)).collect()} == {1.0}
    kept = quality_knn.keep_quality(edge_docs, labels.limit(0))
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows()) and kept.where("_score = 'own'").count() == len(edge_rows())


def test_vote_is_exact():
    draw = np.random.default_rng(1)
    p = quality_knn.Parameters(neighbours=5, rank=6, block=7)
    terms = draw.random((40, quality_knn.n_terms(p))).astype(np.float32)
    model = quality_knn.train(terms[:30], np.arange(30) % 2, p)
    got = quality_knn.vote(terms, model, p)
    v = quality_knn.unit((terms * model.idf) @ model.basis)
    for i in range(40):
        sims = v[i] @ model.vectors.T
        near = np.argsort(-sims)[:5]
        w = np.clip(sims[near].astype(float), 0, 1) ** p.sharpness
        assert abs(got[i] - (w * model.labels[near]).sum() / w.sum()) < 1e-5


def test_nearest_takes_the_first_of_equals():
    draw = np.random.default_rng(0)
    sims = draw.integers(-3, 4, (50, 400)).astype(np.float32) / 3
    for row, got in zip(sims, quality_knn.nearest(sims, 7), strict=True):
        assert sorted(got) == sorted(np.lexsort((np.arange(400), -row))[:7])


def test_trees_equal_a_walk_from_node_to_node():
    """The flattened arrays give each row what following its splits one by one gives."""
    draw = np.random.default_rng(5)
    x = draw.random((500, len(quality_rules.STATISTICS))).round(2)
    y = (x[:, 1] + x[:, 6] * x[:, 9] + 0.2 * draw.random(500) > 0.9).astype(float)
    trees = quality_rules.train(x, y, quality_rules.Parameters(trees=12))
    for row, score in zip(x[:80], trees.score(x[:80]), strict=True):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12
    assert len(trees.roots) == 12 and np.mean((trees.score(x) > 0.5) == y) > 0.85


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


@pytest.mark.parametrize("seed", range(40))
def test_statistics_equal_brute_force(seed):
    draw = random.Random(seed)
    text = "".join(draw.choice(["a ", "b ", "c d ", "\n", "e\x1cf ", "#", " "]) for _ in range(draw.randrange(200)))
    assert tuple(int(x) for x in quality_rules.statistics(text)[:5]) == brute_statistics(text)


def test_quality_rules(spark, edge_docs, no_docs, labels):
    sf = "/root/testdata/sf0.01"
    truth = read_table(spark, sf, "labels")
    docs = read_table(spark, sf, "documents")
    got = quality_rules.quality_rules(docs, truth)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got.collect():
        stats = brute_statistics(texts[r.doc_id])
        assert tuple(r)[1:6] == stats and r.base_failed == (stats[0] < 20 or 100 * stats[4] > 30 * stats[0]) and not (r.base_failed and r.kept)
    share = {(r.quality, r.kept): r["count"] for r in got.join(truth, "doc_id").groupBy("quality", "kept").count().collect()}
    assert share.get((0, True), 0) <= 3 and share[1, False] <= 12
    edge = quality_rules.quality_rules(edge_docs, labels).collect()
    assert sorted(tuple(r)[1:6] for r in edge) == sorted(brute_statistics(x[1]) for x in edge_rows())
    assert quality_rules.quality_rules(no_docs, labels).count() == 0
    assert all(r.kept != r.base_failed for r in quality_rules.quality_rules(edge_docs, labels.limit(0)).collect())


def test_trees_fall_where_they_must():
    draw = np.random.default_rng(0)
    x = draw.random((3000, len(quality_rules.STATISTICS)))
    at = quality_rules.STATISTICS.index("symbol_share")
    y = ((x[:, at] < 0.4) ^ (draw.random(3000) < 0.2) ^ (x[:, at] > 0.9)).astype(float)  # the last part rises again
    trees = quality_rules.train(x, y, quality_rules.Parameters())
    probe = np.repeat(x[:20], 200, axis=0)
    probe[:, at] = np.tile(np.linspace(0, 1, 200), 20)
    scores = trees.score(probe).reshape(20, 200)
    assert (np.diff(scores, axis=1) <= 1e-12).all() and scores[:, 0].mean() > 0.7 > 0.4 > scores[:, -1].mean()
    assert quality_rules.train(x, np.ones(3000), quality_rules.Parameters()) is None


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


PARTS = ["a", "the", " the", " ", "  ", "\n", "'re", "'r", "'", "'ll", "don't", "123", "é", "ß", "日本", "!", "...", "\t", "\x1c", "\x85", "\xa0", " ", "<|endoftext|>", "<|end", "|>", "́", "Ⅷ", "²", "\U0001f600", "ing", "\r\n", "​", "՘", "Ᲊ"]


@pytest.mark.parametrize("seed", range(80))
def test_every_prefix_equals_the_library(seed, counter, library):
    draw = random.Random(seed)
    text = "".join(draw.choice(PARTS) for _ in range(draw.randrange(16)))
    expected = [library(text[:i]) for i in range(len(text) + 1)]
    assert counter.prefixes(text).tolist() == expected and counter.total(text) == expected[-1]
    most = draw.randrange(12)
    assert counter.truncate(text, most) == text[: max(i for i, n in enumerate(expected) if n <= most)]


def test_token_counts(spark, edge_docs, no_docs, library):
    got = token_counts.token_counts(edge_docs, PATH).collect()
    expected = sorted(((r[1] or "").encode().__len__(), library(r[1] or "")) for r in edge_rows())
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == expected and all(r.over_limit == (r.n_tokens > 1024) for r in got)
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == library(texts[r.doc_id]) for r in token_counts.token_counts(docs, PATH).collect())
    ends = token_counts.with_prefix_counts(docs.limit(5), PATH).collect()
    assert all(r.piece_ends[-1] == len(texts[r.doc_id]) and r.piece_tokens[-1] == library(texts[r.doc_id]) for r in ends)
    for r in token_counts.within_budget(token_counts.with_prefix_counts(docs, PATH), 50).collect():
        assert r.n_tokens <= 50 and library(texts[r.doc_id][: r.n_chars]) == r.n_tokens
        assert r.n_chars == len(texts[r.doc_id]) or library(texts[r.doc_id][: r.n_chars + 40]) > 40
    assert all(library(r.text) <= 50 for r in token_counts.truncated(docs.limit(5), PATH, 50).collect())
    assert token_counts.token_counts(no_docs, PATH).count() == 0
    assert edge_docs.select(F.col("doc_id")).count() == len(got)


@pytest.mark.parametrize("module", [toxicity, quality_rules, quality_knn])
def test_repeated_labelled_id_is_fitted_once(spark, monkeypatch, module):
    """A doc_id with many rows brings one row to the driver, and doesn't crowd others out of the sample."""
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 15 not in (0, 1, 4, 5, 7, 10, 13)]  # in no fold that is held out
    rows = [(i, words(i, 30), "en", "a", 1) for i in ids] + [(ids[0], words(1000 + i % 50, 30), "en", "a", 1) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    seen, train = [], module.train
    monkeypatch.setattr(module, "train", lambda found, *rest: seen.append(len(found)) or train(found, *rest))
    module.fit(spark.createDataFrame(rows, SCHEMA), labels)
    # toxicity has an id of label 1 among the unlabelled too
    assert seen == [len(ids) + (sum(i % 2 for i in ids) if module is toxicity else 0)]
