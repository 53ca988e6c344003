"""Quality rules against brute force, and the classifier's held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as driver
from demandscope.llm import quality_classifier as qc
from demandscope.llm import quality_rules as qr
from demandscope.llm.words import slices, words
from demandscope.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, llr string, row int, quality int"
SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "k", 3, 1) for i, t in rows], SCHEMA)


def brute(text):
    found = [m.span() for m in re.finditer("[^\x20\x09-\x0D]+", text)]
    own = [text[a:b] for a, b in found]
    seen = Counter(zip(own, own[1:], own[2:]))
    covered = {j for i, w in enumerate(zip(own, own[1:], own[2:])) if seen[w] > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@given(st.lists(st.text(alphabet="ab #|\n\té \x0b語", max_size=40), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_base_counts(texts):
    got = qr.base_counts(pa.array(texts))
    assert list(zip(*(got[c].tolist() for c in qr.COLUMNS), strict=True)) == [brute(t) for t in texts]


@given(st.lists(st.text(alphabet="ab c\né", max_size=12), min_size=1, max_size=8), st.integers(1, 20))
def test_slices_and_word_hashes(texts, limit):
    batch = pa.record_batch([pa.array(texts)], names=["t"])
    assert [t for part in slices(batch, 0, limit) for t in part.column(0).to_pylist()] == texts
    w = words(batch.column(0))
    own = [w.data[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)]
    assert len(set(own)) == len(set(w.hash.tolist())) == len(set(zip(own, w.hash.tolist(), strict=True)))


def test_rules_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        assert tuple(got[i][c] for c in qr.COLUMNS) == brute(text)
        n, _, _, _, repeated = brute(text)
        assert got[i].base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert got[i].kept == (not got[i].base_failed and got[i].llr >= qr.THRESHOLD)
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if not got[r.doc_id].base_failed]
    good, bad = ([got[r.doc_id].kept for r in labels if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_ratio_is_the_sum_over_grams(spark):
    rows = [(1, "a b " * 40), (2, "a c " * 40), (3, "z z " * 40), (4, None), (5, ""), (5, ""), (None, "a b")]
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (9, 1, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in qr.quality_rules(frame(spark, rows), labels, prior=1.0).collect()}
    raw, target = Counter(), Counter()
    grams = {i: [(w,) for w in (t or "").split()] + list(zip((t or "").split(), (t or "").split()[1:])) for i, t in rows}
    for i, t in rows:
        raw.update(grams[i])
        if i == 1:
            target.update(grams[i])
    share = sum(target.values()) / sum(raw.values())
    for i in (1, 2, 3, None):
        want = np.mean([np.log((target[g] + 1) / (raw[g] * share + 1)) for g in grams[i]])
        assert got[i].llr == pytest.approx(want)
    assert got[4].llr == 0 and got[4].base_failed and not got[4].kept and got[5].n_words == 0
    none = qr.quality_rules(frame(spark, rows), labels.limit(0)).collect()
    assert len(none) == len(rows) and {r.llr for r in none} == {0.0}
    assert qr.quality_rules(frame(spark, rows).limit(0), labels).count() == 0


def test_every_trusted_document_is_counted(spark):
    n = 20_100
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    raw, target = qr.gram_counts(spark.range(n + 50).selectExpr("id AS doc_id", "'a b' AS text"), qr.trusted_ids(labels))
    assert raw.sum() == 3 * (n + 50) and target.sum() == 3 * n


def test_ratios_do_not_move_with_size():
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 400, 1 << qr.BITS)
    target = rng.binomial(raw, 0.4)
    assert target.sum() > 2_750_000
    assert np.allclose(qr.log_ratios(raw, target), qr.log_ratios(1000 * raw, 1000 * target))
    few = target // 100  # the least prior holds below
    assert np.allclose(qr.log_ratios(raw, few), qr.log_ratios(raw, few, qr.PRIOR))


def test_classifier_on_the_held_out_fold(spark):
    got = {r.doc_id: r for r in QUERIES["op4_quality_classifier"](spark, "/root/testdata/sf0.1").collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id].score, r.quality) for r in labels if got[r.doc_id].held_out]
    score, y = map(np.array, zip(*held, strict=True))
    assert np.mean((score >= 0.3) == y) > 0.95
    good, bad = score[y == 1], score[y == 0]
    assert np.mean(good[:, None] > bad[None, :]) > 0.97
    for low, high in ((0.0, 0.5), (0.9, 1.01)):  # calibrated: the mean score of a band is near its share of good texts
        band = (score >= low) & (score < high)
        assert abs(score[band].mean() - y[band].mean()) < 0.15


def test_classifier_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "x" * 200_000), (3, "x" * 200_000), (None, "null id"), (4, "a b c")]
    labels = spark.read.parquet(f"{driver.SMOKE_DIR}/labels.parquet")
    got = qc.quality_scores(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert {r.score for r in qc.quality_scores(frame(spark, rows), labels.limit(0)).collect()} == {0.5}
    assert qc.quality_scores(frame(spark, rows).limit(0), labels).count() == 0


def test_class_signal_of_a_long_text_is_that_of_its_blocks(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    own = {q: [texts[r.doc_id] for r in labels if r.quality == q] for q in (0, 1)}
    good, bad = (qc.dictionary(own[q][::2]) for q in (1, 0))
    long = b"\n".join(own[1][1::2])
    assert len(long) > 20 * qc.BLOCK
    blocks = [long[i:i + qc.BLOCK] for i in range(0, len(long), qc.BLOCK)]
    saved = qc.features(blocks, good, bad)[:, 0] @ [len(b) for b in blocks] / len(long)
    assert saved > 0 and qc.features([long], good, bad)[0, 0] == pytest.approx(saved)


def test_long_labelled_texts_are_learned_from(spark):
    rng = np.random.default_rng(3)
    write = lambda lot: " ".join(f"{lot}{n}" for n in rng.integers(0, 500, 16_000))
    rows = [(i, write("good" if i % 2 else "bad")) for i in range(40)]
    assert min(len(t) for _, t in rows) > qc.LONGEST
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in qc.quality_scores(frame(spark, rows), labels).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if not i % 2)
