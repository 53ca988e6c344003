"""Periodic runs against brute force."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from demandscope.llm.periodic_runs import find_runs, kept_words, periodic_runs, run_digests
from demandscope.llm.queries import QUERIES, planted

SCHEMA = "doc_id long, text string, runs int, start string, n_words string, collapsed int"


def brute_runs(words):
    """Maximal stretches of each period, those with a smaller period left out."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= 4 * q and (i, length) not in seen:
                seen.add((i, length))
                if length >= 6:
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = planted(doc_id, re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, None if not runs else best[1] * 1000 // best[2],
            sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(kept)))


@st.composite
def sequences(draw):
    """Random words with periodic stretches of many lengths, some inside others."""
    out = []
    for _ in range(draw(st.integers(0, 4))):
        unit = draw(st.lists(st.integers(0, draw(st.integers(0, 3))), min_size=1, max_size=draw(st.sampled_from([2, 5, 12, 40]))))
        if draw(st.booleans()):
            unit = unit * draw(st.integers(1, 5)) + draw(st.lists(st.integers(0, 3), max_size=2))
        out += (unit * draw(st.integers(1, 7)))[:draw(st.integers(1, 400))]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(sequences(), max_size=5))
def test_runs_equal_brute_force(batch):
    ids = np.array([x for own in batch for x in own], np.int64)
    assert find_runs(ids, np.array([len(x) for x in batch], np.int64)) == [brute_runs(x) for x in batch]


def test_long_period_and_long_text():
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 50, 30_000)
    ids = np.concatenate([rng.integers(0, 1000, 5_000), np.tile(unit, 5), rng.integers(1000, 2000, 7_000), np.zeros(50_000, np.int64)])
    runs = find_runs(ids, np.array([ids.size]))[0]
    assert [r for r in runs if r[1] > 100] == [(5_000, 150_000, 30_000), (162_000, 50_000, 1)]
    assert kept_words(ids.size, runs).sum() <= 5_000 + 30_000 + 7_000 + 1


def test_query_equals_brute_force(spark, tmp_path):
    words = "a b c d e".split()
    rows = [(i, " ".join(words[(i * k * k + k) % 5] for k in range(i % 90)), 1, "x", "y", 2) for i in range(300)]
    rows += [(400, None, 1, "x", "y", 2), (401, "", 1, "x", "y", 2), (402, " \n\x0b ", 1, "x", "y", 2), (None, "a " * 9, 1, "x", "y", 2),
             (403, "la la la la la la", 1, "x", "y", 2), (403, "la la la la la la", 1, "x", "y", 2), (404, "é\x1cé\n" * 40, 1, "x", "y", 2),
             (405, "b c " * 3000 + "d", 1, "x", "y", 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 6 + ["string"] * 2
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=order) == sorted((brute_row(*r[:2]) for r in rows), key=order)


def test_no_rows_and_own_outputs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert run_digests(periodic_runs(empty)).collect() == []
    one = periodic_runs(spark.createDataFrame([(1, "x  y x y x y\tx y z", 1, "x", "y", 2)], SCHEMA)).first()
    assert (one.n_words, [tuple(r) for r in one.runs], bytes(one.collapsed)) == (9, [(0, 8, 2)], b"x y z")
