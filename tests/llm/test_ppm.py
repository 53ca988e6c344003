"""Partial-matching scores against a trie walked byte by byte."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from demandscope.llm import byte_ppm as ppm
from demandscope.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, chunk int, key string, n int, learn string"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


def body(text):
    return b"\xfe" * ppm.ORDER + b" ".join(tokens(text)) + b"\xff"


def brute(rows, learn):
    follows, single = defaultdict(Counter), Counter()
    for doc_id, text in rows:
        if learn(doc_id):
            single.update([*tokens(text), None])
            b = body(text)
            for i in range(ppm.ORDER, len(b)):
                for k in range(ppm.ORDER + 1):
                    follows[b[i - k:i]][b[i]] += 1
    n, v = sum(single.values()), len(single)
    out = []
    for doc_id, text in rows:
        words, b, score = [*tokens(text), None], body(text), 0.0
        for i in range(ppm.ORDER, len(b)):
            out_of = set()
            for k in range(ppm.ORDER, -1, -1):
                live = {s: c for s, c in follows[b[i - k:i]].items() if s not in out_of}
                if b[i] in live:
                    score += math.log10((live[b[i]] - 0.5) / sum(live.values()))
                    break
                if live:
                    score += math.log10(len(live) / 2 / sum(live.values()))
                    out_of |= live.keys()
            else:
                score -= math.log10(255 - len(out_of))
        base = sum(math.log10((single[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out.append((doc_id, not learn(doc_id), len(words), sum(single[w] > 0 for w in words), n, base, score))
    return out


def same(got, expected):
    order = lambda r: (r[0] is None, r[0] or 0, r[2:])
    got, expected = sorted(map(tuple, got), key=order), sorted(expected, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for a, b in zip(got, expected, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9), a


def sample(n, seed=4):
    rng = random.Random(seed)
    pool = ["The", "the", "a", "ABBA", "été", "naïve", "x" * 40, "中文", "zz-top", "q"]
    rows = [(i, " \t".join(rng.choices(pool[:rng.randint(2, 10)], k=rng.randint(0, 30))) + rng.choice(["", " ", "\n\n"])) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "  \x1c x"), (None, "the end"), (3, "again"), (3, "again"), (n + 4, "é" * 5000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2, "l") for i, t in rows], SCHEMA)


def test_query_equals_brute_force(spark, tmp_path):
    rows = sample(150)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op11_byte_ppm"](spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    same(df.collect(), brute(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1))


def test_many_chunks_and_no_learning_rows(spark):
    rows = sample(60, 5)
    from pyspark.sql import functions as F
    same(ppm.byte_ppm(frame(spark, rows).repartition(3), F.col("doc_id") % 2 == 0, chunk_bytes=500).collect(),
         brute(rows, lambda i: i is not None and i % 2 == 0))
    same(ppm.byte_ppm(frame(spark, rows[:9]), F.lit(False)).collect(), brute(rows[:9], lambda i: False))
    same(ppm.byte_ppm(frame(spark, rows)).collect(), brute(rows, lambda i: True))


def test_no_rows(spark):
    assert ppm.byte_ppm(frame(spark, [])).collect() == []


def test_probabilities_of_all_symbols_sum_to_at_most_one(spark):
    """After any context the model shares out no more than one, and nearly all of it where a symbol was never seen."""
    counts = spark.createDataFrame([(int.from_bytes(w, "big"), n) for w, n in (
        [(bytes([1, 2, 3, 4, 5, s]), 0 if s > 7 else s) for s in range(255) if s != ppm.PAD])], "key long, n long")
    whole = sum(10 ** r.value for r in ppm.window_costs(counts, 5).collect())
    assert 0.98 < whole <= 1 + 1e-9


def test_rendered_and_table():
    texts = ["  A b\t\tC ", "", " ", None, "x", "\n y  z", "é É"]
    data, sizes = ppm.rendered(pa.array(texts))
    assert [data[e - s:e].tobytes() for s, e in zip(sizes, np.cumsum(sizes), strict=True)] == [
        b" ".join(tokens(t)) + b"\xff" for t in texts]
    keys = np.unique(np.random.default_rng(0).integers(-2**62, 2**62, 5000))
    table = ppm.Table(keys, np.arange(keys.size))
    assert (table[keys[::-1]] == np.arange(keys.size)[::-1]).all()
    with pytest.raises(KeyError):
        table[np.array([2**62 + 5])]


def test_a_lean_task_leaves_no_words_cached():
    """A worker keeps its modules, so another operator's cache would stay beside this one's arrays."""
    from demandscope.llm import tokenize
    from demandscope.llm.common import lean

    tokenize._ENCODERS["left behind"] = None
    assert list(lean(lambda batches: (x for x in batches if not tokenize._ENCODERS))([1, 2])) == [1, 2]


def _peak(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_one_long_text_and_a_table_take_little_memory():
    size = 4 << 20
    text = np.random.default_rng(1).integers(0x61, 0x7B, size).astype(np.uint8)
    text[::7], text[-1] = ppm.SPACE, ppm.END
    assert _peak(lambda: [0 for _ in ppm.window_keys(text, np.array([size]), ppm.ORDER)]) < 20 * size
    assert _peak(lambda: ppm.word_keys(text)) < 24 * size
    keys = np.arange(1_000_000) * 7919
    assert _peak(lambda: ppm.Table(keys, keys)) < 20 * keys.size
    assert (ppm.Table(keys, keys)[keys] == keys).all()


def test_rows_for_a_chunk_hold_few_keys():
    chunk, key = np.repeat([3, 1, 3], [200, 5, 100]), np.arange(305)
    batch = pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(key), pa.array(key * 0.5)], names=["chunk", "key", "value"])
    (out,) = ppm._packed(iter([batch]))
    got = [(c, k, v) for c, ks, vs in zip(*out.to_pydict().values()) for k, v in zip(
        np.frombuffer(ks, np.int64).tolist(), np.frombuffer(vs).tolist())]
    assert sorted(got) == sorted(zip(chunk.tolist(), key.tolist(), (key * 0.5).tolist()))
    assert max(len(k) for k in out.to_pydict()["keys"]) <= 8 * 64
