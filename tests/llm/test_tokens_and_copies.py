"""Exact dedup, packing and the wavelet output against brute force, with empty, null, long and repeated rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as driver
from demandscope.llm import exact_dedup as ed
from demandscope.llm.packing import cut, pack
from demandscope.llm.tokenize import WordEncoder, resolve
from demandscope.llm.wavelet import WaveletMatrix, read_shard, token_documents, write_shard, write_tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, keep_id string, bucket int"
ODD = [
    (1, "a b c"), (2, "a b c"), (9, "a b c"), (3, None), (4, ""), (5, "Straße l'été don't 12 345 ,, x́y"),
    (6, "two  spaces\tand\n\nlines \n end "), (7, " lead"), (8, "x" * 5000), (10, "word " * 3000), (11, "a b c "),
    (12, "<|endoftext|> in text"), (13, "naïve ＡＢＣ ١٢ 東京 \x1c z q"), (14, "a b c"), (14, "a b c"), (None, "null id"),
    (None, "a b c"), (15, "Aa.\nBb, CC!!\nÉcole ÀÇ| o'er"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "k", 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def encoders():
    return {n: WordEncoder(resolve(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def direct(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("capacity", [1, 2, 1024])
def test_exact_dedup(spark, capacity):
    groups = defaultdict(list)
    for i, t in ODD:
        groups[t or ""].append(i)
    want = sorted(((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD), key=repr)
    got = ed.exact_dedup(frame(spark, ODD).repartition(3), capacity)
    rows = got.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr) == want
    assert all(r.kept == (r.doc_id == r.keep_id or r.keep_id is None) for r in rows)
    assert ed.exact_dedup(frame(spark, ODD).limit(0)).count() == 0


def test_index_chains_keys_that_collide(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ed.F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    index = ed.write_index(frame(spark, ODD), str(tmp_path / "index"))
    rows = index.collect()
    assert len(rows) == len({t or "" for _, t in ODD}) == len({r.chain for r in rows})
    assert sum(r.group_size for r in rows) == len(ODD)


@given(st.lists(st.integers(0, 40), min_size=16, max_size=16), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_directory_splits_only_overfull_buckets(counts, capacity):
    depth, local = ed.build_directory(np.array(counts), capacity)
    slots = np.arange(16) >> (4 - depth)
    buckets = ed.bucket_of(np.arange(16, dtype=np.uint64) << np.uint64(60), depth, local)
    for b in np.unique(buckets):
        own = np.flatnonzero(buckets == b)
        at = local[slots[own[0]]]
        assert (np.diff(own) == 1).all() and own.size == 1 << (4 - at)
        n = np.array(counts)[own].sum()
        assert n <= capacity or at == 4
        if at:  # its parent was overfull
            parent = np.arange(16) >> (4 - at + 1) == own[0] >> (4 - at + 1)
            assert np.array(counts)[parent].sum() > capacity


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_are_the_tokenizers(spark, encoders, name):
    e = encoders[name]
    texts = [t or "" for _, t in ODD] + [r.text for r in spark.read.parquet(f"{driver.SMOKE_DIR}/documents.parquet").collect()]
    for t in texts:
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == direct(e, t), t[:80]


@given(st.text(alphabet="aB .,'\n\t é1ſİǅßΣ́-", max_size=25))
@settings(max_examples=300, deadline=None)
def test_cached_ids_on_odd_text(encoders, text):
    for e in encoders.values():
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == direct(e, text)


def test_pack(spark, encoders):
    docs = frame(spark, ODD).repartition(3)
    got = pack(docs, window=8, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and crc(ids) == r.ids_crc32
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, ids, r.doc_tokens))
    want = defaultdict(list)
    for i, t in ODD:
        want[i] += direct(encoders["byte_bpe_50k.json"], t) + [0]
    for i, pieces in by_doc.items():
        if i not in (None, 14):
            assert sum((p[1] for p in sorted(pieces)), []) == want[i] and {p[2] for p in pieces} == {len(want[i])}
    total = sum(map(len, want.values()))
    assert sorted(by_sequence) == list(range(-(-total // 8)))
    for s, pieces in by_sequence.items():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == (8 if (s + 1) * 8 <= total else total % 8)
    assert pack(frame(spark, ODD).limit(0)).count() == 0


def test_pack_follows_the_given_order(spark, tmp_path):
    frame(spark, [(i, f"text {i}") for i in range(40)]).repartitionByRange(4, "doc_id").sortWithinPartitions(
        F.desc("doc_id")).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = pack(docs, window=1 << 20, place=(F.col("_metadata.file_name"), F.col("_metadata.row_index"))).collect()
    order = [r.doc_id for r in sorted(got, key=lambda r: r.offset)]
    files = docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index")
    assert order == [r.doc_id for r in files.collect()]


@given(st.integers(0, 50), st.integers(0, 60), st.integers(1, 9))
def test_cut(start, n, window):
    pieces = cut(start, n, window)
    assert sum(p[1] for p in pieces) == n and all(0 < p[1] <= window - p[3] for p in pieces)


@given(st.lists(st.integers(0, 500), max_size=1500))
@settings(max_examples=30, deadline=None)
def test_wavelet_matrix(ids):
    lengths = np.array([len(ids)], dtype=np.int64)
    back, w = read_shard(write_shard(np.array(ids, np.uint16), lengths, 9))
    assert back.tolist() == [len(ids)] and w.decode().tolist() == ids
    for t in {*ids[:5], 3, 511, 900}:
        places = [i for i, x in enumerate(ids) if x == t]
        assert w.count(t) == len(places)
        assert [w.select(t, k) for k in range(len(places))] == places and w.select(t, len(places)) == -1
    for i in range(0, len(ids), 97):
        assert w.access(i) == ids[i]
        assert w.rank(ids[0], i) == ids[:i].count(ids[0])


def test_token_documents(spark, encoders, tmp_path):
    want, at = [], 0
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = direct(encoders["word_bpe_49k.json"], t) + [2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    got = token_documents(frame(spark, ODD).repartition(4))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert token_documents(frame(spark, ODD).limit(0)).count() == 0
    small = write_tokens(frame(spark, ODD), str(tmp_path / "w"), shard_tokens=50).collect()
    assert len(small) > 2 and sum(r.n_tokens for r in small) == at
